"""Every corpus operator against a plain model, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import common, fingerprints, jaccard_join, licenses, neighbours, packing, quality, repeats, sentencepieces, suffix_array, suffix_trees, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, _doc string, bin string, component_id string, _row int"


def sha(b):
    return hashlib.sha256(b).hexdigest()


def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    shared = prose(80)
    texts = [None, "", " \t\n ", "one", "a b c d", prose(34), prose(35), "日本語の文章" * 40, "x" * 5000]
    base = [prose(200) for _ in range(6)]
    for t in base:
        words = t.split()
        texts += [t, t, t.upper() if len(texts) % 2 else t]
        for n in (1, 3, 10, 25):
            own = list(words)
            for _ in range(n):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    texts += [prose(30) + "\n" + shared + "  " + prose(rng.randint(5, 60)) for _ in range(12)]
    texts += [shared[:150] + " " + prose(50), "ab " * 300, "the same line\n" * 60, prose(20_000)]
    texts.append(texts[-1][:60_000] + prose(10))
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, texts[10]), (None, "under the mit license"), (7, "a text of its own " * 12), (7, "another text " * 20)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, "x", None, "b", "c", 1) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# substring dedup


def model_words(rows, window):
    places = defaultdict(set)
    split = [(t or "").encode().split() for _, t in rows]
    for (i, _), w in zip(rows, split):
        for p in range(len(w) - window + 1):
            places[tuple(w[p : p + window])].add((i, p))
    out = Counter()
    for (i, _), w in zip(rows, split):
        cover = [False] * len(w)
        for p in range(len(w) - window + 1):
            if len(places[tuple(w[p : p + window])]) > 1:
                cover[p : p + window] = [True] * window
        kept = [x for x, c in zip(w, cover) if not c]
        out[i, len(w), len(w) - len(kept), sha(b" ".join(kept))] += 1
    return out


def model_bytes(rows, window):
    first = {}
    key = lambda i: -(2**63) if i is None else i
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - window + 1):
            x = b[p : p + window]
            first[x] = min(first.get(x, (key(i), p)), (key(i), p))
    out = Counter()
    for i, b in data:
        cover = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - window + 1):
            if first[b[p : p + window]] < (key(i), p):
                cover[p : p + window] = True
        spans = int((cover[:-1] & ~np.concatenate([[False], cover[:-2]])).sum()) if len(b) else 0
        out[i, len(b), int(cover.sum()), spans, sha(bytes(x for x, c in zip(b, cover) if not c))] += 1
    return out


@pytest.mark.parametrize("window,gram", [(35, 6), (5, 2), (3, 3)])
def test_word_repeats(docs, rows, window, gram):
    assert got(suffix_trees.repeat_digests(docs, window, gram), "doc_id", "n_words", "n_removed", "kept_sha256") == model_words(rows, window)


@pytest.mark.parametrize("window,gram", [(100, 20), (12, 5)])
def test_byte_repeats(docs, rows, window, gram):
    assert got(suffix_array.repeat_digests(docs, window, gram), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == model_bytes(rows, window)


@pytest.mark.parametrize("hot,step", [(1, 3), (3, 2), (2, 1)])
def test_frequent_runs_take_longer_cores(docs, rows, monkeypatch, hot, step):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "STEP", step)
    monkeypatch.setattr(repeats, "GROUP", 50)
    assert got(suffix_trees.repeat_digests(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == model_words(rows, 35)
    assert got(suffix_array.repeat_digests(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == model_bytes(rows, 100)


def test_radix_passes_against_a_plain_count(monkeypatch):
    rng = random.Random(7)
    spans = [sorted((rng.randint(0, 6), rng.randint(0, 6))) for _ in range(300)]
    eo, so = np.array([a for a, _ in spans]), np.array([b for _, b in spans])
    for window in (9, 4, 20):
        kind = suffix_array.kind(window, 3)
        contexts = [bytes(rng.choice(b"xy") for _ in range(b - a + window)) for a, b in spans]
        places = defaultdict(list)
        for i, c in enumerate(contexts):
            for off in range(so[i] - eo[i] + 1):
                places[so[i] - off, c[off : off + window]].append((i, off))
        want = sorted(sorted(x) for x in places.values() if len(x) > 1)
        for most in (1_000_000, 50, 1):
            monkeypatch.setattr(suffix_array, "WINDOWS", most)
            which, off, node = suffix_array.equal_windows(kind, so, eo, contexts)
            groups = defaultdict(list)
            for w, o, g in zip(which.tolist(), off.tolist(), node.tolist()):
                groups[g].append((w, o))
            assert sorted(sorted(x) for x in groups.values()) == want
            assert (np.diff(node) >= 0).all()


@pytest.mark.parametrize("most", [10**6, 40, 1])
def test_suffix_tree_against_plain_prefixes(most):
    rng = random.Random(3)
    for letters, count in ((2, 12), (30, 60), (1, 3)):
        texts = [np.array([rng.randrange(letters) for _ in range(rng.randint(8, 40))]) for _ in range(count)]
        texts += [texts[0].copy(), np.concatenate([texts[1], [letters]])]
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        suffixes = [(i, p) for i, t in enumerate(texts) for p in range(len(t) - 5)]
        tree = suffix_trees.SuffixTree(texts, np.array([begin[i] + p for i, p in suffixes]), most, 6)
        words = [texts[i][p:].tolist() + [(i, "end")] for i, p in suffixes]
        after = defaultdict(set)
        holders = defaultdict(set)
        for k, w in enumerate(words):
            for n in range(len(w)):
                after[tuple(w[:n])].add(w[n])
                holders[tuple(w[:n])].add(k)
        branching = {x for x, nexts in after.items() if len(nexts) > 1 and x}
        found = {tuple(tree.symbols[tree.place[v] : tree.place[v] + tree.depth[v]].tolist()): v for v in range(1, len(tree.parent))}
        least = 0 if most > 10**5 else 6  # what is above the prefixes of the partition is no node
        assert {x for x in found if len(x) > least} == {x for x in branching if len(x) > least} and len(found) == len(tree.parent) - 1
        for x, v in found.items():  # edges: the parent is the longest branching prefix, the label what comes after it
            up = max((y for y in found if len(y) < len(x) and x[: len(y)] == y), key=len, default=())
            assert tree.parent[v] == (found[up] if up else 0) and tuple(tree.label(v).tolist()) == x[len(up) :]
        for k, w in enumerate(words):
            longest = max((n for n in range(len(w)) if len(holders[tuple(w[:n])]) > 1), default=0)
            if longest > least:
                assert tree.longest()[k] == longest
        assert set(tree.deep(6).tolist()) == {v for x, v in found.items() if len(x) >= 6}


def test_prefixes_part_suffixes_into_groups_of_bounded_size():
    rng = random.Random(4)
    texts = [np.array([0, 0, 0, 0] + [rng.randrange(9) for _ in range(40)]) for _ in range(300)]  # one prefix that all share
    starts = np.concatenate([np.arange(10) + 45 * i for i in range(300)])
    tree = suffix_trees.SuffixTree(texts, starts, 200, 35)
    seen = []
    for batch in tree.batches(200, 35):
        assert sum(len(rows) for _, rows in batch) <= 200
        for depth, rows in batch:
            assert len({tuple(tree.symbols[s : s + depth].tolist()) for s in starts[rows]}) == 1
            seen += rows.tolist()
    assert sorted(seen) == list(range(3000)) and len({d for b in tree.batches(200, 35) for d, _ in b}) > 2


def test_maximal_repeats_are_those_of_the_text(spark):
    """Words 0-39 of a text occur in one other text and words 20-70 in a third: two repeats that overlap, not one."""
    rng = random.Random(8)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    a = prose(90)
    rows = [(1, prose(7) + a + prose(3)), (2, prose(50) + a[:40] + prose(50)), (3, a[20:71] + prose(9)), (4, prose(20) + a[75:] + prose(40)), (5, prose(200))]
    rows += [(6, prose(11) + rows[4][1][30:180] + prose(5)), (7, prose(300)), (8, None)]
    rows += [(9, rows[6][1])]
    df = spark.createDataFrame([(i, w and " ".join(w)) for i, w in rows], "doc_id long, text string")
    found = {r.doc_id: [(x.start, x.n_words) for x in r.repeats] for r in suffix_trees.maximal_repeats(df).collect()}
    assert found == {1: [(7, 40), (27, 51)], 2: [(50, 40)], 3: [(0, 51)], 4: [], 5: [(30, 150)], 6: [(11, 150)], 7: [(0, 300)], 8: [], 9: [(0, 300)]}


def test_repeats_keep_columns_and_characters(docs, empty):
    out = suffix_array.remove_later_copies(docs, 12, 5)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.filter("n_chars <> length(text)").count() == 0 and out.filter("text like '%\ufffd%'").count() == 0
    assert suffix_trees.remove_repeats(docs).columns == docs.columns
    found = suffix_trees.maximal_repeats(docs).collect()
    assert any(r.repeats for r in found) and all(x.n_words >= 35 for r in found for x in r.repeats)
    for f in (suffix_trees.repeat_digests, suffix_array.repeat_digests, suffix_array.remove_later_copies):
        assert f(empty).count() == 0


def test_winnowing_gives_every_window_to_one_anchor_and_equal_windows_the_same():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 3, 5000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    symbols[3000:3400] = symbols[100:500]
    bounds = np.array([0, 1000, 1010, 5000])
    row, at, first, last, _ = repeats.winnow(symbols, bounds, 40, 7)
    owned = Counter()
    offset = {}
    for r, a, p, q in zip(row, at, first, last):
        for w in range(p, q + 1):
            owned[r, w] += 1
            assert w <= a <= w + 33
            offset[bounds[r] + w] = a - w
    assert set(owned.values()) == {1} and len(owned) == 961 + 0 + 3951
    assert all(offset[3000 + i] == offset[100 + i] for i in range(361))


# near duplicates


def plain_groups(rows, size=5, percent=80):
    """Numbers of the rows of each component; a row without words is one."""
    ids = [(k, t) for k, (_, t) in enumerate(rows)]
    least = defaultdict(list)
    for (k, _, c), n in model_components(ids, size, percent).items():
        least[c].append(k)
    return list(least.values())


def test_components_of_no_links_and_of_odd_ones(spark):
    from strandloom.llm.components import components

    links = "a long, b long"
    assert components(spark.createDataFrame([], links)).count() == 0
    chain = [(i, i + 1) for i in range(1, 40)] + [(3, 2), (3, 2), (50, 50), (60, 61)]
    out = {r.node: r.component for r in components(spark.createDataFrame(chain, links)).collect()}
    assert out == {**{i: 1 for i in range(1, 41)}, 50: 50, 60: 60, 61: 60}


def model_sets(rows, size=5):
    low = {c: c + 32 for c in range(65, 91)}
    sets = []
    for _, t in rows:
        w = [x.decode().translate(low) for x in (t or "").encode().split()]
        sets.append({tuple(w[p : p + size]) for p in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return sets


def model_links(rows, size=5, percent=80):
    sets = model_sets(rows, size)
    linked = lambda a, b: bool(a & b) and 100 * len(a & b) >= percent * len(a | b)
    return Counter((i, sum(linked(sets[k], other) for m, other in enumerate(sets) if m != k)) for k, (i, _) in enumerate(rows))


def model_components(rows, size=5, percent=80):
    sets = model_sets(rows, size)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    key = lambda i: -(2**63) if i is None else i
    least = defaultdict(lambda: 2**63)
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least[find(k)], key(i))
    return Counter((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("percent,block", [(80, 20_000), (60, 20_000), (80, 3)])
def test_jaccard_components(docs, rows, percent, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "CELL", 5 * block)
    out = jaccard_join.jaccard_components(docs, 5, percent)
    assert got(out, "doc_id", "n_shingles", "component_id") == model_components(rows, 5, percent)
    assert got(out, "doc_id", "n_links") == model_links(rows, 5, percent)


def test_near_windows_in_large_regions(spark, monkeypatch):
    """Many near copies of one text, so that regions are large and several components share them."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        own = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 4, 6))):
            own[rng.randrange(len(own))] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block, cell in ((20_000, 100_000), (10, 500), (7, 10**6)):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        monkeypatch.setattr(jaccard_join, "CELL", cell)
        out = jaccard_join.jaccard_components(df)
        assert got(out, "doc_id", "n_shingles", "component_id") == model_components(rows)
        assert got(out, "doc_id", "n_links") == model_links(rows)


def test_boundary_documents_are_replicated(spark, monkeypatch):
    """Chains of texts, each a little different from the last: cells are cut out of them and links lie over their boundaries."""
    rng = random.Random(15)
    rows = []
    for chain in range(3):
        own = [f"c{chain}w{i}" for i in range(100)]
        for i in range(40):
            rows.append((len(rows), " ".join(own)))
            for _ in range(rng.choice((1, 1, 2, 3))):
                own[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
    seen = []
    plain = jaccard_join.joined_in_cells

    def spy(members, visitors, *rest):
        seen.append((members.count(), visitors.count()))
        return plain(members, visitors, *rest)

    monkeypatch.setattr(jaccard_join, "joined_in_cells", spy)
    out = got(jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_shingles", "component_id")
    assert out == model_components(rows) and len({c for *_, c in out}) < 60
    assert len(seen) == 2 and seen[1][1] > 0 and seen[1][0] > 0


def test_sets_that_share_a_name_stay_apart(spark, monkeypatch):
    plain = jaccard_join.names_of
    monkeypatch.setattr(jaccard_join, "names_of", lambda own: (5, plain(own)[1]))
    rows = [(i, f"text number {i} with some words of its own {i * 7} and more {i}") for i in range(4)] + [(9, None)]
    shared = spark.createDataFrame([(n, 5, 10 + n // 2) for n in range(4)] + [(9, None, None)], "doc_id long, node long, other long")
    nodes = {r.doc_id: r.node for r in jaccard_join.distinct_names(shared).collect()}
    assert nodes == {0: 5, 1: 5, 2: 5 ^ 11, 3: 5 ^ 11, 9: None}
    assert rows and len({plain(np.array([i], np.uint64)) for i in range(1000)}) == 1000


def test_crossing_pairs_of_small_and_large_regions(monkeypatch):
    rng = np.random.default_rng(4)
    m = 400
    region = rng.integers(0, 12, m)
    n = rng.integers(20, 30, m)
    c = {"node": rng.permutation(m), "n": n, "place": rng.integers(0, 5, m), "end": rng.integers(0, 9, m), "most": n - rng.integers(0, 6, m), "component": rng.integers(0, 5, m), "home": rng.integers(0, 40, m)}
    c["points"] = rng.integers(1, 4, m)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(m), np.arange(m)))
    keep = (i < j) & (region[i] == region[j]) & jaccard_join._allowed(i, j, c, 80)
    want = {(min(a, b), max(a, b)) for a, b in zip(c["node"][i[keep]].tolist(), c["node"][j[keep]].tolist())}
    visits = set()
    for x, y in zip(i[keep].tolist(), j[keep].tolist()):
        x, y = (x, y) if (c["points"][x], c["home"][x]) < (c["points"][y], c["home"][y]) else (y, x)
        visits.add((int(c["node"][x]), int(c["home"][y])))
    for limit in (500, 32, 3):
        monkeypatch.setattr(jaccard_join, "_NEARBY", limit)
        left, right, own = jaccard_join.crossing_pairs(region, c, 80)
        a, b = own["node"][left], own["node"][right]
        assert {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())} == want
        node, home = jaccard_join.crossing_visits(region, c, 80)
        assert set(zip(node.tolist(), home.tolist())) == visits and len(node) == len(visits)


def test_links_within_a_cell():
    rng = random.Random(6)
    base = list(range(100))
    sets = []
    for i in range(150):
        own = set(base)
        for _ in range(rng.randint(0, 12)):
            own.discard(rng.choice(base))
            own.add(1000 + rng.randrange(200))
        sets.append(np.array(sorted(own), np.uint64))
    like = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    distance = np.array([1 - like(sets[0], s) for s in sets])
    node = np.array(rng.sample(range(10_000), 150))
    component = np.array([rng.randrange(60) for _ in sets])
    component[0] = component[1]

    def groups(links):
        label = {int(x): int(x) for x in component}
        for a, b in links:
            x, y = label[int(component[a])], label[int(component[b])]
            label = {k: x if v == y else v for k, v in label.items()}
        return Counter(tuple(sorted(k for k, v in label.items() if v == x)) for x in set(label.values()))

    place = {int(x): i for i, x in enumerate(node)}
    largest = Counter(component.tolist()).most_common(1)[0][0]
    away = np.flatnonzero(component != largest)
    links = jaccard_join.cell_links((node[away], component[away], distance[away], [sets[i] for i in away]), (node, component, distance, sets), 80)
    assert all(like(sets[place[a]], sets[place[b]]) >= 0.8 for a, b in links)
    every = [(i, j) for i in range(150) for j in range(i) if like(sets[i], sets[j]) >= 0.8]
    assert groups([(place[a], place[b]) for a, b in links]) == groups(every)


def test_counted_links_against_every_pair():
    rng = random.Random(8)
    sets = []
    for _ in range(120):
        own = set(range(100))
        for _ in range(rng.randint(0, 14)):
            own.discard(rng.randrange(100))
            own.add(1000 + rng.randrange(300))
        sets.append(np.array(sorted(own), np.uint64))
    like = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    far = np.array([int(np.ceil(round(1000 * (1 - like(sets[0], s)), 6))) for s in sets])
    node, documents = np.array(rng.sample(range(9000), 120)), np.array([rng.randint(1, 5) for _ in sets])
    outer = np.flatnonzero(2 * far > 200)
    every = (node, documents, far, sets)
    visitors = (node[outer], documents[outer], far[outer], [sets[i] for i in outer])
    of_outer, of_all = jaccard_join.counted_links(visitors, every, 80)
    want = np.zeros(120, int)
    for i in range(120):
        for j in range(120):
            if i != j and like(sets[i], sets[j]) >= 0.8:
                want[i] += documents[j] if far[i] + far[j] > 200 else 0
    counted = of_all.copy()
    counted[outer] += of_outer
    assert counted.tolist() == want.tolist() and 0 < len(outer) < 120 and of_all.sum() > 0


def test_one_of_each(docs, rows, empty):
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {(i, n, c) for i, n, c in model_components(rows) if (i if i is not None else -(2**63)) == c}
    out = kept.collect()
    assert {r.doc_id for r in out} == {i for i, _, _ in want}
    # one row of each component: rows with null and repeated ids too
    groups = plain_groups(rows)
    texts = Counter((r.doc_id, r.text) for r in out)
    key = lambda i: -(2**63) if i is None else i
    for group in groups:
        members = [rows[k] for k in group]
        held = [m for m in set(members) if m in texts]
        if not (members[0][1] or "").split():
            assert texts[members[0]] >= 1
        else:
            least = min(key(i) for i, _ in members)
            assert any(key(i) == least for i, _ in held)
    assert len(out) == sum(1 for g in groups)
    assert jaccard_join.jaccard_components(empty).count() == 0 and jaccard_join.one_of_each(empty).count() == 0


# classifier


def test_classifier(spark, docs, empty):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choices(["the", "of", "cat", "sat", "on", "mat"], k=40)) if i % 2 else "spam!! " * rng.randint(5, 30)) for i in range(300)]
    good = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in texts] + [(1, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    w = quality.fit(good, labels)
    scored = {r.doc_id: r.score for r in quality.score(good, w).select("_row.doc_id", "score").collect()}
    held = [i for i, _ in texts if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {r.doc_id for r in good.filter(quality.held_out()).collect()} == set(held)
    assert sum((scored[i] >= 0.3) == bool(i % 2) for i in held) >= len(held) - 1
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.score(docs, w).count() == docs.count() and quality.score(empty, w).count() == 0
    assert all(0 <= r.score <= 1 for r in quality.score(docs, w).collect())
    nothing = quality.fit(good, labels.filter("false"))
    assert not nothing.any()
    assert (quality.fit(good, labels, rows=50) != 0).any()


def plain_features(text):
    """Frequencies of hashed word 1- and 2-grams, shape 1- to 3-grams and repetitions, by the rules in words."""
    m = 2**64
    mix = lambda x: int(np.uint64(common.mix64(np.array([x % m], np.uint64))[0]))

    def fnv(t):
        h = 0xCBF29CE484222325
        for b in t.encode():
            h = (h ^ b) * 0x100000001B3 % m
        return h

    def shape(w):
        kinds = [("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c for c in w]
        return "".join(c for i, c in enumerate(kinds) if not i or kinds[i - 1] != c)

    words = (text or "").split()
    w, s = [fnv(x) for x in words], [fnv("\0" + shape(x)) for x in words]
    grams = w + s + [3 * a + 5 * b for a, b in zip(w, w[1:])] + [7 * a + 11 * b for a, b in zip(s, s[1:])]
    grams += [0x51ED270B if a == b else 0x2545F491 for a, b in zip(words, words[1:])]
    grams += [13 * a + 17 * b + 19 * c for a, b, c in zip(s, s[1:], s[2:])]
    counts = Counter(mix(g) >> (64 - quality.BITS) for g in grams)
    norm = sum(n * n for n in counts.values()) ** 0.5
    return {k: n / norm for k, n in counts.items()}


def plain_ftrl(examples, epochs):
    """Follow the regularised leader, one coordinate at a time."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        if k != "bias" and abs(z[k]) <= quality.L1:
            return 0.0
        sign = 1 if z[k] > 0 else -1
        return -(z[k] - (0 if k == "bias" else sign * quality.L1)) / ((quality.BETA + n[k] ** 0.5) / quality.ALPHA + (0 if k == "bias" else quality.L2))

    order = np.arange(len(examples))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            y, x = examples[i]
            x = x | {"bias": 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + np.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - y) * v
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / quality.ALPHA * w[k]
                n[k] += g * g
    return {k: weight(k) for k in list(z)}


def test_classifier_equals_a_plain_model(spark):
    rng = random.Random(13)
    vocabulary = ["the", "Of", "cat", "sat-on", "7 mats", "x9", "ÉTÉ", "!!!", "w" * 300 + "1"]
    rows = [(i, " ".join(rng.choices(vocabulary[: 5 + 4 * (i % 2)], k=rng.randint(0, 30)))) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    chosen = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    want = plain_ftrl([(i % 2, plain_features(t)) for i, t in chosen], quality.EPOCHS)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    w = quality.fit(docs, labels)
    assert abs(w[-1] - want["bias"]) < 1e-5 and all(abs(w[k] - v) < 1e-5 for k, v in want.items() if k != "bias")
    assert np.count_nonzero(w[:-1]) == sum(abs(v) > 1e-9 for k, v in want.items() if k != "bias") > 20
    scored = {r.doc_id: r.score for r in quality.score(docs, w).select("_row.doc_id", "score").collect()}
    for i, t in rows:
        total = want["bias"] + sum(want.get(k, 0) * v for k, v in plain_features(t).items())
        assert abs(scored[i] - 1 / (1 + np.exp(-total))) < 1e-5


def test_shapes_see_whole_words():
    assert quality.Streams.shape_of("a" * 300 + "9" * 5 + "B" + "-") == "a0A-"
    x, y = quality.Streams().vector("a" * 300), quality.Streams().vector("a" * 300 + "9")
    assert quality.Streams.shape_of("a" * 300) != quality.Streams.shape_of("a" * 300 + "9") and set(x[0]).isdisjoint(y[0])


# tokens


def test_tokens_equal_the_library(docs, rows, empty):
    model = sentencepieces.default_model()
    library = sentencepieces.tokenizer(model).library
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "")
        want[i, len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids).encode()), 0] += 1
    assert got(sentencepieces.encode_documents(docs, model), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_corrected") == want
    assert sentencepieces.encode_documents(empty, model).count() == 0
    for r in sentencepieces.encode_documents(docs.limit(5), model, ids=True).collect():
        assert len(r.ids) == r.n_tokens


def test_tokens_of_odd_texts():
    own = sentencepieces.MergeTokenizer(sentencepieces.default_model(), most_cached=50)
    rng = random.Random(2)
    signs = ["a", "bc", "The", " ", "  ", "▁", "\n", "\t", "é", "ß", "日", "🎉", "\x00", ".", ",", "!!", "ing", "ﬁ", "<s>", "0x41", "\u200b", "Ａ"]
    for _ in range(1500):
        t = "".join(rng.choices(signs, k=rng.randint(0, 40)))
        ids = own.library.encode(t)
        assert own.encode(t) == ids and own.digest(t)[2] == own.library.decode(ids) == own.decode(ids)
    assert own.check() and not own.wrong


def test_a_wrong_merge_is_corrected():
    own = sentencepieces.MergeTokenizer(sentencepieces.default_model())
    own.made[0], own.made[1] = own.made[1], own.made[0]
    text = "the inner thing in the hen"
    own.digest(text)
    assert not own.check()
    assert own.encode(text) == own.library.encode(text) and own.digest(text)[3] > 0


def test_a_text_that_differs_as_a_whole_is_encoded_by_the_library(spark, monkeypatch):
    model = sentencepieces.default_model()
    rows = [(1, "plain words here"), (2, "x " * 150_000 + "the longest of the batch"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    library = sentencepieces.tokenizer(model).library
    want = Counter((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids).encode())) for i, t in rows for ids in [library.encode(t or "")])
    columns = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got(sentencepieces.encode_documents(df, model), *columns) == want
    broken = sentencepieces.MergeTokenizer(model)
    digest = broken.digest
    broken.digest = lambda text: (*digest(text)[:2], digest(text)[2] + "!", 0)  # no chunk tells that this is wrong
    assert not broken.agrees(rows[1][1])
    assert [broken.by_library(t)[:3] for _, t in rows[:2]] == [(len(i), ",".join(map(str, i)), library.decode(i)) for i in (library.encode(t) for _, t in rows[:2])]
    assert broken.by_library("abc")[3] == 1


# URLs


def plain_glob(glob, text):
    """Whether a glob fits a text, by trying all ways."""
    if not glob:
        return not text
    if glob.startswith("**"):
        return any(plain_glob(glob[2:], text[i:]) for i in range(len(text) + 1))
    if glob[0] == "*":
        return any(plain_glob(glob[1:], text[i:]) for i in range(len(text) + 1) if "/" not in text[:i])
    return bool(text) and glob[0] in (text[0], "?") and plain_glob(glob[1:], text[1:])


def plain_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow", None
    rest = url.split("://", 1)[1].split("?")[0].split("#")[0]
    host, slash, path = rest.partition("/")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and (slash + path).startswith(p)]
    glob = next((g for g in url_filter.GLOBS if plain_glob(g, host + slash + path)), None)
    _, rule, verdict = max(fits, default=(0, None, "block" if glob else "allow"))
    return host, slash + path, rule, verdict, glob


def test_urls(spark):
    rng = random.Random(1)
    parts = ["http://", "https://", "://", "com", "example.com", "EXAMPLE.net", ".", "/", "/en/", "/en/7", "/de/", "/de/8", "org", "/es/", "?", "#", "x", "é", "www.", "net", ":80", "*", "\n", "@"]
    parts += ["casino-win.", "Casino-", "cheap-pills.", "free-bets.", "/login", "/wp-admin/", ".zip", "/fr/signup/", ".tar.gz", "xyz"]
    urls = [None, "", "com/en/", "http://a.com/en/", "http://xcom/en/", "http://foo.org/x.com/en/1", "http://com/en/7", "http://EXAMPLE.com/en/71", "http://a.b.example.net/de/8", "http://com", "x://y://com/en/", "http://com/en/" + "z" * 2000]
    urls += ["http://m.free-bets.example.org/fr/1", "http://www.casino-win.example.com/fr/3.html", "http://a.org/a/b.zip", "http://a.org/x/login?next=/", "http://a.org/" + "y/" * 400 + "a.zip"]
    urls += ["".join(rng.choices(parts, k=rng.randint(1, 8))) for _ in range(700)] + ["http://" + "".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(1500)]
    df = spark.createDataFrame([(i, u, "c", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.glob) for r in url_filter.judge_urls(df).collect()}
    want = [plain_verdict(u) for u in urls]
    assert [out[i] for i in range(len(urls))] == want
    assert {v for _, _, r, v, _ in want if r is None} == {"allow", "block"} and len({g for *_, g in want}) > 8
    assert url_filter.judge_urls(df.filter("false")).count() == 0


def test_the_rules_say_what_the_contract_says(spark):
    contract = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    urls = [(i, f"http://www.{rule}1") for i, rule in enumerate(contract)]
    out = url_filter.judge_urls(spark.createDataFrame(urls, "page_id long, url string")).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in out] == list(contract.items())


def test_a_url_of_megabytes_costs_its_own_length():
    import time

    automaton = url_filter.WildcardAutomaton([url_filter.Glob(g, -1) for g in url_filter.GLOBS])
    long = "a.org/" + "x/y" * 700_000 + ".zip"
    start = time.time()
    hits = automaton.matches([long] + ["b.org/c.zip"] * 200)
    assert hits[0, url_filter.GLOBS.index("**.zip")] and hits[1:, url_filter.GLOBS.index("**.zip")].all() and time.time() - start < 20


def test_globs():
    import re

    globs = ["a*b", "**.com", "?x", "ab**cd*", "**", "*", "a", "a**", "x" * 70 + "*y"]
    texts = ["", "a", "ab", "a/b", "axxb", "x.com", "y/x.com", ".com", "yx", "abcd", "ab/zcdq", "ab/zcd/q", "x" * 70 + "qy", "x" * 70 + "y", "aé"]
    automaton = url_filter.WildcardAutomaton([url_filter.Glob(g, i) for i, g in enumerate(globs)])
    hits = automaton.matches(texts)
    assert all((automaton.matches([t])[0] == hits[i]).all() for i, t in enumerate(texts))
    for j, g in enumerate(globs):
        pattern = re.escape(g).replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", ".")
        for i, t in enumerate(texts):
            assert hits[i, j] == bool(re.fullmatch(pattern, t, re.S)), (g, t)


# licenses


def plain_words(text):
    words, own = [], ""
    for c in (text or "") + " ":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c.isascii() and not (c.isdigit() or "a" <= c <= "z"):
            if own:
                words.append(own)
            own = ""
        else:
            own += c
    return words


def plain_scan(text):
    words = plain_words(text)
    places, base = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    labels, best = set(base), 1.0 if base else 0.0
    for label, template in licenses.TEMPLATES:
        t = plain_words(template)
        m = len(set(t))
        top = max((len(set(words[i : i + len(t)]) & set(t)) for i in range(len(words))), default=0)
        if top >= 0.8 * m - 1e-9:
            labels.add(label)
            best = max(best, top / m)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(best, 9)


def test_licenses(spark, docs, rows, empty):
    rng = random.Random(4)
    extra = []
    for label, t in licenses.TEMPLATES:
        for drop in (0, 1, 2, 4, 25):
            w = t.split()
            for _ in range(min(drop, len(w) - 1)):
                w.pop(rng.randrange(len(w)))
            rng.shuffle(w) if drop == 2 else None
            extra.append("Lorem-ipsum 7é. " * 5 + " ".join(w).upper() + ", " + "word " * 10)
    extra += ["under the MIT-license under the mit license", "xunder the mit license", "Apache License, Version 2.0", "CC BY-NC cc by nc cc  by\nnc", "mit", "under the mit"]
    all_rows = rows + [(1000 + i, t) for i, t in enumerate(extra)]
    df = spark.createDataFrame(all_rows, "doc_id long, text string").withColumn("labels", F.lit("x"))
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    out = Counter((*(r[c] for c in columns[:-1]), round(r.score, 9)) for r in licenses.scan(df).collect())
    assert out == Counter((i, *plain_scan(t)) for i, t in all_rows)
    assert licenses.scan(empty).count() == 0 and licenses.blocks(empty).count() == 0


def plain_blocks(text):
    """Every window that meets a template, overlapping ones joined, by trying all places."""
    own, out = plain_words(text), []
    for label, template in licenses.TEMPLATES:
        t = plain_words(template)
        m, tokens = len(set(t)), set(t)
        runs = []
        for i in range(len(own)):  # the block that begins with this word of the template
            block = [j for j in range(i, min(len(own), i + len(t))) if own[j] in tokens]
            n = len({own[j] for j in block})
            if own[i] in tokens and n >= 0.8 * m - 1e-9:
                last = next(j for j in block if len({own[x] for x in range(i, j + 1) if own[x] in tokens}) == n)
                if runs and i <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], max(runs[-1][1], block[-1]), max(runs[-1][2], n / m))
                else:
                    runs.append((i, block[-1], n / m))
        out += [(label, a, z, round(x, 9)) for a, z, x in runs]
    return sorted(out)


def test_license_blocks(spark):
    rng = random.Random(12)
    full = [t for _, t in licenses.TEMPLATES if len(t) > 300]
    filler = lambda n: " ".join(rng.choices(["the", "of", "software", "and", "lorem", "any", "or", "use", "ipsum"], k=n))
    texts = ["", filler(400), full[0] + " " + filler(300) + " " + full[2] + " " + filler(50) + " " + full[0], filler(20) + full[1][:500]]
    texts += [filler(30) + " ".join(w for w in rng.choice(full).split() if rng.random() < 0.93) + " " + filler(200) for _ in range(12)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = defaultdict(list)
    for r in licenses.blocks(df).collect():
        found[r.doc_id].append((r.label, r.first_word, r.first_word + r.n_words - 1, round(r.containment, 9)))
    for i, t in enumerate(texts):
        want = plain_blocks(t)
        assert [(label, x) for label, _, _, x in sorted(found[i])] == [(label, x) for label, _, _, x in want]
        assert all(any(label == l and a <= b and e <= z for l, a, z, _ in want) for label, b, e, _ in found[i])
    assert len(found[2]) >= 3


def test_places_of_a_phrase_that_is_said_very_often():
    line = b" " + b"cc by nc " * 200_000
    assert licenses.phrase_places(line, b"cc by nc") == list(range(0, 600_000, 3))


# fingerprints


def plain_fingerprint(text):
    """Distinct closed syncmers of the text's symbols, by the rules in words: padded k-mers, edge minima, first places."""
    import re

    import xxhash

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def chain(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest((v % (1 << 64)).to_bytes(8, "little"), seed)
        return signed(seed)

    k, s = fingerprints.K, fingerprints.S
    symbols = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.findall("[^\x20\x09-\x0D]{1,16}", text or "")]
    out = []
    for i in range(len(symbols)):
        kmer = ([None] * (k - 1) + symbols)[i : i + k]
        smers = [-(2**63) if all(x is None for x in kmer[j : j + s]) else chain(x or 0 for x in kmer[j : j + s]) for j in range(k - s + 1)]
        if min(smers[0], smers[-1]) <= min(smers[1:-1]):
            name = f"{chain(smers[j] for j in range(0, k - s + 1, s)) % (1 << 64) >> 32:08x}"
            if name not in out:
                out.append(name)
    return "".join(out)


def plain_likeness(f, g):
    a, b = ([x[i : i + 8] for i in range(0, len(x), 8)] for x in (f, g))
    if not a or not b:
        return float(a == b)
    diagonals = sorted(a.index(x) - b.index(x) for x in set(a) & set(b))
    width = max(fingerprints.SLACK, min(len(a), len(b)) // fingerprints.BAND)
    return 2 * max((sum(low <= d <= low + width for d in diagonals) for low in diagonals), default=0) / (len(a) + len(b))


def test_fingerprints(spark, docs, rows, empty):
    import xxhash

    def place(row):
        u = xxhash.xxh64_intdigest((row[1] or "").encode(), 42) >> 24
        return (row[0] is None, -(row[0] or 0), u, row[1] or "")

    known = {}
    order, want = sorted(rows, key=place), Counter()
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        f, g, h = (known.setdefault(x, None) or known.__setitem__(x, plain_fingerprint(x)) or known[x] for x in (t, e, n))
        want[i, len(t), sha(e.encode()), f, g, round(plain_likeness(f, g), 9), round(plain_likeness(f, h), 9)] += 1
    for n, stretch in ((docs, 512), (docs, 4), (docs.repartition(7), 1)):
        fingerprints.STRETCH, kept = stretch, fingerprints.STRETCH
        try:
            out = fingerprints.edited_fingerprints(n).collect()
        finally:
            fingerprints.STRETCH = kept
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in out) == want
    assert fingerprints.edited_fingerprints(empty).count() == 0 and fingerprints.passages(empty).count() == 0
    one = fingerprints.edited_fingerprints(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def test_a_repeated_id_is_dealt_into_many_stretches(spark, monkeypatch):
    """Null, or one id, may stand for most rows: its rows are parted by a hash of the text, in one order."""
    monkeypatch.setattr(fingerprints, "STRETCH", 16)
    rows = [(None, f"text {i}") for i in range(300)] + [(7, f"other {i}") for i in range(300)] + [(i, f"own {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = df.select("doc_id", F.col("text").alias("_text"))
    sizes = [r["count"] for r in fingerprints.with_stretch(texts, fingerprints.ids_in_order(texts)).groupBy("_stretch").count().collect()]
    assert sum(sizes) == 700 and len(sizes) >= 30 and max(sizes) < 64
    follows = {r._text: r.next__text for r in fingerprints.with_next(texts).collect()}
    at, seen = "text 0", []
    while at not in seen:
        seen.append(at)
        at = follows[at]
    assert len(seen) == 700
    by_id = {t: i for i, t in rows}
    k = next(i for i in range(700) if by_id[seen[i]] is not None and by_id[seen[i - 1]] is None)
    ids = [by_id[t] for t in seen[k:] + seen[:k]]
    assert ids == sorted(ids, key=lambda i: (i is None, -(i or 0)))


def test_anchors_do_not_depend_on_context(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(1000)}" for _ in range(60)]
    texts = [" ".join(words), "other words before " + " ".join(words) + " and after"]
    df = fingerprints.with_anchors(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "a").collect()
    inside = [{(x.at - shift, x.hash) for x in r.a if x.n == fingerprints.K and shift <= x.at <= shift + 60 - fingerprints.K} for r, shift in zip(df, (0, 3))]
    assert inside[0] == inside[1] and len(inside[0]) > 10


def near(spark, pairs):
    df = spark.createDataFrame([(i, " ".join(x), " ".join(y)) for i, (x, y) in enumerate(pairs)], "i int, x string, y string")
    df = fingerprints.with_sketch(fingerprints.with_sketch(df, "x", "a"), "y", "b")
    return [r.near for r in fingerprints.with_likeness(df, "a", "b", "near").orderBy("i").collect()]


def test_likeness_goes_by_place(spark):
    rng = random.Random(9)
    prose = lambda n: [f"w{rng.randrange(100_000)}" for _ in range(n)]
    a, b, c, shared = prose(30), prose(30), prose(300), prose(60)
    far = [prose(3000) + shared + prose(3000), prose(2000) + shared + prose(4000)]
    swapped, same, none, edited, long, scattered = near(spark, [(a + b, b + a), (a + b, a + b), (a, b), (c, c[:40] + ["x"] + c[40:200] + c[203:]), far, (c, random.Random(1).sample(c, 300))])
    assert same == 1 and none == 0 and swapped < 0.6 and edited > 0.9 and scattered == 0
    assert long > 0  # a passage that is one in a hundred of two long texts is found: no anchor is dropped


def test_likeness_has_no_jump_at_short_texts(spark):
    rng = random.Random(11)
    own, other = ([f"w{rng.randrange(100_000)}" for _ in range(60)] for _ in range(2))
    one_more = near(spark, [(own[:n], own[: n + 1]) for n in range(1, 60)])
    assert one_more[22] > 0.9 and all(x >= (n + 1) / (n + 4) for n, x in enumerate(one_more))
    halves = near(spark, [(own[:n], own[: n // 2] + other[: n - n // 2]) for n in range(8, 60)])
    assert all(0.25 < x < 0.9 for x in halves)
    assert near(spark, [(["x"], ["x"]), (["x"], ["y"]), ([], []), ([], ["x"])]) == [1, 0, 1, 0]


def plain_spans(a, b):
    places = defaultdict(list)
    for x in b:
        places[x.hash].append(x.at)
    out, d, last, before = [], None, -1, False
    for x in a:
        there = places.get(x.hash, [])
        at = x.at - d if d is not None and x.at - d in there else next((p for p in there if p > last), min(there, default=None))
        if at is not None and before and x.at - at == d:
            out[-1][2:] = [x.at + x.n - out[-1][0], out[-1][3] + 1]
        elif at is not None:
            out.append([x.at, at, x.n, 1])
        before = at is not None
        if before:
            d, last = x.at - at, at
    return [tuple(s) for s in out]


def test_passages_are_the_same_in_both_texts(spark, empty):
    rng = random.Random(10)
    prose = lambda n, v=100_000: [f"w{rng.randrange(v)}" for _ in range(n)]
    a, b, c = prose(200), prose(120), prose(90)
    few = prose(400, 3)
    pairs = [(a + b, b + a), (a + b + c, a + prose(40) + b + c), (a + b, a + b), (prose(50) + b + prose(50), prose(500) + b), (a, c), (a, a[:100] + ["other"] + a[101:])]
    pairs += [(few, few[50:] + few[:80]), (["ab"] * 300, ["ab"] * 200), (a + a, b + a + c + a), (["x", "y"], ["y", "x"]), ([], a), ([], [])]
    df = spark.createDataFrame([(i, " ".join(x), " ".join(y)) for i, (x, y) in enumerate(pairs)], "i int, x string, y string")
    df = fingerprints.with_anchors(fingerprints.with_anchors(df, "x", "a"), "y", "b")
    got = {r.i: r for r in fingerprints.with_spans(df, "a", "b", "s").collect()}
    for i, (x, y) in enumerate(pairs):
        r = got[i]
        assert [tuple(s) for s in r.s] == plain_spans(r.a, r.b)
        assert all(x[s.start : s.start + s.n_symbols] == y[s.other_start : s.other_start + s.n_symbols] for s in r.s)
    assert {s.start - s.other_start for s in got[0].s if s.n_symbols > 50} == {-120, 200}
    assert max(s.n_symbols for s in got[3].s) > 100
    out = fingerprints.passages(spark.createDataFrame([(2, " ".join(a + b)), (1, " ".join(b + a))], "doc_id long, text string")).orderBy("doc_id").collect()
    assert all(len([s for s in r.next_spans if s.n_symbols > 50]) == 2 and len(r.edited_spans) >= 1 for r in out)


# neighbours


@pytest.mark.parametrize("leaves,block", [(None, 4096), (256, 4096), (8, 50)])
def test_neighbours(spark, leaves, block, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 12)) * rng.uniform(0.5, 2, (700, 1))
    x[100:180] = x[100]
    rows = [(i, [float(np.float32(v)) for v in r], 1) for i, r in enumerate(x)]
    rows += [rows[40], (1000, None, 1), (1001, [], 1), (1002, [0.0] * 12, 1), (1003, [float("nan")] * 12, 1), (1004, [None] + [1.0] * 11, 1), (1020, [1.0, 2.0], 1), (None, rows[0][1], 1), (1040, [float("inf")] * 12, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3)
    out = neighbours.search(df, df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id")), leaves=leaves)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    found = defaultdict(list)
    for r in out.orderBy("query_id", "rank").collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    x = np.array([r[1] for r in rows[:700]], np.float32).astype(np.float64)
    hits = 0
    assert sorted(found) == list(range(0, 700, 20))
    for q, near in found.items():
        s = (x * x[q]).sum(1)
        order = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:20]
        hits += len({v for _, v, _ in near} & set(order))
        assert [k for k, _, _ in near] == list(range(1, 21))
        assert all(abs(s[v] - score) < 1e-12 for _, v, score in near)
        assert near == sorted(near, key=lambda r: (-r[2], r[1]))
    assert hits >= 0.9 * 20 * len(found)
    assert neighbours.search(df.filter("false"), df.select(F.col("vec_id").alias("query_id"))).count() == 0
    few = df.filter("vec_id < 3")
    assert neighbours.search(few, few.select(F.col("vec_id").alias("query_id"))).count() == 6


def test_every_query_gets_as_many_as_there_are(spark):
    """Tight clusters and far outliers leave small leaves; search goes on until k candidates are held."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 8)) * 3
    x = np.concatenate([centres[i % 30] * rng.uniform(0.1, 4) + rng.normal(size=(1 + 40 * (i % 3 == 0), 8)) * 0.01 for i in range(60)] + [rng.normal(size=(12, 8)) * 50])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    asked = df.select(F.col("vec_id").alias("query_id"))
    for leaves in (8, 64, 200):
        counts = neighbours.search(df, asked, leaves=leaves, recall=0.0).groupBy("query_id").count().collect()
        assert len(counts) == len(x) and {r["count"] for r in counts} == {20}
    few = df.filter("vec_id < 19")
    counts = neighbours.search(few, asked, leaves=16, recall=0.0).groupBy("query_id").count().collect()
    assert len(counts) == 19 and {r["count"] for r in counts} == {18}


def test_leaves_grow_with_the_table():
    assert [neighbours.leaves_for(n) for n in (0, 1000, 10_000, 10**6, 10**12)] == [16, 31, 100, 1000, neighbours.LEAVES]


# packing


@pytest.mark.parametrize("capacities,shard", [((64, 128, 512), 25), ((512, 1024, 2048, 4096), 20_000)])
def test_packing(docs, rows, empty, capacities, shard):
    out = packing.pack(docs, capacities, shard).collect()
    want = Counter((i, len((t or "").encode().split())) for i, t in rows)
    total = Counter()
    for r in out:
        total[r.doc_id] += r.length
    by_id = Counter()
    for (i, n), k in want.items():
        by_id[i] += n * k
    assert +total == +by_id and {r.doc_id for r in out} == {i for i, _ in rows}
    bins = defaultdict(list)
    for r in out:
        assert (r.bin is None) == (r.length == 0)
        if r.length:
            bins[r.bin].append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.place)
        at = 0
        for r in own:
            assert r.place == at
            at += r.length
        capacity = {r.capacity for r in own}
        assert capacity == {min(c for c in capacities if c >= at)}
    filled = sum(r.length for r in out) / sum(own[0].capacity for own in bins.values())
    assert filled > 0.8
    assert packing.pack(empty).count() == 0


def test_best_fit_prefers_the_tightest_bin():
    bins, place, capacity = packing.Shard((10, 20)).pack(np.array([10, 9, 6, 4, 1]))
    load = Counter()
    for b, n in zip(bins, [10, 9, 6, 4, 1]):
        load[b] += n
    assert sum(load.values()) == 30 and sum(capacity) == 30 and all(load[b] == c for b, c in enumerate(capacity))


def plain_packing(lengths, capacities):
    """Best fit, longest first, and the size to open by filling each on trial; bins as (capacity, load), by trying all bins."""
    left = sorted(lengths, reverse=True)
    bins = []  # [room, load, turn in which it got this room]
    turn = 0
    while left:
        n = left.pop(0)
        turn += 1
        fitting = [b for b in bins if b[0] >= n]
        if fitting:
            best = min(fitting, key=lambda b: (b[0], -b[2]))
            best[0], best[1], best[2] = best[0] - n, best[1] + n, turn
            continue
        trials = []
        for c in (c for c in capacities if c >= n):
            rest = c - n
            for x in left:
                if x <= rest:
                    rest -= x
            final = min(x for x in capacities if x >= c - rest)
            trials.append((packing.cost(final) / (c - rest), c))
        least = min(t for t, _ in trials)
        c = next(c for t, c in trials if t <= least + 1e-12)
        bins.append([c - n, n, turn])
    return Counter((min(c for c in capacities if c >= load), load) for _, load, _ in bins)


@pytest.mark.parametrize("seed", range(6))
def test_packing_equals_a_plain_packer(seed):
    rng = random.Random(seed)
    capacities = rng.choice([(10, 20, 40), (512, 1024, 2048, 4096), (7, 50)])
    lengths = [rng.choice([rng.randint(1, capacities[-1]), rng.randint(1, 5), 35 % capacities[-1]]) for _ in range(rng.randint(1, 300))]
    bins, place, capacity = packing.Shard(capacities).pack(np.array(lengths))
    load = Counter()
    for b, n in zip(bins.tolist(), lengths):
        load[b] += n
    assert Counter((int(capacity[b]), n) for b, n in load.items()) == plain_packing(lengths, capacities)


def test_large_bins_are_tried_out_with_all_short_pieces():
    _, _, capacity = packing.Shard().pack(np.full(2000, 35))
    assert sum(map(packing.cost, capacity.tolist())) <= 77_280


def test_one_id_for_many_texts(spark):
    """Each text of a shared id meets its own set alone, and repeated rows of it once."""
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(40)]
    docs = spark.createDataFrame([(None, t) for t in texts] + [(None, texts[0])] * 5, "doc_id long, text string")
    shared = spark.sparkContext.broadcast(np.zeros(0, np.uint64))
    chosen = jaccard_join.points(docs, shared).select("_doc", "_key", "node").distinct()
    got = jaccard_join.texts_of(docs, chosen, 5)
    assert got.count() == got.select("node").distinct().count() == len(texts)
    joins = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "_doc" in line]
    assert joins and all("_key" in line for line in joins)


def test_repeated_rows_train_once(spark):
    rows = [(i, f"{'good plain words' if i % 2 else 'zz qq xx 77'} {i} " * 8) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    once = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    again = quality.fit(spark.createDataFrame(rows + rows[1:2] * 300, "doc_id long, text string"), labels)
    assert (once != 0).any() and (once == again).all()
