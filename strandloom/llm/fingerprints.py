"""Document fingerprints from closed syncmers, with DataFrame functions only.

Symbols are runs of at most 16 characters other than white space. K - 1 blank symbols are
put before the first one, so that a text of any length has one k-mer per symbol. A k-mer
of symbols is chosen when, of the s-mers in it, the least by hash is the first or the
last: that depends on the k-mer alone, so a passage has the same anchors in any
document, at the same places within it. An s-mer of blanks is less than any other, so a
text begins with anchors and even one symbol has one.

A fingerprint is the list of all distinct anchors (32-bit hashes, 8 hexadecimal digits
each) in the order of their first places, whatever the length of the text. The likeness of
two fingerprints is positional: anchors that both hold are matched, each match lies on a diagonal
(its place in the one list less its place in the other), and those in the band of
diagonals that holds the most are counted, as a share of all anchors of both (Dice). A band is as
wide as `SLACK` anchors, or as one in `BAND` of the shorter list. Single words put in or
taken out leave a match in the band; passages in another order, and anchors that are
shared here and there, fall out of it. Likeness depends on the two strings alone.

`passages` gives the matched passages themselves: a span is a run of anchors that follow
each other in the text and match on one diagonal; as they overlap, the symbols of a span
are the same in both. From left to right every anchor whose hash occurs in the other text
goes to one span: it stays on the diagonal of the last match where it can, or else
takes the first place behind that match, or else the first place of all.

Null and empty texts (also white space alone): fingerprint empty; two such are alike (1),
one such and another text are not (0). Equal texts have equal fingerprints. Rows that
repeat a doc_id, null among them, follow each other by a hash of the text, then the
text; repeated rows are rows of their own. Null doc_ids come last and are given back as null.
The only row of a table follows itself. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, id_key, table

K, S = 6, 2
#: Width of the band of diagonals: so many anchors, or this part of the shorter fingerprint.
SLACK, BAND = 8, 8
#: Rows in a stretch within which neighbours are found together, and the most stretches.
STRETCH, STRETCHES = 512, 50_000
SPANS = "array<struct<start:int,other_start:int,n_symbols:int,n_anchors:int>>"
_LEAST = "(-9223372036854775807L - 1L)"


def with_anchors(df: DataFrame, text: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """Adds `out`: place (from 0, in symbols), 32-bit hash and number of symbols of each anchor of the column `text`."""
    inner = k - s + 1
    t, h, g = f"{out}__t", f"{out}__h", f"{out}__g"
    df = df.withColumn(t, F.expr(rf"regexp_extract_all(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]{{1,16}}', 0)"))
    df = df.withColumn(h, F.expr(f"concat(array_repeat(0L, {k - 1}), transform({t}, w -> xxhash64(w)))")).drop(t)
    smer = ", ".join(f"{h}[i + {j}]" for j in range(s))
    df = df.withColumn(g, F.expr(f"CASE WHEN size({h}) >= {k} THEN transform(sequence(0, size({h}) - {s}), i -> IF(i < {k - s}, {_LEAST}, xxhash64({smer}))) ELSE array() END"))
    middle = ", ".join(f"{g}[i + {j}]" for j in range(1, inner - 1))
    edges = f"least({g}[i], {g}[i + {inner - 1}])"
    chosen = f"{edges} <= {f'least({middle})' if inner > 3 else middle}" if inner > 2 else "true"
    spread = ", ".join(f"{g}[i + {j}]" for j in sorted({*range(0, inner, s), inner - 1}))
    return df.withColumn(
        out,
        F.expr(
            f"CASE WHEN size({h}) >= {k} THEN transform(filter(sequence(0, size({h}) - {k}), i -> {chosen}), i -> "
            f"named_struct('at', greatest(i - {k - 1}, 0), 'hash', shiftrightunsigned(xxhash64({spread}), 32), 'n', least(i + 1, {k}))) ELSE array() END"
        ),
    ).drop(h, g)


def with_sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`: the distinct anchor hashes of the column `text`, in the order of their first places."""
    a = f"{out}__a"
    return with_anchors(df, text, a).withColumn(out, F.expr(f"array_distinct({a}.hash)")).drop(a)


def fingerprint(sketch: str) -> Column:
    return F.expr(f"array_join(transform({sketch}, x -> lpad(lower(hex(x)), 8, '0')), '')")


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds `out`: the positional likeness of two sketches.

    Both go into one array of numbers (hash, side, place); in order, a hash of both
    stands next to itself. The fullest band of diagonals is found by a window over
    the sorted diagonals that never shrinks.
    """
    both, diagonals, low = f"{out}__m", f"{out}__d", f"{out}__l"
    pack = "transform({}, (x, i) -> shiftleft(x, 31) + {} + i)"
    df = df.withColumn(both, F.expr(f"sort_array(concat({pack.format(a, 0)}, {pack.format(b, 1 << 30)}))"))
    here, there = "cast(x & 1073741823 AS int)", f"cast(get({both}, i + 1) & 1073741823 AS int)"
    same = f"shiftright(x, 31) = shiftright(get({both}, i + 1), 31)"
    df = df.withColumn(diagonals, F.expr(f"sort_array(array_compact(transform({both}, (x, i) -> IF({same}, {here} - {there}, NULL))))")).drop(both)
    width = f"greatest({SLACK}, cast(floor(least(size({a}), size({b})) / {BAND}) AS int))"
    step = f"IF({diagonals}[i] - {diagonals}[l] > {width}, l + 1, l)"
    df = df.withColumn(low, F.expr(f"CASE WHEN size({diagonals}) > 1 THEN aggregate(sequence(0, size({diagonals}) - 1), 0, (l, i) -> {step}) ELSE 0 END"))
    likeness = f"2D * (size({diagonals}) - {low}) / (size({a}) + size({b}))"
    df = df.withColumn(out, F.expr(f"CASE WHEN size({a}) = 0 AND size({b}) = 0 THEN 1D WHEN size({a}) = 0 OR size({b}) = 0 THEN 0D ELSE {likeness} END"))
    return df.drop(diagonals, low)


def with_spans(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds `out`: the spans of the anchors `a` that `b` holds too, in the order of `a`; places and lengths in symbols.

    The anchors of `b` are put in order as numbers (hash, place) and looked up by bisection.
    """
    sorted_b, steps = f"{out}__b", f"{out}__s"
    df = df.withColumn(sorted_b, F.expr(f"CASE WHEN arrays_overlap({a}.hash, {b}.hash) THEN sort_array(transform({b}, x -> shiftleft(x.hash, 31) + x.at)) ELSE cast(array() AS array<bigint>) END"))
    df = df.withColumn(steps, F.expr(f"transform(sequence(length(bin(size({sorted_b}))) - 1, 0, -1), i -> shiftleft(1, i))"))

    def first_from(at: str) -> str:
        key = f"shiftleft(x.hash, 31) + {at}"
        return f"get({sorted_b}, aggregate({steps}, 0, (p, s) -> IF(p + s <= size({sorted_b}) AND get({sorted_b}, p + s - 1) < {key}, p + s, p)))"

    def place_from(at: str) -> str:
        return f"get(transform(array({first_from(at)}), y -> IF(shiftright(y, 31) = x.hash, cast(y & 2147483647 AS int), NULL)), 0)"

    stays = f"IF(x.at >= acc.d AND {first_from('x.at - acc.d')} = shiftleft(x.hash, 31) + x.at - acc.d, x.at - acc.d, NULL)"
    place = f"coalesce({stays}, {place_from('coalesce(acc.last - acc.d + 1, 0)')}, {place_from('0')}, -1)"
    span = "named_struct('start', {0}.start, 'other_start', {0}.start - {0}.d, 'n_symbols', {0}.until - {0}.start, 'n_anchors', {0}.n)"
    done = "IF({0}.n > 0, concat({0}.done, array(" + span + ")), {0}.done)"
    state = "named_struct('done', {}, 'd', {}, 'start', {}, 'last', {}, 'until', {}, 'n', {})"
    on = state.format("st.done", "st.d", "st.start", "x.at", "x.at + x.n", "st.n + 1")
    new = state.format(done.format("st"), "x.at - y", "x.at", "x.at", "x.at + x.n", "1")
    off = state.format(done.format("st"), "st.d", "st.start", "st.last", "st.until", "0")
    step = f"aggregate(array({place}), acc, (st, y) -> CASE WHEN y < 0 THEN {off} WHEN st.n > 0 AND x.at - y = st.d THEN {on} ELSE {new} END)"
    none = f"cast(array() AS {SPANS})"
    zero = state.format(none, *["cast(NULL AS int)"] * 4, "0")
    found = f"CASE WHEN size({sorted_b}) > 0 THEN aggregate({a}, {zero}, (acc, x) -> {step}, acc -> {done.format('acc')}) ELSE {none} END"
    return df.withColumn(out, F.expr(found)).drop(sorted_b, steps)


def ids_in_order(docs: DataFrame) -> list[int]:
    """Ids (null as the least) that part the rows into stretches of about STRETCH rows: at most STRETCHES numbers."""
    rows = docs.count()
    n = min(STRETCHES, max(1, -(-rows // STRETCH)))
    if n == 1:
        return []
    shares = F.expr(f"array({', '.join(f'{i / n!r}D' for i in range(1, n))})")
    return sorted(docs.agg(F.percentile_approx(id_key(), shares, 4 * n).alias("q")).first().q)


def with_stretch(df: DataFrame, bounds: list[int]) -> DataFrame:
    """Adds _u, the order of rows that share a doc_id, and _stretch, whose numbers rise with the id and fall with _u.

    An id that is a bound several times over holds more than a stretch; its rows are
    parted further by _u, 40 bits of a hash of the text.
    """
    df = df.withColumn("_id", id_key()).withColumn("_u", F.shiftrightunsigned(F.xxhash64("_text"), 24))
    if not bounds:
        return df.withColumn("_stretch", F.lit(0).cast("long"))
    single = sorted(set(bounds))
    times = [bisect_right(bounds, x) - bisect_left(bounds, x) for x in single]
    steps = [1 << i for i in reversed(range(len(single).bit_length()))]
    ids, many, halves = (f"array({', '.join(f'{x}L' if x != NULL_ID else _LEAST for x in v)})" for v in (single, times, steps))
    df = df.withColumn("_bounds", F.expr(ids)).withColumn("_steps", F.expr(halves))
    df = df.withColumn("_at", F.expr("aggregate(_steps, 0L, (p, s) -> IF(p + s <= size(_bounds) AND get(_bounds, cast(p + s - 1 AS int)) <= _id, p + s, p))"))
    part = F.expr(f"CASE WHEN _at > 0 AND get(_bounds, cast(_at - 1 AS int)) = _id THEN 1L + shiftright(_u * get({many}, cast(_at - 1 AS int)), 40) ELSE 0L END")
    return df.withColumn("_stretch", F.shiftleft("_at", 20) + (F.lit((1 << 20) - 1) - part)).drop("_bounds", "_steps", "_at")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, _text and that of the next row (next__text) by descending doc_id; of the last row: the first's.

    Rows are dealt into stretches of ids, bounded by quantiles of the ids, and put in
    order within each; the first row of each stretch follows the last of the one before.
    Only the stretches' numbers (a bounded list) come to the driver. Texts are
    shuffled once; anchors are made afterwards, so that all of them can be kept.
    """
    df = with_stretch(docs, ids_in_order(docs))
    own = Window.partitionBy("_stretch").orderBy(F.desc("_id"), "_u", "_text")
    heads = df.withColumn("_k", F.row_number().over(own)).filter("_k = 1").select("_stretch", F.struct("_text").alias("_head"))
    names = sorted((r._stretch for r in df.select("_stretch").distinct().collect()), reverse=True)  # at most 2 * STRETCHES numbers
    follows = docs.sparkSession.createDataFrame(list(zip(names, names[1:] + names[:1])), "_stretch long, _after long")
    after = follows.join(heads.withColumnRenamed("_stretch", "_after"), "_after").select("_stretch", "_head")
    return (
        df.withColumn("_next", F.lead(F.struct("_text")).over(own))
        .join(after, "_stretch")
        .select("doc_id", "_text", F.coalesce("_next", "_head")["_text"].alias("next__text"))
    )


def with_edited(docs: DataFrame) -> DataFrame:
    """doc_id, _text, next__text, n_chars and _edited, the text with its second half replaced by the next text's first."""
    df = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")))
    df = df.withColumn("n_chars", F.length("_text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    return df.withColumn("_edited", F.concat(F.substring("_text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next__text", F.lit(1), half)))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likenesses of the first to the second and to the next document's."""
    df = with_edited(docs)
    for text, out in (("_text", "_own"), ("next__text", "_next"), ("_edited", "_other")):
        df = with_sketch(df, text, out)
    df = with_likeness(with_likeness(df, "_own", "_other", "near_edited"), "_own", "_next", "near_next")
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint("_own").alias("fingerprint"),
        fingerprint("_other").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, edited_spans and next_spans: the passages that each text shares with its edited text and with the next one."""
    df = with_edited(docs)
    for text, out in (("_text", "_a"), ("next__text", "_b"), ("_edited", "_c")):
        df = with_anchors(df, text, out)
    df = with_spans(with_spans(df, "_a", "_c", "edited_spans"), "_a", "_b", "next_spans")
    return df.select("doc_id", "edited_spans", "next_spans")


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
