"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Jaccard distance is a metric, and the join works in that space, exactly:

1. Documents with equal sets are one point.
2. Every point is sent to regions: one for each shingle of its prefix (its
   shingles in one global order, up to so many that two linked points must share
   one). Regions with one point only are dropped. The order puts shingles that
   are frequent in a bounded sample of documents last; that choice moves work,
   never results.
3. In some regions of each point, chosen by hash, the most central point is the pivot.
   Distances to it are measured; points within the radius are linked to it, and
   links make components. Every point lies in the Voronoi cell of the nearest
   pivot that it was measured against. A cell whose points are still in several
   components is joined within: its points outside its largest component visit the others in
   windows of distances to the pivot (triangle inequality), and what they have in common is
   counted exactly; only links that join components come out.
4. Boundary documents: where points of different cells and components share
   a region and sizes, places and shared prefixes allow a link, the one of the smaller cell is
   replicated into the other's cell. Its distance to that pivot is measured; if it is beyond the cell's radius
   by more than the link's, it goes no further (triangle inequality). Else it is joined with the members
   whose distances to the pivot differ from its own by at most the link's radius, exactly, as in 3.
5. All links give the final components.
6. Links are counted per document within components, by sums where distances to the component's pivot tell that two
   points are linked or are not, and exactly else (`link_counts`); `one_of_each` leaves this out.

In 3 and 4 members of a cell are dealt out in blocks of at most `CELL` shingles and visitors
in blocks of as many, so a cell with any share of all points falls into many tasks; each member meets
only visitors, never all other members.

Regions by nearest pivot alone cannot work here: nearly all documents are at
distance 1 from every pivot, so each would lie on every boundary and be copied
into every region. Hence the regions of step 2; README has more.

Shingles are 64-bit hashes; the name of a point has 128 bits (64, and where two points share those, 64 others). Null and empty texts
have no shingle and link with nothing; fewer words than a shingle has are one
shingle. Repeated rows are equal sets. A null doc_id stays null and takes part
as the least id. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, gram_hashes, id_key, mix64, row_slices, table, text_bytes, words_of, written
from .components import components

SHINGLE = 5
PERCENT = 80
#: Documents looked at to find frequent shingles, and how many of them make a shingle frequent.
SAMPLE, FREQUENT, MOST_FREQUENT = 4000, 4, 200_000
_U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingles of each text, in order of their hashes."""
    out = []
    for i, j in row_slices(offsets):
        bounds = offsets[i : j + 1] - offsets[i]
        starts, _, symbols = words_of(data[offsets[i] : offsets[j]], bounds[:-1], lower=True)
        at = np.searchsorted(starts, bounds)
        grams = gram_hashes(symbols, size)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= size:
                own = np.sort(grams[a : b - size + 1])
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif b > a:
                own = mix64(gram_hashes(symbols[a:b], b - a) + _U(b - a))
            else:
                own = np.zeros(0, np.uint64)
            out.append(own)
    return out


def names_of(own: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a set that is not empty."""
    sums = [mix64(own * _U(0x9E3779B97F4A7C15)).sum(dtype=np.uint64), mix64(own ^ _U(0xA0761D6478BD642F)).sum(dtype=np.uint64)]
    first, second = mix64(np.array(sums, np.uint64) + _U(len(own))).view(np.int64).tolist()
    return first, second


def distinct_names(found: DataFrame) -> DataFrame:
    """node, made of both names: the first, or both where another set has the same first name. Few sets ever have, so
    their list is written and its size decides how it is joined."""
    shared = found.filter("node is not null").groupBy("node").agg(F.min("other").alias("_low"), F.max("other").alias("_high")).filter("_low < _high")
    shared = written(shared.select("node", "_low"), "names")
    node = F.when(F.col("other") > F.col("_low"), F.col("node").bitwiseXOR(F.col("other"))).otherwise(F.col("node"))
    return found.join(shared, "node", "left").withColumn("node", node).drop("_low", "other")


def frequent_shingles(docs: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """At most MOST_FREQUENT shingles of at most SAMPLE documents, sorted."""
    ids = docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(*text_bytes(batch.column(0)), size)
            values, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["key", "n"])

    counted = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    rows = counted.filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "key").limit(MOST_FREQUENT).select("key").toArrow()
    return np.sort(rows.column(0).to_numpy().view(np.uint64))


def prefix_length(n, percent: int):
    return n + 1 - -(-percent * n // 100)


def prefix_of(own: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The first shingles in the global order, of which a set shares one with any other that is similar enough, and
    the place in that order (33 bits) at which they end."""
    length = prefix_length(len(own), percent)
    early = len(own)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        late = frequent[at] == own
        if late.any():
            own = np.concatenate([own[~late], own[late]])
            early = len(own) - int(late.sum())
    return own[:length], int(length > early) << 32 | int(own[length - 1]) >> 32


def points(docs: DataFrame, shared: Broadcast, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, _doc, _key (a hash of the text), n_shingles, node and other, two names (null for an empty set), prefix and its end of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in batches:
            sets = shingle_sets(*text_bytes(batch.column(3)), size)
            prefixes = [prefix_of(s, frequent, percent) if len(s) else (None, None) for s in sets]
            names = [names_of(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    batch.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([a for a, _ in names], pa.int64()),
                    pa.array([b for _, b in names], pa.int64()),
                    pa.array([None if p is None else p.view(np.int64) for p, _ in prefixes], pa.list_(pa.int64())),
                    pa.array([e for _, e in prefixes], pa.int64()),
                ],
                names=["doc_id", "_doc", "_key", "n_shingles", "node", "other", "prefix", "end"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", id_key().alias("_doc"), F.xxhash64("text").alias("_key"), F.col("text").alias("_text"))
    return given.mapInArrow(run, f"doc_id {kind}, _doc long, _key long, n_shingles long, node long, other long, prefix array<long>, end long")


def entries(found: DataFrame, shared: Broadcast, frequent: bool) -> DataFrame:
    """key, node, n, place: a row for each shingle of a point's prefix, once per point and batch; the frequent shingles' or the others'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            lists = batch.column(2).take(pa.array(first))
            lengths = np.diff(lists.offsets.to_numpy())
            keys = lists.flatten()
            n = batch.column(1).to_numpy()[first]
            place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            keys = keys.to_numpy()
            wanted = np.zeros(len(keys), bool)
            if len(shared.value):
                at = np.minimum(np.searchsorted(shared.value, keys.view(np.uint64)), len(shared.value) - 1)
                wanted = shared.value[at] == keys.view(np.uint64)
            wanted = wanted == frequent
            columns = (keys, np.repeat(nodes, lengths), np.repeat(n << 32, lengths) | place)
            yield pa.RecordBatch.from_arrays([pa.array(c[wanted]) for c in columns], names=["key", "node", "packed"])

    return found.filter("node is not null").select("node", "n_shingles", "prefix").mapInArrow(run, "key long, node long, packed long")


def texts_of(docs: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """node and its compressed text, for the nodes and their documents in `chosen` (_doc, _key, node). An id that many texts
    share (null, for one) meets by the text's hash too, so each text is looked at for its own node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3, write_checksum=False)
        for batch in batches:
            z = [pack.compress(t.as_py() or b"") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(z, pa.binary())], names=["_doc", "_key", "_z"])

    def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (node, z) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                (own,) = _sets(z, unpack, size)
                if len(own):
                    first, second = names_of(own)
                    keep[i] = node in (first, first ^ second)
            yield batch.filter(pa.array(keep))

    given = docs.select(id_key().alias("_doc"), F.xxhash64("text").alias("_key"), F.col("text").cast("binary").alias("_text"))
    packed = given.mapInArrow(run, "_doc long, _key long, _z binary")
    # a hash can stand for several texts: the one of the node is kept, of repeated rows one
    joined = packed.join(chosen, ["_doc", "_key"]).select("node", "_z").mapInArrow(fitting, "node long, _z binary")
    return joined.dropDuplicates(["node"])


def _sets(z: pa.Scalar, unpack: zstandard.ZstdDecompressor, size: int) -> list[np.ndarray]:
    data = np.frombuffer(unpack.decompress(z.as_py()), np.uint8)
    return shingle_sets(data, np.array([0, len(data)]), size)


def measured(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """a, b, common, total: the sizes of intersection and union of two points' sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        last, left = None, np.zeros(0, np.uint64)
        for batch in batches:
            a = batch.column(0).to_pylist()
            common, total = [], []
            for i, (za, zb) in enumerate(zip(batch.column(2), batch.column(3))):
                if a[i] != last:
                    (left,) = _sets(za, unpack, size)
                    last = a[i]
                (right,) = _sets(zb, unpack, size)
                both = np.concatenate([left, right])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                common.append(same)
                total.append(len(both) - same)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(total, pa.int64())], names=["a", "b", "common", "total"])

    with_texts = (
        pairs.join(texts.select(F.col("node").alias("b"), F.col("_z").alias("_zb")), "b")
        .join(texts.select(F.col("node").alias("a"), F.col("_z").alias("_za")), "a")
        .select("a", "b", "_za", "_zb")
    )
    return with_texts.mapInArrow(run, "a long, b long, common long, total long")


#: Points of a region beyond which it is split into blocks, and points of a batch of regions.
BLOCK, BATCH = 20_000, 50_000
#: Points of a region up to which all regions with the same least point are dealt to one batch.
ONE_BATCH = 512
#: Shingles of a Voronoi cell's members, and of its visitors, beyond which they are split into blocks.
CELL = 100_000
#: Of a point with more shingles than this, about a fifth of so many regions are used to find pivots; else all.
FIRST = 48
_NEARBY = 32


def _allowed(i: np.ndarray, j: np.ndarray, c: dict[str, np.ndarray], percent: int) -> np.ndarray:
    """Whether two points of a region may be linked, by what is known of each.

    Sizes; the place of the shared shingle (only what follows it, and what is
    shared before it, can be in common); the whole prefix: of the two, the one
    whose prefix ends first can have in common no more than its shared shingles
    and what follows its prefix (`most`). Points of one cell meet there.
    """
    n, m = c["n"][i], c["n"][j]
    need = -(-percent * (n + m) // (100 + percent))
    most = np.where(c["end"][i] < c["end"][j], c["most"][i], np.where(c["end"][i] > c["end"][j], c["most"][j], np.maximum(c["most"][i], c["most"][j])))
    return (
        (c["component"][i] != c["component"][j])
        & (c["home"][i] != c["home"][j])
        & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        & (np.minimum(n - c["place"][i], m - c["place"][j]) >= need)
        & (most >= need)
    )


def crossing_pairs(region: np.ndarray, c: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Places of pairs of points of one region and two components that may be linked, in the columns that are returned with them; c
    holds node, n, place, end, most, component and the nearest pivot (home).

    Small regions are compared as they lie side by side; in a large one each
    point outside its largest component (every pair has one such end) meets all
    of the others.
    """
    order = np.argsort(region, kind="stable")
    region, c = region[order], {k: v[order] for k, v in c.items()}
    first = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]])) if len(region) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(region)))
    mixed = np.repeat(np.maximum.reduceat(c["component"], first) != np.minimum.reduceat(c["component"], first), size) if len(first) else np.zeros(0, bool)
    region, c = region[mixed], {k: v[mixed] for k, v in c.items()}
    first = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]])) if len(region) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(region)))
    small = np.repeat(size <= _NEARBY, size)
    found = []
    for d in range(1, int(size[size <= _NEARBY].max(initial=1))):
        i = np.flatnonzero(small[:-d] & (region[d:] == region[:-d]))
        i = i[_allowed(i, i + d, c, percent)]
        found.append((i, i + d))
    for low, count in zip(first[size > _NEARBY].tolist(), size[size > _NEARBY].tolist()):
        j = np.arange(low, low + count)
        _, of, sizes = np.unique(c["component"][j], return_inverse=True, return_counts=True)
        largest = int(np.argmax(sizes))
        for i in np.flatnonzero(of != largest).tolist():
            i_all = np.full(count, low + i)
            keep = ((of == largest) | (j > low + i)) & _allowed(i_all, j, c, percent)
            found.append((i_all[keep], j[keep]))
    left, right = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found) if found else ((), ())))
    return left, right, c


def crossing_visits(region: np.ndarray, c: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs that may be linked the point of the smaller cell, and the pivot whose cell it has to visit."""
    left, right, c = crossing_pairs(region, c, percent)
    goes = (c["points"][left] < c["points"][right]) | (c["points"][left] == c["points"][right]) & (c["home"][left] < c["home"][right])
    guest, host = np.where(goes, left, right), np.where(goes, right, left)
    visits = np.unique(np.stack([c["node"][guest], c["home"][host]], 1), axis=0)
    return visits[:, 0], visits[:, 1]


Points = tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]


class Joined(NamedTuple):
    """The points of all rows; of each node its component (a node) and the least id in it; the nodes that share a region; their texts."""

    found: DataFrame
    of_node: DataFrame
    chosen: DataFrame
    texts: DataFrame


class Postings:
    """Which of some sets hold each shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.count = len(sets)
        owner = np.repeat(np.arange(len(sets)), [len(own) for own in sets])
        values = np.concatenate([np.zeros(0, np.uint64), *sets])
        order = np.argsort(values, kind="stable")
        self.owner, values = owner[order], values[order]
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
        self.known, self.start = values[first], np.append(first, len(values))

    def common(self, mine: np.ndarray) -> np.ndarray:
        """How many shingles of `mine` each set holds."""
        if not len(self.known):
            return np.zeros(self.count, np.int64)
        at = np.minimum(np.searchsorted(self.known, mine), len(self.known) - 1)
        at = at[self.known[at] == mine]
        length = self.start[at + 1] - self.start[at]
        places = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(self.start[at], length)
        return np.bincount(self.owner[places], minlength=self.count)


def cell_links(visitors: Points, members: Points, percent: int) -> list[tuple[int, int]]:
    """Links that join the components of visitors and members of one Voronoi cell, found exactly; of each: node, component,
    distance to the pivot, set.

    Visitors are taken one by one; what they have in common with the members whose
    distance to the pivot differs by at most the radius is counted through postings of
    shingles. A point that is linked joins the other's component, so each
    component is linked once.
    """
    radius = (100 - percent) / 100 + 1e-6
    node, component, distance, sets = members
    order = np.argsort(distance, kind="stable")  # a window of distances is a range
    node, distance = node[order], distance[order]
    n = np.array([len(sets[i]) for i in order], np.int64)
    _, label = np.unique(np.concatenate([component[order], visitors[1]]), return_inverse=True)
    own, guest = label[: len(node)], label[len(node) :]
    label = np.arange(len(label))
    postings = Postings([sets[i] for i in order])
    out: list[tuple[int, int]] = []
    for u in range(len(visitors[0])):
        mine = visitors[3][u]
        low, high = (int(np.searchsorted(distance, visitors[2][u] + r, side)) for r, side in ((-radius, "left"), (radius, "right")))
        if low >= high:
            continue
        common = postings.common(mine)[low:high]
        linked = np.flatnonzero(100 * common >= percent * (len(mine) + n[low:high] - common)) + low
        for v in linked[label[own[linked]] != label[guest[u]]].tolist():
            x, y = label[guest[u]], label[own[v]]
            if x != y:
                label[label == max(x, y)] = min(x, y)
                a, b = int(visitors[0][u]), int(node[v])
                out.append((min(a, b), max(a, b)))
    return out


def in_blocks(members: DataFrame, visitors: DataFrame, texts: DataFrame, columns: list[str]) -> DataFrame:
    """Members and visitors of cells (home, node, n and the named columns) with their texts, dealt out in blocks of at most
    CELL shingles each: a member block and a visitor block meet in one group (home, _x, _y)."""
    blocks = F.ceil(F.sum("n") / CELL).cast("int")
    cells = visitors.groupBy("home").agg(blocks.alias("of_visitors")).join(members.groupBy("home").agg(blocks.alias("of_members")), "home")
    cells = written(cells, "cells")

    def dealt(points: DataFrame, own: str, other: str, visitor: bool) -> DataFrame:
        rows = points.join(cells, "home").withColumn("_own", F.pmod(F.xxhash64("node"), F.col(own))).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        x, y = ("_other", "_own") if visitor else ("_own", "_other")
        return rows.select("home", F.col(x).cast("int").alias("_x"), F.col(y).cast("int").alias("_y"), "node", *columns, F.lit(visitor).alias("visitor"))

    return dealt(members, "of_members", "of_visitors", False).union(dealt(visitors, "of_visitors", "of_members", True)).join(texts, "node")


def _sides(block: pa.Table, columns: list[str], size: int) -> list[Points]:
    """Visitors and members of a group of `in_blocks`: node, the named columns, sets."""
    unpack = zstandard.ZstdDecompressor()
    is_visitor = block.column("visitor").to_numpy()
    sides = []
    for side in (is_visitor, ~is_visitor):
        part = block.filter(pa.array(side))
        sides.append((*(part.column(c).to_numpy() for c in ("node", *columns)), [own for z in part.column("_z") for own in _sets(z, unpack, size)]))
    return sides


def joined_in_cells(members: DataFrame, visitors: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) of the visitors of cells with members of other components; of each point: home (the cell), node, component, distance, n."""
    columns = ["component", "distance"]

    def run(block: pa.Table) -> pa.Table:
        links = cell_links(*_sides(block, columns, size), percent)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return in_blocks(members, visitors, texts, columns).groupBy("home", "_x", "_y").applyInArrow(run, "a long, b long")


def counted_links(visitors: Points, members: Points, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """With how many documents of the members each visitor links, and of the visitors each member, where distances to the pivot do
    not tell; of each point: node, documents, `far` (as in `link_counts`), set. Members that are visitors elsewhere
    are not counted for here: they count for themselves."""
    limit = 10 * (100 - percent)
    node, documents, far, sets = members
    order = np.argsort(far, kind="stable")  # a window of distances is a range
    node, documents, far = node[order], documents[order], far[order]
    n = np.array([len(sets[i]) for i in order], np.int64)
    postings = Postings([sets[i] for i in order])
    inner = 2 * far <= limit
    of_visitors, of_members = np.zeros(len(visitors[0]), np.int64), np.zeros(len(node), np.int64)
    for u, (name, count, at, mine) in enumerate(zip(*visitors)):
        low = int(np.searchsorted(far, max(limit - at + 1, at - limit - 1), "left"))
        high = int(np.searchsorted(far, at + limit + 1, "right"))
        if low >= high:
            continue
        common = postings.common(mine)[low:high]
        linked = np.flatnonzero(100 * common >= percent * (len(mine) + n[low:high] - common)) + low
        linked = linked[node[linked] != name]
        of_visitors[u] = documents[linked].sum()
        of_members[linked[inner[linked]]] += count
    back = np.empty_like(of_members)
    back[order] = of_members
    return of_visitors, back


def link_counts(join: Joined, size: int, percent: int) -> DataFrame:
    """node, n_links: with how many other documents each document of a node links, for the nodes that link with any.

    Links lie within components. Each component has a pivot, its most central point, and `far` is a point's distance
    to it in thousandths, rounded up. Two points whose `far` together is at most the link's radius are linked (triangle inequality): those
    are counted by sums over distances, without a look at the pair. Two whose distances differ by more than the radius are not. All
    other pairs have an end beyond half of the radius; these ends visit their component, in blocks, and links are
    counted exactly. So cost grows with the square of the number of different texts beyond half of the radius, not of copies.
    """
    limit = 10 * (100 - percent)
    documents = join.found.filter("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("documents"))
    several = join.of_node.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("component")
    own = documents.filter("documents > 1").select("node", (F.col("documents") - 1).alias("n_links"))
    points = join.of_node.select("node", "component").join(several, "component").join(documents, "node").join(join.chosen.select("node", "n", "central"), "node")
    points = written(points.select("node", F.col("component").alias("home"), "documents", "n", "central"), "linked")
    pivots = points.groupBy("home").agg(F.max_by("node", F.struct("central", "node")).alias("p"))
    apart = measured(points.join(pivots, "home").filter("node <> p").select(F.col("p").alias("a"), F.col("node").alias("b")), join.texts, size)
    apart = apart.select(F.col("b").alias("node"), F.expr("(1000 * (total - common) + total - 1) div total").alias("far"))
    points = written(points.join(apart, "node", "left").select("home", "node", "documents", "n", F.coalesce("far", F.lit(0).cast("long")).alias("far")), "far")

    # at most limit + 1 sums a component, and as many sums of sums
    bins = points.filter(F.col("far") <= limit).groupBy("home", "far").agg(F.sum("documents").alias("documents"))
    others = bins.select("home", F.col("far").alias("_far"), F.col("documents").alias("_documents"))
    sure = bins.join(others, "home").filter(F.col("far") + F.col("_far") <= limit).groupBy("home", "far").agg(F.sum("_documents").alias("n_links"))
    itself = F.when(2 * F.col("far") <= limit, F.col("documents")).otherwise(0)
    sure = points.join(sure, ["home", "far"]).select("node", (F.col("n_links") - itself).alias("n_links"))

    outer = points.filter(2 * F.col("far") > limit)
    reach = outer.groupBy("home").agg(F.max("far").alias("_most"))
    members = points.join(reach, "home").filter(F.col("far") + F.col("_most") > limit).drop("_most")
    columns = ["documents", "far"]

    def run(block: pa.Table) -> pa.Table:
        visitors, others = _sides(block, columns, size)
        of_visitors, of_others = counted_links(visitors, others, percent)
        return pa.table({"node": np.concatenate([visitors[0], others[0]]), "n_links": np.concatenate([of_visitors, of_others])})

    counted = in_blocks(members, outer, join.texts, columns).groupBy("home", "_x", "_y").applyInArrow(run, "node long, n_links long").filter("n_links > 0")
    return own.union(sure).union(counted).groupBy("node").agg(F.sum("n_links").alias("n_links"))


def largest_component(points: DataFrame, key: str) -> DataFrame:
    """key and _largest, the component that most points of a group have, of the groups with several components."""
    counts = points.groupBy(key, "component").agg(F.count(F.lit(1)).alias("_n"))
    order = F.struct("_n", "component")
    return counts.groupBy(key).agg(F.max_by("component", order).alias("_largest"), F.count(F.lit(1)).alias("_several")).filter("_several > 1").select(key, "_largest")


def in_cells(of_point: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links within the Voronoi cells whose points are in several components: points outside a cell's largest component visit all of it."""
    mixed = written(of_point.join(largest_component(of_point, "home"), "home"), "mixed")
    return joined_in_cells(mixed, mixed.filter("component <> _largest"), texts, size, percent)


def joined(docs: DataFrame, size: int, percent: int) -> Joined:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent_shingles(docs, size))  # at most MOST_FREQUENT numbers
    found = distinct_names(written(points(docs, shared, size, percent), "points"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # regions that are not large and have one least point are dealt to one batch: most of their pairs are the same
    spot = F.when(F.col("_size") <= ONE_BATCH, F.col("_first")).otherwise(F.col("key")).alias("spot")

    def with_regions(rows: DataFrame, sent: bool) -> DataFrame:
        regions = rows.groupBy("key").agg(F.min("node").alias("_first"), F.max("node").alias("_last"), F.count(F.lit(1)).alias("_size")).filter("_first < _last")
        regions = regions.select("key", F.col("_size").alias("size"), spot)
        return rows.join(F.broadcast(regions) if sent else regions, "key").select("key", "node", "packed", "size", "spot")

    # rows of frequent shingles stay where they are: their regions, at most MOST_FREQUENT, are summed up and sent to them
    often = with_regions(written(entries(found, shared, True), "often"), True)
    members = written(with_regions(entries(found, shared, False).repartition(parts, "key"), False).union(often), "regions")
    n, place = F.shiftright("packed", 32), F.col("packed").bitwiseAND(0xFFFFFFFF)

    shared = members.groupBy("node").agg(F.count(F.lit(1)).alias("_shared"), F.sum("size").alias("_met"))
    named = found.filter("node is not null").groupBy("node").agg(F.min("_doc").alias("_doc"), F.min_by("_key", "_doc").alias("_key"), F.min("n_shingles").alias("n"), F.min("end").alias("end"))
    length = F.col("n") + 1 - F.ceil(percent * F.col("n") / 100)
    most = F.col("_shared") + F.col("n") - length
    chosen = written(named.join(shared, "node").select("node", "_doc", "_key", "n", "end", most.alias("most"), (F.col("_met") / length).alias("central")), "members")
    texts = written(texts_of(docs, chosen.select("_doc", "_key", "node"), size), "texts")
    linked = 100 * F.col("common") >= percent * F.col("total")

    # some regions of each point, chosen by hash and by a point's size (to a power of two): distances to their pivots
    # (the pivot is the most central point, that whose shingles the most points share; a trace of hash breaks ties)
    order = F.col("central") + F.pmod(F.xxhash64("node"), F.lit(1000)) / 1e7
    bits = F.greatest(F.lit(0), F.floor(F.log2(n / FIRST))).cast("int")
    some = F.xxhash64("key").bitwiseAND(F.shiftleft(F.lit(1).cast("long"), 40) - 1) % F.pow(F.lit(2.0), bits).cast("long") == 0
    early = members.filter(some).select("key", "node").join(chosen.select("node", order.alias("_order")), "node")
    pivots = early.groupBy("key").agg(F.max_by("node", "_order").alias("p"), F.min("node").alias("_first"), F.max("node").alias("_last")).filter("_first < _last").select("key", "p")
    stars = early.join(pivots, "key").filter("node <> p").select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b"), "p").distinct()
    sizes = chosen.select("node", "n")
    stars = stars.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("_na")), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("_nb")), "b")
    stars = stars.filter(100 * F.least("_na", "_nb") >= percent * F.greatest("_na", "_nb")).select("a", "b", "p")
    stars = written(stars, "pairs")
    near = written(measured(stars.select("a", "b").distinct(), texts, size), "stars")
    links = near.filter(linked).select("a", "b")
    first = components(links)

    # each point's nearest pivot, then the regions whose points are in several components
    known = near.withColumn("_d", (1 - F.col("common") / F.col("total")).cast("float")).join(stars, ["a", "b"])
    other = F.when(F.col("p") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    homes = known.select(other.alias("node"), F.col("p").alias("_home"), "_d").union(known.select("p", "p", F.lit(0.0).cast("float")))
    homes = homes.groupBy("node").agg(F.min_by("_home", "_d").alias("_home"), F.min("_d").alias("distance"))
    of_point = chosen.join(first, "node", "left").join(homes, "node", "left").select(
        "node", "n", "end", "most", F.coalesce("component", "node").alias("component"), F.coalesce("_home", "node").alias("home"), F.coalesce("distance", F.lit(0.0).cast("float")).alias("distance")
    )
    of_point = written(of_point, "cells")
    inner = written(in_cells(of_point, texts, size, percent), "inner")
    links = links.union(inner)
    # links of cells join components further
    of_point = written(of_point.drop("component").join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node")), "cells")
    cells = of_point.groupBy("home").agg(F.count(F.lit(1)).alias("points"), F.max("distance").alias("radius"), (F.min("component") < F.max("component")).alias("mixed"))
    of_point = written(of_point.join(cells, "home"), "points-in-cells")

    # boundary documents: which point has to visit which cell
    batches = max(parts, -(-members.count() // BATCH))
    met = members.join(of_point.select("node", "end", "most", "component", "home", "points"), "node")
    fields = ["region", "node", "packed", "end", "most", "component", "home", "points", "batch"]
    whole = met.filter(F.col("size") <= BLOCK).withColumn("region", F.col("key")).withColumn("batch", F.pmod(F.xxhash64("spot"), F.lit(batches))).select(*fields)
    # a large region in blocks: each point in one, those outside its largest component in all
    large = met.filter(F.col("size") > BLOCK).join(largest_component(met.filter(F.col("size") > BLOCK), "key"), "key")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    large = large.withColumn(
        "block", F.explode(F.when(F.col("component") == F.col("_largest"), F.array(F.pmod(F.xxhash64("node"), blocks).cast("int"))).otherwise(F.sequence(F.lit(0), blocks - 1)))
    )
    large = large.withColumn("region", F.xxhash64("key", "block")).withColumn("batch", F.pmod("region", F.lit(batches))).select(*fields)
    open_regions = whole.union(large).repartition(batches, "batch")

    def crossing(frame: pd.DataFrame) -> pd.DataFrame:
        c = {x: frame[x].to_numpy() for x in ("node", "end", "most", "component", "home", "points")}
        packed = frame["packed"].to_numpy()
        node, home = crossing_visits(frame["region"].to_numpy(), c | {"n": packed >> 32, "place": packed & 0xFFFFFFFF}, percent)
        return pd.DataFrame({"node": node, "home": home})

    ends = (F.least("node", "home").alias("a"), F.greatest("node", "home").alias("b"))
    visits = written(open_regions.groupBy("batch").applyInPandas(crossing, "node long, home long").distinct().select("node", "home", *ends), "visits")
    more = written(measured(visits.select("a", "b").distinct().join(near.select("a", "b"), ["a", "b"], "left_anti"), texts, size), "more")
    links = links.union(more.filter(linked).select("a", "b"))
    # a replicated document joins the members in its window; of a cell in one component that it is linked with there is nothing more to find
    apart = (1 - F.col("common") / F.col("total")).cast("float")
    guests = visits.join(more.union(near.select("a", "b", "common", "total")).withColumn("distance", apart), ["a", "b"])
    guests = guests.join(of_point.select("node", "n", "component"), "node").join(cells, "home")
    radius = (100 - percent) / 100 + 1e-6
    guests = guests.filter((F.col("points") > 1) & (F.col("mixed") | ~linked) & (F.col("distance") <= F.col("radius") + radius))
    guests = written(guests.select("home", "node", "component", "distance", "n"), "guests")
    nearest = guests.groupBy("home").agg(F.min("distance").alias("_from"), F.max("distance").alias("_to"))
    hosts = of_point.join(nearest, "home").filter((F.col("distance") >= F.col("_from") - radius) & (F.col("distance") <= F.col("_to") + radius))
    labels = components(links.union(written(joined_in_cells(hosts, guests, texts, size, percent), "replicated")))

    of_node = written(found.filter("node is not null").groupBy("node").agg(F.min("_doc").alias("_least")).join(labels, "node", "left").select("node", "_least", F.coalesce("component", "node").alias("component")), "nodes")
    least = of_node.groupBy("component").agg(F.min("_least").alias("_id"))
    return Joined(found, written(of_node.join(least, "component").select("node", "component", "_id"), "ids"), chosen, texts)


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (other rows that it links with) of every row; `_doc` stands for doc_id without nulls."""
    join = joined(docs, size, percent)
    of_node = join.of_node.select("node", "_id").join(link_counts(join, size, percent), "node", "left")
    return (
        join.found.select("doc_id", "_doc", "n_shingles", "node")
        .join(of_node, "node", "left")
        .select("doc_id", "_doc", "n_shingles", F.coalesce("_id", "_doc").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    )


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", F.when(F.col("component_id") != NULL_ID, F.col("component_id")).alias("component_id"), "n_links")


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of every component: that with the least id, of several with that id one text's, of repeated rows one. Rows without
    words link with nothing and all stay. A null doc_id is the least. Other columns, whatever their names, pass through."""
    found, of_node, *_ = joined(docs, size, percent)
    least = found.join(of_node.select("node", "component"), "node").groupBy("component").agg(F.min(F.struct("_doc", "node", "_key")).alias("_k"))
    copies = found.filter("node is not null").groupBy("_doc", "_key").agg(F.count(F.lit(1)).alias("_n"))
    kept = least.select("_k._doc", "_k._key").join(copies, ["_doc", "_key"]).union(found.filter("node is null").select("_doc", "_key", F.lit(1).cast("long")).distinct())
    kept = written(kept, "kept")
    rows = docs.select(id_key().alias("_doc"), F.xxhash64("text").alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    out = rows.join(kept.filter("_n = 1"), ["_doc", "_key"], "left_semi")
    if not kept.filter("_n > 1").isEmpty():
        out = out.union(rows.join(kept.filter("_n > 1"), ["_doc", "_key"], "left_semi").dropDuplicates(["_doc", "_key"]))
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
