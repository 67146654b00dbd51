"""Windows of a fixed number of symbols that occur more than once: how the two substring operators bring them together.

Shuffling every suffix of a corpus costs many times its size, so suffixes are
brought together by anchors. In each window of W symbols the run of k symbols
with the least hash is its anchor: the choice depends on the window's content
alone, so equal windows have their anchors at the same offset, and one in about
(W - k) / 2 places is an anchor. Every window belongs to one anchor.

1. `anchors`: per document, anchors with the windows that belong to them.
2. Anchors whose run of symbols occurs once are dropped (counts are summed
   before the shuffle; the list of repeated runs is a written table, so that the
   join with it can be split where one run is very frequent).
   Of equal texts one goes on; all windows of the others are known to be repeated.
3. An anchor's windows are taken in bands of neighbouring offsets; what all windows of a
   band hold, whatever document they are from, is the band's core. The context of a band
   are the symbols that its windows span. Equal contexts are one class, merged within each
   task before they are dealt out.
4. Classes are dealt by the core into groups of bounded size. A run that occurs up to `HOT` times has one band
   for all offsets, and its core is the run itself; for more frequent runs bands are narrower and
   cores longer, up to single windows, whose core is the whole window, so that the part
   which must agree grows with the count. In each group the operator's own method finds the windows
   that classes share (radix passes or suffix trees).
5. Each class's verdict goes back to its occurrences and from there to the
   documents, whose texts crossed the shuffle compressed, once.

Equality of windows is that of the symbols themselves; hashes choose anchors, deal
out work, name classes (128 bits) and tell equal whole texts (128 bits).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _STEP, BYTE_CODES, gram_hashes, id_key, mix64, row_slices, text_bytes, words_of, written

_U = np.uint64
_SEGMENT = 1 << 21
_PLACE = _U((1 << 22) - 1)
_LEVEL = 60
#: Occurrences of a run of k symbols up to which its windows go together; each further level of bands begins at STEP times as many.
HOT, STEP = 20_000, 10
#: Anchors in a group, about.
GROUP = 30_000


@dataclass(frozen=True)
class Kind:
    """words: symbols are words, else bytes. keep_first: a window that occurs for the first time stays.

    find(kind, rank, so, eo, contexts) tells of each class and window whether another class holds it too (before, with
    keep_first): a matrix of bytes, 0 for no. so and eo are the offsets of the anchor in the first and
    the last window of a context, rank the order of the classes' first occurrences. The bytes are kept with
    words; with bytes as symbols, only whether they are 0.
    """

    words: bool
    window: int
    gram: int
    keep_first: bool
    find: Callable[..., np.ndarray]

    def __post_init__(self):
        if not 0 < self.gram <= self.window or self.window - self.gram > 254:
            raise ValueError("the anchor must fit its window, with at most 254 places in it")

    @property
    def offsets(self) -> int:
        return self.window - self.gram + 1

    @property
    def bands(self) -> tuple[int, ...]:
        """Offsets in a band, by level."""
        n = self.offsets
        return (n, -(-n // 2), -(-n // 5), 1)


def winnow(symbols: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, anchor, first and last window of each anchor (places within the row) and the hash of its symbols."""
    out: list[list[np.ndarray]] = []
    row_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for low in range(0, max(0, len(symbols) - window + 1), _SEGMENT):
        grams = gram_hashes(symbols[low : low + _SEGMENT + window - 1], gram)
        least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        width, length = window - gram + 1, 1
        n = len(least) - width + 1
        while 2 * length <= width:
            least = np.minimum(least[:-length], least[length:])
            length *= 2
        chosen = np.minimum(least[:n], least[width - length : width - length + n]) & _PLACE
        rows = row_of[low : low + n]
        fits = np.flatnonzero(bounds[rows + 1] - np.arange(low, low + n) >= window)
        if not len(fits):
            continue
        at = chosen[fits].astype(np.int64)
        new = np.ones(len(fits), bool)
        new[1:] = (at[1:] != at[:-1]) | (fits[1:] != fits[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(fits)) - 1
        begin = bounds[rows[fits[first]]] - low
        out.append([rows[fits[first]], at[first] - begin, fits[first] - begin, fits[last] - begin, grams[at[first]]])
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def anchors(docs: DataFrame, kind: Kind) -> DataFrame:
    """_gram, _doc, _packed (anchor << 16 | anchor - first window << 8 | anchor - last window)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = text_bytes(batch.column(1))
            for i, j in row_slices(offsets):
                part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                if kind.words:
                    starts, _, symbols = words_of(part, bounds[:-1])
                    bounds = np.searchsorted(starts, bounds)
                else:
                    symbols = BYTE_CODES[part]
                row, at, first, last, gram = winnow(symbols, bounds, kind.window, kind.gram)
                if len(row):
                    packed = at << 16 | (at - first) << 8 | (at - last)
                    yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(ids[i + row]), pa.array(packed)], names=["_gram", "_doc", "_packed"])

    return docs.select(id_key().alias("_doc"), F.col("text").alias("_text")).mapInArrow(run, "_gram long, _doc long, _packed long")


def compressed(docs: DataFrame) -> DataFrame:
    """_doc, _row (all columns but text), _th (a hash of the text) and _z, the text."""
    others = [c for c in docs.columns if c != "text"]
    given = docs.select(id_key().alias("_doc"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), F.xxhash64("text").alias("_th"), F.col("text").cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3, write_checksum=False)
        for batch in batches:
            z = pa.array([None if (t := x.as_py()) is None else pack.compress(t) for x in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], z], names=["_doc", "_row", "_th", "_z"])

    return given.mapInArrow(run, f"_doc long, _row {given.schema['_row'].dataType.simpleString()}, _th long, _z binary")


def copies(docs: DataFrame) -> DataFrame:
    """_doc with _same, the hashes of its texts that other documents have too, and _later, those that a smaller id has.

    Texts are held equal by 128 bits of hash. Every window of such a text occurs
    elsewhere, so it needs no search, and one copy stands for all in it.
    """
    ids = docs.select(id_key().alias("_doc"), F.xxhash64("text").alias("_th"), F.xxhash64(F.lit(1), "text").alias("_th2"))
    several = written(ids.groupBy("_th", "_th2").agg(F.min("_doc").alias("_low"), F.max("_doc").alias("_high")).filter("_low < _high"), "copies")
    found = ids.join(several, ["_th", "_th2"])
    return found.groupBy("_doc").agg(F.collect_set("_th").alias("_same"), F.collect_set(F.when(F.col("_doc") > F.col("_low"), F.col("_th"))).alias("_later"))


def _opened(z: pa.Scalar, unpack: zstandard.ZstdDecompressor) -> bytes:
    z = z.as_py()
    return b"" if z is None else unpack.decompress(z)


def _occurrences(batch: pa.RecordBatch, kind: Kind) -> Iterator[tuple]:
    """(gram, doc, anchor, anchor - first, anchor - last, context, core or None, hash of the text) of each band of the marked anchors."""
    unpack = zstandard.ZstdDecompressor()
    powers = np.array([pow(_STEP, kind.gram - 1 - i, 2**64) for i in range(kind.gram)], np.uint64)
    steps = np.arange(kind.gram)
    window, words = kind.window, kind.words
    docs, hashes = batch.column("_doc").to_pylist(), batch.column("_th").to_pylist()
    for doc, th, marked, z in zip(docs, hashes, batch.column("_marked"), batch.column("_z")):
        text = _opened(z, unpack)
        packed = np.unique(marked.values.to_numpy())
        level, packed = packed >> _LEVEL, packed & ((1 << _LEVEL) - 1)
        at, first, last = packed >> 16, (packed >> 16) - (packed >> 8 & 255), (packed >> 16) - (packed & 255)
        if words:
            text = b" ".join(text.split())
            starts, ends, symbols = words_of(np.frombuffer(text, np.uint8), np.zeros(1, np.int64))
        else:
            symbols = BYTE_CODES[np.frombuffer(text, np.uint8)]
            starts = ends = None
        # a repeated doc_id with other text can bring places that this text does not have
        fine = (first >= 0) & (last >= first) & (last + window <= len(symbols)) & (at + kind.gram <= len(symbols))
        at, first, last, level = at[fine], first[fine], last[fine], level[fine]
        if not len(at):
            continue
        grams = mix64((symbols[at[:, None] + steps] * powers).sum(1, dtype=np.uint64)).view(np.int64).tolist()
        for g, a, p, q, v in zip(grams, at.tolist(), first.tolist(), last.tolist(), level.tolist()):
            if not v:
                context = text[starts[p] : ends[q + window - 1]] if words else text[p : q + window]
                yield g, doc, a, a - p, a - q, context, None, th
                continue
            wide = kind.bands[v]
            for band in range((a - q) // wide, (a - p) // wide + 1):
                low, high = max(a - q, band * wide), min(a - p, band * wide + wide - 1)  # offsets of the band that this anchor has
                r, e = a - band * wide, a - min(band * wide + wide, kind.offsets) + 1 + window  # what every window of the band holds
                context = text[starts[a - high] : ends[a - low + window - 1]] if words else text[a - high : a - low + window]
                yield g, doc, a, high, low, context, text[starts[r] : ends[e - 1]] if words else text[r:e], th


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _class_hash(so: int, eo: int, context: bytes) -> int:
    return _signed(xxhash.xxh3_64_intdigest(context, seed=so << 8 | eo))


def _core_hash(gram: int, core: bytes) -> int:
    return xxhash.xxh3_64_intdigest(core, seed=gram % (1 << 64))


def classes(marked: DataFrame, kind: Kind, groups: int) -> DataFrame:
    """Per group and batch, compressed: classes of equal contexts, their first occurrence, whether there is another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3, write_checksum=False)
        for batch in batches:
            own: dict[tuple, list] = {}
            for g, doc, a, so, eo, context, core, _ in _occurrences(batch, kind):
                key = (g, so, eo, context)
                had = own.get(key)
                if had is None:
                    own[key] = [doc, a, False, core]
                elif (doc, a) != (had[0], had[1]):
                    had[2] = True
                    if (doc, a) < (had[0], had[1]):
                        had[0], had[1] = doc, a
            dealt: dict[int, list] = {}
            for (g, so, eo, context), (doc, a, again, core) in own.items():
                h = (g if core is None else _core_hash(g, core)) % (1 << 64) % groups
                dealt.setdefault(h, []).append((g, so << 8 | eo, doc, a, again, context))
            if dealt:
                blobs = [pack.compress(_blob(rows)) for rows in dealt.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(dealt), pa.int64()), pa.array(blobs, pa.binary())], names=["_group", "_blob"])

    return marked.mapInArrow(run, "_group long, _blob binary")


_BLOB = (("gram", np.int64), ("span", np.uint16), ("doc", np.int64), ("at", np.int64), ("again", np.bool_), ("length", np.int64))


def _blob(rows: list[tuple]) -> bytes:
    *columns, contexts = zip(*rows)
    columns.append([len(c) for c in contexts])
    return b"".join([np.int64(len(rows)).tobytes(), *(np.array(c, t).tobytes() for c, (_, t) in zip(columns, _BLOB)), *contexts])


def _rows(blobs: list[bytes]) -> tuple[dict[str, np.ndarray], list[bytes]]:
    """The columns of all blobs of a group, and the contexts."""
    unpack = zstandard.ZstdDecompressor()
    parts: dict[str, list] = {name: [] for name, _ in _BLOB}
    contexts: list[bytes] = []
    for z in blobs:
        data = unpack.decompress(z)
        n, at = int(np.frombuffer(data, np.int64, 1)[0]), 8
        for name, t in _BLOB:
            parts[name].append(np.frombuffer(data, t, n, at))
            at += n * np.dtype(t).itemsize
        for length in parts["length"][-1].tolist():
            contexts.append(data[at : at + length])
            at += length
    return {name: np.concatenate(x) for name, x in parts.items()}, contexts


def occurrences(marked: DataFrame, kind: Kind) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(g, _class_hash(so, eo, c), doc, a << 16 | so << 8 | eo, th >> 32) for g, doc, a, so, eo, c, _, th in _occurrences(batch, kind)]
            if rows:
                kinds = [pa.int64()] * 4 + [pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["_gram", "_class", "_doc", "_packed", "_t"])

    return marked.mapInArrow(run, "_gram long, _class long, _doc long, _packed long, _t int")


def verdicts(dealt: DataFrame, kind: Kind) -> DataFrame:
    """Of each class: which of its windows occur elsewhere (before, with keep_first), its first occurrence, whether there is another."""

    def run(group: pa.Table) -> pa.Table:
        given, contexts = _rows(group.column("_blob").to_pylist())
        ids: dict[bytes, int] = {}
        content = np.array([ids.setdefault(c, len(ids)) for c in contexts], np.int64)
        gram, span, doc, at, again = (given[c] for c in ("gram", "span", "doc", "at", "again"))
        order = np.lexsort((at, doc, content, span, gram))
        gram, span, doc, at, again, content = (x[order] for x in (gram, span, doc, at, again, content))
        new = np.ones(len(order), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (span[1:] != span[:-1]) | (content[1:] != content[:-1])
        first = np.flatnonzero(new)
        run_of = np.cumsum(new) - 1
        again = np.logical_or.reduceat(again | (doc != doc[first][run_of]) | (at != at[first][run_of]), first)
        gram, span, doc, at = (x[first] for x in (gram, span, doc, at))
        so, eo = span.astype(np.int64) >> 8, span.astype(np.int64) & 255
        flags = np.zeros((len(first), kind.offsets), np.uint8)
        _, of, size = np.unique(gram, return_inverse=True, return_counts=True)
        several = np.flatnonzero(size[of] > 1)
        if len(several):
            rank = np.empty(len(first), np.int64)
            rank[np.lexsort((at, doc))] = np.arange(len(first))
            flags[several] = kind.find(kind, rank[several], so[several], eo[several], [contexts[order[first[i]]] for i in several])
        told = np.flatnonzero(again | flags.any(1))
        masks = flags[told] if kind.words else np.packbits(flags[told] > 0, axis=1)
        return pa.table(
            {
                "_gram": gram[told],
                "_class": pa.array([_class_hash(int(so[i]), int(eo[i]), contexts[order[first[i]]]) for i in told], pa.int64()),
                "_mask": pa.array([m.tobytes() for m in masks], pa.binary()),
                "_first_doc": doc[told],
                "_first_at": at[told].astype(np.int64),
                "_again": again[told],
            }
        )

    return dealt.groupBy("_group").applyInArrow(run, "_gram long, _class long, _mask binary, _first_doc long, _first_at long, _again boolean")


def repeated(docs: DataFrame, kind: Kind) -> DataFrame:
    """_doc, _row, _z of every row; _found: its anchors (packed) with the mask of their repeated windows, null for all; _copied: all windows are repeated."""
    n = F.count(F.lit(1)).alias("_n")
    counts = written(anchors(docs, kind).groupBy("_gram").agg(n).filter("_n > 1"), "grams")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    groups = max(1, -(-total // GROUP))
    level = F.when(F.col("_n") <= HOT, 0).when(F.col("_n") <= HOT * STEP, 1).when(F.col("_n") <= HOT * STEP * STEP, 2).otherwise(3)
    packed = F.col("_packed") + F.shiftleft(level.cast("long"), _LEVEL)
    per_doc = anchors(docs, kind).join(counts, "_gram").groupBy("_doc").agg(F.collect_list(packed).alias("_marked"))
    texts = compressed(docs).join(copies(docs), "_doc", "left")
    marked = texts.join(per_doc, "_doc").filter(~F.coalesce(F.array_contains("_later", F.col("_th")), F.lit(False)))
    told = verdicts(classes(marked, kind, groups), kind)
    if kind.keep_first:
        whole = (F.col("_doc") != F.col("_first_doc")) | (F.shiftright("_packed", 16) != F.col("_first_at"))
    else:
        whole = F.col("_again")
    found = (
        occurrences(marked, kind)
        .join(told, ["_gram", "_class"])
        .select("_doc", "_packed", "_t", F.when(whole, F.lit(None)).otherwise(F.col("_mask")).alias("_mask"))
        .groupBy("_doc")
        .agg(F.collect_list(F.struct("_packed", "_t", "_mask")).alias("_found"))
    )
    copied = F.coalesce(F.array_contains("_later" if kind.keep_first else "_same", F.col("_th")), F.lit(False))
    return texts.join(found, "_doc", "left").withColumn("_copied", copied)


@dataclass(frozen=True)
class Found:
    """What is known of one text of n symbols with the hash th: its anchors' bands and their masks, or that all of it is a copy."""

    kind: Kind
    n: int
    th: int
    bands: pa.Scalar
    copied: bool

    def _bands(self) -> tuple[np.ndarray, np.ndarray, list]:
        """First and last window and the mask (None: all) of the bands that are of this text."""
        if self.copied or not self.bands.is_valid or not len(self.bands.values):
            none = np.zeros(0, np.int64)
            return none, none, []
        packed = self.bands.values.field("_packed").to_numpy()
        own = self.bands.values.field("_t").to_numpy() == self.th >> 32  # a repeated doc_id can stand for other texts too
        at = packed >> 16
        first, last = at - (packed >> 8 & 255), at - (packed & 255)
        fits = np.flatnonzero(own & (first >= 0) & (last + self.kind.window <= self.n))
        masks = self.bands.values.field("_mask").to_pylist()
        return first[fits], last[fits], [masks[i] for i in fits]

    def _mask(self, mask: bytes) -> np.ndarray:
        own = np.frombuffer(mask, np.uint8)
        return own if self.kind.words else np.unpackbits(own)

    def cover(self) -> np.ndarray | None:
        """Which symbols lie in a repeated window; None for none."""
        window = self.kind.window
        if self.copied:
            return np.ones(self.n, bool) if self.n >= window else None
        first, last, masks = self._bands()
        if not masks:
            return None
        step = np.zeros(self.n + 1, np.int32)
        whole = np.array([m is None for m in masks])
        np.add.at(step, first[whole], 1)
        np.add.at(step, last[whole] + window, -1)
        for i in np.flatnonzero(~whole):
            for p in np.flatnonzero(self._mask(masks[i])):
                step[first[i] + p] += 1
                step[first[i] + p + window] -= 1
        cover = np.cumsum(step[:-1]) > 0
        return cover if cover.any() else None

    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each start the length of the longest repeat seen there (0: none), and whether it reaches the end of what was seen."""
        length, open_end = np.zeros(self.n + 1, np.int64), np.zeros(self.n + 1, bool)
        window = self.kind.window
        if self.copied:
            length[: max(0, self.n - window + 1)] = self.n - np.arange(max(0, self.n - window + 1))
            return length, open_end
        for p, q, mask in zip(*self._bands()):
            at = np.arange(p, q + 1)
            seen = q + window - at
            own = seen if mask is None else (lambda m: np.where(m > 0, m + window - 1, 0))(self._mask(mask)[: len(at)].astype(np.int64))
            length[at], open_end[at] = own, own == seen
        return length, open_end


def without_repeats(docs: DataFrame, kind: Kind, make: Callable[[bytes, Found], tuple], fields: str, types: list[pa.DataType]) -> DataFrame:
    """`_row` and what `make` gives for each text (its words, or its bytes) and what was found of it."""
    found = repeated(docs, kind).select("_row", "_th", "_z", "_found", "_copied")
    row_type = found.schema["_row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for th, z, f, c in zip(batch.column("_th").to_pylist(), batch.column("_z"), batch.column("_found"), batch.column("_copied")):
                text = _opened(z, unpack)
                symbols = text.split() if kind.words else text
                out.append(make(symbols, Found(kind, len(symbols), th, f, c.as_py())))
            columns = list(zip(*out)) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *(pa.array(c, t) for c, t in zip(columns, types))], names=["_row", *(f.split()[0] for f in fields.split(", "))])

    return found.mapInArrow(run, f"_row {row_type}, {fields}")


def kept_words(words: list[bytes], cover: np.ndarray | None) -> list[bytes]:
    return words if cover is None else list(compress(words, ~cover))


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
