"""Suffix-array dedup on bytes by a depth-limited radix sort.

Suffixes are sorted only through the first `WINDOW` bytes, most significant
digit first, a digit being eight bytes: after each pass a suffix that shares its
group with no other drops out, and what is still grouped after the last pass are
exactly the repeated windows. `repeats` tells how suffixes come together.

Of equal windows the one that starts first (smaller doc_id, then earlier start)
stays; every byte of the others is covered. Windows are judged on the input.

Null and empty texts: no bytes. Repeated rows of one doc_id with the same text
count as one document: neither is earlier, so both keep the same. A null doc_id
stands before all others. Other columns pass through `remove_later_copies`
untouched; there a character stays whole unless all its bytes are covered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .repeats import Kind, digest, without_repeats

WINDOW = 100
GRAM = 20
#: Windows of a group that are refined at a time, about.
WINDOWS = 1_000_000
_U = np.uint64


def refine(node: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One more radix pass: the places that share node and digit with another, in order, and their new nodes."""
    order = np.lexsort((digit, node))
    a, b = node[order], digit[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    ids = np.cumsum(new) - 1
    many = np.bincount(ids, minlength=0)[ids] > 1
    return order[many], ids[many]


def digits(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Eight bytes as a number at each place of the contexts put in a row, and where each context begins."""
    flat = np.frombuffer(b"".join(contexts) + bytes(16), np.uint8).astype(np.uint64)
    begin = np.cumsum([0] + [len(c) for c in contexts])
    for places in (1, 2, 4):  # two arrays at a time
        wider = flat << _U(8 * places)
        wider[:-places] |= flat[places:]
        flat = wider
    return flat, begin


def equal_windows(kind: Kind, so: np.ndarray, eo: np.ndarray, contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, window and group of the windows that two classes share.

    The windows with their anchors at one offset are a node; a node is split by the next digit of its
    windows, and windows alone in a node are left, until the depth is that of a
    window. Windows at other offsets never meet, so offsets are taken a few at a
    time where there are many windows.
    """
    digit, begin = digits(contexts)
    low, high = int(eo.min()), int(so.max())
    step = max(1, (high - low + 1) * WINDOWS // max(1, int((so - eo + 1).sum())))
    parts, groups = [], 0
    for first in range(low, high + 1, step):
        a, b = np.maximum(eo, first), np.minimum(so, first + step - 1)  # offsets from the anchor
        count = np.maximum(b - a + 1, 0)
        which = np.repeat(np.arange(len(so)), count)
        off = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(so - b, count)
        kept, node = refine(np.zeros(len(which), np.int64), (so[which] - off).astype(np.uint64))
        which, off = which[kept], off[kept]
        depth = 0
        while depth < kind.window and len(which):
            depth = min(depth, kind.window - 8) if kind.window >= 8 else 0
            kept, node = refine(node, digit[begin[which] + off + depth] if kind.window >= 8 else digit[begin[which] + off] >> _U(64 - 8 * kind.window))
            which, off = which[kept], off[kept]
            depth += 8
        if len(which):
            parts.append((which, off, node + groups))
            groups += int(node.max()) + 1
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (none, none, none)


def later_windows(kind: Kind, rank: np.ndarray, so: np.ndarray, eo: np.ndarray, contexts: list[bytes]) -> np.ndarray:
    """Of each class and window 1 if a class that occurs earlier holds it too."""
    which, off, node = equal_windows(kind, so, eo, contexts)
    out = np.zeros((len(contexts), kind.offsets), np.uint8)
    if len(which):
        heads = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        least = np.minimum.reduceat(rank[which], heads)[np.cumsum(np.concatenate([[0], node[1:] != node[:-1]]))]
        later = rank[which] != least
        out[which[later], off[later]] = 1
    return out


def kind(window: int = WINDOW, gram: int = GRAM) -> Kind:
    return Kind(words=False, window=window, gram=min(gram, window), keep_first=True, find=later_windows)


def _digest(text: bytes, found) -> tuple:
    cover = found.cover()
    if cover is None:
        return len(text), 0, 0, digest(text)
    spans = int(cover[0]) + int((cover[1:] & ~cover[:-1]).sum())
    return len(text), int(cover.sum()), spans, digest(np.frombuffer(text, np.uint8)[~cover].tobytes())


def repeat_digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    out = without_repeats(docs.select("doc_id", "text"), kind(window, gram), _digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", [pa.int64()] * 3 + [pa.string()])
    return out.select("_row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _text(text: bytes, found) -> tuple:
    cover = found.cover()
    if cover is None:
        return (text.decode("utf-8", "replace"),)
    data = np.frombuffer(text, np.uint8)
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    if len(heads) and heads[0] == 0:
        gone = np.logical_and.reduceat(cover, heads)
        cover = np.repeat(gone, np.diff(np.append(heads, len(data))))
    return (data[~cover].tobytes().decode("utf-8", "replace"),)


def remove_later_copies(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The documents without later copies of passages; n_chars, if there, follows the text. A null text becomes empty."""
    out = without_repeats(docs, kind(window, gram), _text, "text string", [pa.string()])
    out = out.select(*[f"_row.`{c}`" if c != "text" else c for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir, "documents"))
