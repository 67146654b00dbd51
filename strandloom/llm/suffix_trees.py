"""Substring dedup on words by prefix-partitioned suffix trees.

Suffixes are the window starts of all documents. They are split into groups of bounded size
by prefixes of variable length, twice: over the cluster by words that all windows of
an anchor hold (`repeats`: the more often a run of words occurs, the longer the
part that must agree), and within a task by their own first words, lengthened word by word
until at most `SUFFIXES` share a prefix. For each prefix a suffix tree is grown top down
(`SuffixTree`): edges are labelled with runs of words, an internal node is a run of
words that is followed by different words, a leaf is a suffix. An internal node as deep
as a window or deeper is a repeat, and the leaves below it are its occurrences; the depth of
a leaf's parent is the length of the longest repeat that starts there.

All words of all copies of a repeat are covered, the first included. `maximal_repeats` gives
the repeats themselves: from each start the longest, without those that lie in another. A tree sees a
suffix up to the end of its anchor's last window; a repeat that reaches that end is
carried on by the repeat that starts a window less one word before it.

Null, empty and short texts have no window and lose nothing. Rows that repeat a
doc_id count as the same place where place and words agree, so a plain repeated
row is no repeat of itself. Null doc_ids count as one document id. Other columns
pass through `remove_repeats` untouched. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .repeats import Kind, digest, kept_words, without_repeats

WINDOW = 35
GRAM = 6
#: Suffixes that a task holds in one tree at most, unless more share a whole window.
SUFFIXES = 400_000
_U = np.uint64


class SuffixTree:
    """A suffix tree of chosen suffixes of several texts, grown level by level for all nodes at once.

    Node 0 is the root. Of each other node: its parent, its depth (words from the root),
    and the place of one suffix through it, so that its edge's label is
    `symbols[place + depth of parent : place + depth]`. `leaf_parent` is the parent of each suffix's leaf.
    """

    def __init__(self, texts: list[np.ndarray], starts: np.ndarray, most: int = SUFFIXES, window: int = WINDOW):
        """texts: numbers from 0; starts: places in the texts put in a row, each followed by an end sign of its own."""
        n = max((int(t.max()) + 1 for t in texts if len(t)), default=0)
        self.symbols = np.concatenate([np.concatenate([t, [n + i]]) for i, t in enumerate(texts)] or [np.zeros(0, np.int64)]).astype(np.int64)
        pairs = self.symbols.astype(np.uint64) << _U(32)
        pairs[:-1] |= self.symbols[1:].astype(np.uint64)
        self.pairs = np.append(pairs, _U(0))
        self.starts = starts
        self.parent, self.depth, self.place = [-1], [0], [-1]
        self.leaf_parent = np.zeros(len(starts), np.int64)
        for groups in self.batches(most, window):
            self._grow(groups)
        self.parent, self.depth, self.place = (np.array(x) for x in (self.parent, self.depth, self.place))

    def batches(self, most: int, window: int) -> Iterator[list[tuple[int, np.ndarray]]]:
        """Prefixes (their lengths and their suffixes) that at most `most` suffixes share, packed into batches of as many."""
        pending, batch, held = [(0, np.arange(len(self.starts)))], [], 0
        while pending:
            depth, rows = pending.pop()
            if not depth or len(rows) > most and depth < window:
                after = self.symbols[self.starts[rows] + depth]
                order = np.argsort(after, kind="stable")
                cuts = np.flatnonzero(np.diff(after[order])) + 1
                pending += [(depth + 1, part) for part in np.split(rows[order], cuts)]
                continue
            if batch and held + len(rows) > most:
                yield batch
                batch, held = [], 0
            batch.append((depth, rows))
            held += len(rows)
        if batch:
            yield batch

    def _grow(self, groups: list[tuple[int, np.ndarray]]) -> None:
        """The subtrees of some prefixes. Every open node is a run of suffixes that agree in its depth so far."""
        groups = [g for g in groups if len(g[1]) > 1]
        rows = np.concatenate([np.zeros(0, np.int64), *(r for _, r in groups)])
        size = np.array([len(r) for _, r in groups], np.int64)
        depth = np.array([d for d, _ in groups], np.int64)
        parent = np.zeros(len(groups), np.int64)
        while len(size):
            head = np.cumsum(size) - size
            at = self.starts[rows] + np.repeat(depth, size)
            two = self.pairs[at]
            same = np.logical_and.reduceat(two == np.repeat(two[head], size), head)
            depth[same] += 2
            if same.all():
                continue
            # nodes whose suffixes part ways here, after one more common word or at once
            one = two >> _U(32)
            common = np.logical_and.reduceat(one == np.repeat(one[head], size), head)
            depth[~same & common] += 1
            new = np.flatnonzero(~same)
            ids = len(self.parent) + np.arange(len(new))
            self.parent += parent[new].tolist()
            self.depth += depth[new].tolist()
            self.place += self.starts[rows[head[new]]].tolist()
            open_rows = np.repeat(~same, size)
            own, node = rows[open_rows], np.repeat(ids, size[new])
            after = self.symbols[self.starts[own] + np.repeat(depth[new], size[new])]
            order = np.lexsort((after, node))
            own, node, after = own[order], node[order], after[order]
            first = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (after[1:] != after[:-1])]))
            count = np.diff(np.append(first, len(own)))
            single = np.repeat(count == 1, count)
            self.leaf_parent[own[single]] = node[single]
            many = count > 1
            rows = np.concatenate([rows[~open_rows], own[~single]])
            above = node[first[many]]
            depth = np.concatenate([depth[same], depth[new][above - ids[0]]])
            parent = np.concatenate([parent[same], above])
            size = np.concatenate([size[same], count[many]])

    def label(self, node: int) -> np.ndarray:
        """The words on the edge that leads to a node."""
        p = self.place[node]
        return self.symbols[p + self.depth[self.parent[node]] : p + self.depth[node]]

    def deep(self, least: int) -> np.ndarray:
        """Internal nodes that are at least so deep."""
        return np.flatnonzero(self.depth >= least)

    def longest(self) -> np.ndarray:
        """Of each suffix, how many of its first words it shares with another."""
        return self.depth[self.leaf_parent]


def repeated_lengths(kind: Kind, rank: np.ndarray, so: np.ndarray, eo: np.ndarray, contexts: list[bytes]) -> np.ndarray:
    """Of each class and window: 0, or by how many words less one its longest repeat exceeds the window, plus 1."""
    number: dict[bytes, int] = {}
    texts = [np.array([number.setdefault(w, len(number)) for w in c.split(b" ")], np.int64) for c in contexts]
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    count = so - eo + 1
    which = np.repeat(np.arange(len(texts)), count)
    off = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    longest = SuffixTree(texts, begin[which] + off, window=kind.window).longest()
    out = np.zeros((len(texts), kind.offsets), np.uint8)
    deep = longest >= kind.window
    out[which[deep], off[deep]] = longest[deep] - kind.window + 1
    return out


def kind(window: int = WINDOW, gram: int = GRAM) -> Kind:
    return Kind(words=True, window=window, gram=min(gram, window), keep_first=False, find=repeated_lengths)


def _digest(words: list[bytes], found) -> tuple:
    kept = kept_words(words, found.cover())
    return len(words), len(words) - len(kept), digest(b" ".join(kept))


def repeat_digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    out = without_repeats(docs.select("doc_id", "text"), kind(window, gram), _digest, "n_words long, n_removed long, kept_sha256 string", [pa.int64(), pa.int64(), pa.string()])
    return out.select("_row.doc_id", "n_words", "n_removed", "kept_sha256")


def _text(words: list[bytes], found) -> tuple:
    return (b" ".join(kept_words(words, found.cover())).decode("utf-8", "replace"),)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The documents with the words of repeated passages taken out; the words left are joined by one space."""
    out = without_repeats(docs, kind(window, gram), _text, "text string", [pa.string()])
    return out.select(*[f"_row.`{c}`" if c != "text" else c for c in docs.columns])


def _repeats(words: list[bytes], found) -> tuple:
    window, out, until = found.kind.window, [], 0
    length, open_end = found.lengths()
    for p in np.flatnonzero(length).tolist():
        end = p + int(length[p])
        at = p
        while open_end[at] and end < len(words) and length[end - window + 1]:  # cut off by the end of what the tree saw
            at = end - window + 1
            if at + int(length[at]) <= end:
                break
            end = at + int(length[at])
        if end > until:
            out.append({"start": p, "n_words": end - p})
            until = end
    return (out,)


def maximal_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id and repeats (start, n_words): the longest repeat from each start that lies in no other of the document."""
    element = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64())]))
    out = without_repeats(docs.select("doc_id", "text"), kind(window, gram), _repeats, "repeats array<struct<start:bigint,n_words:bigint>>", [element])
    return out.select("_row.doc_id", "repeats")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir, "documents"))
