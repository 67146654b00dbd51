"""License scans: an exact set-similarity join of text blocks with license templates.

Words are runs of digits, a-z (A-Z lowered) and non-ASCII characters. A block is
any run of as many consecutive words as the template has. A block meets a
template when it holds at least `CONTAINMENT` of the template's distinct words.

The words of all templates are counted over all documents and each template's m
words ordered by that frequency, rarest first. Filters, for blocks and not for documents:

* Prefix: a block that meets the template holds one of its m - need + 1 rarest words, so
  only the zones around those words (a template's length to either side) are looked at.
* Length: a zone must reach over at least `need` words and hold as many of the template's.
* Positional: a zone's words are looked up in that order, and it is given up as soon
  as the words found and those that follow in the order are fewer than `need`.

What is left is verified by a window that slides over the template's words in the
zone. `blocks` gives one row for each run of overlapping blocks that meet a
template: its best block. No shuffle is needed but for the counts, one row per word and batch.

Null and empty texts: no words, no blocks, no labels, score 0. Repeated rows are scanned
one by one; of blocks that tie, the first; null doc_ids stay null. Extra columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .license_texts import TEMPLATES

#: Phrases that decide by themselves; fixed by the contract of the query.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

CONTAINMENT = 0.8
_WORD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()


def phrase_places(line: bytes, phrase: bytes) -> list[int]:
    """Numbers of the words where the phrase begins; `line` has a space before, between and after all words."""
    seek, at, out, counted, number = b" " + phrase + b" ", -1, [], 0, 0
    while (at := line.find(seek, at + 1)) >= 0:
        number += line.count(b" ", counted, at)
        counted = at
        out.append(number)
    return out


class Template:
    def __init__(self, label: str, text: str, frequency: Mapping[bytes, int], containment: float):
        sequence = words(text)
        self.label, self.length = label, len(sequence)
        self.order = sorted(set(sequence), key=lambda w: (frequency.get(w, 0), w))
        self.need = max(1, math.ceil(containment * len(self.order) - 1e-9))
        self.prefix = self.order[: len(self.order) - self.need + 1]

    def zones(self, where: Mapping[bytes, list[int]], n: int) -> list[tuple[int, int]]:
        """Runs of words (from, to) in which every block that meets the template lies: around its rarest words."""
        out: list[list[int]] = []
        for at in sorted(p for w in self.prefix for p in where.get(w, ())):
            low, high = max(0, at - self.length + 1), min(n, at + self.length)
            if out and low <= out[-1][1]:
                out[-1][1] = high
            else:
                out.append([low, high])
        return [(a, b) for a, b in out if b - a >= self.need]

    def held(self, where: Mapping[bytes, list[int]], low: int, high: int) -> list[tuple[int, bytes]] | None:
        """Places of the template's words in a zone, in order; None once too few can be there."""
        found, missing, most = [], 0, len(self.order) - self.need
        for w in self.order:
            own = where.get(w, ())
            i = bisect_left(own, low)
            if i == len(own) or own[i] >= high:
                missing += 1
                if missing > most:
                    return None
            while i < len(own) and own[i] < high:
                found.append((own[i], w))
                i += 1
        return sorted(found)

    def blocks(self, where: Mapping[bytes, list[int]], n: int) -> Iterator[tuple[int, int, float]]:
        """First word, number of words and containment of the best block of each run of overlapping blocks that meet the template."""
        for low, high in self.zones(where, n):
            found = self.held(where, low, high)
            if found is None:
                continue
            within: Counter[bytes] = Counter()
            tail, best, until = 0, None, -1
            for at, w in found:
                within[w] += 1
                while found[tail][0] <= at - self.length:
                    out = found[tail][1]
                    within[out] -= 1
                    if not within[out]:
                        del within[out]
                    tail += 1
                if len(within) >= self.need:
                    if best and found[tail][0] > until:
                        yield best[1], best[2], best[0]
                        best = None
                    share = len(within) / len(self.order)
                    until = at
                    if best is None or share > best[0]:
                        best = (share, found[tail][0], at - found[tail][0] + 1)
            if best:
                yield best[1], best[2], best[0]


class Scanner:
    """All templates and phrases against one text at a time."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]], frequency: Mapping[bytes, int], containment: float):
        self.templates = [Template(label, text, frequency, containment) for label, text in templates]
        self.rare = frozenset(w for t in self.templates for w in t.prefix)
        self.known = frozenset(w for t in self.templates for w in t.order)
        self.phrases = [(p.encode(), [w.encode() for w in p.split()], label) for p, label in phrases]

    def blocks(self, own: list[bytes], distinct: set[bytes]) -> list[tuple[str, int, int, float]]:
        if self.rare.isdisjoint(distinct):
            return []
        where: dict[bytes, list[int]] = {w: [] for w in self.known & distinct}
        for i, w in enumerate(own):
            if w in where:
                where[w].append(i)
        return sorted((t.label, *b) for t in self.templates if not distinct.isdisjoint(t.prefix) for b in t.blocks(where, len(own)))

    def base(self, own: list[bytes], distinct: set[bytes]) -> tuple[list[int], set[str]]:
        """Places of the phrases and their labels."""
        places: list[int] = []
        labels: set[str] = set()
        line = None
        for phrase, parts, label in self.phrases:
            if all(p in distinct for p in parts):
                line = line or b" " + b" ".join(own) + b" "
                if found := phrase_places(line, phrase):
                    places += found
                    labels.add(label)
        return places, labels


def template_word_counts(docs: DataFrame, templates: Sequence[tuple[str, str]], text_column: str = "text") -> dict[bytes, int]:
    """Documents that hold each word of the templates; at most one row per such word comes back."""
    known = frozenset(w for _, t in templates for w in words(t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[bytes] = Counter()
            for t in batch.column(0):
                counts.update(known.intersection(words(t.as_py())))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(text_column).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


def blocks(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, label, first_word, n_words, containment: every text block that meets a template (the best of a run of overlapping ones)."""
    return _each(docs, templates, (), containment, _block_rows, "label string, first_word long, n_words long, containment double", [pa.string(), pa.int64(), pa.int64(), pa.float64()])


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per document: its words, its phrases, the labels of both phrases and blocks, and the largest containment (1 with a phrase)."""
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
    fields = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long"
    return _each(docs, templates, phrases, containment, _digest_rows, fields, kinds)


def _block_rows(scanner: Scanner, own: list[bytes]) -> list[tuple]:
    return scanner.blocks(own, set(own))


def _digest_rows(scanner: Scanner, own: list[bytes]) -> list[tuple]:
    distinct = set(own)
    places, base = scanner.base(own, distinct)
    found = scanner.blocks(own, distinct)
    score = 1.0 if base else max((b[3] for b in found), default=0.0)
    labels = base | {b[0] for b in found}
    return [(len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, len(found))]


def _each(docs: DataFrame, templates, phrases, containment: float, rows_of, fields: str, kinds: list[pa.DataType]) -> DataFrame:
    frequency = template_word_counts(docs, templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases, frequency, containment)
        for batch in batches:
            found = [rows_of(scanner, words(t.as_py())) for t in batch.column(1)]
            at = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
            columns = list(zip(*(r for rows in found for r in rows))) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", *(f.split()[0] for f in fields.split(", "))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {fields}")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("n_blocks")
