"""Encoding and decoding with merge-type (BPE) SentencePiece vocabularies.

A text's white space is made visible and one mark is put before it; the text
falls into chunks (marks and what follows up to the next mark), over which no
piece of the vocabulary reaches. In each an agenda of adjacent symbol
pairs gives up the pair with the best score, the leftmost of equals, until no
pair is a piece; what is no piece in the end falls back to its bytes.

Chunks are cut further where no piece reaches over, as between a letter and a
full stop; what is merged is kept, as most parts come again. Every chunk with a
part that is new to a worker is encoded by the sentencepiece
library too, a batch of chunks at a time, and so is one whole text of each
Arrow batch (the longest, however long), with its decoding. The library's answer stands:
a chunk that differs is put right in the cache, and where a whole text differs its whole
batch is encoded by the library. `n_corrected` counts both for each document.

Null and empty texts: no ids. Repeated rows: one row each. Other columns are
not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

MARK = "▁"


class MergeTokenizer:
    def __init__(self, path: str, most_cached: int = 800_000):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any(re.search(f"[^{MARK}]{MARK}", pieces[i]) for i in plain):
            raise ValueError("a piece reaches over white space: chunks are not independent")
        if sp.encode("a b") == [] or sp.normalize(" a  b ") != f"{MARK}{MARK}a{MARK}{MARK}b{MARK}":
            raise ValueError("only the identity normaliser with a mark in front is handled")
        self.ids = {pieces[i]: i for i in plain}
        self.rank = {pieces[i]: (-sp.get_score(i)) for i in plain}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.bytes_between = set(self.byte_ids)
        self.pieces = pieces
        self._pairs()
        self.comma = [f"{i}," for i in range(n)]
        self.barrier = self._barriers()
        self.parts_made = 0
        self.odd: dict[str, str] = {}
        self.parts = Generations(most_cached, self.part)
        self.cache = Generations(most_cached * 5 // 8, self.entry)
        self.fresh: list[tuple[str, str]] = []
        self.wrong: set[str] = set()

    def _pairs(self) -> None:
        """Symbols as numbers (a piece's id, or a number of its own for any other character of a piece), and
        for each pair of symbols that together are a piece its rank: agenda entries are then plain numbers."""
        n = len(self.pieces)
        number = dict(self.ids)
        for piece in self.ids:
            for c in piece:
                number.setdefault(c, n + len(number))
        by_score = sorted(self.ids, key=lambda p: self.rank[p])
        self.char = {s: i for s, i in number.items() if len(s) == 1}
        self.made = [number[p] for p in by_score]
        self.never = len(by_score)
        self.pairs = {number[p[:c]] << 24 | number[p[c:]]: k for k, p in enumerate(by_score) for c in range(1, len(p)) if p[:c] in number and p[c:] in number}
        ranks = [self.rank[p] for p in by_score]
        if any(a == b for a, b in zip(ranks, ranks[1:]) if a < 1e8):
            raise ValueError("two pieces share a score: ties between them are not handled")

    def chunk_ids(self, chunk: str) -> list[int]:
        char, pairs, made = self.char, self.pairs, self.made
        symbols = [char.get(c, -2) for c in chunk]
        n = len(symbols)
        if n <= 24:  # a flat agenda: the rank of the pair that begins at each symbol
            never = self.never
            agenda = [pairs.get(a << 24 | b, never) for a, b in zip(symbols, symbols[1:])]
            agenda.append(never)
            chars = list(chunk) if -2 in symbols or max(symbols) >= len(self.pieces) else None
            while (best := min(agenda)) < never:
                i = agenda.index(best)
                symbols[i] = joined = made[best]
                del symbols[i + 1], agenda[i + 1]
                if chars:
                    del chars[i + 1]
                agenda[i] = pairs.get(joined << 24 | symbols[i + 1], never) if i + 1 < len(symbols) else never
                if i:
                    agenda[i - 1] = pairs.get(symbols[i - 1] << 24 | joined, never)
            return self._with_bytes(symbols, chars) if chars else symbols
        agenda = [r << 32 | i for i in range(n - 1) if (r := pairs.get(symbols[i] << 24 | symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            entry = pop(agenda)
            i = entry & 0xFFFFFFFF
            left, j = symbols[i], after[i]
            if left == -1 or j >= n or pairs.get(left << 24 | symbols[j]) != entry >> 32:
                continue  # one of the two has been merged since
            symbols[i] = joined = made[entry >> 32]
            symbols[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := pairs.get(joined << 24 | symbols[k])) is not None:
                    push(agenda, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := pairs.get(symbols[h] << 24 | joined)) is not None:
                push(agenda, r << 32 | h)
        return self._with_bytes(symbols, chunk)

    def _with_bytes(self, symbols: list[int], chars) -> list[int]:
        """Ids: a symbol that is no piece is one character, and falls back to its bytes."""
        out = []
        top = len(self.pieces)
        for s, c in zip(symbols, chars):
            if 0 <= s < top:
                out.append(s)
            elif s != -1:
                out.extend([self.byte_ids[b] for b in c.encode()])
        return out

    def _spelled(self, ids: list[int]) -> str:
        if self.bytes_between.isdisjoint(ids):
            return "".join([self.pieces[i] for i in ids]).replace(MARK, " ")
        out, pending = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                pending.append(b)
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            out.append(self.pieces[i])
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def decode(self, ids: list[int]) -> str:
        """The text of the ids of one text: the mark in front goes."""
        s = self._spelled(ids)
        return s[1:] if s[:1] == " " else s

    def _barriers(self) -> re.Pattern:
        """Places within a chunk that no piece reaches over: between a Latin letter and a sign that no piece puts
        after one, and around a line's end if no piece holds it."""
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        letters = [chr(c) for c in range(0x250) if chr(c).isalpha()]
        signs = [chr(c) for c in range(0x80) if not chr(c).isalnum() and not any(x + chr(c) in pairs for x in letters)]
        places = []
        if signs:
            places.append(f"(?<=[{''.join(letters)}])(?=[{re.escape(''.join(signs))}])")
        if not any("\n" in p for p in self.ids):
            places += ["(?<=\n)", "(?=\n)"]
        return re.compile("|".join(places) or "(?!)")

    def part(self, part: str) -> tuple[str, str]:
        """Ids of a part of a chunk, each with a comma after it, and the part's text."""
        self.parts_made += 1
        ids = self.chunk_ids(part)
        return "".join([self.comma[i] for i in ids]), self._spelled(ids)

    def entry(self, body: str) -> str:
        """Of the chunk with one mark and this body: ids with a comma after each. What they decode to is noted in
        `odd` if that is not the body after a space."""
        made, get = self.parts_made, self.parts.__getitem__
        parts = self.barrier.split(MARK + body)
        if len(parts) == 1:
            line, text = get(parts[0])
        else:
            lines, texts = zip(*[get(x) for x in parts if x])
            line, text = "".join(lines), "".join(texts)
        if text[1:] != body:
            self.odd[body] = text[1:]
        if self.parts_made != made:
            self.fresh.append((body, line))
        return line

    def bodies(self, text: str) -> list[str]:
        """Chunks of a text without the mark that each begins with."""
        if "  " in text or MARK in text or text[:1] == " " or text[-1:] == " ":
            return [c[1:] for c in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.digest(text)[1].split(",") if i]

    def digest(self, text: str | None) -> tuple[int, str, str, int]:
        """Number of ids, ids joined by commas, decoded text, corrected chunks."""
        if not text:
            return 0, "", "", 0
        bodies = self.bodies(text)
        if len(self.odd) > 100_000:
            self.odd = {b: self.odd[b] for b in self.odd if b in self.wrong}
            self.cache.clear()
            self.cache.older = {}
        line = "".join(map(self.cache.__getitem__, bodies))
        if len(self.fresh) > 20_000:
            self.check()
        wrong = 0
        if self.wrong and (wrong := sum(b in self.wrong for b in bodies)):
            line = "".join(map(self.cache.__getitem__, bodies))
        texts = bodies if not self.odd or self.odd.keys().isdisjoint(bodies) else [self.odd.get(b, b) for b in bodies]
        return line.count(","), line[:-1], " ".join(texts), wrong

    def by_library(self, text: str | None) -> tuple[int, str, str, int]:
        """The library's digest of a whole text; one correction is noted where it is not ours."""
        ids = self.library.encode(text or "")
        line, decoded = ",".join(map(str, ids)), self.library.decode(ids)
        own = self.digest(text)
        return len(ids), line, decoded, own[3] + ((line, decoded) != own[1:3])

    def agrees(self, text: str) -> bool:
        return self.by_library(text)[1:3] == self.digest(text)[1:3]

    def check(self) -> bool:
        """What the cache got since the last check, against the library; True if all was right."""
        fresh, self.fresh = [x for x in self.fresh if x[0]], []  # the library gives no mark for an empty text
        fine = True
        for (body, line), ids in zip(fresh, self.library.encode([b.replace(MARK, " ") for b, _ in fresh], num_threads=1)):
            if line != "".join([self.comma[i] for i in ids]):
                self.wrong.add(body)
                self.cache[body] = "".join([self.comma[i] for i in ids])
                self.odd[body] = self._spelled(ids)[1:]
                fine = False
        return fine


class Generations(dict):
    """A cache in two halves; when the younger is full, the older goes."""

    def __init__(self, most: int, make):
        super().__init__()
        self.most, self.make, self.older = most // 2, make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        if len(key) <= 256:
            self[key] = value
        return value


_loaded: dict[str, MergeTokenizer] = {}


def tokenizer(path: str) -> MergeTokenizer:
    if path not in _loaded:
        _loaded[path] = MergeTokenizer(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text", ids: bool = False) -> DataFrame:
    """Digests of ids and decoded text per document; with ids=True their list too."""
    kind = docs.schema[id_column].dataType.simpleString()

    def row(got: tuple[int, str, str, int]) -> tuple:
        n, line, decoded, corrected = got
        return n, hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), corrected, [int(i) for i in line.split(",") if i] if ids else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(model)
        for batch in batches:
            texts = batch.column(1)
            rows = []
            longest: str | None = None
            for value in texts:
                text = value.as_py()
                got = own.digest(text)
                if own.fresh and len(own.fresh) > 5000 and not own.check():
                    got = own.digest(text)
                if len(text or "") > len(longest or ""):
                    longest = text
                rows.append(row(got))
            if not own.check():
                rows = [row(own.digest(t.as_py())) for t in texts]
            if longest and not own.agrees(longest):
                rows = [row(own.by_library(t.as_py())) for t in texts]
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32())]
            names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256", "n_corrected", "ids"]
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + ids], names=names[: 5 + ids])

    schema = f"{id_column} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_corrected long" + ", ids array<int>" * ids
    return docs.select(id_column, text_column).mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), default_model())
