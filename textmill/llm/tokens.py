"""Token ids of whole texts by prefix dynamic programming (problem 7).

A byte-level BPE has one valid encoding of each byte string, and in it each two neighbours are the encoding of their own
bytes. So each prefix has one valid last token: the one that is compatible with the last token of the prefix before it.
Storing it for every prefix gives the ids by walking back; appending bytes leaves what is stored for shorter prefixes valid.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from textmill.lineage import only, table

NAME = "byte_bpe_50k"
#: Pieces whose ids a worker keeps; beyond that it begins anew, results don't depend on it.
KEPT = 400_000


class Vocabulary:
    """Ranks of byte strings and the pattern that splits texts into pieces before encoding."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.lengths = sorted({len(b) for b in ranks}, reverse=True)
        self.split = regex.compile(pattern)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The definition: the neighbours of lowest rank are merged until none can be. For short strings only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether a before b is the encoding of their bytes; a = -1 stands for the start of a piece."""
        known = self.pairs.get((a, b))
        if known is None:
            whole = (self.bytes_of[a] if a >= 0 else b"") + self.bytes_of[b]
            known = self.pairs[a, b] = self.merged(whole) == ([a, b] if a >= 0 else [b])
        return known

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """last[i] is the last token of data[:i], -1 at 0; gives the missing ones for all longer prefixes."""
        ranks, lengths = self.ranks, self.lengths
        for end in range(len(last), len(data) + 1):
            for n in lengths:
                if n <= end:
                    token = ranks.get(data[end - n : end])
                    if token is not None and last[end - n] > -2 and self.compatible(last[end - n], token):
                        last.append(token)
                        break
            else:
                last.append(-2)  # no valid last token; doesn't occur where all single bytes have ids
        return last

    def walked(self, last: list[int]) -> tuple[int, ...]:
        out, end = [], len(last) - 1
        while end:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return tuple(reversed(out))

    def piece(self, text: str) -> tuple[int, ...]:
        known = self.pieces.get(text)
        if known is None:
            data = text.encode("utf-8", "replace")
            whole = self.ranks.get(data)
            known = (whole,) if whole is not None else self.walked(self.extend(data, [-1]))
            if len(self.pieces) >= KEPT:
                self.pieces.clear()
            self.pieces[text] = known
        return known

    def ids(self, text: str | None) -> list[int]:
        """Ids without special tokens, whose strings are ordinary text; none for an empty or null text."""
        if not text:
            return []
        return list(chain.from_iterable(map(self.piece, self.split.findall(text))))


class Encoded:
    """A text with the ids of its pieces, which can be appended to and edited; only pieces near a change are encoded again."""

    def __init__(self, vocabulary: Vocabulary, text: str = "") -> None:
        self.v, self.text = vocabulary, text
        self.starts = [m.start() for m in vocabulary.split.finditer(text)]
        self.parts = [vocabulary.piece(p) for p in vocabulary.split.findall(text)]

    @property
    def ids(self) -> list[int]:
        return list(chain.from_iterable(self.parts))

    def replace(self, start: int, end: int, new: str) -> Encoded:
        """text[start:end] becomes new. Splitting begins two pieces before the change and ends where old and new pieces begin alike after it."""
        from bisect import bisect_left

        moved = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        first = max(0, bisect_left(self.starts, start) - 2)
        at = self.starts[first] if self.starts else 0
        # Pieces depend on what comes next but only by looking ahead within one run of white space.
        old = {s + moved: k for k, s in enumerate(self.starts) if s >= end}
        starts, parts, k = [], [], len(self.starts)
        for m in self.v.split.finditer(self.text, at):
            if m.start() >= start + len(new) and m.start() in old:
                k = old[m.start()]
                break
            starts.append(m.start())
            parts.append(self.v.piece(m[0]))
        self.starts[first:] = starts + [s + moved for s in self.starts[k:]]
        self.parts[first:] = parts + self.parts[k:]
        return self

    def append(self, more: str) -> Encoded:
        return self.replace(len(self.text), len(self.text), more)


@cache
def vocabulary(name: str = NAME, path: str | None = None) -> Vocabulary:
    """A public tokenizer's vocabulary, read once in each worker; path is that of its file of ranks."""
    import public_tokenizers

    with open(path or public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Vocabulary(ranks, public_tokenizers.PATTERN)


def with_ids(documents: DataFrame, name: str = NAME, path: str | None = None) -> DataFrame:
    """doc_id, ids of each row. Null and empty texts have no ids (an empty array); a repeated row is encoded again; an empty table gives none.

    One pass without a shuffle; a text of any length is encoded whole, in time linear in its length."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(name, path)
        for b in batches:
            ids = [v.ids(t) for t in b.column("text").to_pylist()]
            offsets = [0]
            for x in ids:
                offsets.append(offsets[-1] + len(x))
            flat = pa.array(list(chain.from_iterable(ids)), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], ["doc_id", "ids"])

    rows = only(documents, "doc_id", "text")
    return rows.mapInArrow(encoded, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids ARRAY<INT>")


def sized(documents: DataFrame, name: str = NAME, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens of each row, as with_ids would give, without carrying the ids."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(name, path)
        for b in batches:
            n = [len(v.ids(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    rows = only(documents, "doc_id", "text")
    return rows.mapInArrow(counted, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens BIGINT")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ids(table(spark, sf_dir, "documents"))
