"""Texts that were decoded with a wrong encoding (problem 9).

A multinomial classifier on hashed byte bigrams of words, trained on clean words and on the same words garbled by each chain of encodings, names the chain of
each word that isn't plain ASCII. The chain is then undone and the result checked: it must decode strictly, and be a right word in the classifier's eyes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.lineage import only, table
from textmill.llm.signs import RUN, is_garbled, misread, undone

#: (name, encoding of the bytes, encoding they were read in), and how often that happened. Bytes that an encoding doesn't define are read as the control of their number.
SINGLE = ("cp1252", "latin-1", "iso8859-15", "cp437", "cp850", "mac_roman", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866")
CHAINS: dict[str, tuple[tuple[str, str], ...]] = {f"utf-8>{c}": (("utf-8", c),) for c in SINGLE}
CHAINS |= {f"utf-8>{c}>utf-8>{c}": (("utf-8", c),) * 2 for c in ("cp1252", "latin-1", "cp437", "mac_roman")}
CHAINS |= {f"utf-8>{a}>utf-8>{b}": (("utf-8", a), ("utf-8", b)) for a, b in (("latin-1", "cp1252"), ("cp1252", "latin-1"))}
CHAINS |= {"utf-8>cp1252>utf-8>cp1252>utf-8>cp1252": (("utf-8", "cp1252"),) * 3}
CHAINS |= {f"{a}>{b}": ((a, b),) for a, b in (("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("cp1251", "latin-1"), ("koi8-r", "latin-1"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1252"))}
CHAINS |= {f"{a}>{b}": ((a, b),) for a, b in (("gb18030", "cp1252"), ("gb18030", "latin-1"), ("utf-8", "gb18030"), ("shift_jis", "cp1252"), ("big5", "cp1252"), ("utf-8", "shift_jis"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp1250"), ("cp1252", "cp1251"))}
#: Read with loss: what was there can't be restored.
LOSSY = {f"{a}>utf-8 with loss": (a, "utf-8") for a in ("cp1252", "mac_roman", "cp1251", "gb18030")}
#: Documents that the classifier is trained on, those of lowest hash: a bound on what the driver gets. Buckets of the hashed bigrams.
SAMPLE, BUCKETS = 4_000, 1 << 13

NOT_ASCII = re.compile(r"[^\x00-\x7f]")
HIGH = re.compile(r"[^\x00-\x7f]+")


@lru_cache(None)
def tables(codec: str) -> tuple[dict[str, bytes], dict[int, str]]:
    """Character to byte and byte to character of a single-byte encoding, undefined bytes as controls."""
    to = {}
    for b in range(256):
        try:
            to[b] = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            to[b] = chr(b)
    back = {chr(b): bytes([b]) for b in range(128, 160)} | {c: bytes([b]) for b, c in to.items()}
    return back, to


def read_as(data: bytes, codec: str) -> str:
    if codec in SINGLE:
        return "".join(map(tables(codec)[1].__getitem__, data))
    return data.decode(codec, "replace")


def bytes_in(text: str, codec: str) -> bytes | None:
    """The bytes that text stands for in codec, null if it has a character that codec hasn't."""
    try:
        return b"".join(map(tables(codec)[0].__getitem__, text)) if codec in SINGLE else text.encode(codec)
    except (KeyError, UnicodeEncodeError):
        return None


def garble(word: str, chain: str) -> str | None:
    """word as it looks after the chain, null where the chain can't have happened to it."""
    if chain in LOSSY:
        data = bytes_in(word, LOSSY[chain][0])
        return None if data is None else data.decode("utf-8", "replace")
    for written, read in CHAINS[chain]:
        try:
            data = word.encode(written)
        except UnicodeEncodeError:
            return None
        word = read_as(data, read)
    return word


def undo(text: str, chain: str) -> str | None:
    """text before the chain, null if its bytes aren't strictly those of the encodings named."""
    for written, read in reversed(CHAINS[chain]):
        data = bytes_in(text, read)
        if data is None:
            return None
        try:
            text = data.decode(written)
        except UnicodeDecodeError:
            return None
    return text


@lru_cache(100_000)
def features(word: str) -> tuple[int, ...]:
    data = b"\x01" + word.encode("utf-8", "replace") + b"\x02"
    return tuple((data[i] * 31_337 + data[i + 1] * 7_919) % BUCKETS for i in range(len(data) - 1) if data[i] > 127 or data[i + 1] > 127)


class Classifier:
    """Multinomial naive Bayes over the hashed byte bigrams that touch a byte over 127."""

    def __init__(self, words: Counter[str]) -> None:
        self.classes = ["clean", *CHAINS, *LOSSY]
        counts = np.zeros((len(self.classes), BUCKETS))
        for word, n in words.items():
            n = min(n, 20)
            for k, chain in enumerate(self.classes):
                w = word if chain == "clean" else garble(word, chain)
                if w is not None and (chain == "clean" or w != word):
                    for f in features(w):
                        counts[k, f] += n
        self.log = np.log((counts + 0.05) / (counts + 0.05).sum(axis=1, keepdims=True)).T.astype(np.float32)
        self.kept: dict[str, np.ndarray] = {}

    def scores(self, word: str) -> np.ndarray:
        """The log likelihood of the word in each class."""
        known = self.kept.get(word)
        if known is None:
            f = list(features(word))
            known = self.log[f].sum(axis=0) if f else np.zeros(len(self.classes), np.float32)
            if len(self.kept) > 200_000:
                self.kept.clear()
            self.kept[word] = known
        return known


#: Margin of log likelihood by which a garbled class must lead for a word to be checked.
MARGIN = 2.0


def trained(documents: DataFrame, sample: int = SAMPLE) -> Classifier:
    """The classifier, fitted on the words of up to sample documents that show no sign of a wrong decoding. Each word is garbled by every chain that could have happened to it."""
    clean = F.pandas_udf(lambda s: ~s.map(is_garbled).astype(bool), "boolean")
    some = only(documents, "doc_id", "text").where("text IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    words = some.where(clean("text")).select(F.explode(F.split("text", r"\s+")).alias("word")).where(F.col("word").rlike(NOT_ASCII.pattern))
    rows = words.groupBy(F.substring("word", 1, 64).alias("word")).count().orderBy(F.desc("count"), "word").limit(20_000).collect()
    return Classifier(Counter({r["word"]: r["count"] for r in rows}))


def named(text: str, classifier: Classifier) -> Counter[str]:
    """The chains that the classifier names for the text's words, with their margins added up."""
    out: Counter[str] = Counter()
    for word in set(text.split()):
        if not word.isascii():
            s = classifier.scores(word)
            k = int(s.argmax())
            if k and s[k] - s[0] > MARGIN:
                out[classifier.classes[k]] += float(s[k] - s[0])
    return out


def restored(text: str, chains: Counter[str]) -> tuple[str, str | None]:
    """The chain that is undone, and the text with it undone wherever its bytes decode strictly: the likeliest one that leaves no sign of a wrong decoding. Else the likeliest chain, and null."""
    likely = [c for c, _ in chains.most_common(8)]
    for chain in likely:
        if chain in CHAINS:
            whole = undo(text, chain)
            if whole is not None and whole != text and not is_garbled(whole):
                return chain, whole
            parts = HIGH.sub(lambda m, c=chain: u if (u := undo(m[0], c)) is not None else m[0], text)
            if parts != text and not is_garbled(parts):
                return chain, parts
    # Several chains in one text, one after the other.
    out, first = text, None
    for _ in range(3):
        codec = misread(out)
        if not codec:
            break
        first = first or f"utf-8>{codec}"
        out = RUN.sub(lambda m, c=codec: undone(m[0], c)[0], out)
    return (first, out) if first and out != text and not is_garbled(out) else (likely[0], None)


def garbled(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, chain, text: the documents with at least one garbled sequence, the likeliest chain of encodings, and the original text, null where it can't be restored.

    Null, empty and plain ASCII texts are no cases. A text of any length is read whole. Repeated rows give a row each. Without clean texts to train on, the table has no cases.
    One pass without a shuffle, after fitting on a bounded sample."""
    classifier = trained(documents, sample)
    classifier.kept.clear()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                chains = named(text, classifier)
                if chains and is_garbled(text):
                    rows.append((i, *restored(text, chains)))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (b.column("doc_id").type, pa.string(), pa.string()), strict=True)], ["doc_id", "chain", "text"])

    rows = only(documents, "doc_id", "text").where(F.col("text").rlike(NOT_ASCII.pattern))
    return rows.mapInArrow(found, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, chain STRING, text STRING")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled(table(spark, sf_dir, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled(table(spark, sf_dir, "documents"))
