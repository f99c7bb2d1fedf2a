"""Benchmark decontamination: which test items occur in which documents.

An item occurs in a document if at least 0.8 of its five-word shingles do.  Items are far shorter
than documents, so signatures of equal length would compare a Jaccard similarity near zero.  Instead
items are partitioned by their number of shingles, and each size class has its own bottom-k MinHash
sketches and its own threshold: an item of n shingles that occurs can miss at most n - ceil(0.8 n) of
them, so of its n - ceil(0.8 n) + 1 smallest hashes at least one is in the document (k is taken for
the class's largest n), and a document with less than 0.8 of the class's smallest n holds none of it.
The search looks up the hashes of a document in the sketches of each class, which has no false
negatives, and only the candidates that come out are verified, shingle by shingle and word by word.

The sketches of a benchmark up to a block's size are broadcast, and documents are not shuffled.
Those of a larger one stay a table, to which the documents' hashes are joined.  There a hash that many
items share (a template's) would lead to all of them, so an item's smallest hashes are taken from its
others first; any so many of its hashes hold one that the document has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, SIMILARITY, byte_texts, materialise

#: Bytes of item texts whose sketches are broadcast; they take some twenty times as much in a task.
BLOCK_BYTES = 8 << 20
#: Bits that tell whether a hash may be in any sketch: 64 MB are broadcast, whatever the benchmark's size.
FILTER_BITS = 1 << 29
#: A hash that more items have than this goes into a sketch last.
POSTINGS = 64
#: Characters that a quotation may gain or lose.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
KNOWN_WORDS = 1 << 20


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words without ASCII punctuation; a word of punctuation alone is none."""
    return text.lower().translate(None, PUNCTUATION).split()


class WordHashes(dict):
    """64-bit hashes of words, held for the most recent ones."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(hashes: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each run of so many words."""
    n = max(0, len(hashes) - length + 1)
    h = np.full(n, length, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            h = (h ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def shingles_of(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    """The distinct shingles of an item; one of fewer words than a shingle is one: its whole sequence."""
    length = min(size, len(words))
    return set(zip(*(words[k:] for k in range(length)), strict=False))


def needed(n: int, similarity: float) -> int:
    return math.ceil(similarity * n - 1e-9)


def size_class(n: int) -> int:
    """Items of up to 1, 2, 4, 8, ... shingles share a class."""
    return (n - 1).bit_length()


def item_hashes(words: list[bytes], size: int, similarity: float) -> tuple[int, int, np.ndarray, int]:
    """The class of an item, the length of its shingles, its hashes in order, and how many of them the class's largest size asks for."""
    length = min(size, len(words))
    hashes = np.unique(mixed(np.fromiter(map(WordHashes().__getitem__, words), dtype=np.uint64, count=len(words)), length))
    n = len(shingles_of(words, size))
    most = 1 << size_class(n)
    return size_class(n), length, hashes, most - needed(most, similarity) + 1


def sketch(words: list[bytes], size: int, similarity: float) -> tuple[int, int, np.ndarray]:
    """The class of an item, the length of its shingles, and its smallest hashes."""
    kind, length, hashes, asked = item_hashes(words, size, similarity)
    return kind, length, hashes[:asked]


def shared_shingles(words: list[bytes], item: set[tuple[bytes, ...]]) -> int:
    """How many of an item's shingles are among the words, compared word by word."""
    length = len(next(iter(item)))
    return len(item.intersection(zip(*(words[k:] for k in range(length)), strict=False)))


class ItemIndex:
    """Sketches of one block of items, by size class and length of shingle, and the items' own shingles."""

    def __init__(self, items: list[tuple], size: int, similarity: float):
        self.similarity = similarity
        split = [(key, words) for key, text in items if (words := words_of((text or "").encode("utf-8", "replace")))]
        self.keys = [key for key, _ in split]
        self.items = [shingles_of(words, size) for _, words in split]
        self.words = frozenset(w for _, words in split for w in words)
        parts: dict[tuple[int, int], list[tuple[np.ndarray, int]]] = {}
        for k, (_, words) in enumerate(split):
            kind, length, hashes = sketch(words, size, similarity)
            parts.setdefault((kind, length), []).append((hashes, k))
        self.partitions: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # fewest shingles to hold, length, hashes, items
        for (kind, length), sketches in sorted(parts.items()):
            hashes = np.concatenate([h for h, _ in sketches])
            owners = np.repeat([k for _, k in sketches], [len(h) for h, _ in sketches])
            order = np.argsort(hashes, kind="stable")
            fewest = needed(min(len(self.items[k]) for _, k in sketches), similarity)
            self.partitions.append((fewest, length, hashes[order], owners[order]))
        self.hash_of = WordHashes()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"hash_of": WordHashes()}

    def search(self, text: bytes) -> list[tuple[int, int]]:
        """(item, shared shingles) of each item that occurs in the text."""
        words = words_of(text)
        known = np.fromiter(map(self.words.__contains__, words), dtype=bool, count=len(words))
        if not known.any():
            return []
        hashes = np.zeros(len(words), dtype=np.uint64)
        places = np.flatnonzero(known)
        hashes[places] = np.fromiter((self.hash_of[words[k]] for k in places), dtype=np.uint64, count=len(places))
        runs = np.concatenate([[0], np.cumsum(known)])
        of_length: dict[int, np.ndarray] = {}
        candidates: set[int] = set()
        for fewest, length, sketches, owners in self.partitions:
            if length not in of_length:  # hashes of the runs of words that items have
                whole = runs[length:] - runs[: max(0, len(runs) - length)] == length
                of_length[length] = np.unique(mixed(hashes, length)[whole])
            own = of_length[length]
            if len(own) >= fewest:
                lo, hi = np.searchsorted(sketches, own, "left"), np.searchsorted(sketches, own, "right")
                for k in np.flatnonzero(hi > lo):
                    candidates.update(owners[lo[k] : hi[k]].tolist())
        found = []
        for item in sorted(candidates):
            shared = shared_shingles(words, self.items[item])
            if shared >= needed(len(self.items[item]), self.similarity):
                found.append((item, shared))
        return found


def distinct_items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("item_text")).distinct()


def matcher(items: DataFrame, size: int, similarity: float):
    """The items that occur in a text, by broadcast sketches; for benchmarks within a block."""
    spark, key_type = items.sparkSession, items.schema["item_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(ItemIndex([tuple(r) for r in items.collect()], size, similarity))

    @F.pandas_udf(f"array<struct<item_id:{key_type},n_shingles:long,n_shared:long>>")
    def matches(texts: pd.Series) -> pd.Series:
        index = shared.value
        out = []
        for t in texts:
            hits = index.search(t.encode("utf-8", "replace")) if t else []
            out.append([{"item_id": index.keys[i], "n_shingles": len(index.items[i]), "n_shared": n} for i, n in hits])
        return pd.Series(out)

    return matches


def sketches_of(items: DataFrame, size: int, similarity: float) -> DataFrame:
    """item_md5, length, hash: the sketches of items (item_md5, item_text), hashes of more than POSTINGS items last."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
                if words := words_of(text):
                    _, length, hashes, asked = item_hashes(words, size, similarity)
                    n = len(hashes)
                    columns = [pa.array([key] * n, pa.string()), pa.array([length] * n, pa.int32()), pa.array([asked] * n, pa.int32()), pa.array(hashes.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["item_md5", "length", "asked", "hash"])

    every = materialise(items.select("item_md5", "item_text").mapInArrow(hashed, "item_md5 string, length int, asked int, hash long"))
    shared = every.groupBy("hash").count().filter(F.col("count") > POSTINGS).select(F.col("hash").alias("shared"))
    marked = every.join(shared, F.col("hash") == F.col("shared"), "left")
    place = F.row_number().over(Window.partitionBy("item_md5").orderBy(F.col("shared").isNotNull(), "hash"))
    return marked.withColumn("place", place).filter("place <= asked").select("item_md5", "length", "hash")


def joined_matches(texts: DataFrame, items: DataFrame, size: int, similarity: float, filter_bits: int = FILTER_BITS) -> DataFrame:
    """md5 (of a text), item_md5, n_shingles, n_shared of all items that occur in texts (md5, text), by joins.

    A bitmap of bounded size keeps most hashes that are in no sketch out of the shuffle; the pairs that
    share a hash of a sketch are then verified on both whole texts.
    """
    spark = texts.sparkSession
    own = materialise(items.select(F.md5("item_text").alias("item_md5"), "item_text").filter("item_text is not null").distinct())

    sketches = materialise(sketches_of(own, size, similarity))
    lengths = [r[0] for r in sketches.select("length").distinct().orderBy("length").collect()]  # at most ``size`` numbers
    width = filter_bits // 256

    def bits(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        marks = np.zeros(width, dtype=bool)
        marks[part["bit"].to_numpy()] = True
        return pd.DataFrame({"segment": [key[0]], "bits": [np.packbits(marks).tobytes()]})

    place = F.pmod(F.col("hash"), F.lit(filter_bits))
    marked = sketches.select(F.floor(place / width).cast("int").alias("segment"), (place % width).alias("bit")).distinct()
    segments = marked.groupBy("segment").applyInPandas(bits, "segment int, bits binary").collect()  # filter_bits / 8 bytes at most
    empty = bytes(width // 8)
    by_number = {r["segment"]: bytes(r["bits"]) for r in segments}
    bitmap = spark.sparkContext.broadcast(b"".join(by_number.get(k, empty) for k in range(256)))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe, hash_of = np.frombuffer(bitmap.value, dtype=np.uint8), WordHashes()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
                words = words_of(text)
                hashes = np.fromiter(map(hash_of.__getitem__, words), dtype=np.uint64, count=len(words))
                h = np.unique(np.concatenate([np.empty(0, np.uint64), *(mixed(hashes, n) for n in lengths)])).view(np.int64)
                at = h % filter_bits
                h = h[(maybe[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(h), pa.string()), pa.array(h)], ["md5", "hash"])

    distinct_texts = texts.filter("text is not null").dropDuplicates(["md5"])
    asked = distinct_texts.select("md5", "text").mapInArrow(probes, "md5 string, hash long")
    pairs = asked.join(sketches, "hash").select("md5", "item_md5").distinct()

    @F.arrow_udf("struct<n_shingles:long,n_shared:long>")
    def counted(text: pa.Array, item: pa.Array) -> pa.Array:
        sizes, shared = [], []
        for t, i in zip(byte_texts(text), byte_texts(item), strict=True):
            own = shingles_of(words_of(i), size)
            sizes.append(len(own))
            shared.append(shared_shingles(words_of(t), own))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(shared, pa.int64())], ["n_shingles", "n_shared"])

    both = pairs.join(own, "item_md5").join(distinct_texts.select("md5", "text"), "md5")
    checked = both.select("md5", "item_md5", counted("text", "item_text").alias("n")).select("md5", "item_md5", "n.*")
    return materialise(checked.filter(F.col("n_shared") >= F.ceil(similarity * F.col("n_shingles") - 1e-9)))


def within_a_block(items: DataFrame, block_bytes: int) -> bool:
    return (items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0) <= block_bytes


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    size: int = SHINGLE_WORDS,
    similarity: float = SIMILARITY,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Pairs (doc_id, item_id, n_shingles, n_shared, containment) of all items that occur in a document.

    Texts that are null, empty or without words contain nothing and are contained in nothing.  An
    item of fewer than five words is one shingle.  Null ids are kept as null; repeated documents
    give repeated pairs, repeated items one; other columns are ignored; empty tables give no pairs.
    """
    items = distinct_items(benchmark, item_id_col, item_text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    containment = (F.col("n_shared") / F.col("n_shingles")).alias("containment")
    if within_a_block(items, block_bytes):
        found = rows.select("doc_id", F.explode(matcher(items, size, similarity)("text")).alias("m"))
        return found.select("doc_id", "m.*").select("*", containment)
    keyed = rows.withColumn("md5", F.md5("text"))
    found = keyed.select("doc_id", "md5").join(joined_matches(keyed, items, size, similarity), "md5")
    named = found.join(items.select("item_id", F.md5("item_text").alias("item_md5")).distinct(), "item_md5")
    return named.select("doc_id", "item_id", "n_shingles", "n_shared", containment)


def remove_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    size: int = SHINGLE_WORDS,
    similarity: float = SIMILARITY,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents, with all their columns, in which no item occurs; nulls and empties as in find_contamination."""
    items = distinct_items(benchmark, item_id_col, item_text_col)
    text: Column = F.col(text_col)
    if within_a_block(items, block_bytes):
        return docs.filter(F.size(matcher(items, size, similarity)(text)) == 0)
    texts = docs.select(text.alias("text"), F.md5(text).alias("md5"))
    found = joined_matches(texts, items, size, similarity).select(F.col("md5").alias("__found")).distinct()
    return docs.join(found, F.md5(text) == F.col("__found"), "left_anti")
