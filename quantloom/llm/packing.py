"""Packing into fixed-length training sequences by vector bin packing.

Every example has three demands (tokens, one segment, loss-bearing tokens) and every
sequence the same three limits.  A sequence takes, one after another, the fitting example
whose demand vector has the largest dot product with what is left of the sequence.

Packing works inside each input partition, so it needs no shuffle, holds a bounded pool of
examples and costs the same per row at any size.  Numbers of sequences carry the partition's
number, and a lost task is packed again in full from its own partition.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts

CAPACITY = 1024
MAX_SEGMENTS = 64
POOL = 512
END_ID = 0
LONG_SPACE = re.compile(r"\s{4096}")
#: A task numbers its sequences from its partition's number times this.
SEQUENCES_PER_TASK = 1 << 40


class Bin:
    """What is left of one sequence."""

    def __init__(self, limits: np.ndarray):
        self.limits, self.left, self.items = limits, limits.copy(), []

    def put(self, item, demand: np.ndarray) -> None:
        self.items.append(item)
        self.left = self.left - demand


def best_fit(demands: np.ndarray, left: np.ndarray, limits: np.ndarray) -> int:
    """Index of the fitting demand with the largest normalised dot product, -1 if none fits; ties: the first."""
    fits = (demands <= left).all(axis=1)
    if not fits.any():
        return -1
    scale = 1.0 / np.square(np.maximum(limits, 1)).astype(float)
    return int(np.argmax(np.where(fits, demands @ (left * scale), -1.0)))


def pack_examples(
    examples: DataFrame,
    id_col: str = "example_id",
    tokens_col: str = "n_tokens",
    loss_col: str = "n_loss_tokens",
    capacity: int = CAPACITY,
    max_segments: int = 16,
    max_loss_tokens: int | None = None,
    pool: int = POOL,
) -> DataFrame:
    """Places whole examples; returns example id, n_tokens, n_loss_tokens, sequence_id, segment, offset.

    Null counts read as 0.  An example over a limit on its own gets no sequence: sequence_id,
    segment and offset are null.  Repeated ids and null ids are examples like any other; other
    columns of the input are ignored; an empty table gives an empty table.
    """
    limits = np.array([capacity, max_segments, capacity if max_loss_tokens is None else max_loss_tokens])
    rows = examples.select(
        F.col(id_col).alias("example_id"),
        F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.col(loss_col).cast("long"), F.lit(0)).alias("n_loss_tokens"),
    )
    kind = rows.schema["example_id"].dataType.simpleString()
    schema = f"example_id {kind}, n_tokens long, n_loss_tokens long, sequence_id long, segment int, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() * SEQUENCES_PER_TASK
        waiting: list[tuple] = []  # key, tokens, loss-bearing tokens

        def placed(wanted: int) -> Iterator[tuple]:
            """Fill sequences until no more than wanted examples are left."""
            nonlocal waiting, number
            demands = np.array([(n, 1, loss) for _, n, loss in waiting], dtype=np.int64)
            while len(waiting) > wanted:
                room, taken = Bin(limits), []
                free = np.ones(len(waiting), dtype=bool)
                while (k := best_fit(np.where(free[:, None], demands, limits + 1), room.left, limits)) >= 0:
                    free[k] = False
                    taken.append(k)
                    room.put(k, demands[k])
                at = 0
                for segment, k in enumerate(taken):
                    yield *waiting[k], number, segment, at
                    at += waiting[k][1]
                number += 1
                waiting, demands = [x for x, f in zip(waiting, free, strict=True) if f], demands[free]

        def columns(rows: list[tuple], batch_type: pa.DataType) -> pa.RecordBatch:
            parts = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (batch_type, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ("example_id", "n_tokens", "n_loss_tokens", "sequence_id", "segment", "offset")
            return pa.RecordBatch.from_arrays([pa.array(p, t) for p, t in zip(parts, kinds, strict=True)], names)

        id_type = pa.null()
        for batch in batches:
            id_type = batch.column(0).type
            out: list[tuple] = []
            for key, n, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n > capacity or loss > limits[2] or max_segments < 1:
                    out.append((key, n, loss, None, None, None))
                    continue
                waiting.append((key, n, loss))
                if len(waiting) >= 2 * pool:
                    out.extend(placed(pool))
            yield columns(out, id_type)
        if waiting:
            yield columns(list(placed(0)), id_type)

    return rows.mapInArrow(run, schema)


@lru_cache(maxsize=2)
def encoder(path: str):
    """Encodes texts to ids as ``tokenizers`` does with the file.

    The rank file beside a byte-level BPE file holds the same vocabulary; tiktoken reads it and
    gives the same ids about four times as fast.  Texts that spell a special token, texts with a long run
    of white space (over which its pattern backtracks until the stack ends), and files without ranks
    go to ``tokenizers`` itself.
    """
    import base64
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    special = [t.content for t in exact.get_added_tokens_decoder().values()]
    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_path):
        return lambda text: exact.encode(text, add_special_tokens=False).ids
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(s in text for s in special) or LONG_SPACE.search(text):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def binary_parts(n: int) -> list[int]:
    """n as a sum of powers of two, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class DocumentPacker:
    """Cuts documents and fills sequences without gaps.

    Full-length pieces are sequences of their own.  Remainders wait in a pool of bounded size;
    the vector heuristic fills a sequence with whole remainders, and the largest one still
    waiting is cut to fill the last gap.  What is left at the end of a task is cut into
    sequences whose lengths are powers of two, which need no padding either.
    """

    def __init__(self, first: int, capacity: int, max_segments: int, max_loss: int, pool: int):
        self.limits = np.array([capacity, max_segments, max_loss])
        self.capacity, self.pool, self.number = capacity, pool, first
        self.waiting: list[tuple] = []  # key, ids, start, tokens of the document

    def emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for key, ids, start, total in pieces:
            yield key, start, len(ids), zlib.crc32(ids.tobytes()), total, self.number, at, self.loss(ids, start, total)
            at += len(ids)
        self.number += 1

    @staticmethod
    def loss(ids: np.ndarray, start: int, total: int) -> int:
        """All tokens bear loss but the separator that ends the document."""
        return len(ids) - (start + len(ids) == total)

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        total, start = len(ids), 0
        whole = min(self.capacity, int(self.limits[2]))
        while total - start >= self.capacity and whole == self.capacity:
            yield from self.emit([(key, ids[start : start + whole], start, total)])
            start += whole
        while start < total:  # under a lower limit on loss, several pieces
            n = min(whole, total - start)
            self.waiting.append((key, ids[start : start + n], start, total))
            start += n
        while len(self.waiting) >= 2 * self.pool:
            yield from self.fill()

    def demands(self) -> np.ndarray:
        return np.array([(len(ids), 1, self.loss(ids, start, total)) for _, ids, start, total in self.waiting])

    def fill(self) -> Iterator[tuple]:
        """Sequences until the pool is down to its size, or empty at the end."""
        demands = self.demands()
        free = np.ones(len(demands), dtype=bool)
        while int(free.sum()) > self.pool:
            yield from self.place(self.one(demands, free))
        self.waiting = [w for w, f in zip(self.waiting, free, strict=True) if f]

    def one(self, demands: np.ndarray, free: np.ndarray) -> list[tuple]:
        room, pieces = Bin(self.limits), []
        while room.left.min() > 0:
            k = best_fit(np.where(free[:, None], demands, self.limits + 1), room.left, self.limits)
            if k < 0:
                break
            free[k] = False
            pieces.append(self.waiting[k])
            room.put(k, demands[k])
        gap = int(min(room.left[0], room.left[2]))
        if gap > 0 and room.left[1] > 0 and free.any():
            k = int(np.argmax(np.where(free, demands[:, 0], -1)))
            key, ids, start, total = self.waiting[k]
            if len(ids) > gap:
                pieces.append((key, ids[:gap], start, total))
                self.waiting[k] = (key, ids[gap:], start + gap, total)
                demands[k] = (len(ids) - gap, 1, self.loss(ids[gap:], start + gap, total))
        return pieces

    def finish(self) -> Iterator[tuple]:
        demands = self.demands() if self.waiting else np.empty((0, 3), dtype=np.int64)
        free = np.ones(len(demands), dtype=bool)
        while free.any():
            yield from self.place(self.one(demands, free))
        self.waiting = []

    def place(self, pieces: list[tuple]) -> Iterator[tuple]:
        """A full sequence as it is; a shorter one (end of a task, or another limit reached) in powers of two."""
        if sum(len(p[1]) for p in pieces) == self.capacity:
            yield from self.emit(pieces)
        else:
            yield from self.in_powers(pieces)

    def in_powers(self, pieces: list[tuple]) -> Iterator[tuple]:
        for length in binary_parts(sum(len(p[1]) for p in pieces)):
            part, need = [], length
            while need:
                key, ids, start, total = pieces[0]
                part.append((key, ids[:need], start, total))
                if len(ids) > need:
                    pieces[0] = (key, ids[need:], start + need, total)
                else:
                    pieces.pop(0)
                need -= len(part[-1][1])
            yield from self.emit(part)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    max_segments: int = MAX_SEGMENTS,
    max_loss_tokens: int | None = None,
    pool: int = POOL,
) -> DataFrame:
    """Tokenises whole texts, ends each with id 0 and packs the ids; a document may be cut anywhere.

    Returns per piece doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and
    n_loss_tokens.  A null text is an empty one (its only id is the ending 0); a null id is kept as
    null; repeated rows are documents of their own; other columns of the input are ignored; an
    empty table gives an empty table.  No sequence breaks a limit; a text is never shortened.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "n_loss_tokens")
    schema = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names)
    max_loss = capacity if max_loss_tokens is None else max_loss_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        packer = DocumentPacker(TaskContext.get().partitionId() * SEQUENCES_PER_TASK, capacity, max_segments, max_loss, pool)
        id_type = pa.null()

        def columns(out: list[tuple]) -> pa.RecordBatch:
            parts = list(zip(*out, strict=True)) or [[]] * 8
            arrays = [pa.array(p, id_type if not k else pa.int64()) for k, p in enumerate(parts)]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", *names])

        for batch in batches:
            id_type, out = batch.column(0).type, []
            for key, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
                ids = np.array([*encode(text.decode("utf-8", "replace")), END_ID], dtype="<u4")
                out.extend(packer.add(key, ids))
                if len(out) >= 20_000:
                    yield columns(out)
                    out = []
            yield columns(out)
        if packer.waiting:
            yield columns(list(packer.finish()))

    return rows.mapInArrow(run, schema)


def instruction_examples(turns: DataFrame, tokenizer: str, id_col: str = "conv_id", role_col: str = "role", text_col: str = "text", learned: str = "assistant") -> DataFrame:
    """example_id, n_tokens, n_loss_tokens of every conversation, given its turns.

    A turn is its text's tokens and id 0; those of the role ``learned`` bear loss.  A null text is an
    empty one, a null role bears no loss, turns without an id are one conversation, repeated turns count
    each; other columns are ignored; an empty table gives an empty table.
    """

    @F.arrow_udf("long")
    def n_tokens(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = encoder(tokenizer)
        for part in texts:
            yield pa.array([len(encode(t.decode("utf-8", "replace"))) + 1 for t in byte_texts(part)], pa.int64())

    counted = turns.select(F.col(id_col).alias("example_id"), (F.col(role_col) == learned).alias("bears"), n_tokens(F.col(text_col)).alias("n"))
    loss = F.sum(F.when(F.col("bears"), F.col("n")).otherwise(0))
    return counted.groupBy("example_id").agg(F.sum("n").alias("n_tokens"), loss.alias("n_loss_tokens"))
