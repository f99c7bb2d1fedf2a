"""Log-probabilities of texts under a smoothed trigram model, as a weighted backoff automaton.

The states of the automaton are the contexts seen in training: of two words, of one word (or the
start of a text), and the empty one, the root.  A trigram seen in training is an arc from its first
two words, a bigram one from its first word, a word one from the root; an arc leads to the longest
context that ends its words.  Each other state has a failure arc to its context without the first
word.  With c a training count, and P the weight of the shorter context,

    P(x) = (c(x) + 1) / (N + V + 1),  P(x | h) = (c(h, x) + m P(x | h without its first word)) / (c(h) + m):

an arc weighs log10 of that, a failure arc log10 m / (c(h) + m), so each state's weights sum to 1.  A
text is read once from left to right, carrying the state: where it has no arc for the next word,
failure arcs are followed, and their weights added, up to one that has.

Counts are of all training texts, and the model as a whole is in no place at once.  Texts are cut
into blocks, which are kept as tables of numbers.  Each block sends the 56-bit keys of its distinct
words, bigrams and trigrams, with its training counts, to buckets by ranges of keys; a bucket adds
the counts of equal keys of all blocks and returns the totals to each block that asked.  So a block
gets just the part of the automaton that its own texts can reach.  A key comes once from each block
at most, however frequent it is, and empty ranges are not sent: what is exchanged is at most one row
for each of a block's keys, and grows with the input.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, fold, in_pieces, materialise

#: Weight of the shorter context in each longer one, in tokens.
PRIOR = 100.0
FOLDS, HELD_OUT = 7, 2
BLOCK_BYTES = 8 << 20
#: Text for each bucket: what is sent to one takes some twice as many bytes in its task.
BUCKET_BYTES = 6 << 20
#: A task numbers its blocks from its partition's number times this.
BLOCKS_PER_TASK = 1 << 32
#: Keys have 56 bits: of 10^13 n-grams one in several thousand shares its key, and so its count, with another.
SPARE_BITS = np.uint64(8)
END, START = np.uint64(0x9AE16A3B2F90404F) >> SPARE_BITS, np.uint64(0xC949D7C7509E6557) >> SPARE_BITS


def squeezed(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed: leading zero bytes cost next to nothing."""
    return zlib.compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), 1)


def unsqueezed(data: bytes, dtype: str) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(dtype).ravel()


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Keys of pairs of keys."""
    with np.errstate(over="ignore"):
        k = first * np.uint64(0x9E3779B97F4A7C15) ^ (second + np.uint64(0x7F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        k = (k ^ (k >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return (k ^ (k >> np.uint64(29))) >> SPARE_BITS


class Block:
    """Some texts as numbers: words by first appearance in the block, 0 for the end of a text."""

    def __init__(self, seq: np.ndarray, lengths: np.ndarray, keys: np.ndarray):
        self.seq, self.lengths, self.keys = seq, lengths, keys
        self.starts = np.cumsum(lengths) - lengths
        self.start = len(keys)  # the context before the first word
        before = np.empty_like(seq)
        before[1:] = seq[:-1]
        before[self.starts] = self.start
        codes, self.bigram_of = np.unique(before * (self.start + 1) + seq, return_inverse=True)
        self.context, self.word = np.divmod(codes, self.start + 1)
        later = np.ones(len(seq), dtype=bool)  # all but the first of each text end a trigram
        later[self.starts] = False
        at = np.flatnonzero(later)
        codes, of = np.unique(self.bigram_of[at - 1] * (self.start + 1) + seq[at], return_inverse=True)
        self.pair, self.last = np.divmod(codes, self.start + 1)
        self.trigram_of = np.full(len(seq), -1)
        self.trigram_of[at] = of
        self.first_pair = np.append(self.bigram_of[at], 0)[np.unique(of, return_index=True)[1]] if len(at) else of  # the bigram that ends each trigram

    @classmethod
    def of(cls, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of the words, the lengths of the texts with their ends, the words' keys."""
        number: dict[bytes, int] = {}
        parts = []
        for text in texts:
            parts.append(np.fromiter((number.setdefault(w, len(number) + 1) for w in text.lower().split()), dtype=np.int32))
            parts.append(np.zeros(1, dtype=np.int32))
        seq = np.concatenate(parts)
        lengths = np.diff(np.concatenate([[-1], np.flatnonzero(seq == 0)]))
        keys = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), dtype=np.uint64, count=len(number)) >> SPARE_BITS
        return seq, lengths, np.concatenate([[END], keys])

    def ngram_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys of the block's bigrams and of its trigrams."""
        extended = np.append(self.keys, START)
        bigrams = pair_keys(extended[self.context], extended[self.word])
        return bigrams, pair_keys(bigrams[self.pair], extended[self.last])


def asked(keys: np.ndarray, counts: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """For each bucket that has any: its keys in order, and their training counts, compressed."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts.astype(np.int32)[order]
    at = cuts(keys, buckets)
    for b in np.flatnonzero(np.diff(at) > 0).tolist():
        part = slice(at[b], at[b + 1])
        yield b, deltas(keys[part]), squeezed(counts[part])


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the ranges of the buckets begin among sorted keys."""
    bounds = np.array([(b << 56) // buckets for b in range(1, buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def deltas(keys: np.ndarray) -> bytes:
    return squeezed(np.diff(keys, prepend=np.uint64(0)))


def undeltas(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueezed(data, "<u8"), dtype=np.uint64)


def totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """Total of each key's counts, in place of each; number of keys with a count."""
    unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(counts), len(unique)).astype(np.int64)
    return total[inverse], int((total > 0).sum())


class BackoffAutomaton:
    """The part of the model that a block reaches.  States: 0 is the root, then words (and the start), then bigrams."""

    def __init__(self, block: Block, words: np.ndarray, bigrams: np.ndarray, trigrams: np.ndarray, tokens: int, vocabulary: int, prior: float):
        n, m = len(block.keys), len(block.context)
        contexts = np.append(words, words[0])  # the start comes as often as the end
        base = (words + 1) / (tokens + vocabulary + 1)
        shorter = (bigrams + prior * base[block.word]) / (contexts[block.context] + prior)
        longer = (trigrams + prior * shorter[block.first_pair]) / (bigrams[block.pair] + prior)
        word_state = np.where(contexts > 0, np.arange(1, n + 2), 0)
        pair_state = np.where(bigrams > 0, np.arange(n + 2, n + 2 + m), word_state[block.word])
        self.start = int(word_state[block.start])
        self.level = np.concatenate([[0], np.ones(n + 1, dtype=np.int8), np.full(m, 2, dtype=np.int8)])
        self.failure = np.concatenate([[0], np.zeros(n + 1, dtype=np.int64), word_state[block.word]])
        self.failure_weight = np.log10(prior / (np.concatenate([[0], contexts, bigrams]) + prior))
        # arcs of words, of bigrams and of trigrams; those not seen in training are not there
        self.weight = np.log10(np.concatenate([base, shorter, longer]))
        self.target = np.concatenate([word_state[:n], pair_state, pair_state[block.first_pair]])
        self.arcs = (np.arange(n), np.where(bigrams > 0, np.arange(n, n + m), -1), np.where(trigrams > 0, np.arange(n + m, n + m + len(trigrams)), -1))

    def arc(self, block: Block, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The arc by which the word at each place leaves the state of that level that ends before it, or -1."""
        found = self.arcs[0][block.seq[at]]
        for k, ngram_of in ((1, block.bigram_of), (2, block.trigram_of)):
            here = level == k
            found[here] = self.arcs[k][ngram_of[at[here]]]
        return found

    def traverse(self, block: Block) -> np.ndarray:
        """The log10 probability of each text: all texts step from word to word together, each in its own state."""
        order = np.argsort(-block.lengths, kind="stable")
        lengths, starts = block.lengths[order], block.starts[order]
        state, total = np.full(len(order), self.start), np.zeros(len(order))
        active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
        for step, n in enumerate(active.tolist()):
            at, s = starts[:n] + step, state[:n]
            arc = self.arc(block, self.level[s], at)
            while len(stuck := np.flatnonzero(arc < 0)):
                total[stuck] += self.failure_weight[s[stuck]]
                s[stuck] = self.failure[s[stuck]]
                arc[stuck] = self.arc(block, self.level[s[stuck]], at[stuck])
            total[:n] += self.weight[arc]
            state[:n] = self.target[arc]
        out = np.empty_like(total)
        out[order] = total
        return out


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT, prior: float = PRIOR, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    The texts of fold ``held_out`` teach nothing.  A null text is an empty one: its only token is the
    end.  A null id is in no fold (held_out false) and teaches; repeated rows count and are scored
    each.  Without training texts all counts are 0.  Other columns are ignored; an empty table gives
    an empty table.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(fold(F.col(id_col), folds) == held_out, F.lit(False)).alias("held_out"),
        F.col(text_col).alias("text"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    stored = {"task": "int", "block": "long", "doc_ids": f"array<{kind}>", "held_out": "array<boolean>", "lengths": "binary", "seq": "binary", "keys": "binary", "tokens": "long", "bytes": "long"}

    def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number = task * BLOCKS_PER_TASK
        ids, held, texts, gathered, id_type = [], [], [], 0, pa.null()

        def row() -> pa.RecordBatch:
            nonlocal number, ids, held, texts, gathered
            seq, lengths, keys = Block.of(texts)
            values = [task, number, ids, held, squeezed(lengths.astype("<i4")), squeezed(seq), squeezed(keys), int(lengths[~np.array(held, dtype=bool)].sum()), gathered]
            types = [pa.int32(), pa.int64(), pa.list_(id_type), pa.list_(pa.bool_()), *[pa.binary()] * 3, pa.int64(), pa.int64()]
            number, ids, held, texts, gathered = number + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], list(stored))

        for batch in batches:
            id_type = batch.column(0).type
            for key, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_texts(batch.column(2)), strict=True):
                ids.append(key)
                held.append(out)
                texts.append(text)
                gathered += len(text)
                if gathered >= block_bytes:
                    yield row()
        if ids:
            yield row()

    # in buckets by task, so that one file is written by each task and blocks meet their answers without a shuffle
    blocks = materialise(rows.mapInArrow(block_rows, ", ".join(f"{c} {t}" for c, t in stored.items())), by="task")
    known = blocks.agg(F.sum("tokens"), F.sum("bytes")).first()
    tokens, buckets = int(known[0] or 0), max(1, math.ceil((known[1] or 0) / bucket_bytes))
    wide = max(1, buckets // 16)  # words are far fewer

    def training(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The numbers, lengths and keys of a block, and for each number whether it is of a training text."""
        row = {name: batch.column(name)[k].as_py() for name in ("held_out", "lengths", "seq", "keys")}
        lengths = unsqueezed(row["lengths"], "<i4").astype(np.int64)
        return unsqueezed(row["seq"], "<i4").astype(np.int64), lengths, unsqueezed(row["keys"], "<u8"), np.repeat(~np.array(row["held_out"], dtype=bool), lengths)

    request = "task int, block long, bucket int, size int, keys binary, counts binary"

    def packed(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for part in in_pieces(rows, 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], [c.split()[0] for c in request.split(", ")])

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                seq, _, keys, teaches = training(batch, k)
                own = batch.column("task")[k].as_py(), batch.column("block")[k].as_py()
                yield from packed((*own, b, 1, *sent) for b, *sent in asked(keys, np.bincount(seq, teaches, len(keys)), wide))

    def ask_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                seq, lengths, keys, teaches = training(batch, k)
                block, own = Block(seq, lengths, keys), (batch.column("task")[k].as_py(), batch.column("block")[k].as_py())
                bigrams, trigrams = block.ngram_keys()
                yield from packed((*own, b, 2, *sent) for b, *sent in asked(bigrams, np.bincount(block.bigram_of, teaches, len(bigrams)), buckets))
                later = block.trigram_of >= 0
                yield from packed((*own, b, 3, *sent) for b, *sent in asked(trigrams, np.bincount(block.trigram_of[later], teaches[later], len(trigrams)), buckets))

    def answer(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        counts = [unsqueezed(c, "<i4") for c in part["counts"]]
        total, distinct = totals([undeltas(k) for k in part["keys"]], counts)
        at = np.cumsum([0, *map(len, counts)])
        out = part[["task", "block", "bucket", "size"]].assign(counts=[squeezed(total[a:b]) for a, b in zip(at, at[1:], strict=False)])
        return out.assign(known=[distinct] + [0] * (len(part) - 1))

    def answers(ask: Callable) -> DataFrame:
        return blocks.mapInArrow(ask, request).groupBy("size", "bucket").applyInPandas(answer, "task int, block long, bucket int, size int, counts binary, known long")

    words = materialise(answers(ask_words))
    vocabulary = int(words.agg(F.sum("known")).first()[0] or 0)

    def score(key: tuple, blocks: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        by_block = dict(list(got.sort_values(["size", "bucket"]).groupby("block")))
        return pd.concat([scored(row, by_block[row["block"]]) for _, row in blocks.iterrows()])

    def scored(row: pd.Series, got: pd.DataFrame) -> pd.DataFrame:
        block = Block(unsqueezed(row["seq"], "<i4").astype(np.int64), unsqueezed(row["lengths"], "<i4").astype(np.int64), unsqueezed(row["keys"], "<u8"))
        counts = []
        for size, keys in enumerate((block.keys, *block.ngram_keys()), 1):
            told = [unsqueezed(c, "<i8") for c in got.loc[got["size"] == size, "counts"]]
            here = np.empty(len(keys), dtype=np.int64)
            here[np.argsort(keys)] = np.concatenate(told) if told else 0
            counts.append(here)
        automaton = BackoffAutomaton(block, *counts, tokens, vocabulary, prior)
        return pd.DataFrame(
            {
                "doc_id": row["doc_ids"],
                "held_out": row["held_out"],
                "n_tokens": block.lengths,
                "n_known": np.add.reduceat((counts[0][block.seq] > 0).astype(np.int64), block.starts),
                "train_tokens": tokens,
                "base_score": np.add.reduceat(automaton.weight[block.seq], block.starts),
                "score": automaton.traverse(block),
            }
        )

    wanted = words.drop("known").unionByName(answers(ask_ngrams).drop("known"))
    return blocks.drop("tokens", "bytes").groupBy("task").cogroup(wanted.groupBy("task")).applyInPandas(
        score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
