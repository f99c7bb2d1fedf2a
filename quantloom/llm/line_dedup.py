"""Removal of multi-line passages that repeat across documents.

A rolling hash over the hashes of a document's lines gives every run of lines its fingerprint.
Which runs count as chunks depends on their content alone, so an inserted or missing line
elsewhere shifts nothing: a chunk opens at every line and closes at the first line with which it
has more than ``min_words`` words, and likewise backwards from every line.  Sparse boundaries (where
a rolling hash hits a divisor) would be fewer, but a passage lies within one to a few lines, and
those found only part of the repeated passages; the README has the figures.

A chunk repeats if two documents have it; the document of the smallest id keeps it.  Chunks of a
document that overlap, in it as in their keeper, grow into one run, so that a line is written for
comparison once for each keeper, however many chunks it lies in.  Runs whose bytes equal their
keeper's are removed; one that differs (unlike chunks of equal hashes) stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import byte_texts, discard, materialise

MIN_WORDS = 50
BASE = np.uint64(0x9E3779B97F4A7C15)
RUNS = ArrayType(StructType([StructField("first", LongType()), StructField("n_lines", LongType())]))


def chunks_of(text: bytes, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, number of lines and hash of each chunk."""
    lines = text.split(b"\n")
    n = np.fromiter((len(line.split()) for line in lines), dtype=np.int64, count=len(lines))
    total = np.concatenate([[0], np.cumsum(n)])
    if total[-1] <= min_words:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    opening = np.flatnonzero(n)
    closing = np.searchsorted(total, total[opening] + min_words, side="right") - 1
    forward = closing < len(lines)
    starts, ends = opening[forward], closing[forward]
    first = np.searchsorted(total, total[opening + 1] - min_words, side="left") - 1
    backward = first >= 0
    starts, ends = np.concatenate([starts, first[backward]]), np.concatenate([ends, opening[backward]])
    runs = np.unique(np.stack([starts, ends]), axis=1)
    starts, ends = runs[0], runs[1]
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(line) for line in lines), dtype=np.uint64, count=len(lines))
    rolled, power = np.zeros(len(lines) + 1, np.uint64), np.ones(len(lines) + 1, np.uint64)
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.full(len(lines), BASE, dtype=np.uint64))
        power[1:] = powers
        # the hash of lines i..j is the sum of their hashes times falling powers: prefix sums over inverse powers
        inverse = np.multiply.accumulate(np.full(len(lines), np.uint64(pow(int(BASE), -1, 1 << 64)), dtype=np.uint64))
        rolled[1:] = np.cumsum(hashes * inverse, dtype=np.uint64)
        h = (rolled[ends + 1] - rolled[starts]) * power[starts + 1]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + (ends - starts + 1).astype(np.uint64)
    return starts, ends - starts + 1, h


def chunk_table(docs: DataFrame, min_words: int) -> DataFrame:
    """doc, twin, first, n_lines, chunk of every chunk of every document (columns doc, twin, text)."""
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, rows = [], []
            for k, text in enumerate(byte_texts(batch.column(2))):
                c = chunks_of(text, min_words)
                found.append(c)
                rows.append(np.full(len(c[0]), k))
            if not rows:
                continue
            first, n_lines, h = (np.concatenate(x) for x in zip(*found, strict=True))
            at = pa.array(np.concatenate(rows))
            arrays = [batch.column(0).take(at), batch.column(1).take(at), pa.array(first, pa.int64()), pa.array(n_lines, pa.int64()), pa.array(h.view(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "twin", "first", "n_lines", "chunk"])

    return docs.select("doc", "twin", "text").mapInArrow(run, f"doc {kind}, twin long, first long, n_lines long, chunk long")


@F.arrow_udf(RUNS)
def widest(runs: pa.Array) -> pa.Array:
    """The fewest runs that cover the same lines; runs that only touch stay apart."""
    out = []
    for found in runs:
        merged: list[list[int]] = []
        for first, n_lines in sorted((r["first"], r["n_lines"]) for r in found.as_py()):
            if merged and first < merged[-1][0] + merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], first + n_lines - merged[-1][0])
            else:
                merged.append([first, n_lines])
        out.append([{"first": first, "n_lines": n_lines} for first, n_lines in merged])
    return pa.array(out, pa.list_(pa.struct([("first", pa.int64()), ("n_lines", pa.int64())])))


def remove_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """The documents, with all their columns, without passages of over min_words words that an earlier one has.

    Adds the columns n_lines and n_removed_lines (replacing any of that name).  Earlier is the
    document of the smaller id; a null id comes last, and rows of one id (or of none) are one
    document, so that nothing counts as repeated among them.  A null text stays null with 0 lines;
    an empty text has one empty line.  Repeats within a document alone stay.  An empty table gives
    an empty table.
    """
    keyed = docs.withColumns({"__twin": F.xxhash64(text_col)})
    texts = keyed.select(F.col(id_col).alias("doc"), F.col("__twin").alias("twin"), F.col(text_col).alias("text"))
    chunks = materialise(chunk_table(texts, min_words))
    rank = [F.col("doc").isNull().alias("last"), F.col("doc").alias("doc")]
    repeated = chunks.groupBy("chunk").agg(F.min(F.struct(*rank, "twin", "first")).alias("keeper"), F.min(F.struct(*rank)).alias("least"), F.max(F.struct(*rank)).alias("most"))
    # a keeper is never null, as nulls come last; as a table, so that a hot chunk's join can be split or broadcast
    repeated = materialise(repeated.filter("least != most").select("chunk", *(F.col(f"keeper.{c}").alias(f"k_{c}") for c in ("doc", "twin", "first"))))
    theirs = ["doc", "twin", "k_doc", "k_twin"]
    shifted = chunks.join(repeated, "chunk").filter(~F.col("doc").eqNullSafe(F.col("k_doc"))).withColumn("shift", F.col("first") - F.col("k_first"))
    runs = shifted.groupBy(*theirs, "shift").agg(F.collect_set(F.struct("first", "n_lines")).alias("runs"))
    runs = runs.select(*theirs, "shift", F.explode(widest("runs")).alias("run")).select(*theirs, "run.*", (F.col("run.first") - F.col("shift")).alias("k_first"))
    runs = materialise(runs)
    discard(chunks)
    discard(repeated)
    place = ["k_doc", "k_twin", "k_first", "n_lines"]
    kept = runs.select(*place).distinct().select(F.col("k_doc").alias("doc"), F.col("k_twin").alias("twin"), F.col("k_first").alias("first"), F.lit(True).alias("keeps"), *place)
    parts = runs.select("doc", "twin", "first", F.lit(False).alias("keeps"), *place).unionByName(kept)
    parts = parts.groupBy("doc", "twin").agg(F.collect_set(F.struct("first", "keeps", *place)).alias("runs"))
    cut = F.slice("lines", F.col("run.first").cast("int") + 1, F.col("run.n_lines").cast("int"))
    spelled = (
        texts.join(parts, [texts["doc"].eqNullSafe(parts["doc"]), texts["twin"] == parts["twin"]])
        .select(texts["doc"], texts["twin"], F.split("text", "\n").alias("lines"), F.explode("runs").alias("run"))
        .select("doc", "twin", "run.*", F.array_join(cut, "\n").alias("bytes"))
    )
    spelled = materialise(spelled)
    discard(runs)
    kept = materialise(spelled.filter("keeps").groupBy(*place).agg(F.min("bytes").alias("kept_bytes")))
    again = spelled.filter("not keeps").join(kept, place).filter(F.col("bytes") == F.col("kept_bytes"))
    removed = again.groupBy(F.col("doc").alias("__doc"), F.col("twin").alias("__twin_of")).agg(
        F.collect_set(F.struct("first", "n_lines")).alias("__runs")
    )
    joined = keyed.join(removed, [keyed[id_col].eqNullSafe(removed["__doc"]), keyed["__twin"] == removed["__twin_of"]], "left")

    @F.arrow_udf("struct<text:string,n_lines:int,n_removed_lines:int>")
    def clean(text: pa.Array, runs: pa.Array) -> pa.Array:
        texts, sizes, removed = [], [], []
        for t, r in zip(text, runs, strict=True):
            parts = [] if (whole := t.as_py()) is None else whole.split("\n")
            gone = np.zeros(len(parts), dtype=bool)
            for run in r.as_py() or ():
                gone[run["first"] : run["first"] + run["n_lines"]] = True
            texts.append("\n".join(p for p, g in zip(parts, gone, strict=True) if not g) if gone.any() else whole)
            sizes.append(len(parts))
            removed.append(int(gone.sum()))
        columns = [pa.array(texts, pa.string()), pa.array(sizes, pa.int32()), pa.array(removed, pa.int32())]
        return pa.StructArray.from_arrays(columns, ["text", "n_lines", "n_removed_lines"])

    done = joined.withColumn("__done", clean(F.col(text_col), F.col("__runs")))
    columns = [F.col("__done.text").alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed_lines")]
    return done.select(*columns, "__done.n_lines", "__done.n_removed_lines")
