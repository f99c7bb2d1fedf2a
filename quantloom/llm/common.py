"""Small helpers shared by the corpus operators.

Words are maximal runs of anything but ASCII white space.  On UTF-8 bytes that is
exactly ``bytes.split()``, and ``bytes.lower()`` lower-cases A-Z alone, so the Python
helpers of the operators work on the bytes of a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.storage import discard, materialise, scratch  # noqa: F401  (the operators take them from here)

#: ASCII white space: what separates words.
WHITE_SPACE = " \t\n\x0b\x0c\r"
#: The same as a pattern for Java's regular expressions.
WHITE_SPACE_RUN = r"[\x20\x09-\x0D]+"
SHINGLE_WORDS = 5
SIMILARITY = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: inside a higher-order function Spark would compute it for each element."""
    return F.transform(F.array(value), body)[0]


def fold(key: Column, folds: int) -> Column:
    """crc32 of a key's decimal text, modulo the number of folds (null for a null key)."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(folds)


def byte_texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of an Arrow column, null as empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def in_pieces(rows: Iterable, size: int) -> Iterator[list]:
    """Lists of up to size rows."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
