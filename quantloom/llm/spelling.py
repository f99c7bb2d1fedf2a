"""Words one edit apart, by two-dimensional range reporting, and the common form of each rare one.

Two words that differ at one position share what is before and what is after it.  Sorted, the words
with that beginning are an interval; sorted by their reversed letters, those with that end are one too.
A word is a point (place in the one order, place in the other), and the near words at a position
are the points in a rectangle.  A wavelet tree over the places of the second order, in the first
order, reports them; all words and positions of a batch descend it together.

Words are dealt out by what they must share.  A range of positions fixes the beginning before and the end
behind it, so all words that may meet in that range have one key.  There are two ranges at first, and
a key with too many words is dealt out again by the halves of its range, down to single positions,
where an alphabet of 94 letters bounds the words that share a key.  Each pair is found in one range and at one position.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, discard, materialise

LEAST_LETTERS, LEAST_COUNT, RATIO, TYPO_EVERY = 6, 5, 5, 199
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Words of one key that are dealt out again; words a task holds at once; distinct words counted before they are handed on.
MOST_OF_KEY, BATCH, HELD = 1 << 16, 1 << 16, 1 << 19
WORD, COUNT = "word string", "n long"
REPORT = "word string, near long, best_n long, best string"


def changed(run: str, key: str) -> str:
    """A lower-cased run as document `key` spells it: one in 199 loses a letter."""
    h = zlib.crc32(f"{key}:{run}".encode())
    if h % TYPO_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """word, n: how often each word of enough letters occurs in all documents, where it does often enough."""
    rows = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
                for word, n in Counter(RUN.findall(text.lower().decode())).items():  # bytes: only A-Z
                    word = changed(word, key or "")
                    if len(word) >= LEAST_LETTERS:
                        held[word] += n
                if len(held) >= HELD:
                    yield counted()
        yield counted()

    return rows.mapInArrow(run, f"{WORD}, {COUNT}").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def dealt(low: Column, high: Column) -> Column:
    """The key of a word of a class (of its letters or one more) for positions from low up to high: all it fixes."""
    return F.xxhash64("class", low, high, F.left(F.col("word"), low), F.right(F.col("word"), F.greatest(F.col("class") - high, F.lit(0))))


def shards(words: DataFrame) -> DataFrame:
    """word, n, class, low, high, key: every word in each class and range in which it may meet others.

    A class holds the words of one length and those one letter longer.  Its ranges cover the positions 0 to its length.
    """
    length = F.length("word")
    classes = words.withColumn("class", F.explode(F.array(length, length - 1))).filter(F.col("class") >= LEAST_LETTERS)
    middle = F.floor(F.col("class") / 2).cast("int")
    ranges = F.array(F.struct(F.lit(0).alias("low"), middle.alias("high")), F.struct(middle.alias("low"), (F.col("class") + 1).alias("high")))
    rows = classes.withColumn("range", F.explode(ranges)).select("word", "n", "class", "range.low", "range.high")
    return rows.withColumn("key", dealt(F.col("low"), F.col("high")))


def dealt_again(rows: DataFrame, most: int) -> DataFrame:
    """The same with the ranges of crowded keys halved until no key has more than `most` words or its range is one position."""
    wide = F.col("high") - F.col("low") > 1
    while True:
        rows = materialise(rows)
        crowded = materialise(rows.filter(wide).groupBy("key").count().filter(F.col("count") > most).select("key", F.lit(True).alias("crowded")))
        if crowded.isEmpty():
            return rows
        marked = rows.join(crowded, "key", "left")
        stays = F.col("crowded").isNull() | ~wide
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct("low", middle.alias("high")), F.struct(middle.alias("low"), "high"))
        split = marked.filter(~stays).withColumn("range", F.explode(halves)).select("word", "n", "class", "range.low", "range.high")
        split = split.withColumn("key", dealt(F.col("low"), F.col("high")))
        rows = marked.filter(stays).select(*split.columns).unionByName(split)


class WaveletTree:
    """Whole numbers below 2^bits in a sequence; reports those of a value range in a range of places.

    Of each level from the highest bit down it keeps how many numbers before each place have a zero there; numbers are
    in the order in which the levels above left them, zeros first.
    """

    def __init__(self, numbers: np.ndarray):
        self.bits = max(int(numbers.max(initial=0)).bit_length(), 1)
        self.zeros = []
        for bit in range(self.bits - 1, -1, -1):
            one = (numbers >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            numbers = np.concatenate([numbers[~one], numbers[one]])

    def report(self, begin: np.ndarray, end: np.ndarray, least: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For all queries together: the number of a query and a value in [least, above) at a place in [begin, end) of it.

        Values that occur several times in a range of places are given once.
        """
        query = np.flatnonzero((begin < end) & (least < above))
        begin, end, least, above = begin[query], end[query], least[query], above[query]
        value = np.zeros(len(query), dtype=np.int64)
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            zeros = self.zeros[level]
            b0, e0 = zeros[begin], zeros[end]
            b1, e1 = begin - b0 + zeros[-1], end - e0 + zeros[-1]
            query, begin, end, least, above, value = (
                np.concatenate(pair) for pair in ((query, query), (b0, b1), (e0, e1), (least, least), (above, above), (value, value | 1 << bit))
            )
            keep = (begin < end) & (value < above) & (value + (1 << bit) > least)
            query, begin, end, least, above, value = (x[keep] for x in (query, begin, end, least, above, value))
        return query, value


class Lexicon:
    """Words of one length in both orders, with the wavelet tree of their points."""

    def __init__(self, words: np.ndarray, length: int):
        self.words, self.length = words, length
        self.forward = np.argsort(words, kind="stable")
        back = backwards(words, length)
        self.reverse = np.argsort(back, kind="stable")
        self.sorted, self.sorted_back = words[self.forward], back[self.reverse]
        place = np.empty(len(words), dtype=np.int64)
        place[self.reverse] = np.arange(len(words))
        self.tree = WaveletTree(place[self.forward])

    def between(self, before: np.ndarray, n_before: int, behind_back: np.ndarray, n_behind: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and a word that begins with its first part and ends with its last (given backwards)."""
        begin, end = interval(self.sorted, before, n_before)
        least, above = interval(self.sorted_back, behind_back, n_behind)
        query, value = self.tree.report(begin, end, least, above)
        return query, self.reverse[value]


def backwards(words: np.ndarray, length: int) -> np.ndarray:
    return np.ascontiguousarray(words.view(np.uint8).reshape(len(words), length)[:, ::-1]).view(f"S{length}").ravel()


def interval(ordered: np.ndarray, parts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where in an order the words begin with each part of n letters."""
    if n == 0:
        return np.zeros(len(parts), dtype=np.int64), np.full(len(parts), len(ordered))
    heads, parts = ordered.astype(f"S{n}"), parts.astype(f"S{n}")
    return np.searchsorted(heads, parts, "left"), np.searchsorted(heads, parts, "right")


def near_pairs(short: np.ndarray, long: np.ndarray, length: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Of words of one length and of one more, the pairs near each other at positions from low up to high.

    Yields places in `short` and in `short` (a replaced letter; each pair both ways) or in `long` (an inserted one,
    at the last of the positions that give the same word), and whether the second is in `long`.
    """
    same, longer = (Lexicon(short, length), Lexicon(long, length + 1)) if len(short) else (None, None)
    if same is None:
        return
    back = backwards(short, length)
    letters = short.view(np.uint8).reshape(len(short), length)
    letters_long = long.view(np.uint8).reshape(len(long), length + 1)
    for at in range(low, min(high, length)):
        query, found = same.between(short, at, back, length - at - 1)
        other = query != found
        yield query[other], found[other], False
    for at in range(low, high) if len(long) else ():
        query, found = longer.between(short, at, back, length - at)
        if at < length:
            last = letters_long[found, at] != letters[query, at]
            query, found = query[last], found[last]
        yield query, found, True


def best_of(words: list[str], n: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple]:
    """For each word on the left: how many near words it has, and the commonest (ties: the smallest)."""
    letters = np.array(words)
    order = np.lexsort((letters[right], -n[right], left))
    left, right = left[order], right[order]
    first = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]])) if len(left) else np.zeros(0, dtype=np.int64)
    for k, size in zip(first, np.diff(np.append(first, len(left))), strict=True):
        yield words[left[k]], int(size), int(n[right[k]]), words[right[k]]


def reports(words: list[str], n: np.ndarray, length: int, low: int, high: int) -> Iterator[tuple]:
    """What each word of a batch of whole keys is near to at the positions of their range."""
    sizes = np.array([len(w) for w in words])
    at_short, at_long = np.flatnonzero(sizes == length), np.flatnonzero(sizes == length + 1)
    encoded = np.array([w.encode("latin-1") for w in words], dtype=f"S{length + 1}")
    short, long = encoded[at_short].astype(f"S{length}"), encoded[at_long]
    for query, found, longer in near_pairs(short, long, length, low, high):
        left, right = at_short[query], (at_long if longer else at_short)[found]
        yield from best_of(words, n, left, right)
        if longer:
            yield from best_of(words, n, right, left)


def near_words(words: DataFrame, most_of_key: int = MOST_OF_KEY) -> DataFrame:
    """word, n_near, best, best_n: how many words each is near to, and the commonest of them; of words without any, none."""
    rows = dealt_again(shards(words), most_of_key)
    places = ("class", "low", "high", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done(rows: list[tuple]) -> pa.RecordBatch:
            of_range: dict[tuple, list] = {}
            for row in rows:
                of_range.setdefault(row[2:5], []).append(row[:2])
            out: list[tuple] = []
            for (length, low, high), members in of_range.items():
                out.extend(reports([w for w, _ in members], np.array([n for _, n in members]), length, low, high))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["word", "near", "best_n", "best"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) >= BATCH and held[-1][2:] != row[2:]:  # between two keys
                    yield done(held)
                    held = []
                held.append(row)
        yield done(held)

    grouped = rows.select("word", "n", *places).repartition("key").sortWithinPartitions(*places)
    found = grouped.mapInArrow(run, REPORT)
    first = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), first.alias("first")).select("word", "n_near", "first.best", (-F.col("first.minus")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following forms ends.  Each round doubles the steps taken; counts grow fivefold a step, so there are few."""
    current = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialise(current.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        discard(current)
        current = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return current


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_of_key: int = MOST_OF_KEY) -> DataFrame:
    """Returns for each word: word, form, root, n, n_near, form_n.

    Words are runs of letters with A-Z lower-cased, of which one in 199 a document loses a letter, that have six letters
    and five occurrences or more.  A null text has none, a null id counts as an empty one, rows of a repeated id
    each count; other columns are ignored.  An empty table gives an empty table.  Of near words that are
    equally common the smallest by code points is the form.
    """
    words = materialise(word_counts(docs, id_col, text_col))
    near = near_words(words, most_of_key)
    joined = words.join(near, "word", "left")
    form = F.when(F.col("best_n") >= RATIO * F.col("n"), F.col("best"))
    known = materialise(
        joined.select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n"))
    )
    ends = roots(known.filter("form is not null"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
