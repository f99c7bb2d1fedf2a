"""Secrets in texts: fixed patterns, and strings of high entropy.

Candidate strings are runs of the base64 alphabet.  Within a candidate a window of fixed length
slides over each maximal run of a character class (hexadecimal, alphanumeric, base64); the
window's Shannon entropy is kept up to date from the counts that one character leaving and one
entering change.  Every run whose best window reaches its class's threshold is a secret, unless the
allow-list suppresses it; runs that overlap are one.  One pass over the scan, no shuffle.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from os.path import commonprefix
from string import ascii_lowercase, ascii_uppercase

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts

WINDOW = 20
#: Bits a character that a window must reach, by class; random strings of 20 lie well above.
THRESHOLDS = {"hex": 2.9, "alnum": 3.7, "base64": 3.9}
KINDS = ("assign", "access", "hex", "entropy")

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_RUN = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
RUNS = {
    "hex": re.compile(r"[0-9a-fA-F]{%d,}" % WINDOW),
    "alnum": re.compile(r"[A-Za-z0-9]{%d,}" % WINDOW),
    "base64": re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW),
}

# What looks random and is none (words are compared in lower case).  Each run is judged
# for itself, so what stands beside a harmless word or path is still found.
ALLOWED_PARTS = ("example", "placeholder", "changeme", "xxxxxx", "your_", "your-", "dummy", "redacted", "lorem")
ALLOWED_SHAPES = tuple(
    re.compile(p)
    for p in (
        r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUIDs
        r"[A-Za-z]+(?:[-_/=+][A-Za-z]*)*",  # words and paths of words
        r"[0-9]+(?:[-_/=+][0-9]*)*",  # numbers, dates, phone numbers
        r"(.{1,4}?)\1+.{0,3}",  # short repeats
    )
)
ALPHABETS = (ascii_lowercase, ascii_uppercase, "01234567890", "1234567890")
LEAST_OF_ALPHABET, BETWEEN_ALPHABETS = 6, "+/_=-"
PATH = re.compile(r"[a-z0-9_-]+(?:/[a-z0-9_-]*)+")
#: A piece between / or = that is nothing but words.
WORDS = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[-_](?:[A-Z]?[a-z]+|[A-Z]+))*[-_]?")
PIECE = re.compile(r"[^/]+")
PART = re.compile(r"[^/=]+[/=]?")


def best_entropy(run: str, size: int = WINDOW) -> float:
    """The largest Shannon entropy (bits a character) of a window of the run, by incremental counts.

    With counts c in a window of n characters it is log2 n - sum(c log2 c) / n, so moving the
    window on changes two terms of the sum.
    """
    size = min(size, len(run))
    if not size:
        return 0.0
    term = [0.0] + [c * math.log2(c) for c in range(1, size + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    best = math.inf
    for k, ch in enumerate(run):
        if k >= size:
            old = run[k - size]
            c = counts[old]
            counts[old] = c - 1
            total += term[c - 1] - term[c]
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += term[c + 1] - term[c]
        if k >= size - 1:
            best = min(best, total)
    return math.log2(size) - best / size


def harmless(run: str) -> bool:
    """Whether a run holds a word of the allow-list."""
    low = run.lower()
    return any(p in low for p in ALLOWED_PARTS)


def alphabetical(run: str) -> bool:
    """Whether a run is made of beginnings of alphabets, six letters or more each, with separators behind them.

    Of every place it is known whether what is before it is so made; a place looks ahead over one alphabet at most.
    """
    made = bytearray(len(run) + 1)
    made[0] = 1
    for at, ch in enumerate(run):
        if not made[at]:
            continue
        if at and ch in BETWEEN_ALPHABETS:
            made[at + 1] = 1
        for letters in ALPHABETS:
            if ch == letters[0]:
                n = len(commonprefix((letters, run[at : at + len(letters)])))
                for k in range(LEAST_OF_ALPHABET, n + 1):
                    made[at + k] = 1
    return bool(run) and bool(made[-1])


def allowed(run: str) -> bool:
    return harmless(run) or any(p.fullmatch(run) for p in ALLOWED_SHAPES) or alphabetical(run)


def free_parts(start: int, end: int, taken: list[tuple[int, int]], starts: list[int], reach: list[int]) -> Iterator[tuple[int, int]]:
    """What of start to end lies outside the spans taken; these are sorted, reach[k] is where the first k + 1 of them end."""
    k = bisect_left(starts, start)
    at = max(start, reach[k - 1]) if k else start
    while k < len(starts) and starts[k] < end:
        if starts[k] > at:
            yield at, starts[k]
        at = max(at, taken[k][1])
        k += 1
    if at < end:
        yield at, end


def judged_runs(word: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """What of a run is judged as one: of a path each of its pieces, and what lies beside a piece of mere words that are allowed."""
    run = word[start:end]
    if PATH.fullmatch(run):
        yield from ((start + m.start(), start + m.end()) for m in PIECE.finditer(run))
    elif harmless(run) and ("/" in run or "=" in run):
        a = start
        for m in PART.finditer(run):
            piece = m[0].rstrip("/=")
            if WORDS.fullmatch(piece) and harmless(piece):
                yield a, start + m.start()
                a = start + m.end()
        yield a, end
    else:
        yield start, end


def secret_runs(word: str) -> Iterator[tuple[int, int]]:
    """Every maximal run of every class with a window of high entropy, unless it is allowed."""
    for kind, threshold in THRESHOLDS.items():
        for m in RUNS[kind].finditer(word):
            for a, b in judged_runs(word, *m.span()):
                run = word[a:b]
                if len(run) >= WINDOW and mixed_classes(run) and best_entropy(run) >= threshold and not allowed(run):
                    yield a, b


def entropy_spans(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of high entropy outside the spans already taken; of runs that overlap, what they cover together."""
    taken = sorted(taken)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for candidate in CANDIDATE.finditer(text):
        if candidate[0].isalpha():
            continue
        for a, b in free_parts(candidate.start(), candidate.end(), taken, starts, reach):
            start = end = -1
            for x, y in sorted(secret_runs(text[a:b])):
                if x >= end:
                    if end > start:
                        yield a + start, a + end
                    start = x
                end = max(end, y)
            if end > start:
                yield a + start, a + end


def mixed_classes(run: str) -> bool:
    """Letters and digits both: words alone are no secrets, nor are numbers."""
    return any(c.isdigit() for c in run) and any(c.isalpha() for c in run)


def spans_of(text: str) -> tuple[list[tuple[int, int, int]], int, int, int]:
    """All spans (start, rank of kind, end) in order, and the numbers of assign, access and hex spans."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6] if "=" in text or ":" in text else []
    n_assign = len(base)
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    n_access = len(base) - n_assign
    base += [(m.start(), 2, m.end()) for m in HEX_RUN.finditer(text)]  # the maximal runs of 24 or more
    n_hex = len(base) - n_assign - n_access
    found = [(a, 3, b) for a, b in entropy_spans(text, [(a, b) for a, _, b in base])]
    return sorted(base + found), n_assign, n_access, n_hex


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_entropy of every document.

    Spans are in code points.  A null text is an empty one, without spans; null ids and repeated
    rows are scanned like any other; other columns are ignored; an empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy")
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in byte_texts(batch.column(1)):
                spans, n_assign, n_access, n_hex = spans_of(text.decode("utf-8", "replace"))
                base = joined([s for s in spans if s[1] < 3])
                digest = hashlib.sha256(base.encode()).hexdigest()
                out.append((n_assign, n_access, n_hex, digest, joined(spans), len(spans) - n_assign - n_access - n_hex))
            parts = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, parts, types)], ["doc_id", *names])

    return rows.mapInArrow(run, schema)


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The documents, with all their columns, with every span replaced; a null text stays null, an empty table an empty one."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            out, at = [], 0
            for start, _, end in spans_of(t)[0]:
                if end > at:
                    out += [t[at:start], mask] if start >= at else []
                    at = end
            return "".join([*out, t[at:]])

        return texts.map(one, na_action=None)

    return docs.withColumn(text_col, masked(F.col(text_col)))
