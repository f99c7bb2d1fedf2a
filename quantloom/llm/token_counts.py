"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

A byte-level BPE cuts a text into pieces by a pattern and merges bytes within each piece.  Within
a piece the encoding of a prefix is the encoding of a shorter prefix and one more token, and that
token is the only one ending there that the shorter encoding's last token can stand beside.
So one pass that keeps each prefix's last token and count gives the count of all prefixes, and those
of a text follow by adding what its earlier pieces have.  Truncation and budgets are then
lookups; nothing is encoded again.

Pieces recur, so each task keeps the tables of short ones; memory is bounded by their number.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 1024
MOST_TABLES, LONGEST_KEPT = 1 << 19, 60
#: Texts of characters below this one are cut by a pattern of ranges, which is faster.
NARROW = 0x250
#: Pieces of which a prefix is more than one piece.
CONTRACTIONS = ("'re", "'ve", "'ll")


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class ByteMerges:
    """The merges of a vocabulary on bytes, and which tokens may stand side by side."""

    def __init__(self, model: dict):
        import ahocorasick

        byte_of = byte_characters()
        raw = lambda token: bytes(byte_of[c] for c in token)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.ends = ahocorasick.Automaton()
        pair_of: dict[bytes, tuple] = {bytes([b]): () for b in range(256)}
        for token in {a + b for a, b in self.rank}:
            pair = tuple(self.merged(token, until=2))
            if pair in self.rank:  # else other merges come first and no text is encoded as this token
                pair_of[token] = pair
        #: Of each token, its parts at the right (left) edge from itself down, each with the rank of the merge that ends it.
        self.right_edge, self.left_edge = ({t: self.edge(t, side, pair_of) for t in pair_of} for side in (-1, 0))
        for token in pair_of:
            self.ends.add_word(token.decode("latin-1"), token)
        self.ends.make_automaton()
        self.fits: dict[tuple[bytes, bytes], bool] = {}

    def merged(self, data: bytes, until: int) -> list[bytes]:
        """The tokens of a few bytes, by merging the pair of lowest rank, the leftmost first, until so many are left."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > until:
            rank, k = min((self.rank.get((parts[k], parts[k + 1]), len(self.rank)), k) for k in range(len(parts) - 1))
            if rank == len(self.rank):
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def edge(self, token: bytes, side: int, pair_of: dict[bytes, tuple]) -> list[tuple[bytes, int]]:
        out, ends = [(token, len(self.rank))], len(self.rank)
        while pair := pair_of[token]:
            token, ends = pair[side], self.rank[pair]
            out.append((token, ends))
        return out

    def beside(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens encode as themselves: no merge over their border comes before those that make them.

        Of equal ranks the leftmost merge comes first, which is the one within the left token, or the one over the border.
        """
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= 1 << 20:
                self.fits.clear()
            rank, begun = self.rank.get, self.left_edge[right]
            known = True
            for a, a_ends in self.right_edge[left]:
                for b, b_ends in begun:
                    over = rank((a, b))
                    if over is not None and over < a_ends and over <= b_ends:
                        known = False
            self.fits[left, right] = known
        return known

    def prefix_counts(self, data: bytes) -> list[int]:
        """Tokens of each prefix of data, that of no bytes first."""
        last: list[bytes] = [b""] * (len(data) + 1)
        counts = [0] * (len(data) + 1)
        for at, token in self.ends.iter(data.decode("latin-1")):
            end = at + 1
            begin = end - len(token)
            if not last[end] and (begin == 0 or self.beside(last[begin], token)):
                last[end], counts[end] = token, counts[begin] + 1
        return counts


class PieceTables(dict):
    """piece -> tokens of each of its prefixes by code points; computed when first asked for."""

    def __init__(self, merges: ByteMerges):
        super().__init__()
        self.merges = merges

    def __missing__(self, piece: str) -> Sequence[int]:
        data = piece.encode()
        counts = self.merges.prefix_counts(data)
        table = counts
        if len(data) != len(piece):  # where a code point ends
            table = [counts[k] for k in range(len(data) + 1) if k == len(data) or data[k] & 0xC0 != 0x80]
        if piece in CONTRACTIONS:
            table = [*table[:2], self[piece[0]][-1] + self[piece[1]][-1], table[3]]
        if len(piece) <= LONGEST_KEPT:
            table = bytes(table)
            if len(self) >= MOST_TABLES:
                self.clear()
            self[piece] = table
        return table


class PrefixCounter:
    """Counts tokens of texts and of all their prefixes as ``tokenizers`` does with a byte-level BPE file."""

    def __init__(self, path: str):
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        made = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if model["model"]["type"] != "BPE" or model["normalizer"] or {k: model["pre_tokenizer"].get(k) for k in made} != made:
            raise ValueError("only byte-level BPE without normalisation is counted by prefixes")
        self.tables = PieceTables(ByteMerges(model["model"]))
        self.pattern, self.space = regex.compile(PATTERN), regex.compile(r"\s+")
        letter, number, blank = ("".join(re.escape(chr(k)) for k in range(NARROW) if regex.fullmatch(kind, chr(k))) for kind in (r"\p{L}", r"\p{N}", r"\s"))
        self.narrow = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{blank}{letter}{number}]+|[{blank}]+(?![^{blank}])|[{blank}]+")
        self.rare = re.compile(f"[^\x00-{chr(NARROW - 1)}]")
        self.cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.special = [t["content"] for t in model["added_tokens"]]
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.agreed = lru_cache(1 << 16)(self.agreed_on)

    def agreed_on(self, character: str) -> bool:
        """Whether the pattern here and that of ``tokenizers``, of another Unicode version, class a character alike."""
        return all(len(self.pattern.findall(c + character)) == len(self.cut(c + character)) for c in "a1!\t")

    def pieces(self, text: str) -> list[str]:
        if not self.rare.search(text):
            return self.narrow.findall(text)
        if all(map(self.agreed, set(self.rare.findall(text)))):
            return self.pattern.findall(text)
        return [text[begin:end] for _, (begin, end) in self.cut(text)]

    def total(self, text: str) -> int:
        """Tokens of the whole text: what the tables of its pieces end with."""
        if any(s in text for s in self.special):
            parts = self.specials.split(text)
            return sum(self.total(p) for p in parts) + len(parts) - 1
        tables = self.tables
        return sum([tables[p][-1] for p in self.pieces(text)])

    def plain(self, text: str, enough: int | None = None) -> list[int]:
        """Tokens of each prefix of a text without special tokens; may end where all longer prefixes have more than enough.

        A run of white space is one piece while the text ends with it, and less its last character once more follows.
        """
        out, base, run, run_base = [0], 0, "", 0
        for piece in self.pieces(text):
            if enough is not None and (run_base if run else base) >= enough:
                break
            table = self.tables[piece]
            if self.space.fullmatch(piece):
                run_base = run_base if run else base
                whole = self.tables[run + piece]
                out += [run_base + c for c in whole[len(run) + 1 :]]
                run += piece
            else:
                out += [base + c for c in table[1:]]
                if run and piece[0] == " ":
                    out[-len(piece)] = run_base + self.tables[run + " "][-1]
                run = ""
            base += table[-1]
        return out

    def prefixes(self, text: str, enough: int | None = None) -> list[int]:
        """Tokens of each prefix of a text, by code points; a special token counts one where its string ends."""
        out, base, at = [0], 0, 0
        for found in self.specials.finditer(text):
            if enough is not None and base > enough:
                return out
            part = self.plain(text[at : found.end()], None)
            out += [base + c for c in part[1:-1]]
            base += self.total(text[at : found.start()]) + 1
            out.append(base)
            at = found.end()
        return out + [base + c for c in self.plain(text[at:], None if enough is None else enough - base)[1:]]

    def fitting(self, text: str, budget: int) -> int:
        """Code points of the longest prefix with at most budget tokens."""
        counts = self.prefixes(text, budget)
        return max(k for k, c in enumerate(counts) if c <= budget)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns for each document: id, n_bytes, n_tokens, over_limit, fitting_chars (of the longest prefix within the limit).

    A null text is an empty one of no tokens.  Null and repeated ids are rows like any other, other columns are
    ignored, an empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    schema = f"{id_col} {rows.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, fitting_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            n_bytes, n_tokens, fitting = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                n = counts.total(text)
                n_bytes.append(len(text.encode()))
                n_tokens.append(n)
                fitting.append(len(text) if n <= limit else counts.fitting(text, limit))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (n_bytes, n_tokens)), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(fitting, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_bytes", "n_tokens", "over_limit", "fitting_chars"])

    return rows.mapInArrow(run, schema)


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and prefix_tokens: element k (from 0) is the number of tokens of the text's first k code points.

    Write it once; tokens_of() and cut_to() then answer from it.  Odd rows are as for count_tokens().
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    schema = f"{id_col} {rows.schema[id_col].dataType.simpleString()}, text string, prefix_tokens array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            for k in range(batch.num_rows):  # four bytes a code point: one row at a time bounds what a task holds
                row = batch.slice(k, 1)
                table = pa.array([counts.prefixes(row.column(1)[0].as_py() or "")], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), table], [id_col, "text", "prefix_tokens"])

    return rows.mapInArrow(run, schema)


def tokens_of(n_chars: Column | int, prefix_tokens: str = "prefix_tokens") -> Column:
    """Tokens of the first n_chars code points, null beyond the text."""
    return F.get(F.col(prefix_tokens), n_chars if isinstance(n_chars, Column) else F.lit(n_chars))


def cut_to(budget: int, text: str = "text", prefix_tokens: str = "prefix_tokens") -> Column:
    """The longest prefix of the text with at most budget tokens; a null text stays null."""
    places = F.transform(prefix_tokens, lambda c, k: F.when(c <= budget, k))
    return F.substring(F.col(text), F.lit(1), F.array_max(places))
