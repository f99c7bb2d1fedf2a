"""Spelling variants, token counts and whitening against brute force, the tokenizers library and numpy, and in odd cases."""

from __future__ import annotations

import math
import os
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quantloom.llm import queries as llm
from quantloom.llm.spelling import WaveletTree, near_words, spelling_variants
from quantloom.llm.token_counts import ByteMerges, byte_characters, count_tokens, counter, cut_to, prefix_counts, tokens_of
from quantloom.llm.whitening import whiten

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, "   \n\t"), (None, "no id here"), (None, None), (4, "twice"), (4, "twice"), (5, "x" * 200_000), (6, "wordier " * 50_000), (7, "\U0001f600 é\n\n" * 40)]


# 11
def spelt(rows) -> Counter:
    """Words of at least six letters with their counts, document by document and run by run."""
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 199 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            out[low] += 1
    return Counter({w: n for w, n in out.items() if len(w) >= 6 and n >= 5})


def one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def by_pairs(words: Counter) -> set[tuple]:
    form, near = {}, {w: [v for v in words if one_apart(w, v)] for w in words}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def test_wavelet_tree_reports_what_a_scan_finds():
    rng = np.random.default_rng(3)
    for size in (1, 2, 7, 300):
        numbers = rng.permutation(size)
        tree = WaveletTree(numbers)
        box = rng.integers(0, size + 1, (200, 4))
        query, value = tree.report(*box.T)
        want = {(q, int(v)) for q, (b, e, lo, hi) in enumerate(box) for v in numbers[b:e] if lo <= v < hi}
        assert sorted(zip(query.tolist(), value.tolist(), strict=True)) == sorted(want)
    assert all(len(x) == 0 for x in WaveletTree(np.zeros(0, dtype=np.int64)).report(*np.zeros((4, 1), dtype=np.int64)))


@pytest.mark.parametrize("most_of_key", [1 << 16, 2])
def test_spelling_variants_against_all_pairs(spark, most_of_key):
    rng = random.Random(5)
    alphabet = "abBéÿ"
    vocabulary = {"".join(rng.choice(alphabet) for _ in range(rng.randint(5, 8))) for _ in range(300)}
    vocabulary |= {w[:k] + c + w[k + rng.randint(0, 1) :] for w in list(vocabulary)[:60] for k in (0, 3, len(w)) for c in "aaé"}
    rows = [(rng.randint(0, 50), " ".join([w] * rng.choice([1, 5, 6, 30, 200]))) for w in sorted(vocabulary)] + [(None, "commonly " * 6), (None, "commonly_commonlyCOMMONLY1commonly")]
    got = {tuple(r) for r in spelling_variants(spark.createDataFrame(rows, DOCS), most_of_key=most_of_key).collect()}
    want = by_pairs(spelt(rows))
    assert len(want) > 150 and any(root != form for _, form, root, *_ in want if form)
    assert got == want


def test_crowded_keys_are_dealt_out_to_single_positions(spark):
    """Many words with one beginning: keys are halved until one position is left, and no pair is lost or doubled."""
    words = ["prefixes" + a + b + "behind" for a in "abcdefghij" for b in "abcdefghij"]
    df = spark.createDataFrame([(w, 5 + k) for k, w in enumerate(words)], "word string, n long")
    for most in (1, 20, 1 << 16):
        got = {r["word"]: (r["n_near"], r["best_n"]) for r in near_words(df, most).collect()}
        assert got == {w: (18, max(5 + k for k, v in enumerate(words) if one_apart(w, v))) for w in words}


def test_spelling_of_odd_tables(spark):
    odd = spark.createDataFrame(ODD, DOCS)
    want = by_pairs(spelt(ODD))
    assert {tuple(r) for r in spelling_variants(odd).collect()} == want and want
    assert {tuple(r) for r in spelling_variants(odd.selectExpr("*", "1 as word", "2 as n", "3 as key", "4 as form")).collect()} == want
    assert spelling_variants(odd.limit(0)).count() == 0
    assert spelling_variants(odd.filter("text is null")).count() == 0


# 12
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(llm.tokenizer_path())


PARTS = ["a", "the", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'v", "é", "中", "\U0001f600", "1", "23", "!", "?!", "<|endoftext|>", "<|endof", "՘", "\xa0", " ", "ing", " quality", "́"]


def test_prefix_counts_are_those_of_each_prefix():
    rng, lib, counts = random.Random(1), library(), counter(llm.tokenizer_path())
    for _ in range(400):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25)))
        want = [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert counts.prefixes(text) == want, text
        assert counts.total(text) == want[-1]
        for budget in (0, 1, 5):
            assert counts.fitting(text, budget) == max(k for k, n in enumerate(want) if n <= budget)


def test_counts_of_any_characters():
    rng, lib, counts = random.Random(2), library(), counter(llm.tokenizer_path())
    for _ in range(400):
        codes = (rng.choice([rng.randrange(32, 127), rng.randrange(0x110000), rng.randrange(0x3000)]) for _ in range(rng.randint(0, 30)))
        text = "".join(chr(c) for c in codes if not 0xD800 <= c < 0xE000)
        assert counts.total(text) == len(lib.encode(text, add_special_tokens=False).ids)


def test_prefix_counts_of_bytes_by_small_merges():
    """A toy vocabulary, all strings of up to seven letters: the last token and count of each prefix."""
    of_byte = {b: c for c, b in byte_characters().items()}
    merges = ByteMerges({"merges": [tuple("".join(of_byte[x] for x in part) for part in pair) for pair in ((b"a", b"b"), (b"b", b"a"), (b"ab", b"a"), (b"a", b"a"), (b"aa", b"ba"), (b"b", b"ab"))]})
    texts = [b""]
    for _ in range(7):
        texts += [t + c for t in texts if len(t) == len(texts[-1]) for c in (b"a", b"b")]
    for text in texts:
        assert merges.prefix_counts(text) == [0] + [len(merges.merged(text[:k], until=1)) for k in range(1, len(text) + 1)]


def test_token_counts_of_all_documents(spark):
    lib = library()
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    got = {r["doc_id"]: r for r in llm.op12_token_counts(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        text = d["text"] or ""
        n = len(lib.encode(text, add_special_tokens=False).ids)
        r = got[d["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 1024)
        assert len(lib.encode(text[: r["fitting_chars"]], add_special_tokens=False).ids) <= 1024 and (r["fitting_chars"] == len(text)) == (n <= 1024)


def test_budgets_are_lookups(spark):
    lib = library()
    rows = [(1, "Don't count twice,  ever.\n\nReally\U0001f600 not."), (2, None), (3, "")]
    stored = prefix_counts(spark.createDataFrame(rows, DOCS), llm.tokenizer_path())
    got = {r["doc_id"]: r for r in stored.select("doc_id", cut_to(6).alias("cut"), tokens_of(9).alias("n"), tokens_of(F.length("text")).alias("all")).collect()}
    text = rows[0][1]
    n = lambda s: len(lib.encode(s, add_special_tokens=False).ids)
    assert got[1]["cut"] == max((text[:k] for k in range(len(text) + 1) if n(text[:k]) <= 6), key=len)
    assert (got[1]["n"], got[1]["all"]) == (n(text[:9]), n(text))
    assert (got[2]["cut"], got[2]["n"], got[3]["cut"], got[3]["all"]) == (None, None, "", 0)


def test_token_counts_of_odd_tables(spark):
    odd = spark.createDataFrame(ODD, DOCS)
    path = llm.tokenizer_path()
    lib = library()
    want = Counter((i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD)
    for df in (odd, odd.selectExpr("*", "1 as n_tokens", "'a' as prefix_tokens", "3 as n_bytes")):
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in count_tokens(df, path).collect()) == want
    assert count_tokens(odd.limit(0), path).count() == 0 and prefix_counts(odd.limit(0), path).count() == 0


def test_long_texts_of_one_piece_take_linear_time():
    counts = counter(llm.tokenizer_path())
    for unit in ("x", " ", "\n", "qzj", "é中", "!"):
        took = []
        for n in (50_000, 200_000):
            began = time.time()
            counts.total(unit * (n // len(unit)))
            took.append(time.time() - began)
        assert took[1] < 12 * took[0] + 0.5, unit


# 13
def by_numpy(vectors: list, wanted: int = 16):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((n * fit - sums) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    trace = float(Fraction(int(((n * fit - sums) ** 2).sum()), n**3))
    k = int(min(wanted, (values > values[0] * 1e-12).sum()))
    whitened = ((n * x - sums) / n).astype(float) @ axes[:, :k] / np.sqrt(values[:k])
    return n, ((n * x - sums) ** 2).sum(axis=1).tolist(), whitened, values[:k] / trace


def check_whitening(df, rows):
    n, deviation, whitened, explained = by_numpy([v for _, v in rows])
    k = whitened.shape[1]
    got = {}
    for r in df.collect():
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(got) == len(rows) and all(sorted(g) == list(range(1, k + 1)) for g in got.values())
    signs = np.sign(sum(np.array([got[i][c + 1]["whitened"] * w[c] for c in range(k)]) for (i, _), w in zip(rows, whitened, strict=True)))
    for (i, _), d, w in zip(rows, deviation, whitened, strict=True):
        for c in range(k):
            r = got[i][c + 1]
            assert (r["n"], r["deviation"]) == (n, d)
            assert r["whitened"] * signs[c] == pytest.approx(w[c], abs=1e-7)
            assert r["explained"] == pytest.approx(explained[c], rel=1e-6) and r["identity_error"] < 1e-9


def test_whitening_of_all_embeddings_against_numpy(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    check_whitening(llm.op13_whitening(spark, SF), rows)


def test_whitening_of_uneven_scales_and_copies(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(80, 3)) * [3e4, 5.0, 0.5] + [1e6, -20, 0]
    rows = [(k, base[k % 80].tolist()) for k in range(200)]
    check_whitening(whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), rows)


def test_whitening_leaves_out_what_it_cannot_use(spark):
    kind = "vec_id long, embedding array<double>"
    good = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [3.0, 5.0]), (10, [-5.0, 0.3])]
    bad = [(4, None), (5, [1.0, None]), (6, [1.0, math.nan]), (7, [math.inf, 1.0]), (8, []), (9, [1.0]), (11, [1e30, 1.0])]
    check_whitening(whiten(spark.createDataFrame(good + bad, kind)), good)
    check_whitening(whiten(spark.createDataFrame(good + bad, kind).selectExpr("*", "1 as n", "2 as x", "3 as component", "4 as id")), good)
    assert whiten(spark.createDataFrame(bad, kind)).count() == whiten(spark.createDataFrame(good[:2], kind)).count() == 0
    assert whiten(spark.createDataFrame([], kind)).count() == 0
    twice = [(None, [1.0, 2.0, 7.0]), (None, [1.0, 3.0, 7.0]), (1, [4.0, 5.0, 7.0]), (1, [4.0, 5.0, 7.0])]
    got = whiten(spark.createDataFrame(twice, kind))
    assert got.count() == 8 and got.filter("n = 3 and identity_error < 1e-9").count() == 8  # a constant dimension has no component


def test_whitening_of_deviations_beyond_a_long(spark):
    rows = [(k, [float(k % 2) * 2.0**39, float(k)]) for k in range(50)]
    got = {r["vec_id"]: r["deviation"] for r in whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert set(got.values()) == {None} and len(got) == 50


# 6
def test_allow_list_takes_linear_time_on_any_shape():
    from quantloom.llm.secrets_scan import spans_of

    key = "xQ7vK2mP9wR4tY8zB3nL"
    for unit in ("01234567890123456789_", "deadbeef-dead-beef-dead-", "Word_word-", "12-34/", "aB1", "abcdefgh/", "example/", "A1b2C3d4/", "00000000-0000-0000-0000-000000000000"):
        took = []
        for n in (100_000, 400_000):
            began = time.time()
            spans_of(unit * (n // len(unit)) + key)
            took.append(time.time() - began)
        assert took[1] < 12 * took[0] + 0.5, unit


def test_alphabets_are_those_of_a_search_by_splits():
    from string import ascii_lowercase, ascii_uppercase

    from quantloom.llm.secrets_scan import alphabetical

    def made(run: str) -> bool:
        for s in (ascii_lowercase, ascii_uppercase, "01234567890", "1234567890"):
            for k in range(6, len(s) + 1):
                if run.startswith(s[:k]):
                    rest = run[k:].lstrip("+/_=-")
                    if not rest or made(rest):
                        return True
        return False

    rng, parts = random.Random(0), ["012345", "0123456789", "01234567890", "123456", "1234567890", "abcdefg", ascii_uppercase, "_", "-", "x", "0", "12345"]
    runs = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 5))) for _ in range(3000)]
    assert [alphabetical(r) for r in runs] == [made(r) for r in runs] and 100 < sum(map(made, runs)) < 2900


# 3
PROSE = (
    "Our kitchen staff bake a cookie every morning, and nobody complains about it.",
    "The history of copyright law begins in England, long before printers agreed on anything.",
    "He writes JavaScript for a living, and he is not ashamed of it.",
    "She came home late, and the menu was already cold.",
    "Home again in Berlin",
    "人们 在 河 边 走 ， 看 着 水 流 过 桥 。",
)
NO_PROSE = (
    "Alle Rechte vorbehalten.", "Tous droits réservés", "Todos los derechos reservados.", "Accueil Contact Mentions légales", "Copyright 2021 Example Inc.", "This website uses cookies, accept all?",
    "Please enable JavaScript in your browser to view this page.", "Startseite", "Inicio Contacto", "Click here to read more", "Diese Seite verwendet Cookies, bitte akzeptieren Sie.", "Licensed under CC BY-NC 4.0.", "Powered by WordPress",
)


def test_rules_spare_prose_and_know_four_languages(spark):
    from quantloom.llm.quality_rules import judge

    rows = [(k, line) for k, line in enumerate((*PROSE, *NO_PROSE))]
    failed = {r["doc_id"]: r["n_failed_lines"] for r in judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert [rows[k][1] for k in failed if failed[k] != (k >= len(PROSE))] == []
    lines = "\n".join([*PROSE, "", *NO_PROSE])
    r = judge(spark.createDataFrame([(1, lines)], DOCS)).first()
    assert (r["n_lines"], r["n_failed_lines"]) == (len(PROSE) + len(NO_PROSE), len(NO_PROSE)) and r["clean_text"] == "\n".join([*PROSE, ""])
