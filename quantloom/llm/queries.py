"""The corpus operators as queries over the driver's tables, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import find_contamination
from .html_text import extract_text
from .line_dedup import remove_repeated_lines
from .lm_score import score_texts
from .near_dedup import near_duplicates
from .packing import instruction_examples, pack_documents, pack_examples
from .pii import find_pii
from .quality_model import score_quality
from . import quality_rules as rules
from .quality_rules import judge
from .secrets_scan import find_secrets
from .spelling import spelling_variants
from .token_counts import count_tokens
from .whitening import whiten


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("text", "clean_text")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations in sequences of at most 4096 tokens, 4 conversations and 3200 tokens that bear loss: each limit is reached."""
    examples = instruction_examples(table(spark, sf_dir, "conversations"), tokenizer_path())
    return pack_examples(examples, capacity=4096, max_segments=4, max_loss_tokens=3200)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents"))
    # sums of doubles depend on their order beyond this
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = remove_repeated_lines(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "text", "n_lines", "n_removed_lines")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


OP2_SQL = r"""
WITH item AS (SELECT DISTINCT item_id, text FROM benchmark),
item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM item),
doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
item_shingle AS (
  SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
  FROM (SELECT item_id, w, least(5, len(w)) AS k FROM item_words WHERE len(w) > 0)),
item_size AS (SELECT item_id, count(*) AS n FROM item_shingle GROUP BY item_id),
doc_shingle AS (
  SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
  FROM doc_words, (SELECT DISTINCT k FROM item_shingle) WHERE len(w) >= k)
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_shared, count(*) / n AS containment
FROM doc_shingle JOIN item_shingle USING (k, g) JOIN item_size USING (item_id)
GROUP BY doc_id, item_id, n HAVING count(*) >= 0.8 * n - 1e-9
"""

def words_in(words: tuple[str, ...]) -> str:
    return "(?:^|[^a-z])(?:" + "|".join(words).replace("'", "''") + ")(?:[^a-z]|$)"


def low_has(words: tuple[str, ...]) -> str:
    return "regexp_matches(low, '" + "|".join(words).replace("'", "''") + "')"


OP3_SQL = rf"""
WITH d AS (
  SELECT doc_id, text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
gram AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
hit AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM gram),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM hit WHERE n > 1) GROUP BY doc_id),
line AS (
  SELECT doc_id, x, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    length(regexp_replace(x, '[^ \t]', '', 'g')) + 1 AS n,
    length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS symbols,
    length(regexp_replace(x, '[^!?]', '', 'g')) AS shouts,
    regexp_matches(x, '[{rules.SENTENCE_MARKS}]') AS marked,
    length(regexp_replace(x, '[^|»›·•]', '', 'g')) AS seps
  FROM (SELECT doc_id, unnest(l) AS x FROM d)),
judged AS (
  SELECT doc_id, length(x) AS c,
    symbols > 0.3 * n OR (shouts > 0.3 * n AND shouts >= 3) OR (n >= 10 AND NOT marked)
    OR (seps >= 3 AND seps > 0.2 * n)
    OR (n <= 10 AND NOT regexp_matches(rtrim(x, ' '), '[{rules.ENDS_OF_SENTENCES}]$')
      AND (regexp_matches(low, '{words_in(rules.NAVIGATION)}') OR (regexp_matches(low, '{words_in(rules.MENU_WORDS)}')
        AND (n <= 2 OR regexp_matches(low, '{words_in(rules.MENU_WORDS)}[^\n]*{words_in(rules.MENU_WORDS)}')))))
    OR (n <= 40 AND ({low_has(rules.BOILERPLATE)} OR {' OR '.join(f'({low_has((word,))} AND {low_has(beside)})' for word, beside in rules.SUSPECTS)})) AS failed
  FROM line),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE failed) AS n_failed_lines,
    coalesce(sum(c) FILTER (WHERE failed), 0) AS lost_chars, sum(c) AS line_chars
  FROM judged GROUP BY doc_id),
base AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id)
SELECT b.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(lost_chars, 0) <= 0.5 * coalesce(line_chars, 0) AS kept,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_failed_lines, 0) AS n_failed_lines,
  coalesce(lost_chars, 0) AS lost_chars, coalesce(line_chars, 0) AS line_chars
FROM base b LEFT JOIN lines ON b.doc_id = lines.doc_id
"""

OP8_SQL = r"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (
  SELECT doc_id, coalesce(text, '') AS text,
    xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
      lambda a, b: xor(a // 256, t[(xor(a % 256, b) + 1)::BIGINT]))) % 7 = 2 AS held_out
  FROM documents, crc_table),
w AS (
  SELECT doc_id, held_out, list_append(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), ' ') AS w
  FROM d),
token AS (SELECT doc_id, held_out, unnest(w) AS w, unnest(list_prepend('', w)[1:len(w)]) AS h, unnest(list_prepend(NULL, list_prepend('', w))[1:len(w)]) AS g FROM w),
unigram AS (SELECT w, count(*) AS c FROM token WHERE NOT held_out GROUP BY w),
context AS (SELECT h, count(*) AS c FROM token WHERE NOT held_out GROUP BY h),
bigram AS (SELECT h, w, count(*) AS c FROM token WHERE NOT held_out GROUP BY h, w),
trigram AS (SELECT g, h, w, count(*) AS c FROM token WHERE NOT held_out AND g IS NOT NULL GROUP BY g, h, w),
size AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM unigram),
scored AS (
  SELECT doc_id, held_out, n, coalesce(u.c, 0) AS cu, coalesce(x.c, 0) AS ch, coalesce(b.c, 0) AS cb, coalesce(y.c, 0) AS cg, coalesce(t3.c, 0) AS ct,
    (coalesce(u.c, 0) + 1) / (n + v + 1) AS p, (cb + 100 * p) / (ch + 100) AS p2, (ct + 100 * p2) / (cg + 100) AS p3
  FROM token t CROSS JOIN size LEFT JOIN unigram u ON t.w = u.w LEFT JOIN context x ON t.h = x.h LEFT JOIN bigram b ON t.h = b.h AND t.w = b.w
    LEFT JOIN bigram y ON t.g = y.h AND t.h = y.w LEFT JOIN trigram t3 ON t.g = t3.g AND t.h = t3.h AND t.w = t3.w)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (WHERE cu > 0) AS n_known, n AS train_tokens,
  round(sum(log10(p)), 6) AS base_score, round(sum(log10(p3)), 6) AS score
FROM scored GROUP BY doc_id, held_out, n
"""

# The article of a page as its author marked it: what the scores must arrive at.
OP9_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '<br>', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(h, '</?(?:h1|p)>'), lambda x: trim(regexp_replace(
    replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'),
    '[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))) AS blocks FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM c
"""

OP10_SQL = r"""
WITH line AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
counted AS (SELECT *, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM line),
summed AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM counted),
forward AS (
  SELECT a.doc_id, a.i AS first, min(b.i) AS last FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.total - a.total + a.n > 50
  WHERE a.n > 0 GROUP BY a.doc_id, a.i),
backward AS (
  SELECT b.doc_id, max(a.i) AS first, b.i AS last FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.total - a.total + a.n > 50
  WHERE b.n > 0 GROUP BY b.doc_id, b.i),
chunk AS (
  SELECT c.doc_id, c.first, c.last, array_to_string(l[c.first:c.last], chr(10)) AS bytes
  FROM (SELECT * FROM forward UNION SELECT * FROM backward) c
  JOIN (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) d ON c.doc_id = d.doc_id),
repeated AS (SELECT bytes, min(doc_id) AS keeper FROM chunk GROUP BY bytes HAVING min(doc_id) <> max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM chunk JOIN repeated USING (bytes) WHERE doc_id <> keeper)
SELECT d.doc_id,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(c.line, chr(10) ORDER BY c.i) FILTER (WHERE g.i IS NULL), '') END AS text,
  count(c.i) AS n_lines, count(g.i) AS n_removed_lines
FROM documents d LEFT JOIN counted c ON d.doc_id = c.doc_id LEFT JOIN gone g ON c.doc_id = g.doc_id AND c.i = g.i
GROUP BY d.doc_id, d.text
"""

OP11_SQL = r"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
run AS (
  SELECT doc_id, word, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS word FROM documents)
  GROUP BY doc_id, word),
hashed AS (
  SELECT word, n, length(word) AS size,
    xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(doc_id || ':' || word, ''),
        lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::UBIGINT] ELSE [(192 + unicode(x) // 64)::UBIGINT, (128 + unicode(x) % 64)::UBIGINT] END))),
      lambda a, b: xor(a // 256, t[(xor(a % 256, b) + 1)::BIGINT]))) AS h
  FROM run, crc_table),
spelt AS (
  SELECT CASE WHEN h % 199 = 0 THEN word[1:(h % size)::BIGINT] || word[(h % size)::BIGINT + 2:] ELSE word END AS word, n FROM hashed),
w AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN w b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS best_n, min(other) FILTER (WHERE m = most) AS best FROM (SELECT *, max(m) OVER (PARTITION BY word) AS most FROM near) GROUP BY word),
form AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n
  FROM w LEFT JOIN best USING (word)),
chain(word, root, next) AS (
  SELECT word, word, form FROM form
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN form f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM form f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_model": op1_quality_model,
        "op2_decontamination": op2_decontamination,
        "op3_quality_rules": op3_quality_rules,
        "op4_packing": op4_packing,
        "op5_pii": op5_pii,
        "op6_secrets": op6_secrets,
        "op7_near_dedup": op7_near_dedup,
        "op8_lm_score": op8_lm_score,
        "op9_html_text": op9_html_text,
        "op10_line_dedup": op10_line_dedup,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_token_counts": op12_token_counts,
        "op13_whitening": op13_whitening,
        "instruction_packing": instruction_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op3_quality_rules": OP3_SQL, "op8_lm_score": OP8_SQL, "op9_html_text": OP9_SQL, "op10_line_dedup": OP10_SQL, "op11_spelling_variants": OP11_SQL}
