"""Personal data by fixed patterns and by bootstrapped contextual extraction, with DataFrame functions alone.

The fixed patterns find the seeds.  One and two words left and right of a seed, and one on both sides at
once, are its lexical patterns, and every string with a digit or an at sign is an instance that such
patterns may also surround.  The
graph of patterns and instances is scored round by round: a pattern trusts a kind by the share of
its instances that have it, an instance by the patterns around it.  Instances that end above the
threshold, have the kind's shape and are no seed are identifiers that the fixed patterns missed.

Links of a pattern and an instance are counted before they are shuffled, and only patterns with
enough support and trust go back to the instances, so frequent words cost no more than rare ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, let, materialise

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: Characters beside a candidate in which its two words on each side are looked for.
NEAR = 80
MIN_SUPPORT = 3.0
MIN_TRUST = 0.9

# The fixed patterns, in forms that Java's engine matches in linear time and without recursion: the
# same matches, with possessive repeats and starts only where a run of characters starts.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: A cheap test that a text can have a match at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
BYTE = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9]|(?<=0))"
VALID_IP = rf"^{BYTE}(?:\.{BYTE}){{3}}$"
#: A phone number as it is written at home: 7 to 15 digits with blanks, brackets and the like between.
NATIONAL = r"\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,14}(?![0-9A-Za-z@_])"
BLANK = r"\x20\x09-\x0D"
#: The punctuation that ends a word.
TAIL = rf"[^A-Za-z0-9{BLANK}]++(?![^{BLANK}])"
#: Anything that may be an identifier: a phone or card number, else a word with a digit or an at sign
#: (but not the first word of a phone number).  An address word stays apart from numbers after it.
CANDIDATE = (
    r"\+[0-9][\x20().0-9-]+[0-9]|(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,18}+(?![0-9])|"
    rf"(?<![^{BLANK}])[0-9]{{1,3}}(?:[.:_-][0-9]{{1,3}}){{3}}(?:{TAIL}|(?![^{BLANK}]))|"
    r"(?<![0-9A-Za-z])[0-9](?:[\x20._/-]?[0-9]){11,18}+(?![0-9A-Za-z@_])|"
    rf"(?<![0-9A-Za-z]){NATIONAL}(?:{TAIL})?+|"
    rf"(?<![^{BLANK}])[^{BLANK}0-9@]*+(?!(?<![A-Za-z])(?=[0-9()./-]*+\x20[()./-]?[0-9]){NATIONAL})[0-9@][^{BLANK}]*+"
)
TRIM = r"^((?:(?!\([0-9]+\)[\x20./-]{0,2}[0-9])[^A-Za-z0-9+])*+)(.*?)[^A-Za-z0-9]*$"
#: What an identifier that no fixed pattern finds must look like.
SHAPES = {
    "email": r"^[^@\x20]+@[^@\x20]+$",
    "ip": r"^[0-9]{1,3}(?:[.:_-][0-9]{1,3}){3}$",
    "card": r"^[0-9](?:[ ._/-]?[0-9]){11,18}$",
    "phone": r"^[+(]?[0-9](?:[ ()./-]{0,2}[0-9]){6,14}$",
}
SPAN = "struct<start:int,kind:int,end:int,value:string>"


def running(numbers: Column, join: Callable[[Column, Column], Column], run: int = 128) -> Column:
    """The numbers (ints) joined up to each place (sum, greatest), in runs: appending copies an array, so runs keep that short."""

    def up_to(part: Column, first: Column) -> Column:
        return F.aggregate(part, first, lambda done, x: F.concat(done, F.array(F.coalesce(join(F.element_at(done, -1), x), x))))

    def shifted(parts: Column, heads: Column) -> Column:
        moved = F.transform(parts, lambda part, k: F.when(k == 0, part).otherwise(F.transform(part, lambda x: join(F.get(heads, k - 1), x))))
        return F.flatten(moved)

    def whole(a: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / run).cast("int")), lambda b: F.slice(a, b * run + 1, F.lit(run)))
        each = F.transform(runs, lambda part: up_to(F.slice(part, F.lit(2), F.lit(run)), F.slice(part, F.lit(1), F.lit(1))))
        ends = lambda parts: F.transform(parts, lambda part: F.element_at(part, -1))
        heads = lambda last: up_to(F.slice(last, F.lit(2), F.size(last)), F.slice(last, F.lit(1), F.lit(1)))
        return let(each, lambda parts: let(heads(ends(parts)), lambda h: shifted(parts, h)))

    return let(numbers, lambda a: F.when(F.size(a) <= 0, a).otherwise(whole(a)))


def found(text: Column, pattern: str, kind: int) -> Column:
    """All matches with their places in code points: what lies between matches tells where they are."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(m: Column) -> Column:
        steps = F.zip_with(m, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), lambda x, gap: F.length(gap) + F.length(x))
        span = lambda x, end: F.struct((end - F.length(x)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x.alias("value"))
        return F.zip_with(m, running(steps, lambda a, b: a + b), span)

    return let(matches, placed)


def outside(extra: Column, base: Column) -> Column:
    """The extra spans that overlap none of base, by what ends last before them and what starts next."""
    sign = lambda spans, is_extra: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(is_extra).alias("extra"), s.alias("span")))
    far = F.lit(-(1 << 31) + 1)

    def free(both: Column) -> Column:
        ends = running(F.transform(both, lambda x: F.when(x["extra"], far).otherwise(x["span"]["end"])), F.greatest)
        starts = F.transform(F.reverse(both), lambda x: F.when(x["extra"], far).otherwise(-x["start"]))
        return let(
            F.struct(ends.alias("ends"), F.reverse(running(starts, F.greatest)).alias("starts")),
            lambda near: F.transform(
                F.filter(both, lambda x, k: x["extra"] & (F.get(near["ends"], k) <= x["start"]) & (-F.get(near["starts"], k) >= x["span"]["end"])), lambda x: x["span"]
            ),
        )

    return let(F.sort_array(F.concat(sign(base, False), sign(extra, True))), free)


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""

    def add(total: Column, k: Column) -> Column:
        d = F.substring(digits, F.length(digits) - k, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(k % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """Whether a match of a fixed pattern is one of its kind."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(VALID_IP)
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    hint = text.contains("@") if kind == "email" else text.rlike(HINTS[kind])
    spans = F.filter(found(text, PATTERNS[kind], KINDS.index(kind)), lambda s: valid(kind, s["value"]))
    return F.when(hint, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def spelled(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def candidates(docs: DataFrame) -> DataFrame:
    """doc, twin, start, end, value, patterns and seed (a kind's number or null) of every candidate.

    docs has the columns doc, twin, text.
    """
    with_any = docs.filter(F.col("text").rlike("[0-9@]"))
    spans = with_any.select("doc", "twin", found(F.col("text"), CANDIDATE, 0).alias("spans"), F.split("text", CANDIDATE, -1).alias("gaps"))
    # outer, as Spark would otherwise infer a filter that finds the spans several times over
    each = spans.select("doc", "twin", "gaps", F.posexplode_outer("spans").alias("k", "span")).filter("k is not null")
    left, right = F.right(F.get("gaps", F.col("k")), F.lit(NEAR)), F.left(F.get("gaps", F.col("k") + 1), F.lit(NEAR))
    value = F.regexp_extract(F.col("span.value"), TRIM, 2)
    start = F.col("span.start") + F.length(F.regexp_extract(F.col("span.value"), TRIM, 1))
    placed = each.select(
        "doc",
        "twin",
        start.alias("start"),
        (start + F.length(value)).alias("end"),
        value.alias("value"),
        F.lower(F.regexp_extract(left, rf"([^{BLANK}]++)[{BLANK}]*+$", 1)).alias("left"),
        F.lower(F.regexp_extract(left, rf"([^{BLANK}]++)[{BLANK}]++[^{BLANK}]++[{BLANK}]*+$", 1)).alias("left2"),
        F.lower(F.regexp_extract(right, rf"^[{BLANK}]*+([^{BLANK}]++)", 1)).alias("right"),
        F.lower(F.regexp_extract(right, rf"^[{BLANK}]*+[^{BLANK}]++[{BLANK}]++([^{BLANK}]++)", 1)).alias("right2"),
    ).filter(F.length("value") >= 4)
    seed = F.coalesce(*(F.when(F.col("value").rlike("^(?:" + PATTERNS[k] + ")$") & valid(k, F.col("value")), i) for i, k in enumerate(KINDS)))

    def joined(side: str, *words: str) -> Column:
        return F.when(F.length(words[0]) * F.length(words[-1]) > 0, F.concat_ws(" ", F.lit(side), *words))

    around = F.array(joined("<", "left"), joined("<", "left2", "left"), joined(">", "right"), joined(">", "right", "right2"), joined("=", "left", "right"))
    return placed.select("doc", "twin", "start", "end", "value", F.array_compact(around).alias("patterns"), seed.alias("seed"))


def bootstrap(places: DataFrame, rounds: int = ROUNDS, min_support: float = MIN_SUPPORT, min_trust: float = MIN_TRUST) -> DataFrame:
    """value, kind (its number) and trust of the instances that the patterns around them reveal."""
    links = materialise(places.select("value", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.min("seed").alias("seed")))
    kinds = range(len(KINDS))
    trust = [F.when(F.col("seed") == k, 1.0).otherwise(0.0) for k in kinds]
    scored = links.select("pattern", "value", "seed", *(t.alias(f"s{k}") for k, t in enumerate(trust)))
    known = None
    for _ in range(rounds):
        sums = scored.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"s{k}").alias(f"s{k}") for k in kinds))
        share = [F.when(F.col(f"s{k}") >= min_support, F.col(f"s{k}") / (F.col("n") + 1)).otherwise(0.0).alias(f"c{k}") for k in kinds]
        # a table, not an aggregate on the join's key: a pattern around a third of all instances can then be split
        patterns = materialise(sums.select("pattern", *share).filter(" or ".join(f"c{k} >= 0.5" for k in kinds)))
        # a side is trusted as its best pattern is; the sides' doubts multiply, and both at once may be one pattern
        best = lambda k, side: F.coalesce(F.max(F.when(F.col("pattern").startswith(side), F.col(f"c{k}"))), F.lit(0.0))
        trusted = [F.greatest(1 - (1 - best(k, "<")) * (1 - best(k, ">")), best(k, "=")) for k in kinds]
        shaped = [F.when(F.col("value").rlike(SHAPES[name]), t).otherwise(0.0).alias(f"t{k}") for (k, name), t in zip(enumerate(KINDS), trusted, strict=True)]
        earlier, known = known, materialise(links.filter("seed is null").join(patterns, "pattern").groupBy("value").agg(*shaped))
        discard(patterns)
        if earlier is not None:
            discard(earlier)
        learned = [F.coalesce(F.col(f"t{k}"), trust[k]).alias(f"s{k}") for k in kinds]
        scored = links.join(known, "value", "left").select("pattern", "value", "seed", *learned)
    discard(links)
    best = F.greatest(*(F.col(f"t{k}") for k in kinds))
    kind = F.coalesce(*(F.when(F.col(f"t{k}") == best, k) for k in kinds))
    return known.select("value", kind.alias("kind"), best.alias("trust")).filter(F.col("trust") >= min_trust)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, min_support: float = MIN_SUPPORT, min_trust: float = MIN_TRUST) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_discovered of every document.

    Spans are in code points.  The numbers and base_sha256 are of the fixed patterns; spans has these
    and the discovered ones that overlap none of them.  A null text is an empty one, without spans;
    null ids and repeated rows are scanned like any other; other columns are ignored; an empty table
    gives an empty table.
    """
    texts = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("twin", F.xxhash64("text"))
    places = materialise(candidates(texts))
    discovered = bootstrap(places, rounds, min_support, min_trust)
    extra = (
        places.filter("seed is null")
        .join(discovered, "value")
        .groupBy(F.col("doc").alias("__doc"), F.col("twin").alias("__twin"))
        .agg(F.collect_set(F.struct(F.col("start").cast("int").alias("start"), F.col("kind"), F.col("end").cast("int").alias("end"), "value").cast(SPAN)).alias("extra"))
    )
    each = texts.select("doc", "twin", *(base_spans(F.col("text"), k).alias(k) for k in KINDS))
    base = each.select("doc", "twin", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sort_array(F.concat(*KINDS)).alias("base"))
    joined = base.join(extra, [base["doc"].eqNullSafe(extra["__doc"]), base["twin"] == extra["__twin"]], "left")
    more = F.when(F.col("extra").isNotNull(), outside(F.col("extra"), F.col("base"))).otherwise(F.array().cast(f"array<{SPAN}>"))
    return joined.withColumn("more", more).select(
        F.col("doc").alias("doc_id"),
        *(f"n_{k}" for k in KINDS),
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(F.sort_array(F.concat("base", "more"))).alias("spans"),
        F.size("more").cast("long").alias("n_discovered"),
    )
