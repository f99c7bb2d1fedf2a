"""Line-first cleaning with DataFrame functions alone.

Every line is judged by rules on its punctuation, on navigation and on boilerplate.  Failing lines
are removed, and a document is rejected if it loses too much of its text, or by the document-wide
base rules (too short, or too many words in repeated windows).  It is one projection over the
scan: no shuffle, no join, nothing but built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE_SPACE_RUN, let

MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
WINDOW = 5
MIN_KEPT_SHARE = 0.5

# What the line rules look for, in English, German, French and Spanish (A-Z match in either case).
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›·•"
SENTENCE_MARKS = ".,;:!?…。，、；：！？"
ENDS_OF_SENTENCES = ".!?…。！？"
NAVIGATION = (
    "log in", "login", "sign in", "sign up", "next page", "previous page", "back to top", "skip to content", "click here", "read more",
    "learn more", "share this", "subscribe", "follow us", "contact us", "about us", "site map", "sitemap",
    "anmelden", "abmelden", "registrieren", "weiterlesen", "mehr erfahren", "hier klicken", "nach oben", "nächste seite", "vorherige seite", "zum inhalt springen", "folgen sie uns", "über uns",
    "connexion", "inscrire", "lire la suite", "en savoir plus", "cliquez ici", "retour en haut", "page suivante", "page précédente", "aller au contenu", "suivez-nous", "contactez-nous", "plan du site",
    "iniciar sesión", "regístrate", "leer más", "saber más", "haga clic aquí", "volver arriba", "página siguiente", "página anterior", "ir al contenido", "síguenos", "contáctenos", "mapa del sitio",
)
#: Words that are also words of prose: they tell a menu only in a line of two words at most, or two of them together.
MENU_WORDS = ("home", "menu", "register", "newsletter", "contact", "startseite", "menü", "kontakt", "impressum", "accueil", "mentions légales", "inicio", "contacto", "aviso legal")
BOILERPLATE = (
    "all rights reserved", "©", "privacy policy", "terms of use", "terms of service", "lorem ipsum", "licensed under", "released under", "powered by",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "lizenziert unter", "veröffentlicht unter der",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "sous licence",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "términos de uso", "condiciones de uso", "bajo la licencia", "bajo licencia",
)
#: Words of prose that are boilerplate only beside one of the second list.
SUSPECTS = (
    ("copyright", ("[(]c[)]", "(?:19|20)[0-9][0-9]")),
    ("cookie", ("accept", "consent", "browser", "website", "this site", "our site", "settings", "akzeptier", "webseite", "diese seite", "acceptez", "ce site", "navigateur", "aceptar", "este sitio", "navegador")),
    ("javascript", ("enable", "disabled", "browser", "turn on", "required", "aktivier", "activer", "activez", "navigateur", "active", "habilit", "navegador")),
)


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def occurrences(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(without(text, characters))


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words that lie in a window of so many words found twice or more in the text."""

    def covered(places: Column) -> Column:
        reach = F.transform(places, lambda p, k: F.least(F.lit(size), F.coalesce(F.get(places, k + 1) - p, F.lit(size))))
        return F.aggregate(reach, F.lit(0), lambda a, b: a + b)

    def twice(ordered: Column) -> Column:
        hit = F.filter(ordered, lambda x, k: F.coalesce(x["h"] == F.get(ordered, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(ordered, k + 1)["h"], F.lit(False)))
        return let(F.sort_array(F.transform(hit, lambda x: x["i"])), covered)

    def over(grams: Column) -> Column:
        ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(let(ordered, twice))

    def windows(hashes: Column) -> Column:
        starts = F.slice(hashes, F.lit(1), F.size(hashes) - (size - 1))
        return let(F.transform(starts, lambda h, i: F.xxhash64(h, *(F.get(hashes, i + k) for k in range(1, size)))), over)

    return F.when(F.size(words) <= size, 0).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), windows))


def counted(text: Column, characters: str) -> Column:
    """occurrences(), by a search first: most texts have none."""
    return F.when(text.rlike(f"[{characters}]"), occurrences(text, characters)).otherwise(0)


def any_of(words: tuple[str, ...]) -> str:
    return "(?i)(?:" + "|".join(words) + ")"


def whole_words(words: tuple[str, ...]) -> str:
    return "(?i)(?:^|[^a-z])(?:" + "|".join(words) + ")(?:[^a-z]|$)"


def line_fails(line: Column) -> Column:
    """Whether a line that has a word fails a rule.

    A line of navigation is short, ends no sentence, and has a phrase of navigation, one or two menu words alone, or two
    among others.  Boilerplate is a line of 40 words at most with one of its phrases, or with a word
    such as "cookie" beside another of its kind; prose about cookies, scripts or copyright stays.
    """

    def with_words(n: Column) -> Column:
        shouts, separators = counted(line, "!?"), counted(line, SEPARATORS)
        punctuation = (counted(line, SYMBOLS) > 0.3 * n) | ((shouts > 0.3 * n) & (shouts >= 3)) | ((n >= 10) & ~line.rlike(f"[{SENTENCE_MARKS}]"))
        menu = line.rlike(whole_words(MENU_WORDS)) & ((n <= 2) | line.rlike(whole_words(MENU_WORDS) + "[^\\n]*" + whole_words(MENU_WORDS)[4:]))
        phrase = line.rlike(whole_words(NAVIGATION)) | menu
        navigation = ((separators >= 3) & (separators > 0.2 * n)) | ((n <= 10) & ~F.rtrim(line).rlike(f"[{ENDS_OF_SENTENCES}]$") & phrase)
        found = line.rlike(any_of(BOILERPLATE))
        for word, beside in SUSPECTS:
            found = found | (line.rlike(any_of((word,))) & line.rlike(any_of(beside)))
        return punctuation | navigation | ((n <= 40) & found)

    return let(F.length(line) - F.length(F.replace(F.replace(line, F.lit(" "), F.lit("")), F.lit("\t"), F.lit(""))) + 1, with_words)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_kept_share: float = MIN_KEPT_SHARE) -> DataFrame:
    """doc_id, text, the counts and verdicts, and the cleaned text of every document.

    A null text has no words and cleans to null, an empty one to an empty text; both fail the base
    rules.  Null ids and repeated rows are judged like any other; other columns are ignored; an empty table
    gives an empty table.
    """
    parts = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.coalesce(F.array_remove(F.split(F.col(text_col), WHITE_SPACE_RUN), ""), F.array().cast("array<string>")).alias("words"),
        F.coalesce(F.split(F.col(text_col), "\n"), F.array().cast("array<string>")).alias("lines"),
    )
    # 0: without a word, 1: passes, 2: fails; found once for each line
    kind = lambda line: F.when(~line.rlike(r"[^\x20\x09-\x0D]"), 0).when(line_fails(line), 2).otherwise(1)
    judged = parts.select(
        "doc_id",
        "text",
        "lines",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.coalesce(counted(F.col("text"), SYMBOLS), F.lit(0)).cast("long").alias("n_symbols"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.transform("lines", kind).alias("kinds"),
    )
    of_kind = lambda wanted: F.filter("lines", lambda _, i: wanted(F.get("kinds", i)))
    judged = judged.withColumn("full_lines", of_kind(lambda k: k > 0))
    failed = of_kind(lambda k: k == 2)
    chars = lambda lines: F.coalesce(F.length(F.array_join(lines, "")), F.lit(0))
    measured = judged.withColumn("failed_lines", failed).withColumns(
        {
            "n_dup_lines": (F.size("full_lines") - F.size(F.array_distinct("full_lines"))).cast("long"),
            "n_lines": F.size("full_lines").cast("long"),
            "n_failed_lines": F.size("failed_lines").cast("long"),
            "lost_chars": chars(F.col("failed_lines")).cast("long"),
            "line_chars": chars(F.col("full_lines")).cast("long"),
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")),
        }
    )
    kept = ~F.col("base_failed") & (F.col("lost_chars") <= (1 - min_kept_share) * F.col("line_chars"))
    passing = of_kind(lambda k: k != 2)
    clean = F.when(F.col("n_failed_lines") == 0, F.col("text")).otherwise(F.array_join(passing, "\n"))
    return measured.select(
        "doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        kept.alias("kept"), "n_lines", "n_failed_lines", "lost_chars", "line_chars", clean.alias("clean_text"),
    )


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_kept_share: float = MIN_KEPT_SHARE) -> DataFrame:
    """doc_id and cleaned text of the documents that are kept; cases as in judge()."""
    return judge(docs, id_col, text_col, min_kept_share).filter("kept").select("doc_id", F.col("clean_text").alias("text"))
