"""Operator 10: line-first quality rules, in DataFrame functions only.

Lines are judged first: a line fails on missing punctuation, navigation marks, shouting, symbol noise or
boilerplate phrases. Failing lines go, and a document that loses too much of its text is rejected.
Everything is an expression over one row; nothing is shuffled, and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Fixed phrases of licence, cookie and navigation lines in the corpus' four languages, lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "this work is licensed", "creative commons", "terms of use", "terms of service",
    "privacy policy", "cookie", "javascript", "lorem ipsum", "subscribe", "sign in", "log in", "read more", "click here", "share this",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutz", "mehr lesen", "weiterlesen", "jetzt anmelden", "impressum",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "lire la suite", "abonnez-vous", "se connecter",
    "todos los derechos reservados", "condiciones de uso", "política de privacidad", "leer más", "suscríbete", "iniciar sesión",
)


def strip_to(text: Column, drop: str) -> Column:
    return F.translate(text, drop, "")


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def words_of(text: Column) -> Column:
    """Array of the words of a text."""
    return F.array_remove(F.split(F.translate(text, BLANK, " " * len(BLANK)), " "), "")


def once(value: Column, f) -> Column:
    """``f`` of a value that is computed once and not at each use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def windows(words: Column, n: int) -> Column:
    """64-bit hash of each ``n``-word window: of one word, doubled while it fits, the rest added word by word."""
    drop = lambda a, k: F.slice(a, k + 1, F.greatest(F.size(a) - F.lit(k), F.lit(0)))
    join = lambda a, b: F.zip_with(F.slice(a, 1, F.size(b)), b, lambda x, y: F.xxhash64(x, y))

    def grow(h: Column, have: Column, size: int) -> Column:
        if size == n:
            return have
        if 2 * size <= n:
            return once(join(have, drop(have, size)), lambda x: grow(h, x, 2 * size))
        return once(join(have, drop(h, size)), lambda x: grow(h, x, size + 1))

    return once(F.transform(words, lambda w: F.xxhash64(w)), lambda h: grow(h, h, 1))


def repeat_words(words: Column, n: int = 5) -> Column:
    """Words inside ``n``-word windows that the text holds at least twice, the first included.

    Texts without a repeat, nearly all, stop at one hash set of their windows; the others sort (hash, place), keep places
    whose neighbour has the same hash, and add up what each place covers."""

    def covered(p: Column) -> Column:
        again = F.filter(p, lambda x, j: (x["h"] == F.get(p, j + 1)["h"]) | (x["h"] == F.get(p, j - 1)["h"]))
        return F.array_sort(F.transform(again, lambda x: x["i"]))

    def total(codes: Column) -> Column:
        pairs = F.array_sort(F.transform(codes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        steps = lambda s: F.transform(s, lambda x, j: F.least(F.lit(n), F.coalesce(F.get(s, j + 1) - x, F.lit(n))))
        return once(pairs, lambda p: once(covered(p), lambda s: F.aggregate(steps(s), F.lit(0), lambda a, x: a + x)))

    found = once(windows(words, n), lambda c: F.when(F.size(F.array_distinct(c)) == F.size(c), F.lit(0)).otherwise(total(c)))
    return F.when(F.size(words) < n + 1, F.lit(0)).otherwise(found).cast("long")


def line_fails(line: Column) -> Column:
    """Whether a line is no prose: navigation bars, symbol noise, shouting, a long run without sentence punctuation, or a
    short line with a boilerplate phrase. Marks are held against the line's length."""
    size = F.length(line)
    marks = lambda some: size - F.length(F.translate(line, some, ""))
    noisy = (marks("|") * 40 > size) | (marks(SYMBOLS) * 24 > size) | ((size >= 15) & (marks("!") * 18 > size))
    unpunctuated = (size >= 200) & ~line.rlike("[.!?;:,]")
    boiler = (size <= 160) & F.lower(line).rlike("|".join(BOILERPLATE))
    return F.when(line.rlike("[#*$%&|<>!]"), noisy).otherwise(F.lit(False)) | unpunctuated | boiler


#: Share of a document's characters that failing lines may take: a document that is mostly navigation is none.
MAX_LOST = 0.5


def clean_lines(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """``docs`` (with a ``text`` column; any others) plus one struct column ``quality``: n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and ``text``, what is left of the text.

    Null and empty texts have no words, fail the base rules and are not kept. Lines without words always
    pass and weigh nothing. Rows are judged alone, so repeated rows, ties and an empty table need no rule."""
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    lines = F.split(text, "\n", -1)
    d = docs.select(F.struct("*").alias("_row")).withColumn("_words", words_of(text)).withColumn("_lines", F.filter(lines, has_word))
    d = d.withColumn("_bad", F.filter("_lines", line_fails))
    chars = lambda s: F.length(strip_to(s, BLANK)).cast("long")
    d = d.select(
        "_row", F.size("_words").cast("long").alias("n_words"), chars(text).alias("word_chars"), (F.length(text) - F.length(strip_to(text, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), repeat_words(F.col("_words")).alias("n_repeat_words"),
        chars(F.array_join("_bad", "")).alias("_lost"), F.array_join(F.filter(lines, lambda x: ~has_word(x) | ~line_fails(x)), "\n").alias("text"),
    )
    d = d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("_lost") <= F.lit(max_lost) * F.col("word_chars")))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "text"]
    return d.select("_row.*", F.struct(*names).alias("quality"))


def rules_report(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, the counts, base_failed and kept."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return clean_lines(docs.select("doc_id", "text")).select("doc_id", *[F.col(f"quality.{n}").alias(n) for n in names])
