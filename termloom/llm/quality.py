"""Quality rules [native]: line-first cleaning, then a verdict on each document.

Every rule is a DataFrame expression, evaluated in one narrow pass over the
table: no shuffle, no Python. A line is cut at "\\n". A line with at least one word fails when

* symbols: over `max_symbol_share` of its characters are symbols such as `#`, `*` or `&`;
* navigation: it holds `min_separators` or more of `|`, `»`, `›`, `•`, and at least
  one for every two of its remaining words (a menu or a table row);
* boilerplate: it holds one of the fixed phrases;
* punctuation: it has fewer than `min_open_words` words and doesn't end in
  sentence punctuation before its closing white space (a heading, button or label left over from a page).

Failed lines are removed. A document is rejected when it fails a base rule
(too few words, too many words in repeated 3-word windows), or when the failed
lines hold over `max_lost_share` of its words.

Defined results: null and empty texts have no words and fail the base rules;
repeated rows are judged alike; an empty table gives an empty result; extra
columns are dropped by `judge` and kept by `clean` (which replaces `text`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, WORD, let, text_or_empty

#: Phrases of page furniture, matched in lower case.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "cookie policy", "terms of service", "terms of use", "use of cookies",
    "enable javascript", "subscribe to our", "sign up for", "click here", "share this", "follow us on", "lorem ipsum",
    "tous droits réservés", "alle rechte vorbehalten", "todos los derechos reservados",
)
#: Symbols that a line of prose holds few of, and the marks that close one.
SYMBOLS = r"[#*$%&|<>=+_~^{}\[\]\\@/]"
ENDS = (".", "!", "?", "…", ":", ";", ",", '"', "'", ")", "»", "”")
SPACES = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words inside windows of `width` words that occur twice or more in `words`, the first included.

    Each window becomes one long, hash above and place below, in as many bits as
    the text's number of words needs; sorted, equal windows are neighbours, and the covered
    words are counted from the sorted places. Neighbours are compared word by word, so a collision of the
    shortened hashes adds nothing. O(n log n) in the words.
    """
    low_of = lambda w: F.pow(F.lit(2.0), F.ceil(F.log2(F.size(w) + F.lit(1.0)))).cast("long") - 1

    def keys(w: Column, low: Column) -> Column:
        key = lambda _, i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))
        return F.sort_array(F.transform(F.slice(w, 1, F.greatest(F.size(w) - width + 1, F.lit(0))), key))

    def places(w: Column, s: Column, low: Column) -> Column:
        at = lambda x: x.bitwiseAND(low).cast("int")
        same = lambda x, y: (x.bitwiseOR(low) == y.bitwiseOR(low)) & F.forall(
            F.array(*[F.lit(k) for k in range(width)]), lambda k: F.get(w, at(x) + k) == F.get(w, at(y) + k)
        )
        twice = F.filter(s, lambda x, i: F.coalesce(same(x, F.get(s, i + 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i - 1)), F.lit(False)))
        return F.sort_array(F.transform(twice, at))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x).cast("long")

    return let(low_of(words), lambda low: let(keys(words, low), lambda s: let(places(words, s, low), covered)))


def failed_lines(text: Column, max_symbol_share=0.3, min_separators=3, min_open_words=3) -> Column:
    """The lines with a word that break a rule. Cheap tests of the whole text guard the dearer tests of its lines."""
    lower = F.lower(text)
    phrase = lower.contains(BOILERPLATE[0])
    for p in BOILERPLATE[1:]:
        phrase |= lower.contains(p)
    menu = text.contains("|") | text.contains("»") | text.contains("›") | text.contains("•")

    def fails(line: Column, phrase: Column, menu: Column) -> Column:
        separators = F.regexp_count(line, F.lit("[|»›•]"))
        navigation = menu & (separators >= min_separators) & (2 * separators >= F.size(words_of(line)) - separators)
        boilerplate = phrase & F.lower(line).rlike("|".join(BOILERPLATE))
        symbols = F.regexp_count(line, F.lit(SYMBOLS)) > max_symbol_share * F.length(line)
        closed = F.substring(F.rtrim(line, F.lit(SPACE_CHARS)), -1, 1).isin(*ENDS)
        open_end = ~closed & (F.size(words_of(line)) < min_open_words)
        return (symbols | open_end | navigation | boilerplate) & line.rlike(WORD)

    guards = F.struct(phrase.alias("phrase"), menu.alias("menu"))
    return let(guards, lambda g: F.filter(F.split(text, "\n"), lambda x: fails(x, g["phrase"], g["menu"])))


def clean_text(text: Column, **rules) -> Column:
    """The text without its failed lines."""
    kept = lambda bad: F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(bad, x))
    return let(failed_lines(text, **rules), lambda bad: F.when(F.size(bad) == 0, text).otherwise(F.array_join(kept(bad), "\n")))


def words_in(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0), lambda a, x: a + F.size(words_of(x)))


def measures(text: Column, **rules) -> Column:
    """Every count of one text as a struct; its words are split once."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    counts = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).alias("n_repeat_words"),
    )
    return F.struct(
        let(words_of(text), counts).alias("of_words"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        words_in(failed_lines(text, **rules)).cast("long").alias("words_lost"),
    )


def verdict(n_words: Column, n_repeat: Column, lost: Column, min_words=50, max_repeat_percent=50, max_lost_share=0.5):
    """(base_failed, kept) from the counts."""
    failed = (n_words < min_words) | (100 * n_repeat > max_repeat_percent * n_words)
    return failed, ~failed & (lost <= max_lost_share * n_words)


def judge(docs: DataFrame, limits: dict | None = None, **rules) -> DataFrame:
    """One row per document: counts, base verdict, words in failed lines, verdict."""
    m = docs.select("doc_id", measures(text_or_empty(), **rules).alias("m"))
    m = m.select("doc_id", "m.of_words.n_words", "m.of_words.word_chars", "m.n_symbols", "m.n_dup_lines", "m.of_words.n_repeat_words", "m.words_lost")
    failed, kept = verdict(F.col("n_words"), F.col("n_repeat_words"), F.col("words_lost"), **(limits or {}))
    return m.select("*", failed.alias("base_failed"), kept.alias("kept"))


def clean(docs: DataFrame, limits: dict | None = None, **rules) -> DataFrame:
    """The accepted documents, each with its failed lines removed; all columns stay."""
    m = docs.withColumn("_m", measures(text_or_empty(), **rules))
    _, kept = verdict(F.col("_m.of_words.n_words"), F.col("_m.of_words.n_repeat_words"), F.col("_m.words_lost"), **(limits or {}))
    return m.filter(kept).withColumn("text", clean_text(F.col("text"), **rules)).drop("_m")
