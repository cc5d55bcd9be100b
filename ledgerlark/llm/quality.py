"""Quality rules: base counts, and divergence from language references.

A document's histogram of character classes and its histogram of common words are
compared with those of all documents of its language, by Jensen-Shannon distance
(0 to 1, base 2). Everything is a column expression over the document's own row, so
texts are never shuffled and one source or language may hold any share of the rows.

Defined cases: a null or blank text has no words and all counts 0, so it fails the base
rule. A document whose language is null or has no word list is compared with the
reference of all such documents (``*``). Distances of texts under the minimum lengths are
null and never reject; the bound of word histograms rises as words get fewer. Repeated rows are judged alike; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let, stored, words

# Frequent words of each language.
COMMON_WORDS = {
    "de": ("das", "den", "der", "des", "die", "ein", "für", "ist", "mit", "nicht", "und", "von", "zu"),
    "en": ("a", "and", "are", "as", "for", "in", "is", "it", "of", "on", "that", "the", "to", "was", "with"),
    "es": ("con", "de", "del", "el", "en", "la", "las", "los", "por", "que", "se", "un", "una", "y"),
    "fr": ("dans", "de", "des", "du", "est", "et", "la", "le", "les", "pour", "que", "un", "une"),
}
POOLED = "*"
# Character classes in the order they are taken out of a text; the rest is the last class.
CHAR_CLASSES = ("[a-z]+", "[\\x20\\x09-\\x0D]+", "[^\\x00-\\x7F]+", "[A-Z]+", "[0-9]+", "[#*$%&|<>]+", "[.,;:!?'\"()-]+")
MIN_CHARS = 200
MIN_WORDS = 50
MAX_CHAR_DISTANCE = 0.30
# Bound of a word histogram: a fixed part, and the noise of few words, which falls with the
# square root of their number.
MAX_WORD_DISTANCE = 0.14
WORD_NOISE = 1.35
MIN_BASE_WORDS = 50


def _language(lang: Column) -> Column:
    return F.when(lang.isin(*COMMON_WORDS), lang).otherwise(F.lit(POOLED))


def _lists() -> dict[str, list[str]]:
    pooled = sorted({w for listed in COMMON_WORDS.values() for w in listed})
    return {**{k: list(v) for k, v in COMMON_WORDS.items()}, POOLED: pooled}


def _char_counts(text: Column) -> Column:
    """Characters per class: each class is what its removal takes from what was left."""

    def take(left: Column, classes: tuple[str, ...], counts: tuple[Column, ...]) -> Column:
        if not classes:
            return F.array(*counts, F.length(left).cast("long"))
        return let(
            F.regexp_replace(left, classes[0], ""),
            lambda rest: take(rest, classes[1:], (*counts, (F.length(left) - F.length(rest)).cast("long"))),
        )

    return let(F.coalesce(text, F.lit("")), lambda t: take(t, CHAR_CLASSES, ()))


def _word_counts(tokens: Column, language: Column) -> Column:
    """Counts of the language's common words, and of all other words last.

    The common words are joined with a blank on either side; removing one word then
    shortens the string by its length and two, as often as it occurs.
    """
    lists = _lists()
    common = F.filter(tokens, lambda w: F.lower(w).isin(*lists[POOLED]))

    def counts(joined: Column, listed: list[str]) -> Column:
        each = [
            ((F.length(joined) - F.length(F.replace(joined, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long")
            for w in listed
        ]
        return let(
            F.array(*each),
            lambda a: F.concat(a, F.array(F.size(tokens).cast("long") - F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y))),
        )

    def by_language(joined: Column) -> Column:
        cases = F.when(language == "de", counts(joined, lists["de"]))
        for key in lists:
            if key != "de":
                cases = cases.when(language == key, counts(joined, lists[key]))
        return cases

    return let(F.concat(F.lit(" "), F.array_join(F.transform(common, F.lower), "  "), F.lit(" ")), by_language)


def repeated_words(tokens: Column) -> Column:
    """Words in 3-word windows found at least twice in the text, the first included.

    Windows are compared by a 64-bit hash of the three words, within one text.
    """
    windows = F.size(tokens) - 2

    def covered(hashes: Column) -> Column:
        def total(placed: Column) -> Column:
            last = F.size(placed) - 1
            repeated = F.filter(
                F.sequence(F.lit(0), last),
                lambda j: ((j > 0) & (F.get(placed, j - 1)["h"] == placed[j]["h"]))
                | ((j < last) & (F.get(placed, j + 1)["h"] == placed[j]["h"])),
            )
            starts = F.array_sort(F.transform(repeated, lambda j: placed[j]["p"]))
            begin = F.struct(F.lit(-3).alias("p"), F.lit(0).cast("long").alias("n"))
            return F.aggregate(
                starts,
                begin,
                lambda acc, p: F.struct(p.alias("p"), (acc["n"] + F.least(F.lit(3), p - acc["p"])).alias("n")),
                lambda acc: acc["n"],
            )

        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(placed, total))

    hashes = F.transform(F.sequence(F.lit(0), windows - 1), lambda i: F.xxhash64(tokens[i], tokens[i + 1], tokens[i + 2]))
    return F.when(windows < 2, F.lit(0).cast("long")).otherwise(let(hashes, covered))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(" \t\r\x0b\x0c")) != "")
    return let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


def distance(left: Column, right: Column) -> Column:
    """Jensen-Shannon distance of two count arrays; null if one of them is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    entropy = lambda a: F.aggregate(
        a, F.lit(0.0), lambda x, p: x - F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0))
    )
    share = lambda a, n: F.transform(a, lambda v: v / n)

    def of(p: Column, q: Column) -> Column:
        mean = F.zip_with(p, q, lambda a, b: (a + b) / 2)
        return F.sqrt(F.greatest(F.lit(0.0), entropy(mean) - (entropy(p) + entropy(q)) / 2))

    return F.when((total(left) > 0) & (total(right) > 0), let(share(left, total(left)), lambda p: let(share(right, total(right)), lambda q: of(p, q))))


def _source(docs: DataFrame, carry: Sequence[str], text: str, lang: str) -> DataFrame:
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row"),
        _language(F.col(f"`{lang}`")).alias("_key"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"),
    )


def histograms(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``(_key, chars, common)`` of each text."""
    body, key = F.col("_text"), F.col("_key")
    common = let(words(body), lambda tokens: _word_counts(tokens, key))
    return _source(docs, [], text, lang).select("_key", _char_counts(body).alias("chars"), common.alias("common"))


def figures(docs: DataFrame, carry: Sequence[str], text: str, lang: str) -> DataFrame:
    """A struct ``_row`` of the columns to carry, and counts and histograms of each text.

    They are made as one struct by a generator. A filter on them then stays above it;
    pushed below, it would repeat their expressions, in lambdas once per word.
    """
    body, key = F.col("_text"), F.col("_key")

    def measured(tokens: Column) -> Column:
        return F.struct(
            F.size(tokens).cast("long").alias("n_words"),
            F.length(F.regexp_replace(body, "[\\x20\\x09-\\x0D]+", "")).cast("long").alias("word_chars"),
            (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            repeated_lines(body).alias("n_dup_lines"),
            repeated_words(tokens).alias("n_repeat_words"),
            F.length(body).alias("n_chars"),
            _char_counts(body).alias("chars"),
            _word_counts(tokens, key).alias("common"),
        )

    made = F.explode(F.transform(F.array(words(body)), measured)).alias("_made")
    return _source(docs, carry, text, lang).select("_row", "_key", made).select("_row", "_key", "_made.*")


def language_references(rows: DataFrame) -> DataFrame:
    """``(_key, _ref_chars, _ref_words)``: summed histograms per listed language and for
    all other documents; as many rows as there are word lists, and one more."""
    lists = _lists()
    widths = {"chars": len(CHAR_CLASSES) + 1, "common": max(map(len, lists.values())) + 1}
    sums = rows.groupBy("_key").agg(
        *[F.coalesce(F.sum(F.get(a, F.lit(i))), F.lit(0)).alias(f"{a}{i}") for a, n in widths.items() for i in range(n)]
    )

    def sized(column: str) -> Column:
        cases = None
        for name, listed in lists.items():
            n = len(listed) + 1 if column == "common" else widths["chars"]
            value = F.array(*[F.col(f"{column}{i}") for i in range(n)])
            cases = F.when(F.col("_key") == name, value) if cases is None else cases.when(F.col("_key") == name, value)
        return cases

    return sums.select("_key", sized("chars").alias("_ref_chars"), sized("common").alias("_ref_words"))


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", carry: Sequence[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all) of ``docs`` and one struct of figures and verdicts.

    The struct's name is ``quality`` with underscores in front if that is taken. Its
    fields: ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    char_distance, word_distance, base_failed, kept``. Texts that are carried along are
    measured in two passes, one for the references; else the figures are written once.
    """
    carry = docs.columns if carry is None else list(carry)
    out = free_name(carry, "quality")
    rows = figures(docs, carry, text, lang)
    if text not in carry:
        rows = stored(rows, "figures")
    measured = rows if text not in carry else histograms(docs, text, lang)
    # One row per word list: bounded by the parameter COMMON_WORDS.
    rows = rows.join(F.broadcast(language_references(measured)), "_key", "left").withColumns({
        "char_distance": F.when(F.col("n_chars") >= MIN_CHARS, distance(F.col("chars"), F.col("_ref_chars"))),
        "word_distance": F.when(F.col("n_words") >= MIN_WORDS, distance(F.col("common"), F.col("_ref_words"))),
    })
    failed = (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    over = lambda column, most: F.coalesce(F.col(column) > most, F.lit(False))
    most_words = F.lit(MAX_WORD_DISTANCE) + F.lit(WORD_NOISE) / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    far = over("char_distance", MAX_CHAR_DISTANCE) | over("word_distance", most_words)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance")
    return rows.select("_row.*", F.struct(*names, failed.alias("base_failed"), (~failed & ~far).alias("kept")).alias(out))


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows of ``docs`` that the rules keep, with the same columns."""
    out = free_name(docs.columns, "quality")
    return judged(docs, text, lang).where(F.col(f"{out}.kept")).drop(out)
