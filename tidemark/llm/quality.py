"""Quality rules: a table of thresholds, compiled into one projection of built-in expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import BLANKS, packed


class Rule(NamedTuple):
    """A text passes if 100 times one count over another lies within the bounds (None: no bound)."""

    name: str
    part: str
    whole: str
    least: int | None
    most: int | None


# The thresholds of the verdict, in percent.
RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1200),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop_words", "n_words", 2, None),
    Rule("echoed_words", "n_echoed_words", "n_words", None, 30),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 60),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
    Rule("cut_lines", "n_cut_lines", "n_lines", None, 40),
)

# Common function words by language.
STOP_WORDS = {
    "en": "the of and to a in is that it for was on with as be by are this at from or an not have has but his they which you".split(),
    "de": "der die und in den von zu das sich mit auf für des ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "de la le et les des en un du une que est pour par avec qui dans pas sur au il ce ne se plus son sa ou mais".split(),
    "es": "de la que el en y los se las del un por con no una para su es al lo como más o pero sus le ha me si".split(),
}

#: Words of a window whose second occurrence makes it a repeat.
WINDOW = 8


def window_hashes(window: int = WINDOW) -> list[Callable[[Column], Column]]:
    """Steps that turn hashes of words, one after the other, into hashes of all windows: each step joins neighbours, doubling what a hash stands for."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    left = lambda h, k: F.slice(h, F.lit(1), F.greatest(F.size(h) - k, F.lit(0)))
    right = lambda h, k: F.slice(h, F.lit(k + 1), F.size(h))
    return [lambda h, k=1 << i: F.zip_with(left(h, k), right(h, k), lambda a, b: F.xxhash64(a, b)) for i in range(window.bit_length() - 1)]


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """How many words stand in windows found twice or more, from the hashes of a text's windows.

    Texts whose windows all differ, nearly all of them, end at a set of hashes; for the others places are sorted by hash and the words they cover added up.
    Windows are told apart by 64-bit hashes within a text.
    """
    order = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = lambda s: F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
    # one-element arrays bind an intermediate result, so that it is computed once
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    places = bound(order, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
    ends = lambda p: F.zip_with(F.slice(p, F.lit(2), F.size(p)), F.slice(p, F.lit(1), F.size(p) - 1), lambda b, a: F.least(b - a, F.lit(window)))
    covered = bound(places, lambda p: F.aggregate(ends(p), F.lit(window), lambda s, x: s + x))
    return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered).cast("long")


def passes(rule: Rule) -> Column:
    """The condition that a line of the table stands for; a text without the whole passes."""
    part, whole = F.col(rule.part) * 100, F.col(rule.whole)
    kept = F.lit(True)
    if rule.least is not None:
        kept = kept & (part >= whole * rule.least)
    if rule.most is not None:
        kept = kept & (part <= whole * rule.most)
    return kept


def judge_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, stop_words: dict[str, list[str]] = STOP_WORDS, text: str = "text", lang: str | None = "lang", min_words: int = 20, max_repeated: int = 30) -> DataFrame:
    """docs with counts of its words, lines and symbols, base_failed, failed (names of the rules that it breaks) and kept.

    Words are runs of anything but ASCII white space, lines what stands between \\n and holds a word. base_failed: fewer than min_words words, or more than
    max_repeated percent of them in windows of eight words that the text holds twice or more. kept: not base_failed and no rule broken. Rules about stop words
    hold for languages with a list only (all texts, if lang is None or null); words of all lists count, whatever the text's language.

    Null or empty text has no words, so base_failed; very long texts are read whole, by arrays within their row; rows of one id are judged each by itself;
    an empty table gives an empty table. Other columns are kept, save those that have a name of the counts, which replace them.
    No row is shuffled and no user function is called.
    """
    value = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    words, lines, hashes = F.col("words"), F.col("lines"), F.col("hashes")
    without = lambda chars, put="": reduce(lambda v, c: F.replace(v, F.lit(c), F.lit(put)), chars, value)
    listed = sorted({x for ws in stop_words.values() for w in ws for x in (w, w.capitalize())})
    counted = lambda xs, f: F.size(F.filter(xs, f)).cast("long")

    rows = docs.select(packed(docs).alias("row"))
    # a separator of one character spares the regular expression
    rows = rows.withColumn("words", F.array_remove(F.split(without(BLANKS[1:], " "), " ", -1), "")).withColumn("lines", F.filter(F.split(value, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    rows = rows.withColumn("hashes", F.transform(words, lambda w: F.xxhash64(w))).withColumn("windows", hashes)
    for step in window_hashes():
        rows = rows.withColumn("windows", step(F.col("windows")))
    counts = {
        "n_words": F.size(words).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "word_chars": F.length(without(BLANKS)).cast("long"),
        "n_symbols": (F.length(value) - F.length(without("#*$%&|<>"))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(F.col("windows")),
        "n_stop_words": counted(words, lambda w: w.isin(listed)),
        "n_echoed_words": counted(hashes, lambda h, i: (i > 0) & (F.get(hashes, i - 1) == h)),
        "n_bullet_lines": counted(lines, lambda x: F.btrim(x, F.lit(BLANKS)).rlike(r"^[-*•‣●]")),
        "n_cut_lines": counted(lines, lambda x: F.btrim(x, F.lit(BLANKS)).rlike(r"(\.\.\.|…)$")),
    }
    known = F.lit(True) if lang is None else F.col(f"row.`{lang}`").isNull() | F.col(f"row.`{lang}`").isin(list(stop_words))
    rows = rows.select("row", known.alias("known"), *[c.alias(name) for name, c in counts.items()])
    rows = rows.withColumn("base_failed", (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeated))
    broken = [F.when(~passes(r) & (F.col("known") if r.part == "n_stop_words" else F.lit(True)), F.lit(r.name)) for r in rules]
    rows = rows.withColumn("failed", F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>"))
    made = [*counts, "base_failed", "failed", "kept"]
    kept = reduce(lambda a, b: a & b, [~F.col("base_failed"), F.size("failed") == 0])
    return rows.withColumn("kept", kept).select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in made], *made)
