"""Text operators as Catalyst expressions: no Python in the path, so they stay inside code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from thazin.functions.zawgyi_rules import LEGACY_TO_STANDARD, STANDARD_TO_LEGACY
from thazin.kernels.text import INVISIBLE

_LEGACY = "[ၚၠ-႗]|္(?![က-အ])|(?:^|[^က-အျ-ှ])[ေျ]|ေေ|််"
_SPACE = "\\t-\\r\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"  # all white space, which the JVM class is not
_SYLLABLE_BREAK = "(?=(?<!္)[က-အ](?![်္])|[ဣ-ဪဿ၌-၏]|(?<![၀-၉])[၀-၉]|[၊။])"


def visible(text: Column) -> Column:
    return F.translate(text, INVISIBLE, "")


def normalized(text: Column) -> Column:
    """Invisible characters deleted and the composition (NFC) of Myanmar text.

    Exact for text whose other characters are composed already; general text
    goes through :func:`thazin.operators.text.normalized`.
    """
    t = F.replace(visible(text), F.lit("ဦ"), F.lit("ဦ"))
    return F.replace(t, F.lit("့်"), F.lit("့်"))


def is_legacy(text: Column) -> Column:
    """Whether a text shows legacy font order; false for empty text, null for null."""
    return text.rlike(_LEGACY)


def _cascade(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        java = "(?Ud)" + pattern
        text = F.regexp_replace(text, java, re.sub(r"\\(\d)", r"$\1", to.replace("$", "\\$")))
    return text


def legacy_to_standard(text: Column) -> Column:
    """The ordered rule cascade, as nested replacements."""
    return _cascade(text, LEGACY_TO_STANDARD)


def standard_to_legacy(text: Column) -> Column:
    return _cascade(text, STANDARD_TO_LEGACY)


def syllables(text: Column) -> Column:
    """Syllables, digit runs, stops and other pieces of normalized text; white space only separates."""
    runs = F.regexp_extract_all(text, F.lit(f"[က-႟]+|[^{_SPACE}က-႟]+"), 0)
    return F.filter(F.flatten(F.transform(runs, lambda r: F.when(r.rlike("^[က-႟]"), F.split(r, _SYLLABLE_BREAK)).otherwise(F.regexp_extract_all(r, F.lit("[!-/:-@\\[-`{-~‐-‟…«»]+|[^!-/:-@\\[-`{-~‐-‟…«»]+"), 0)))), lambda s: s != "")


def script_runs(text: Column) -> Column:
    """Runs of digits, punctuation, Myanmar, Latin or other characters, each with the white space before it."""
    digits, punct = "[0-9၀-၉႐-႙]+", "[\\p{P}]+"
    myanmar, latin = "[က-ဿ၌-ႏႚ-႟ꧠ-꧿ꩠ-ꩿ]+", "[A-Za-zÀ-ÖØ-öø-ɏ]+"
    pattern = "\\s*" + "|\\s*".join((digits, punct, myanmar, latin)) + "|\\s*[^\\s\\p{P}0-9A-Za-zÀ-ÖØ-öø-ɏက-႟ꧠ-꧿ꩠ-ꩿ]+|\\s+"
    runs = F.regexp_extract_all(text, F.lit("(?U)" + pattern), 0)
    kind = lambda r: (
        F.when(r.rlike("^(?U)\\s*" + digits), "digit").when(r.rlike("^(?U)\\s*" + punct), "punctuation").when(r.rlike("^(?U)\\s*" + myanmar), "myanmar").when(r.rlike("^(?U)\\s*" + latin), "latin").when(r.rlike("^(?U)\\s+$"), "whitespace").otherwise("other")
    )
    return F.transform(runs, lambda r: F.struct(kind(r).alias("script"), r.alias("text")))


def spans(parts: Column) -> Column:
    """Half-open character spans of strings that follow each other, from the start of the first."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("out"))
    step = lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.array_append(acc["out"], F.struct(acc["at"].alias("start"), (acc["at"] + F.length(p)).alias("end"))).alias("out"))
    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def placed_runs(text: Column) -> Column:
    """The script runs with their half-open spans."""
    runs = script_runs(text)
    places = spans(F.transform(runs, lambda r: r["text"]))
    return F.zip_with(runs, places, lambda r, p: F.struct(r["script"].alias("script"), r["text"].alias("text"), p["start"].alias("start"), p["end"].alias("end")))


def paragraphs(text: Column) -> Column:
    """Pieces between line breaks that aren't blank."""
    return F.filter(F.split(text, "\n+"), lambda p: F.trim(p) != "")


def rewrite_category(matched: Column, replacement: Column) -> Column:
    """length_change, reorder or substitution."""
    letters = lambda c: F.array_sort(F.split(c, ""))
    return F.when(F.length(matched) != F.length(replacement), "length_change").when((letters(matched) == letters(replacement)) & (matched != replacement), "reorder").otherwise("substitution")


def word_boundaries(words: Column) -> Column:
    """Ends of all words but the last, in characters from the start: one running sum."""
    sizes = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda w: F.length(w))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))
    return F.aggregate(sizes, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["ends"], acc["at"] + n).alias("ends")), lambda acc: F.array_distinct(acc["ends"]))


def looks_legacy(text: Column) -> Column:
    """The pattern-only hint that a text is in legacy font order."""
    return text.rlike("[ၚၠ-႗]|(?:^|[^က-အျ-ှ])[ေျ]|ေေ|််")


def stop_sentences(words: Column) -> Column:
    """The words of each sentence, where only end marks end one; words after the last are a sentence too."""
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"))
    ends = lambda w: F.coalesce((w == "။") | w.rlike("^[.!?…]+$"), F.lit(False))

    def step(acc: Column, w: Column) -> Column:
        now = F.array_append(acc["open"], w)
        return F.when(ends(w), F.struct(F.array_append(acc["done"], now).alias("done"), F.array().cast("array<string>").alias("open"))).otherwise(F.struct(acc["done"].alias("done"), now.alias("open")))

    return F.aggregate(words, start, step, lambda acc: F.when(F.size(acc["open"]) > 0, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]))
