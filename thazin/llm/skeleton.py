"""Visually identical text (problem 3): a confusables skeleton.

The skeleton decomposes a text, replaces every character by the prototype of
its look-alike class, sorts the marks of each Myanmar cluster, and decomposes
again.  Two texts look the same exactly if their skeletons are equal.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thazin.kernels.text import MARK_RANK
from thazin.session import cut, mapped

# Letters of other scripts (Cyrillic, Greek, Coptic, Cherokee, Armenian, Lisu, Latin extensions) by the Latin letter they look like.
LATIN_LOOK = {
    "A": "АΑⲀᎪꓮ", "B": "ВΒⲂᏴꓐ", "C": "СϹⲤᏟꓚ", "D": "Ꭰꓓ", "E": "ЕΕⲈᎬꓰ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "НΗⲎᎻꓧ", "I": "ІΙⲒ", "J": "ЈͿᎫꓙ", "K": "КΚⲔᏦꓗ", "L": "ᏞⳐꓡ", "M": "МΜⲘᎷꓟ", "N": "ΝⲚꓠ", "O": "ОΟⲞՕꓳ", "P": "РΡⲢᏢꓑ", "Q": "Ԛ",
    "R": "Ꭱꓣ", "S": "ЅՏᏚꓢ", "T": "ТΤⲦᎢꓔ", "U": "Սꓴ", "V": "ѴᏙꓦ", "W": "ԜᎳꓪ", "X": "ХΧⲬꓫ", "Y": "ҮΥⲨꓬ", "Z": "ΖⲌᏃꓜ",
    "a": "аαɑ", "c": "сϲⲥᴄ", "d": "ԁ", "e": "е", "g": "ցɡ", "h": "һհ", "i": "іιı", "j": "јϳ", "k": "ᴋ", "l": "ӏӀꓲ", "n": "ո", "o": "оοօⲟᴏ", "p": "рρⲣ", "q": "ԛ", "s": "ѕꜱ", "u": "սυᴜ", "v": "νѵᴠ", "w": "ԝաᴡ", "x": "х", "y": "уү", "z": "ᴢ",
}
# Myanmar letters and digits, and punctuation, by what they look like.
OTHER_LOOK = {
    "ဝ": "၀", "ရ": "၇႐", "၎": "၄", "ဥ": "ဉ", "သြ": "ဩ", "သြော်": "ဪ",
    "-": "‐‑–−", "'": "’‘ʼ´‛", ":": "։꞉", ",": "‚",
}
# ASCII characters that look like others, or like several.
ASCII_LOOK = {"0": "O", "1": "l", "I": "l", "|": "l", "m": "rn"}
LOOK_ALIKES = {c: to for table in (LATIN_LOOK, OTHER_LOOK) for to, letters in table.items() for c in letters}
_INVISIBLE = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x3164, 0xFEFF, 0xFFA0, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10)]
_MARKS = re.compile("[" + "".join(MARK_RANK) + "]{2,}")


@lru_cache(1)
def prototypes() -> dict[int, str]:
    """The look-alike table by rule: widths, fonts, ligatures, numerals, small capitals and kinds of space from the character database, plus the fixed letters.

    Characters that ASCII ones look like keep their prototype, so the table
    may be used to clean text; :func:`skeleton` goes one step further.
    """
    table: dict[int, str] = {}
    for cp in (*range(0x80, 0x3400), *range(0xA490, 0xAC00), *range(0xF900, 0x12000), *range(0x16000, 0x17000), *range(0x1A000, 0x1FC00)):  # blocks with such characters
        c = chr(cp)
        kind = unicodedata.decomposition(c).partition("> ")[0]
        if kind in ("<wide", "<narrow", "<font") or kind == "<compat" and re.search(" (?:LIGATURE|NUMERAL) ", unicodedata.name(c)):
            table[cp] = unicodedata.normalize("NFKD", c)
        elif unicodedata.category(c) == "Zs":
            table[cp] = " "
        elif unicodedata.name(c, "").startswith("LATIN LETTER SMALL CAPITAL ") and len(unicodedata.name(c)) == 28:
            table[cp] = unicodedata.name(c)[-1]
    table |= {0x09: " "} | dict.fromkeys(_INVISIBLE, "")
    table |= {ord(a): unicodedata.normalize("NFD", b) for a, b in LOOK_ALIKES.items()}
    # a prototype may itself have one: follow it
    return {cp: "".join(table.get(ord(c), c) for c in to) for cp, to in table.items()}


_ASCII = str.maketrans(ASCII_LOOK)


def skeleton(text: str) -> str:
    """Decomposed, each character replaced by its prototype, marks of each cluster sorted, decomposed again."""
    s = unicodedata.normalize("NFD", text).translate(prototypes())
    s = _MARKS.sub(lambda m: "".join(sorted(m.group(), key=MARK_RANK.__getitem__)), s)
    return unicodedata.normalize("NFD", s.translate(_ASCII))


def skeleton_of(text: Column) -> Column:
    return mapped(skeleton, "string", text)


CLASS_ROWS = 1_000  # rows of a class that one task pairs with the others


def _forms(df: DataFrame, id_col: str, text_col: str, within: str | None = None) -> DataFrame:
    """(id, within, form, look): digests of each stored form and of its skeleton, each computed once and kept."""
    w = F.col(within) if within else F.lit(0)
    rows = df.select(F.col(id_col).alias("_id"), w.alias("_w"), F.col(text_col).alias("_t")).where("_id is not null and _w is not null and _t is not null")
    return cut(rows.select("_id", "_w", F.unhex(F.md5(F.col("_t"))).alias("_form"), F.unhex(F.md5(skeleton_of(F.col("_t")))).alias("_look")).distinct())


def same_look(df: DataFrame, id_col: str, text_col: str, within: str) -> DataFrame:
    """Pairs (id_a < id_b) of one ``within`` value whose texts differ but look the same.

    Rows with a null id, text or ``within`` take part in no pair; repeated
    rows of an id count once (an id with several texts counts with each).
    Empty and blank texts are compared like others.  Only digests are
    shuffled, and classes with one stored form are left out before the join,
    so plain copies never meet.  A large class is split over tasks: its rows
    are cut into parts, each paired with all of them.
    """
    forms = _forms(df, id_col, text_col, within)
    mixed = forms.groupBy("_w", "_look").agg(F.min("_form").alias("_lo"), F.max("_form").alias("_hi"), F.count(F.lit(1)).alias("_n")).where("_lo < _hi")
    kept = forms.join(mixed.select("_w", "_look", F.ceil(F.col("_n") / CLASS_ROWS).alias("_parts")), ["_w", "_look"])
    a = kept.select("_w", "_look", F.col("_id").alias("id_a"), F.col("_form").alias("_fa"), F.pmod(F.xxhash64("_id"), F.col("_parts")).alias("_part"))
    b = kept.select("_w", "_look", F.col("_id").alias("id_b"), F.col("_form").alias("_fb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"))
    return a.join(b, ["_w", "_look", "_part"]).where("id_a < id_b and _fa <> _fb").select("id_a", "id_b").distinct()


def classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, look, n_forms, n_links): each text's class of equal look, how many stored forms it has, and with how many other rows of another form the text looks the same."""
    rows = _forms(df, id_col, text_col)
    by_form = rows.groupBy("_look", "_form").agg(F.count(F.lit(1)).alias("_n"))
    size = by_form.groupBy("_look").agg(F.count(F.lit(1)).alias("n_forms"), F.sum("_n").alias("_all"))
    both = rows.join(by_form, ["_look", "_form"]).join(size, "_look")
    return both.select(F.col("_id").alias(id_col), F.lower(F.hex("_look")).alias("look"), "n_forms", (F.col("_all") - F.col("_n")).alias("n_links")).distinct()
