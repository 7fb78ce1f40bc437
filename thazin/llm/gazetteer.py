"""Mapping freely entered values to a list of names (problem 1).

A symmetric-delete dictionary of the listed names answers lookups of bounded
edit distance: every name is filed under each string that at most two
deletions make of it, and a value meets it where one of its own deletions is
filed.  Candidates are then ranked by a weighted Damerau-Levenshtein distance
that is cheap for sounds and marks often confused, by agreement of the kind
of name, and by the frequency of the name in the data.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thazin.kernels.text import canonical_order, legacy_to_standard
from thazin.llm.skeleton import LOOK_ALIKES, prototypes
from thazin.session import built, cut, mapped, shared, spread

MAX_EDITS = 2
MAX_ENTRIES = 200_000  # the bound under which the list is broadcast; a longer one is joined on its deletions
MIN_STEM = 3  # letters of a stem that names are looked up by

# The kinds of names, with the words that end such names in Burmese, romanized and English.
KIND_WORDS = {
    "TOWN": ["မြို့", "myo", "town", "city"],
    "DISTRICT": ["ခရိုင်", "khayaing", "district"],
    "RIVER": ["မြစ်", "myit", "river"],
    "MOUNTAIN": ["တောင်", "taung", "mountain", "mount", "hill"],
    "UNIVERSITY": ["တက္ကသိုလ်", "ကောလိပ်", "tetkatho", "university", "college"],
    "PAGODA": ["ဘုရား", "စေတီ", "paya", "pagoda"],
    "ORGANIZATION": ["အဖွဲ့", "အသင်း", "ahpwe", "organization", "organisation", "association"],
}
# What may follow a name (case particles, diminutives, administrative additions) or precede it.
ENDINGS = ["မြို့နယ်", "တောင်တန်း", "နယ်", "တန်း", "လေး", "ကြီး", "ရုံး", "ဝ", "ကို", "မှ", "မှာ", "တွင်", "နှင့်", "နဲ့", "၏", "ရဲ့", "သို့", "က", "သည်", "၌", "တို့", "များ", "အား"]
PREFIXES = ["အဆိုပါ", "ဤ", "ထို", "ယင်း", "ဒီ", "the "]
# Romanization of onsets and rhymes.
ONSETS = {
    "က": "k", "ခ": "kh", "ဂ": "g", "ဃ": "gh", "င": "ng", "စ": "s", "ဆ": "hs", "ဇ": "z", "ဈ": "z", "ည": "ny", "ဉ": "ny", "တ": "t", "ထ": "ht", "ဒ": "d", "ဓ": "d", "န": "n", "ဏ": "n",
    "ပ": "p", "ဖ": "hp", "ဗ": "b", "ဘ": "bh", "မ": "m", "ယ": "y", "ရ": "r", "လ": "l", "ဝ": "w", "သ": "th", "ဟ": "h", "ဠ": "l", "အ": "",
    "ကျ": "ky", "ကြ": "ky", "ချ": "ch", "ခြ": "ch", "ဂျ": "gy", "ဂြ": "gy", "မှ": "hm", "လှ": "hl", "နှ": "hn", "ရှ": "sh", "မွှ": "hmw", "ရွှ": "shw", "လွှ": "hlw", "နွှ": "hnw",
}
RHYMES = {
    "က်": "et", "င့်": "int", "င်": "in", "င်း": "in", "ည်": "yi", "ည်း": "yi", "တ်": "at", "ပ်": "at", "န့်": "ant", "န်": "an", "န်း": "an", "ာ": "a", "ား": "ar", "ါ": "a", "ါး": "ar",
    "ိတ်": "eik", "ိန်": "ein", "ို": "o", "ိုး": "o", "ို့": "oh", "ိုက်": "aik", "ိုင်း": "aing", "ိုင်": "aing", "ီ": "i", "ီး": "i", "ုတ်": "ok", "ုံ": "on", "ုံး": "on", "ု": "u", "ူ": "u", "ူး": "oo",
    "ေ": "e", "ေး": "ay", "ော": "aw", "ော်": "aw", "ောက်": "auk", "ောင်": "aung", "ောင်း": "aung", "ဲ": "ei", "ဲ့": "ei", "ံ": "an", "ံ့": "am", "စ်": "it", "": "a",
}
# Letters often written for each other.
CONFUSED = ["ကခ", "ဂဃ", "စဆ", "တထ", "ဒဓ", "ပဖ", "ဗဘ", "နဏ", "လဠ", "ယရ", "သဆ", "ျြ", "ိီ", "ုူ", "ေဲ", "ဝ၀", "ညဉ"]
_CLOSE = {p for a in CONFUSED for p in ((a[0], a[1]), (a[1], a[0]))}
_LIGHT = set("့းံ်ုူိီှွောဲျြ")
_SYLLABLE = re.compile("([က-အဥဩ])([ျ-ှ]*)((?:[ါ-ဲံ-း်]|[က-အ](?=့?်))*)")
_MOJIBAKE = ("cp1252", "cp1251", "cp437", "mac_roman", "latin-1")


def romanize(name: str) -> str:
    """Names of plain syllables to Latin letters; other text is kept."""
    out, at = [], 0
    for m in _SYLLABLE.finditer(name):
        out.append(name[at : m.start()])
        base, medials, rhyme = m.groups()
        onset = ONSETS.get(base + medials)
        if onset is None:
            ha, rest = "ှ" in medials, medials.replace("ှ", "")
            onset = ("h" if ha else "") + ONSETS.get(base, base) + "".join({"ျ": "y", "ြ": "y", "ွ": "w"}[c] for c in rest)
        out.append(onset + RHYMES.get(rhyme, rhyme))
        at = m.end()
    return "".join(out) + name[at:]


def decoded(text: str) -> str:
    """Undo a UTF-8 text read in a one-byte encoding, if that gives Myanmar text."""
    if not re.search("[က-႟]", text) and re.search("[^\x00-\x7f]", text):
        for codec in _MOJIBAKE:
            try:
                s = text.encode(codec).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if re.search("[က-႟]", s):
                return s
    return text


def fold(text: str) -> str:
    """One stored form for what looks the same, lower case, without punctuation, marks of Latin letters and spaces."""
    s = unicodedata.normalize("NFKC", text).translate({k: v for k, v in prototypes().items() if v == "" or v == " "})
    if re.search("[A-Za-z]", s):
        s = "".join(LOOK_ALIKES.get(c, c) for c in s)
        s = "".join(c for c in unicodedata.normalize("NFD", s) if not "̀" <= c <= "ͯ")
    s = re.sub("[^\\w\\s့-ှါ-ဲ္်ံး]|[၊။_]", "", s).lower()
    s = re.sub("၀(?=[ါ-ှ])|(?<=[က-ှ])၀", "ဝ", s)
    s = re.sub("[ါ-ှ]{2,}", lambda m: re.sub("(.)\\1+", "\\1", m.group()), canonical_order(s))
    return re.sub("\\s+", " ", s).strip()


def forms(text: str) -> Iterator[str]:
    """The readings of a value: as it is, and with legacy font order undone."""
    text = decoded(text)
    first = fold(text)
    yield first
    if re.search("[က-႟]", text):
        other = fold(legacy_to_standard(text))
        if other != first:
            yield other


def stems(value: str) -> list[tuple[str, str | None]]:
    """(stem, kind) readings of a folded value: with and without prefix, endings and the word of a kind."""
    seen, out, queue = set(), [], [(value, 0)]
    while queue:
        s, cuts = queue.pop(0)
        s = s.strip()
        if s in seen or not s:
            continue
        seen.add(s)
        kind = None
        stem = s
        for k, words in KIND_WORDS.items():
            for w in words:
                t = s.replace(" ", "") if w[0] > "z" else s
                if t.endswith(w) and len(t) > len(w):
                    kind, stem = k, t[: -len(w)]
        out.append((stem.replace(" ", ""), kind))
        if cuts < 2:
            for e in ENDINGS:
                if s.endswith(e) and len(s) > len(e) + 2:
                    queue.append((s[: -len(e)], cuts + 1))
            for p in PREFIXES:
                if s.startswith(p) and len(s) > len(p) + 2:
                    queue.append((s[len(p) :], cuts + 1))
    return out


def weighted(a: str, b: str, limit: float) -> float:
    """Restricted Damerau-Levenshtein distance with weights; a value above limit may stand for any larger one."""

    def step(c: str) -> float:
        return 0.6 if c in _LIGHT else 1.0

    before, row = None, [0.0]
    for c in b:
        row.append(row[-1] + step(c))
    for i, x in enumerate(a, 1):
        now = [row[0] + step(x)]
        for j, y in enumerate(b, 1):
            cost = 0.0 if x == y else 0.4 if (x, y) in _CLOSE else 0.6 if x in _LIGHT and y in _LIGHT else 1.0
            best = min(row[j - 1] + cost, row[j] + step(x), now[j - 1] + step(y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 0.4)
            now.append(best)
        if min(now) > limit:
            return limit + 1
        before, row = row, now
    return row[-1]


def deletions(s: str, edits: int = MAX_EDITS) -> Iterable[str]:
    seen = {s}
    yield s
    for k in range(1, min(edits, len(s) - 1) + 1):
        for at in combinations(range(len(s)), len(s) - k):
            d = "".join([s[i] for i in at])
            if d not in seen:
                seen.add(d)
                yield d


def entry_keys(kind: str | None, name: str, latin: str | None) -> list[str]:
    """The stems under which an entry is filed: of its name, its romanization, and its given Latin form."""
    whole = fold(name)
    stem = next((t for t, k in stems(whole)[:1] if k == kind), whole.replace(" ", ""))
    keys = {stem, romanize(stem), romanize(name.removesuffix(KIND_WORDS.get(kind or "", [""])[0])).lower()}
    if latin and (read := stems(fold(latin))):
        keys.add(read[0][0])
    return sorted(k for k in keys if k)


def readings(value: str) -> list[tuple[int, str, str | None]]:
    """(rank, stem, kind) of all readings of a value, in the order in which they are tried."""
    return [(i, stem, kind) for i, (stem, kind) in enumerate(r for form in forms(value) for r in stems(form)) if len(stem) >= MIN_STEM]


def reach(stem: str) -> float:
    return min(MAX_EDITS, 0.17 * len(stem))


class Gazetteer:
    """The symmetric-delete dictionary over (entry id, kind, name, latin, frequency)."""

    def __init__(self, entries: Iterable[tuple[int, str | None, str | None, str | None, int]]):
        self.filed: dict[str, list[tuple[int, str]]] = {}
        self.kind: dict[int, str | None] = {}
        self.frequency: dict[int, int] = {}
        self.stem: dict[str, list[int]] = {}
        self.memo: dict[str, int] = {}
        for entry, kind, name, latin, frequency in entries:
            if not name or not name.strip():
                continue
            self.kind[entry], self.frequency[entry] = kind, frequency or 0
            for key in entry_keys(kind, name, latin):
                self.stem.setdefault(key, []).append(entry)
                for d in deletions(key):
                    self.filed.setdefault(d, []).append((entry, key))

    def lookup(self, value: str) -> int:
        """The entry meant, or -1."""
        known = self.memo.get(value)
        if known is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            known = self.memo[value] = self._lookup(value)
        return known

    def _lookup(self, value: str) -> int:
        read = readings(value)
        for _, stem, kind in read:  # without any edit nothing can rank higher
            same = [e for e in self.stem.get(stem, ()) if kind in (None, self.kind[e])]
            if same:
                return min(same, key=lambda e: (-self.frequency[e], e))
        best = None
        for _, stem, kind in read:
            limit = reach(stem)
            found = {x for d in deletions(stem) for x in self.filed.get(d, ())}
            for entry, key in found:
                distance = weighted(stem, key, limit)
                if distance <= limit:
                    rank = (distance + (0 if kind in (None, self.kind[entry]) else 0.5), -self.frequency[entry], entry)
                    best = rank if best is None or rank < best else best
        return -1 if best is None else best[2]


def _joined(values: DataFrame, listed: DataFrame) -> DataFrame:
    """(value, entry_id) by a join on deletions, for lists too long to send around; the same choice as the dictionary's."""
    key_type = "array<struct<key: string, dels: array<string>>>"
    keys = mapped(lambda name, kind, latin: [{"key": k, "dels": list(deletions(k))} for k in entry_keys(kind, name, latin)], key_type, F.col("name"), F.col("entity_type"), F.col("latin"))
    filed = listed.where("trim(name) <> ''").select("entry_id", F.col("entity_type").alias("ekind"), F.coalesce("f", F.lit(0)).alias("f"), F.explode(keys).alias("k")).select("entry_id", "ekind", "f", "k.key", "k.dels")
    read_type = "array<struct<rank: int, stem: string, kind: string, dels: array<string>>>"
    read = mapped(lambda v: [{"rank": i, "stem": t, "kind": k, "dels": list(deletions(t))} for i, t, k in readings(v)], read_type, F.col("value"))
    asked = values.select("value", F.explode(read).alias("r")).select("value", "r.rank", "r.stem", "r.kind", "r.dels")
    fits = F.col("kind").isNull() | (F.col("kind") == F.col("ekind"))
    exact = asked.join(filed, asked["stem"] == filed["key"]).where(fits)
    exact = exact.groupBy("value").agg(F.min(F.struct("rank", (-F.col("f")).alias("f"), "entry_id")).alias("x")).select("value", F.col("x.entry_id").alias("exact"))
    pairs = asked.withColumn("d", F.explode("dels")).drop("dels").join(filed.withColumn("d", F.explode("dels")).drop("dels"), "d").drop("d").distinct()
    near = pairs.withColumn("dist", mapped(lambda a, b: weighted(a, b, reach(a)), "double", F.col("stem"), F.col("key"))).where(F.col("dist") <= mapped(reach, "double", F.col("stem")))
    cost = F.col("dist") + F.when(fits, 0.0).otherwise(0.5)
    best = near.groupBy("value").agg(F.min(F.struct(cost.alias("c"), (-F.col("f")).alias("f"), "entry_id")).alias("x")).select("value", F.col("x.entry_id").alias("near"))
    return values.join(exact, "value", "left").join(best, "value", "left").select("value", F.coalesce("exact", "near", F.lit(-1)).cast("long").alias("entry_id"))


def match(df: DataFrame, entries: DataFrame, id_col: str, value_col: str, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """(rec_id, value, entry_id): one row for each record whose value is neither null nor blank nor a listed name.

    entry_id is -1 where no name is within reach.  Repeated rows of an id
    count once (by id and value).  Ties in distance go to the more frequent
    name in the data, then to the smaller id.  Each different value is looked
    up once, and what it means joined back to its records.  A list of at most
    ``max_entries`` rows, which is checked, is sent to the tasks; a longer one
    is joined on its deletions, with the same result.
    """
    spark = df.sparkSession
    listed = entries.select("entry_id", "entity_type", "name", "latin").where("name is not null")
    rows = df.select(F.col(id_col).cast("long").alias("rec_id"), F.col(value_col).alias("value")).where(F.col(value_col).isNotNull() & ~F.col(value_col).rlike("(?U)^\\s*$")).distinct()
    counts = cut(rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")))  # the different values
    is_small = listed.limit(max_entries + 1).count() <= max_entries
    hint = F.broadcast if is_small else lambda x: x
    names = listed.select(F.col("name").alias("value"), "entry_id").distinct()
    seen = counts.join(hint(names), "value").groupBy("entry_id").agg(F.sum("n").alias("f"))
    weighed = listed.join(seen, "entry_id", "left")
    values = counts.select("value").join(hint(names.select("value")), "value", "left_anti")
    if is_small:
        handle = shared(spark, sorted(tuple(r) for r in weighed.select("entry_id", "entity_type", "name", "latin", "f").collect()))

        def find(batches):
            g = built(handle, Gazetteer)
            for batch in batches:
                yield batch.map(g.lookup).astype("int64")

        meant = spread(values, "value").select("value", F.pandas_udf(find, "long", F.PandasUDFType.SCALAR_ITER)("value").alias("entry_id"))
    else:
        meant = _joined(values, weighed)
    return rows.join(meant, "value").select("rec_id", "value", "entry_id")
