"""Corpus statistics: boundary scores, disagreements, distributions, fertility, features, spelling."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thazin.functions import native
from thazin.kernels.lexicon import Lexicon
from thazin.kernels.spelling import distance
from thazin.operators import text
from thazin.session import cut, mapped


def _rates(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp and fn; 0 where nothing was counted."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _boundaries(col: str) -> Column:
    return F.coalesce(native.word_boundaries(F.col(col)), F.array().cast("array<int>"))


def boundary_scores(df: DataFrame, gold: str, hyp: str, by: str | None = None) -> DataFrame:
    """Micro precision, recall and F1 of word boundaries, per ``by``; 0 where nothing was counted.

    Both segmentations of a row are compared as sets in place, so only three
    counters a group are shuffled.  Null arrays count as empty.
    """
    rows = df.select(*([by] if by else []), _boundaries(gold).alias("_g"), _boundaries(hyp).alias("_h"))
    same = F.size(F.array_intersect("_g", "_h"))
    return _rates(rows.groupBy(*([by] if by else [])).agg(F.sum(same).alias("tp"), F.sum(F.size("_h") - same).alias("fp"), F.sum(F.size("_g") - same).alias("fn")))


def stratified_scores(df: DataFrame, id_col: str, gold: str, hyp: str, lexicon: DataFrame) -> DataFrame:
    """The scores for boundaries between known words and for those that touch an unknown one: rows ``known`` true and false.

    A boundary between two gold words is known if the lexicon (``word``) has
    both; one inside a gold word is what the word is.  Rows are told apart by
    ``id_col``; rows without a gold word are left out.
    """
    one = df.where(F.size(gold) > 0).select(F.col(id_col).alias("_id"), gold, hyp)
    w = one.select("_id", F.posexplode(gold).alias("_i", "word")).join(lexicon.select("word").distinct().withColumn("_in", F.lit(True)), "word", "left")
    along = Window.partitionBy("_id").orderBy("_i")
    iv = F.coalesce("_in", F.lit(False))
    ends = w.select("_id", F.sum(F.length("word")).over(along).alias("_p"), iv.alias("_iv"), F.lead(iv).over(along).alias("_next"))
    left = ends.select("_id", "_p", "_iv", "_next", F.col("_next").isNotNull().alias("_g"), F.lit(False).alias("_h"))
    right = one.select("_id", F.explode(_boundaries(hyp).cast("array<long>")).alias("_p"), F.lit(None).cast("boolean").alias("_iv"), F.lit(None).cast("boolean").alias("_next"), F.lit(False).alias("_g"), F.lit(True).alias("_h"))
    at = left.unionByName(right).groupBy("_id", "_p").agg(F.max("_iv").alias("_iv"), F.max("_next").alias("_next"), F.max("_g").alias("_g"), F.max("_h").alias("_h"))
    ahead = Window.partitionBy("_id").orderBy("_p").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    inside = F.first("_iv", ignorenulls=True).over(ahead)  # of the word that ends here or next
    known = F.coalesce(F.when(F.col("_g"), F.col("_iv") & F.col("_next")).otherwise(inside), F.lit(True))
    marked = at.select("_g", "_h", known.alias("known"))
    n = lambda c: F.sum(c.cast("long"))
    return _rates(marked.groupBy("known").agg(n(F.col("_g") & F.col("_h")).alias("tp"), n(~F.col("_g") & F.col("_h")).alias("fp"), n(F.col("_g") & ~F.col("_h")).alias("fn")))


def canonical_words(col: Column) -> Column:
    """Each word normalized and with its marks in order, so that boundaries of both sides count the same characters."""
    from thazin.kernels.text import canonical_order, normalize

    return mapped(lambda ws: [canonical_order(normalize(w or "")) for w in ws], "array<string>", col)


def disagreements(df: DataFrame, id_col: str, gold: str, plain: str, merged: str, context: int = 10) -> DataFrame:
    """Where merging words to units differs from the gold words: one row a boundary.

    ``merged_gold_split``: merging removed a boundary that gold has.
    ``split_gold_merged``: a boundary survived inside a gold word.  Each with
    its position, the text around it, and the gold span it lies in, with
    whether that holds punctuation.
    """
    rows = df.where(F.size(gold) > 0).select(F.col(id_col), F.array_join(gold, "").alias("_t"), _boundaries(gold).alias("_g"), _boundaries(plain).alias("_p"), _boundaries(merged).alias("_m"))
    first = F.transform(F.array_intersect(F.array_except("_p", "_m"), F.col("_g")), lambda x: F.struct(x.alias("position"), F.lit("merged_gold_split").alias("direction")))
    second = F.transform(F.array_except(F.array_intersect("_p", "_m"), F.col("_g")), lambda x: F.struct(x.alias("position"), F.lit("split_gold_merged").alias("direction")))
    flat = rows.select(id_col, "_t", "_g", F.explode(F.concat(first, second)).alias("d")).select(id_col, "_t", "_g", "d.*")
    p = F.col("position")
    lo = F.coalesce(F.array_max(F.filter("_g", lambda b: b <= p)), F.lit(0))
    hi = F.coalesce(F.array_min(F.filter("_g", lambda b: b >= p)), F.length("_t"))
    piece = lambda a, b: F.substring(F.col("_t"), a + 1, b - a)
    a, b = F.greatest(p - context, F.lit(0)), F.least(p + context, F.length("_t"))
    out = flat.withColumns({"span_start": lo, "span_end": hi, "context_start": a, "context_end": b})
    out = out.withColumn("span_text", F.concat(piece(a, p), F.lit("|"), piece(p, b))).withColumn("compound", piece(F.col("span_start"), F.col("span_end")))
    return out.withColumn("crosses_punctuation", F.col("compound").rlike("[\\p{P}၊။]")).drop("_t", "_g")


# Endings of regular derivations.
DERIVATIONS = ["မှု", "ရေး", "ခြင်း", "စရာ", "နိုင်", "ခွင့်"]


def categories(found: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Adds the category of a disagreement: date_number, productive_derivation, proper_noun (in ``names``.name) or genuine_compound."""
    if names is not None:
        found = found.join(names.select(F.col("name").alias("compound")).distinct().withColumn("_proper", F.lit(True)), "compound", "left")
    proper = F.coalesce("_proper", F.lit(False)) if names is not None else F.lit(False)
    kind = (
        F.when(F.col("crosses_punctuation") | F.col("compound").rlike("[0-9၀-၉]"), "date_number")
        .when(F.col("compound").rlike(f"(?:{'|'.join(DERIVATIONS)})$"), "productive_derivation").when(proper, "proper_noun").otherwise("genuine_compound")
    )
    return found.withColumn("category", kind).drop("_proper")


def numbered(df: DataFrame, *order: str, out: str = "n") -> DataFrame:
    """Rows with their number from 0 in the whole order, without bringing them into one task: sizes of the sorted parts are added up first."""
    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("size"), F.min("_in").alias("_least"))  # a row per task
    before = sizes.select("_part", "_least", (F.sum("size").over(Window.orderBy("_part")) - F.col("size")).alias("_before"))
    return parts.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.col("_in") - F.col("_least")).drop("_part", "_in", "_least", "_before")


def diverse_sample(found: DataFrame, id_col: str, order: list[str], n: int = 20) -> DataFrame:
    """At most n rows spread over all of them in order, one at most of each sentence."""
    rows = numbered(found, id_col, *order, out="_n")
    total = rows.count()
    step = max(1, total // (n * 20))
    picked = rows.where(F.col("_n") % step == 0)
    first = picked.groupBy(id_col).agg(F.min("_n").alias("_n"))
    return picked.join(first, [id_col, "_n"]).orderBy("_n").limit(n).drop("_n")


def differences(df: DataFrame, id_col: str, a: str, b: str, context: int = 8) -> DataFrame:
    """(id, position, only, context) of the boundaries that one of two segmentations of the same text has."""
    rows = df.select(F.col(id_col), F.array_join(F.coalesce(a, b), "").alias("_t"), _boundaries(a).alias("_a"), _boundaries(b).alias("_b"))
    side = lambda x, y, name: F.transform(F.array_except(x, y), lambda p: F.struct(p.alias("position"), F.lit(name).alias("only")))
    flat = rows.select(id_col, "_t", F.explode(F.concat(side("_a", "_b", "a"), side("_b", "_a", "b"))).alias("d")).select(id_col, "_t", "d.*")
    p = F.col("position")
    before, after = F.substring(F.col("_t"), F.greatest(p - context, F.lit(0)) + 1, F.least(p, F.lit(context))), F.substring(F.col("_t"), p + 1, F.lit(context))
    return flat.select(id_col, "position", "only", F.concat(before, F.lit("["), F.col("only"), F.lit("]"), after).alias("context"))


def aligned(gold: DataFrame, other: DataFrame, id_col: str, words: str) -> DataFrame:
    """Gold rows with the words of another segmentation as ``other``; ValueError unless each row has its counterpart of the same characters."""
    both = gold.join(other.select(id_col, F.col(words).alias("other")), id_col, "full")
    odd = both.where(F.col(words).isNull() | F.col("other").isNull() | (F.array_join(words, "") != F.array_join("other", "")))
    if not odd.isEmpty():
        raise ValueError("the segmentations aren't of the same sentences")
    return both


def collapse(df: DataFrame, words: str) -> DataFrame:
    """(raw, canonical, collapsed): how many different words there are, and how many once their marks are in order."""
    w = df.select(F.explode(words).alias("w")).where("w is not null").distinct()
    both = w.select("w", text.reordered(F.col("w")).alias("c"))
    return both.agg(F.count(F.lit(1)).alias("raw"), F.countDistinct("c").alias("canonical")).withColumn("collapsed", F.col("raw") - F.col("canonical"))


def distribution(df: DataFrame, value: str, by: str) -> DataFrame:
    """Count, mean, extremes, spread and linearly interpolated quantiles of a value; nulls are left out.

    Equal values are counted first; the distinct ones are range-partitioned
    and their counts added up part by part, so that no group is brought into
    one task.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("_k"), F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    parts = cut(counted.repartitionByRange("_k", "_v").withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_k", "_part").agg(F.sum("_n").alias("_s"))
    upto = sums.withColumn("_before", F.sum("_s").over(Window.partitionBy("_k").orderBy("_part")) - F.col("_s")).drop("_s")  # a row per group and part
    inside = Window.partitionBy("_k", "_part").orderBy("_v")
    ranked = parts.withColumn("_cum", F.sum("_n").over(inside)).alias("r").join(F.broadcast(upto.alias("u")), F.col("r._k").eqNullSafe(F.col("u._k")) & (F.col("r._part") == F.col("u._part")))
    ranked = ranked.select("r._k", "r._v", "r._n", (F.col("r._cum") + F.col("u._before")).alias("_end"))
    totals = parts.groupBy("_k").agg(F.sum("_n").alias("n"), (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean"), F.min("_v").alias("least"), F.max("_v").alias("most"))
    both = ranked.alias("a").join(F.broadcast(totals.alias("b")), F.col("a._k").eqNullSafe(F.col("b._k"))).select("a._k", "_v", "_n", "_end", "n", "mean", "least", "most")
    quantiles = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}

    def at(q: float) -> Column:
        k = (F.col("n") - 1) * q
        value_at = lambda rank: F.max(F.when((F.col("_end") > rank) & (F.col("_end") - F.col("_n") <= rank), F.col("_v")))
        lo, hi = value_at(F.floor(k)), value_at(F.least(F.floor(k) + 1, F.col("n") - 1))
        part = F.max(k - F.floor(k))
        return lo * (1 - part) + hi * part

    out = both.groupBy("_k").agg(F.max("n").alias("n"), F.max("mean").alias("mean"), F.max("least").alias("least"), *(at(q).alias(name) for name, q in quantiles.items()), F.max("most").alias("most"))
    return out.withColumnRenamed("_k", by).withColumn("spread", F.col("most") - F.col("least"))


def neighbour_features(df: DataFrame, id_col: str, items: str) -> DataFrame:
    """One row per item with its neighbours and place flags, for sequence labelling; in place, without a shuffle."""
    w, n = F.col(items), F.size(items)
    rows = F.transform(w, lambda x, i: F.struct(i.alias("position"), x.alias("item"), F.when(i > 0, F.get(w, i - 1)).alias("prev_item"), F.get(w, i + 1).alias("next_item"), (i == 0).alias("bos"), (i == n - 1).alias("eos")))
    return df.select(id_col, F.explode(rows).alias("f")).select(id_col, "f.*")


# Classes of Myanmar characters.
MEDIALS, VOWELS, TONES = "ျ-ှ", "ါ-ဲ", "့း"


def syllable_features(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per syllable of a text with its form, its neighbours and its first and last characters; what doesn't apply is null."""
    s = df.select(id_col, native.syllables(text.normalized(F.col(text_col))).alias("_s")).where("_s is not null")
    f = neighbour_features(s, id_col, "_s")
    x, n = F.col("item"), F.length("item")
    has = lambda chars: x.rlike(f"[{chars}]")
    return f.select(
        id_col, "position", x.alias("syllable"), n.alias("len"), F.substring(x, F.lit(1), F.lit(1)).alias("first_char"), F.substring(x, n, F.lit(1)).alias("last_char"),
        has(MEDIALS).alias("has_medial"), has(VOWELS).alias("has_vowel_sign"), has(TONES).alias("has_tone"), has("်").alias("has_asat"), has("ံ").alias("has_anusvara"), has("္").alias("has_stacked"),
        x.rlike("^[၀-၉]+$").alias("is_digit"), x.isin("၊", "။").alias("is_punctuation"), F.col("prev_item").alias("prev_syllable"), F.length("prev_item").alias("prev_len"), F.col("next_item").alias("next_syllable"), F.length("next_item").alias("next_len"), "bos", "eos",
        F.when(n >= 2, F.substring(x, F.lit(1), F.lit(2))).alias("bigram_first"), F.when(n >= 2, F.substring(x, n - 1, F.lit(2))).alias("bigram_last"), F.when(n >= 3, F.substring(x, F.lit(1), F.lit(3))).alias("trigram_first"),
    )


# ------------------------------------------------------------------ token fertility

Tokenizer = Callable[[str], int]
BACKENDS: dict[str, Tokenizer] = {"utf8_bytes": lambda t: len(t.encode("utf-8")), "code_points": len}


def measured(df: DataFrame, text_col: str, backends: Mapping[str, Tokenizer] | None = None, lexicon: Lexicon | None = None, canonicalize: bool = True) -> DataFrame:
    """Adds ``canonical``, ``denominators`` (bytes, chars, syllables, words), ``tokens`` by backend and ``runs`` with their own counts by script.

    A backend counts the tokens of a text.  Unless switched off, marks are put
    in order and invisible characters deleted first, as encodings of the same
    text would otherwise count differently.  Null text gives nulls.
    """
    backends = dict(BACKENDS if backends is None else backends)
    names = sorted(backends)

    def count(t: str) -> dict[str, int]:
        return {n: backends[n](t) for n in names}

    base = text.canonical_then_normalized(F.col(text_col)) if canonicalize else F.col(text_col)
    out = text.segmented(df.withColumn("canonical", base), "canonical", "_words", lexicon)
    sizes = F.struct(F.octet_length("canonical").alias("bytes"), F.length("canonical").alias("chars"), F.size(native.syllables(native.visible(F.col("canonical")))).alias("syllables"), F.size("_words").alias("words"))
    out = out.withColumn("denominators", F.when(F.col("canonical").isNotNull(), sizes)).withColumn("tokens", mapped(count, "map<string, int>", F.col("canonical"))).withColumn("_runs", native.script_runs(F.col("canonical")))
    per = mapped(lambda ts: [count(t) for t in ts], "array<map<string, int>>", F.transform("_runs", lambda r: r["text"]))
    runs = F.transform(F.arrays_zip(F.col("_runs").alias("r"), F.col("_per").alias("c")), lambda x: F.struct(x["r"]["script"].alias("script"), x["r"]["text"].alias("text"), x["c"].alias("tokens")))
    return out.withColumn("_per", per).withColumn("runs", runs).drop("_words", "_runs", "_per")


def ratios(df: DataFrame, backend: str) -> DataFrame:
    """Adds tokens per byte, char, syllable and word of a backend to measured rows; null where the denominator is 0."""
    n = F.col("tokens")[backend]
    d = F.col("denominators")
    return df.withColumns({f"tokens_per_{x[:-1]}": F.when(d[x] > 0, n / d[x]) for x in ("bytes", "chars", "syllables", "words")})


# ------------------------------------------------------------------ spelling


def known_words(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, canonical, known): whether the lexicon has a word under any order of its marks."""
    lex = lexicon.select(text.canonical(F.col("word")).alias("canonical")).where("canonical <> ''").distinct().withColumn("known", F.lit(True))
    ask = words.select("word").where("word is not null").distinct().withColumn("canonical", text.canonical(F.col("word")))
    return ask.join(lex, "canonical", "left").select("word", "canonical", F.coalesce("known", F.lit(False)).alias("known"))


def _shortened(word: Column) -> Column:
    """The strings that deleting one character of a word makes."""
    n = F.length(word)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))).otherwise(F.array().cast("array<string>"))


def spelling_suggestions(words: DataFrame, lexicon: DataFrame, k: int = 5) -> DataFrame:
    """(word, suggestions): up to k lexicon words in canonical order at one edit, or at two where there is none, by code point.

    An edit deletes, inserts, replaces or swaps neighbours, and a second one
    may touch what the first made.  Both sides are joined on what up to two
    deletions make of them, so no pairs beyond those that share one are
    formed, and the pairs are then measured.  Known and empty words get an
    empty array.  Expects columns ``word``; nulls are left out.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    asked = known_words(words, lexicon)
    lex = lexicon.select(text.canonical(F.col("word")).alias("w")).where("w <> ''").distinct()
    unknown = asked.where("not known and canonical <> ''").select(F.col("canonical").alias("w")).distinct()

    def keyed(df: DataFrame, name: str) -> DataFrame:
        one = df.withColumn("_1", F.array_distinct(_shortened(F.col("w"))))
        keys = F.array_distinct(F.concat(F.array("w"), F.col("_1"), F.flatten(F.transform("_1", _shortened))))
        return one.select(F.col("w").alias(name), F.explode(keys).alias("key"))

    pairs = keyed(unknown, "canonical").join(keyed(lex, "entry"), "key").select("canonical", "entry").distinct()
    near = pairs.withColumn("_d", mapped(distance, "int", F.col("canonical"), F.col("entry"))).where("_d <= 2")
    best = near.groupBy("canonical").agg(F.min("_d").alias("_d"))
    chosen = near.join(best, ["canonical", "_d"]).groupBy("canonical").agg(F.slice(F.sort_array(F.collect_set("entry")), 1, k).alias("s"))
    return asked.join(chosen, "canonical", "left").select("word", F.coalesce("s", F.array().cast("array<string>")).alias("suggestions"))


def corrected(df: DataFrame, words: str, lexicon: DataFrame, id_col: str, out: str = "corrected") -> DataFrame:
    """Adds words with each unknown one replaced by its first suggestion, where it has one; a row per id."""
    flat = df.select(id_col, F.posexplode(words).alias("_i", "word"))
    first = spelling_suggestions(flat.select("word"), lexicon, 1).select("word", F.get("suggestions", F.lit(0)).alias("_s"))
    fixed = flat.join(first, "word", "left").select(id_col, F.struct("_i", F.coalesce("_s", "word").alias("w")).alias("x"))
    lists = fixed.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["w"]).alias(out))
    return df.join(lists, id_col, "left")


def listed(df: DataFrame, entries: DataFrame, col: str) -> DataFrame:
    """The rows whose value is listed, with what the list says; several entries of one value give several rows.  The planner picks how to join by size."""
    return df.where(F.col(col).isNotNull()).join(entries, col)


# ------------------------------------------------------------------ reports


def frozen_vocabulary(df: DataFrame, words: str, path: str) -> bool:
    """Write the canonical vocabulary of a corpus once; False if it is there already."""
    if Path(path).exists():
        return False
    df.select(F.explode(words).alias("w")).where("w is not null").select(text.reordered(F.col("w")).alias("word")).distinct().write.parquet(path)
    return True


def log_run(path: str, **values) -> None:
    """Append one line of JSON with the time to a log of scored runs."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps({"unix_time": time.time(), **values}, ensure_ascii=False) + os.linesep)


def write_text(df: DataFrame, words: str, order: str, path: str) -> None:
    """The sentences as lines of text, in order."""
    df.orderBy(order).select(F.array_join(words, "").alias("value")).write.text(path)


def report(df: DataFrame, id_col: str, gold: str, hyp: str, lexicon: DataFrame) -> DataFrame:
    """(stratum, tp, fp, fn, precision, recall, f1) of all boundaries and of both strata."""
    whole = boundary_scores(df.where(F.size(gold) > 0), gold, hyp).select(F.lit("all").alias("stratum"), "tp", "fp", "fn", "precision", "recall", "f1")
    parts = stratified_scores(df, id_col, gold, hyp, lexicon).select(F.when(F.col("known"), "in_lexicon").otherwise("out_of_lexicon").alias("stratum"), "tp", "fp", "fn", "precision", "recall", "f1")
    return whole.unionByName(parts)
