"""Keyword-stuffed and link-list pages (problem 10).

A page is cut into pieces of comparable length.  For each piece a
rank-frequency curve is fitted with SQL windows, and its divergence from
prose of the same language is the mean log ratio of its tokens between prose
and lists.  All figures are compared with those of prose pieces of the same
language and about the same number of tokens.  A piece is list material if
its tokens together are too improbable as prose, or if its divergence and the
slope, level or residual of its curve are extreme among such pieces; a page
is found if most of its characters lie in list material.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thazin.llm.encoding import _SYLLABLES
from thazin.session import cut, spread

PIECE_TOKENS = 28
SEED_TOKENS = 10  # pieces below this teach nothing about prose and lists; they are judged like others
HEAD_SHARE = 0.15  # a word in this share of a language's documents is one of its common words
LANGUAGES = 200  # labels with prose of their own, the most frequent; the rest share that of "*"
TERM_SHARE = 1e-5  # terms rarer in all prose and lists of a script have no weight, so at most 1 / TERM_SHARE per group bring one
PROSE_MASS = 0.5  # share of common words in a piece that is clearly prose
CURVE_TOKENS = 8  # tokens from which a rank-frequency curve is fitted
EVIDENCE = 5.0  # log odds of lists against prose over a piece from which it is list material
FAR = 3.0  # standard deviations from prose of the language and length that are extreme
_TOKENS = re.compile(
    r"(?P<url>(?:https?://|www\.)\S+|\b[\w-]+\.[a-z]{2,9}/\S*|\b[\w-]+\.(?:test|invalid|example|com|net|org|info|biz|shop|store)\b\S*)"
    r"|(?P<tag>#\w[\wါ-ှၖ-ၙ]*)|(?P<code>\b[A-Za-z]{1,4}-?\d{2,}\w*)|(?P<num>\d+(?:[.,]\d+)*)|(?P<my>[က-ဿၐ-႟]+)"
    r"|(?P<w>[^\W\d_က-႟]+(?:['’][^\W\d_]+)?)|(?P<end>[.!?။…。！？]+(?=\s|$)|[။。！？])|(?P<p>[^\w\s])"
)
_SPECIAL = {"<url>", "<tag>", "<code>"}


def tokens(text: str) -> list[tuple[str, int]]:
    """(token, start): words in lower case, syllables of Myanmar script, classes of links, tags, codes and numbers, and punctuation."""
    out = []
    for m in _TOKENS.finditer(text):
        kind = m.lastgroup
        if kind == "my":
            out += [(s, m.start()) for s in _SYLLABLES.findall(m.group())]
        elif kind == "w":
            out.append((m.group().lower(), m.start()))
        else:
            out.append((m.group() if kind == "p" else f"<{kind}>", m.start()))
    return out


def pieces(text: str) -> list[tuple[list[str], int]]:
    """(tokens, characters) of pieces of about PIECE_TOKENS tokens that cover the text."""
    t = tokens(text)
    if not t:
        return []
    size = math.ceil(len(t) / max(1, round(len(t) / PIECE_TOKENS)))
    starts = [0, *(t[i][1] for i in range(size, len(t), size)), len(text)]
    return [([w for w, _ in t[k * size : (k + 1) * size]], starts[k + 1] - starts[k]) for k in range(len(starts) - 1)]


def _burmese(words: list[str]) -> bool:
    my = sum("က" <= w[0] <= "႟" for w in words)
    return my > 0.5 * sum(w[0].isalpha() and not "က" <= w[0] <= "႟" for w in words) and my > 0


class Prose:
    """Common words and log ratios per language, for scoring pieces."""

    def __init__(self, head: dict[str, set[str]], weights: dict[str, dict[str, float]] | None = None):
        self.head, self.weights = head, weights or {}
        self.burmese = {lang: sum(_burmese([w]) for w in words) * 2 > len(words) for lang, words in head.items()}

    def languages(self, words: list[str]) -> list[str]:
        my = _burmese(words)
        return [x for x, b in self.burmese.items() if b == my] or list(self.burmese)

    def mass(self, words: list[str]) -> tuple[str | None, float]:
        """The language whose common words cover most of a piece, and how much of it."""
        real = [w for w in words if w[0].isalpha() or w in _SPECIAL]
        best = max(((sum(w in self.head[x] for w in real), x) for x in self.languages(words)), default=(0, None))
        return best[1], best[0] / max(1, len(real))

    def score(self, words: list[str]) -> tuple[str | None, float]:
        best = max(((sum(self.weights.get(x, {}).get(w, 0.0) for w in words), x) for x in self.languages(words)), default=(0.0, None))
        return best[1], best[0] / max(1, len(words))


def _paired(df: DataFrame, burmese: list[tuple[str, bool]], share: float) -> dict[tuple[str, str], int]:
    """Counts (group, token) -> n of prose and lists: all of a token that reaches the share in either group of a script, so that none is read as 0.

    At most 1 / share tokens a group reach it; the other groups of the script hold no more of those.
    """
    script = {f"-{my}": str(my) for my in (True, False)} | {f"+{x}": str(my) for x, my in burmese}
    name = F.create_map(*(F.lit(v) for kv in script.items() for v in kv))
    seen = df.withColumn("script", F.coalesce(name[F.col("g")], F.lit("")))
    chosen = seen.where(F.col("n") >= F.col("all") * share).select("script", "token").distinct()
    return {(r[0], r[1]): r[2] for r in seen.join(chosen, ["script", "token"], "left_semi").select("g", "token", "n").toLocalIterator()}


def _summed(df: DataFrame, columns: list[str], count) -> DataFrame:
    """(g, token, n): counters per task, summed by key; kept, as callers read them several times."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            for row in zip(*(batch[c] for c in columns)):
                held.update(count(*row))
            if len(held) > 200_000:
                yield pd.DataFrame([(g, t, n) for (g, t), n in held.items()], columns=["g", "token", "n"])
                held = Counter()
        if held:
            yield pd.DataFrame([(g, t, n) for (g, t), n in held.items()], columns=["g", "token", "n"])

    return cut(df.select(*columns).mapInPandas(run, "g string, token string, n long").groupBy("g", "token").agg(F.sum("n").alias("n")))


def _words(text: Column) -> Column:
    """The different words, in lower case, and syllables of Myanmar script, without leaving the JVM."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{Nl}\\p{No}&&[^က-႟]]+(?:['’][\\p{L}\\p{Nl}\\p{No}]+)?"), 0)
    runs = F.regexp_extract_all(text, F.lit("[က-ဿၐ-႟]+"), 0)
    return F.array_distinct(F.concat(words, F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(_SYLLABLES.pattern), 0)))))


def heads(src: DataFrame) -> dict[str, set[str]]:
    """The common words by label, over all documents: at most 1 / HEAD_SHARE times the words of a document for each of LANGUAGES + 1 labels."""
    labelled = src.where("_l is not null")
    docs = cut(labelled.groupBy(F.col("_l").alias("g")).agg(F.count(F.lit(1)).alias("all")))
    top = docs.orderBy(F.col("all").desc(), "g").limit(LANGUAGES).select("g", F.col("g").alias("own"))
    owned = lambda df: df.join(F.broadcast(top), "g", "left").withColumn("g", F.coalesce("own", F.lit("*")))
    size = owned(docs).groupBy("g").agg(F.sum("all").alias("all"))
    seen = labelled.select(F.col("_l").alias("g"), F.explode(_words(F.col("_t"))).alias("token")).groupBy("g", "token").agg(F.count(F.lit(1)).alias("n"))
    common = owned(seen).groupBy("g", "token").agg(F.sum("n").alias("n")).join(F.broadcast(size), "g").where(F.col("n") >= F.col("all") * HEAD_SHARE)
    out: dict[str, set[str]] = defaultdict(set)
    for g, token in common.select("g", "token").toLocalIterator():
        out[g].add(token)
    return out


def fitted(df: DataFrame, text_col: str, lang_col: str) -> Prose:
    """Common words by labelled language, then log ratios between pieces that are clearly prose and clearly lists; over all rows."""
    src = df.select(F.col(text_col).alias("_t"), F.col(lang_col).alias("_l")).where("_t is not null and _t <> ''")
    head = heads(src)
    first = Prose(dict(head))
    by_script = {b: [x for x in first.burmese if first.burmese[x] == b] for b in (True, False)}
    shared = df.sparkSession.sparkContext.broadcast((first, by_script))

    def in_pieces(text: str):
        prose, scripts = shared.value
        out = []
        for words, _ in pieces(text):
            if len(words) < SEED_TOKENS:
                continue
            lang, mass = prose.mass(words)
            ends, my = words.count("<end>"), _burmese(words)
            special = sum(w in _SPECIAL for w in words) / len(words)
            if mass >= PROSE_MASS and ends:
                out += [(f"+{lang}", w) for w in words]
            elif not ends and (mass <= 0.35 or my and len(words) >= 20) or special >= 0.3:
                out += [(f"-{my}", w) for w in words]
        return out

    df2 = _summed(src, ["_t"], in_pieces)
    sums = df2.groupBy("g").agg(F.sum("n").alias("all"))
    size = {r[0]: r[1] for r in sums.collect()}  # two rows per language at most
    counts = _paired(df2.join(F.broadcast(sums), "g"), list(first.burmese.items()), TERM_SHARE)
    by_group: dict[str, dict[str, int]] = defaultdict(dict)
    for (g, w), n in counts.items():
        by_group[g][w] = n
    weights: dict[str, dict[str, float]] = {}
    for my, langs in by_script.items():
        lists, n_lists = by_group.get(f"-{my}", {}), size.get(f"-{my}", 0)
        for x in langs:
            prose, n_prose = by_group.get(f"+{x}", {}), size.get(f"+{x}", 0)
            ratio = lambda w: math.log((prose.get(w, 0) + 2) / (n_prose + 2000)) - math.log((lists.get(w, 0) + 2) / (n_lists + 2000))
            weights[x] = {w: max(-3.0, min(3.0, ratio(w))) for w in {*prose, *lists} if prose.get(w, 0) + lists.get(w, 0) >= 5}
    return Prose(dict(head), weights)


def measured(df: DataFrame, id_col: str, text_col: str, lang_col: str, prose: Prose | None = None) -> DataFrame:
    """One row per piece of each document: (id, piece, chars, n, lang, prose, divergence, slope, level, residual); prose is true where common words and sentence ends tell so."""
    prose = prose or fitted(df, text_col, lang_col)
    shared = df.sparkSession.sparkContext.broadcast(prose)

    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = shared.value
        for texts in batches:
            out = []
            for t in texts:
                rows = []
                for words, chars in pieces(t):
                    lang, score = p.score(words)
                    spectrum = Counter(Counter(w for w in words if w != "<end>" and (w[0].isalnum() or w[0] == "<")).values())
                    plain = "<end>" in words and p.mass(words)[1] >= PROSE_MASS
                    rows.append({"chars": chars, "n": len(words), "lang": lang, "prose": plain, "divergence": score, "spectrum": [{"f": f, "c": c} for f, c in spectrum.items()]})
                out.append(rows)
            yield pd.Series(out, dtype=object)

    kind = "array<struct<chars: int, n: int, lang: string, prose: boolean, divergence: double, spectrum: array<struct<f: int, c: int>>>>"
    rows = spread(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where("_id is not null and _t is not null and _t <> ''"), "_id", "_t").distinct()
    parts = rows.select("_id", F.pandas_udf(measure, kind, F.PandasUDFType.SCALAR_ITER).asNondeterministic()("_t").alias("p")).select("_id", F.posexplode("p").alias("piece", "p"))
    flat = parts.select("_id", "piece", "p.chars", "p.n", "p.lang", "p.prose", "p.divergence", F.explode_outer("p.spectrum").alias("s"))
    key = ["_id", "piece"]
    down = Window.partitionBy(*key).orderBy(F.col("s.f").desc())
    # the rank at the end of each frequency: the curve has few points however many terms share a frequency
    ranked = flat.withColumn("x", F.log(F.sum("s.c").over(down))).withColumn("y", F.log("s.f"))
    curve = ranked.groupBy(*key).agg(
        *(F.first(c).alias(c) for c in ("chars", "n", "lang", "prose", "divergence")),
        F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("slope"),
        F.coalesce(F.max("y"), F.lit(0.0)).alias("level"),
        F.sqrt(F.greatest(F.coalesce(F.regr_syy("y", "x") - F.coalesce(F.regr_slope("y", "x") * F.regr_sxy("y", "x"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)) / F.greatest(F.count("y"), F.lit(1))).alias("residual"),
    )
    return curve.withColumnRenamed("_id", id_col)


FIGURES = {"divergence": 0.15, "slope": 0.15, "level": 0.25, "residual": 0.1}  # with the least standard deviation each is taken to have


def judged(m: DataFrame) -> DataFrame:
    """Adds to pieces ``improbable`` (by their tokens together) and ``extreme`` (by divergence and curve, among prose of the language and length).

    Lengths are compared in bands that double.  A piece of fewer than
    CURVE_TOKENS tokens has no curve worth fitting and is judged by its tokens
    only, as is one without prose of its language in its band.
    """
    m = m.withColumn("band", F.least(F.floor(F.log2(F.greatest(F.col("n"), F.lit(1)))), F.lit(6)))
    usual = m.where("prose").groupBy("lang", "band").agg(*(f(c).alias(f"{p}_{c}") for c in FIGURES for p, f in (("m", F.avg), ("s", F.stddev_pop))))
    m = m.join(F.broadcast(usual), ["lang", "band"], "left")  # a row per language and band
    z = {c: (F.col(c) - F.col(f"m_{c}")) / F.greatest(F.col(f"s_{c}"), F.lit(least)) for c, least in FIGURES.items()}
    curve = (F.col("n") >= CURVE_TOKENS) & ((z["slope"] < -FAR) | (z["level"] > FAR) | (z["residual"] > FAR))
    return m.withColumn("improbable", F.col("divergence") * F.col("n") < -EVIDENCE).withColumn("extreme", F.coalesce((z["divergence"] < -FAR) & curve, F.lit(False)))


def stuffed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", prose: Prose | None = None) -> DataFrame:
    """(id, list_share) of the documents most of whose characters are list material.

    Null and empty texts are never found; rows with a null id are left out.
    The language is that of the closest prose, whatever the label says.  An id
    with several texts counts as one document of all of them.
    """
    m = judged(cut(measured(df, id_col, text_col, lang_col, prose)))  # a few numbers a piece, read twice
    bad = F.col("improbable") | F.col("extreme")
    share = m.groupBy(id_col).agg((F.sum(F.when(bad, F.col("chars")).otherwise(0)) / F.sum("chars")).alias("list_share"))
    return share.where("list_share > 0.5")
