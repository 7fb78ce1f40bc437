"""Languages of documents and their segments (problem 2): prediction by partial matching.

Each language has a tree of byte contexts of variable order with escape
probabilities (method C), frozen after training on labelled sentences.  The
trees of all languages are merged into sorted tables of byte n-grams that
hold one exact code length per language, so a text is scored against all of
them at once, in vector operations.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thazin.llm import encoding
from thazin.session import built, mapped, shared, spread

ORDER = 5
MAX_SAMPLES = 20_000  # labelled rows to train on; all of them below this bound
# Other spellings, codes and names of the languages.
NAMES = {
    "my": "my mya bur burmese myanmar myanma မြန်မာ birmanisch birman birmano",
    "shn": "shn shan လိၵ်ႈတႆး တႆး tai-yai",
    "mnw": "mnw mon မန် raman",
    "ksw": "ksw kar karen s'gaw-karen sgaw-karen sgaw s'gaw ကညီ",
    "en": "en eng english englisch anglais inglés ingles",
    "fr": "fr fra fre french français francais französisch francés",
    "th": "th tha thai ไทย thailändisch siamese",
    "de": "de deu ger german deutsch allemand alemán aleman",
    "es": "es spa spanish español espanol castellano castilian spanisch espagnol",
    "und": "und zxx undetermined",
}
_OF_NAME = {w: code for code, words in NAMES.items() for w in words.split()}


def label_code(label: str | None) -> str | None:
    """The code a label names, in any spelling, code or region; None if it names none of the known ones."""
    if label is None:
        return None
    s = re.sub("[’ʼ`]", "'", label.strip().lower())
    for part in (re.sub("\\s+", "-", s), re.split("[-_ @.]", s)[0]):
        if part in _OF_NAME:
            return _OF_NAME[part]
    return None


class Ppm:
    """Frozen context trees of several languages as tables of byte n-grams."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER):
        self.languages = sorted(samples)
        self.order = order
        n_lang = len(self.languages)
        counts: list[dict[bytes, np.ndarray]] = [defaultdict(lambda: np.zeros(n_lang)) for _ in range(order + 2)]  # by n-gram length
        for k, lang in enumerate(self.languages):
            c = Counter()
            for text in samples[lang]:
                data = b"\n" * order + prepared(text) + b"\n"
                for i in range(order, len(data)):
                    for size in range(1, order + 2):
                        c[data[i - size + 1 : i + 1]] += 1
            for gram, n in c.items():
                counts[len(gram)][gram][k] = n
        total: dict[bytes, np.ndarray] = defaultdict(lambda: np.zeros(n_lang))  # by context
        kinds: dict[bytes, np.ndarray] = defaultdict(lambda: np.zeros(n_lang))
        for size in range(1, order + 2):
            for gram, n in counts[size].items():
                total[gram[:-1]] += n
                kinds[gram[:-1]] += n > 0
        escape: dict[bytes, np.ndarray] = {}
        for ctx, t in total.items():
            with np.errstate(divide="ignore", invalid="ignore"):
                escape[ctx] = np.where(t > 0, -np.log2(kinds[ctx] / (t + kinds[ctx])), 0.0)
        self.unseen = escape[b""] + 8.0  # a byte no tree has: uniform below order 0
        symbol: list[dict[bytes, np.ndarray]] = [{} for _ in range(order + 2)]
        for size in range(1, order + 2):
            for gram, n in counts[size].items():
                ctx = gram[:-1]
                lower = self.unseen - escape[b""] if size == 1 else symbol[size - 1][gram[1:]]
                with np.errstate(divide="ignore"):
                    own = -np.log2(n / (total[ctx] + kinds[ctx] + (total[ctx] == 0)))
                symbol[size][gram] = np.where(n > 0, own, escape[ctx] + lower)
        climbed: dict[bytes, np.ndarray] = {b"": np.zeros(n_lang)}  # escapes from a context down to order 0
        for size in range(1, order + 1):
            for ctx in [c for c in escape if len(c) == size]:
                climbed[ctx] = climbed.get(ctx[1:], np.zeros(n_lang)) + escape[ctx]
        self.gram_keys, self.gram_cost, self.gram_climb = [], [], []
        self.ctx_keys, self.ctx_climb = [], []
        for size in range(1, order + 2):
            grams = sorted(symbol[size], key=lambda g: int.from_bytes(g, "big"))
            self.gram_keys.append(np.array([int.from_bytes(g, "big") for g in grams], dtype=np.uint64))
            self.gram_cost.append(np.array([symbol[size][g] for g in grams], dtype=np.float32))
            self.gram_climb.append(np.array([climbed.get(g[:-1], climbed[b""]) for g in grams], dtype=np.float32))
            if size <= order:
                ctxs = sorted((c for c in climbed if len(c) == size), key=lambda g: int.from_bytes(g, "big"))
                self.ctx_keys.append(np.array([int.from_bytes(c, "big") for c in ctxs], dtype=np.uint64))
                self.ctx_climb.append(np.array([climbed[c] for c in ctxs], dtype=np.float32))

    def bits(self, segments: list[str], block: int = 150_000) -> np.ndarray:
        """Exact code lengths: a row per segment, a column per language."""
        out, at = np.zeros((len(segments), len(self.languages))), 0
        coded = [prepared(s) for s in segments]
        while at < len(coded):
            end, size = at, 0
            while end < len(coded) and (end == at or size + len(coded[end]) < block):
                size += len(coded[end]) + self.order
                end += 1
            out[at:end] = self._bits(coded[at:end])
            at = end
        return out

    def _bits(self, coded: list[bytes]) -> np.ndarray:
        pad = b"\n" * self.order
        data = np.frombuffer(b"".join(pad + c for c in coded) or b"\n", dtype=np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(len(coded)), [len(c) + self.order for c in coded])
        real = np.concatenate([np.r_[np.zeros(self.order, bool), np.ones(len(c), bool)] for c in coded]) if coded else np.zeros(0, bool)
        pos = np.flatnonzero(real)
        if not len(pos):
            return np.zeros((len(coded), len(self.languages)))
        cost = np.empty((len(pos), len(self.languages)), dtype=np.float32)
        cost[:] = self.unseen
        climb = np.zeros_like(cost)
        keys, key = [], np.zeros(len(data), dtype=np.uint64)
        for size in range(1, self.order + 2):
            key = key.copy()
            shifted = np.zeros_like(data)
            shifted[size - 1 :] = data[: len(data) - size + 1]
            key += shifted << np.uint64(8 * (size - 1))
            keys.append(key)
        left = np.arange(len(pos))
        for size in range(self.order + 1, 0, -1):
            table = self.gram_keys[size - 1]
            k = keys[size - 1][pos[left]]
            i = np.minimum(np.searchsorted(table, k), len(table) - 1)
            hit = table[i] == k
            cost[left[hit]] = self.gram_cost[size - 1][i[hit]]
            climb[left[hit]] = -self.gram_climb[size - 1][i[hit]]
            left = left[~hit]
        left = np.arange(len(pos))
        for size in range(self.order, 0, -1):
            table = self.ctx_keys[size - 1]
            k = keys[size - 1][pos[left] - 1]
            i = np.minimum(np.searchsorted(table, k), len(table) - 1)
            hit = table[i] == k
            climb[left[hit]] += self.ctx_climb[size - 1][i[hit]]
            left = left[~hit]
        total = np.zeros((len(coded), len(self.languages)))
        per = cost + climb
        for k in range(total.shape[1]):
            total[:, k] = np.bincount(owner[pos], per[:, k], len(coded))
        return total


def prepared(text: str) -> bytes:
    return re.sub("[\\d၀-၉\\s]+", " ", text.lower()).strip().encode("utf-8", "replace")


_PIECE = re.compile("[^။.!?…。\\n/|]*[။.!?…。\\n/|]*")
_SCRIPTS = re.compile("([က-႟ꧠ-꧿ꩠ-ꩿ]+)|([฀-๿]+)|([^\\W\\d_က-႟฀-๿]+)")
_LETTER = re.compile("[^\\W\\d_]")


_BRACKETS = re.compile("\\(([^()]*)\\)|\\[([^\\[\\]]*)\\]")


def segments(text: str) -> list[str]:
    """Pieces of one script between end marks, in text order; what stands in brackets makes pieces of its own."""
    found: list[tuple[int, str]] = []
    for m in _BRACKETS.finditer(text):
        found += [(m.start() + at, s) for at, s in _pieces(m.group()[1:-1])]
    outside = _BRACKETS.sub(lambda m: " " * len(m.group()), text) if found else text
    found += _pieces(outside)
    return [s for _, s in sorted(found, key=lambda x: x[0])]


def _pieces(text: str) -> list[tuple[int, str]]:
    """(start, piece) between end marks and changes of script; pieces without a letter are none."""
    out = []
    for m in _PIECE.finditer(text):
        piece, base, start, script = m.group(), m.start(), 0, None
        for r in _SCRIPTS.finditer(piece):
            kind = r.lastindex
            if script is not None and kind != script:
                out.append((base + start, piece[start : r.start()]))
                start = r.start()
            script = kind
        if script is not None:
            out.append((base + start, piece[start:]))
    return [(at, s.strip()) for at, s in out if _LETTER.search(s)]


MIN_LETTERS, MIN_WORDS = 9, 4  # what a piece must hold to be a sentence rather than a name; of words only in scripts with spaces


def weight(segment: str) -> int:
    """Letters and marks of a segment that may be a sentence of its own; 0 for names and titles.

    Weightless segments are scored and named like others; they only don't make
    a text mixed, and decide its language where nothing else is there.
    """
    letters = sum(c.isalpha() or "ါ" <= c <= "ှ" or "ၖ" <= c <= "႙" or "ั" <= c <= "๎" for c in segment)
    if letters < MIN_LETTERS:
        return 0
    if not re.search("[က-႟฀-๿]", segment):
        words = re.findall("[^\\W\\d_]+", segment)
        if len(words) < MIN_WORDS or all(w[0].isupper() for w in words):
            return 0
    return letters


MARGIN = 10.0  # bits by which a segment must differ from the language of the whole


def decide(parts: list[str], bits: np.ndarray, languages: list[str]) -> tuple[list[tuple[str, str, float]], list[tuple[str, float]]]:
    """([(segment, language, confidence)], [(language of the text, confidence)]), the main language first."""

    def conf(row: np.ndarray) -> float:
        gap = np.minimum(row - row.min(), 60.0)
        return float(1.0 / np.exp2(-gap).sum())

    heavy = [weight(p) > 0 for p in parts]
    use = [i for i, h in enumerate(heavy) if h] or list(range(len(parts)))
    whole = bits[use].sum(axis=0)
    best = [int(bits[i].argmin()) for i in range(len(parts))]
    # the main language is the one with the most text among the segments' own
    votes = defaultdict(float)
    for i in use:
        votes[best[i]] += len(parts[i])
    main = max(votes, key=lambda k: (votes[k], -whole[k]))
    found, named = {main: conf(whole) if len(votes) == 1 else 0.0}, []
    for i, p in enumerate(parts):
        k = best[i] if heavy[i] and bits[i][main] - bits[i].min() >= MARGIN else main
        c = conf(bits[i])
        named.append((p, languages[k], c if k == best[i] else 1.0 - c))
        if heavy[i] or not any(heavy):
            found[k] = max(found.get(k, 0.0), c if k == best[i] else 0.0)
    return named, [(languages[k], c) for k, c in found.items()]


def identify(df: DataFrame, samples: DataFrame, id_col: str, text_col: str, label_col: str | None = None, model_columns: tuple[str, ...] | None = None, max_samples: int = MAX_SAMPLES, model=None) -> DataFrame:
    """(id, label, languages array<struct<lang, confidence>>, segments array<struct<text, lang, confidence>>) for each text neither null nor blank.

    Garbled text is restored first, so it has the language of its original.  A
    text without any letter is ``und`` with confidence 1.  Repeated rows count
    once.  The trees are trained on at most max_samples rows of ``samples``
    (lang, text), taken in order of a hash; rows without a label or text are
    left out.  Without any sample every text is ``und``, with confidence 0 if it
    has letters.  Equal code lengths go to the language first in the alphabet.
    """
    spark = df.sparkSession
    rows = samples.select(F.col("lang").alias("l"), F.col("text").alias("t")).where("l is not null and t is not null and trim(t) <> ''").orderBy(F.xxhash64("l", "t"), "l", "t").limit(max_samples).collect()
    by_lang: dict[str, list[str]] = defaultdict(list)
    for r in rows:
        by_lang[label_code(r["l"]) or r["l"]].append(r["t"])
    trees = spark.sparkContext.broadcast(Ppm(dict(by_lang)) if by_lang else None)  # its size is bounded by max_samples
    if model is None:
        model = shared(spark, encoding.corpus_model(df, model_columns or (text_col,)))
    label = F.col(label_col) if label_col else F.lit(None).cast("string")
    src = df.select(F.col(id_col).alias("_id"), label.alias("_label"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull() & ~F.col("_text").rlike("(?U)^\\s*$"))
    src = spread(src, "_id", "_label", "_text").distinct()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m, ppm = built(model, encoding.model_of), trees.value
        for texts in batches:
            parts = []
            for t in texts:
                fixed = encoding.repair(t, m)[1] if re.search("[^\x00-\x7f]", t) else t
                p = segments(fixed)
                parts.append(p or ([fixed] if _LETTER.search(fixed) else []))
            flat = [s for p in parts for s in p]
            bits, at, out = ppm.bits(flat) if ppm else None, 0, []
            for p in parts:
                if p and not ppm:
                    out.append(([{"lang": "und", "confidence": 0.0}], [{"text": s, "lang": "und", "confidence": 0.0} for s in p]))
                    continue
                if not p:
                    out.append(([{"lang": "und", "confidence": 1.0}], []))
                    continue
                named, found = decide(p, bits[at : at + len(p)], ppm.languages)
                at += len(p)
                out.append(([{"lang": g, "confidence": c} for g, c in found], [{"text": s, "lang": g, "confidence": c} for s, g, c in named]))
            yield pd.DataFrame({"languages": [o[0] for o in out], "segments": [o[1] for o in out]})

    kind = "languages array<struct<lang: string, confidence: double>>, segments array<struct<text: string, lang: string, confidence: double>>"
    # not deterministic for the planner, so that no filter repeats it
    r = F.pandas_udf(run, kind, F.PandasUDFType.SCALAR_ITER).asNondeterministic()("_text")
    return src.select("_id", "_label", r.alias("r")).select(F.col("_id").alias(id_col), F.col("_label").alias("label"), "r.languages", "r.segments")


def mislabelled(identified: DataFrame, id_col: str) -> DataFrame:
    """(id, lang) rows of the texts whose label is missing or wrong or that hold several languages."""
    code = mapped(lambda s: label_code(s), "string", F.col("label"))
    x = identified.withColumn("_code", code)
    odd = (F.size("languages") > 1) | F.col("_code").isNull() | (F.col("_code") != F.col("languages")[0]["lang"])
    return x.where(odd).select(id_col, F.explode("languages.lang").alias("lang")).distinct()
