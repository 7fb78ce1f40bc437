"""Per-document operators that need a kernel, in Arrow batches; each is stateless and works on streams too."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thazin.kernels import analysis, records, repair, syntax, text
from thazin.kernels.entities import Entities
from thazin.kernels.grammar import Grammar
from thazin.kernels.lexicon import Lexicon
from thazin.session import built, mapped, shared


def normalized(col: Column) -> Column:
    """Invisible characters deleted, then NFC; null for null."""
    return mapped(text.normalize, "string", col)


def canonical(col: Column) -> Column:
    return mapped(lambda t: text.canonical_order(text.normalize(t)), "string", col)


def reordered(col: Column) -> Column:
    """Marks in order, nothing else."""
    return mapped(text.canonical_order, "string", col)


def canonical_then_normalized(col: Column) -> Column:
    """Marks in order, then invisible characters deleted and composed (NFC)."""
    return mapped(lambda t: text.normalize(text.canonical_order(t)), "string", col)


def romanized(col: Column) -> Column:
    return mapped(analysis.romanize, "string", col)


def tokenized(col: Column) -> Column:
    """array<struct<text, start, end, kind>> of syllables with offsets into the normalized text."""
    return mapped(lambda t: [dict(zip(("text", "start", "end", "kind"), x)) for x in text.tokens(text.normalize(t))], "array<struct<text: string, start: int, end: int, kind: string>>", col)


def segmented(df: DataFrame, col: str, out: str = "words", lexicon: Lexicon | None = None) -> DataFrame:
    """Adds the words of a text: longest lexicon entries over its syllables."""
    handle = shared(df.sparkSession, lexicon or Lexicon.seed())
    return df.withColumn(out, mapped(lambda t: [w[0] for w in analysis.words(text.normalize(t), handle.value[1])], "array<string>", F.col(col)))


def tagged(df: DataFrame, col: str, out: str = "tags", lexicon: Lexicon | None = None) -> DataFrame:
    """Adds one tag for each word of an array."""
    handle = shared(df.sparkSession, lexicon or Lexicon.seed())
    return df.withColumn(out, mapped(lambda w: analysis.pos_tags([x or "" for x in w], handle.value[1]), "array<string>", F.col(col)))


DOCUMENT = (
    "text string, syllables array<string>, words array<string>, spans array<struct<start: int, end: int>>, units array<struct<text: string, category: string, first: int, last: int, index: int>>, tags array<string>, "
    "entities array<struct<text: string, type: string, first: int, last: int, attributes: map<string, string>>>, chunks array<struct<type: string, text: string, first: int, last: int>>, "
    "sentences array<struct<text: string, start: int, end: int, first: int, stop: int>>, "
    "phrases array<struct<sentence: int, depth: int, type: string, part: string, function: string, role: string, text: string, first: int, last: int>>, "
    "clauses array<struct<sentence: int, kind: string, relation: string, marker: string, text: string, first: int, last: int>>"
)
RECORD = (
    "id int, text string, tokens array<struct<id: int, text: string, pos: string>>, chunks array<struct<id: int, type: string, start: int, end: int, function: string, semantic_role: string>>, "
    "clauses array<struct<id: int, type: string, start: int, end: int, relation: string, marker: string>>, entities array<struct<id: int, label: string, start: int, end: int>>, mwe array<struct<id: int, type: string, start: int, end: int>>"
)


class Engine:
    """What the analysis of a text needs, built once for a worker."""

    def __init__(self, value: tuple):
        self.lexicon, units, entities, self.grammar, self.soft = value
        self.units = analysis.Units(units)
        self.entities = Entities(entities, self.lexicon)

    def run(self, raw: str) -> dict:
        norm = text.normalize(raw)
        found = analysis.words(norm, self.lexicon)
        words, merged = self.units.merge([w[0] for w in found])
        at, spans = 0, []
        inside = {u[4]: u[3] - u[2] + 1 for u in merged}
        for i in range(len(words)):
            n = inside.get(i, 1)
            spans.append((found[at][1], found[at + n - 1][2]))
            at += n
        tags = analysis.pos_tags(words, self.lexicon, {u[4]: analysis.Units.TAG.get(u[1], "IDIOM") for u in merged})
        hits = self.entities.find(words, tags)
        for h in hits:
            tags[h.first : h.last + 1] = ["PROPN"] * (h.last - h.first + 1)
        chunks = analysis.chunks(words, tags, [(h.first, h.last) for h in hits], self.grammar)
        bounds = syntax.sentences(words, tags, chunks, self.soft)
        chars = syntax.char_spans(norm, spans, bounds)
        trees = [syntax.parsed(words, chunks, s) for s in bounds]
        return {
            "text": norm,
            "syllables": [t[0] for t in text.tokens(norm)],
            "words": words,
            "spans": [{"start": a, "end": b} for a, b in spans],
            "units": [dict(zip(("text", "category", "first", "last", "index"), u)) for u in merged],
            "tags": tags,
            "entities": [{"text": h.text, "type": h.kind, "first": h.first, "last": h.last, "attributes": {k: v for k, v in h.attributes.items() if v is not None}} for h in hits],
            "chunks": [dict(zip(("type", "text", "first", "last"), c)) for c in chunks],
            "sentences": [{"text": norm[x:y], "start": x, "end": y, "first": a, "stop": b} for (a, b), (x, y) in zip(bounds, chars)],
            "phrases": [{"sentence": k, "depth": d, "type": p.kind, "part": p.part, "function": p.function, "role": p.role, "text": p.text, "first": p.first, "last": p.last} for k, (ps, _) in enumerate(trees) for d, p in syntax.flat(ps)],
            "clauses": [{"sentence": k, "kind": c[0], "relation": c[1], "marker": c[2], "text": "".join(words[c[3] : c[4] + 1]), "first": c[3], "last": c[4]} for k, (_, cs) in enumerate(trees) for c in cs],
        }

    def records(self, raw: str) -> list[dict]:
        return records.sentence_records(self.run(raw))


def _engine(spark, lexicon: Lexicon | None, units: Iterable, entities: Iterable, grammar: Grammar | None, soft: bool):
    return shared(spark, (lexicon or Lexicon.seed(), list(units), list(entities), grammar, soft))


def processed(df: DataFrame, col: str, lexicon: Lexicon | None = None, units: Iterable = (), entities: Iterable = (), out: str = "document", grammar: Grammar | None = None, soft: bool = True) -> DataFrame:
    """Adds the whole analysis of a text as one struct, in one pass.

    Words, multi-word units, tags (PROPN inside entities), entities, phrases,
    sentences that partition the text, the phrase tree of each (relative
    clauses nested, depth-first with their depth) and its clauses.  ``entities``
    are (name, kind, attributes); names are cut into words like the texts.
    Without ``soft`` only stops end sentences.  Empty text gives empty lists,
    null gives null.
    """
    handle = _engine(df.sparkSession, lexicon, units, entities, grammar, soft)
    return df.withColumn("_d", mapped(lambda t: [built(handle, Engine).run(t)], f"array<struct<{_ddl(DOCUMENT)}>>", F.col(col))).withColumn(out, F.col("_d")[0]).drop("_d")


def recorded(df: DataFrame, col: str, lexicon: Lexicon | None = None, units: Iterable = (), entities: Iterable = (), out: str = "records", grammar: Grammar | None = None, soft: bool = True) -> DataFrame:
    """Adds the sentence records of a text, for export."""
    handle = _engine(df.sparkSession, lexicon, units, entities, grammar, soft)
    return df.withColumn(out, mapped(lambda t: built(handle, Engine).records(t), f"array<struct<{_ddl(RECORD)}>>", F.col(col)))


def entities_of(words: Column, tags: Column | None, spark, entries: Iterable, lexicon: Lexicon | None = None) -> Column:
    """The entities over given words: array<struct<text, type, first, last>>; without tags their checks are left out."""
    handle = shared(spark, (list(entries), lexicon or Lexicon.seed()))
    cols = (words,) if tags is None else (words, tags)

    def run(w, t=None):
        return [{"text": h.text, "type": h.kind, "first": h.first, "last": h.last} for h in built(handle, _finder).find([x or "" for x in w], None if t is None else list(t))]

    return mapped(run, "array<struct<text: string, type: string, first: int, last: int>>", *cols)


def _finder(value: tuple) -> Entities:
    return Entities(*value)


def stats(document: Column) -> Column:
    """Counts, means and the tags of an analysed document."""
    size = lambda name: F.size(document[name])
    each = lambda a, b: size(a) / F.greatest(size(b), F.lit(1))
    kinds = F.array_distinct(document["tags"])
    return F.struct(
        F.length(document["text"]).alias("char_count"), size("syllables").alias("syllable_count"), size("words").alias("word_count"), size("sentences").alias("sentence_count"),
        each("words", "sentences").alias("avg_words_per_sentence"), each("syllables", "words").alias("avg_syllables_per_word"),
        F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(document["tags"], lambda t: t == k)))).alias("pos_distribution"),
    )


def _ddl(schema: str) -> str:
    """Column definitions as fields of a struct."""
    out, depth = [], 0
    for part in schema.replace("<", " <").split(", "):
        name, _, kind = part.partition(" ")
        out.append(part.replace(" <", "<") if depth else f"{name}: {kind.replace(' <', '<')}")
        depth += part.count("<") - part.count(">")
    return ", ".join(out)


REPORT = (
    "array<struct<text: string, paragraphs: array<struct<text: string, converted_text: string, probability: double, converted: boolean, "
    "repairs: array<struct<rule_index: int, matched_text: string, replacement_text: string, origin_start: int, origin_end: int, category: string, lossy: boolean, ambiguous: boolean>>>>, summary: struct<min: double, max: double, spread: double>>>"
)


def repaired(df: DataFrame, col: str, model: repair.OrderModel | repair.MarkovModel, threshold: float = 0.5, out: str = "report") -> DataFrame:
    """Adds the paragraph-wise conversion report of a text."""
    handle = shared(df.sparkSession, model)
    return df.withColumn("_d", mapped(lambda t: [repair.repair_report(t, handle.value[1].probability, threshold)], REPORT, F.col(col))).withColumn(out, F.col("_d")[0]).drop("_d")


def standardized(df: DataFrame, col: str, model: repair.OrderModel | repair.MarkovModel, threshold: float = 0.9, out: str = "standard") -> DataFrame:
    """Adds the text, converted as a whole where the model finds legacy order, and composed."""
    handle = shared(df.sparkSession, model)
    return df.withColumn(out, mapped(lambda t: repair.standard(t, handle.value[1].probability, threshold), "string", F.col(col)))
