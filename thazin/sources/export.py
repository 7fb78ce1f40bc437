"""Sinks and sources: CoNLL, JSON lines, stand-off annotations, labelling tasks, gold-standard lines."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thazin.kernels import records
from thazin.operators.evaluation import numbered
from thazin.session import mapped


def conll(words: Column, tags: Column) -> Column:
    """id, form, lemma (_), tag and _ by line, tabs between, for one sentence."""
    line = F.transform(F.arrays_zip(words.alias("w"), tags.alias("t")), lambda x, i: F.concat_ws("\t", (i + 1).cast("string"), x["w"], F.lit("_"), x["t"], F.lit("_")))
    return F.array_join(line, "\n")


def write_conll(df: DataFrame, words: str, tags: str, path: str) -> None:
    """Sentences with a blank line between them, as text files."""
    df.select(F.concat(conll(F.col(words), F.col(tags)), F.lit("\n")).alias("value")).write.text(path)


def write_records(df: DataFrame, path: str) -> None:
    """One JSON object a line; null fields are left out."""
    df.write.json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def gold_lines(df: DataFrame, value: str = "value") -> DataFrame:
    """Lines of word/tag, split at the last slash, to (words, tags, raw_line); blank lines are left out."""
    parts = F.filter(F.split(F.trim(value), "\\s+"), lambda p: p != "")
    rows = df.where(F.trim(value) != "").select(F.col(value).alias("raw_line"), parts.alias("_p"))
    return rows.select(F.transform("_p", lambda p: F.regexp_replace(p, "/[^/]*$", "")).alias("words"), F.transform("_p", lambda p: F.element_at(F.split(p, "/"), -1)).alias("tags"), "raw_line")


def treebank_lines(df: DataFrame, value: str = "value") -> DataFrame:
    """Lines of id<TAB>(S (TAG word) ...) to (id, words, tags): the leaves in order."""
    tree = F.regexp_extract(value, "\t(.*)$", 1)
    return df.select(F.regexp_extract(value, "^([^\t]*)\t", 1).alias("id"), F.regexp_extract_all(tree, F.lit("\\([^()\\s]+ ([^()\\s]+)\\)"), 1).alias("words"), F.regexp_extract_all(tree, F.lit("\\(([^()\\s]+) [^()\\s]+\\)"), 1).alias("tags"))


def gold_compounds(df: DataFrame, value: str = "value") -> DataFrame:
    """Lines of word/tag in which | joins the parts of a compound, to (words, tags, raw_line): a compound is one word with the tag of its first part."""
    pieces = F.filter(F.split(F.trim(value), "\\s+"), lambda p: p != "")
    parts = F.transform(pieces, lambda p: F.split(p, "\\|"))
    word = F.transform(parts, lambda ps: F.array_join(F.transform(ps, lambda p: F.regexp_replace(p, "/[^/]*$", "")), ""))
    tag = F.transform(parts, lambda ps: F.when(F.get(ps, F.lit(0)).contains("/"), F.element_at(F.split(F.get(ps, F.lit(0)), "/"), -1)))
    both = F.filter(F.arrays_zip(word.alias("w"), tag.alias("t")), lambda x: x["w"] != "")
    return df.where(F.trim(value) != "").select(F.transform(both, lambda x: x["w"]).alias("words"), F.transform(both, lambda x: x["t"]).alias("tags"), F.col(value).alias("raw_line"))


def segmented_lines(df: DataFrame, value: str = "value") -> DataFrame:
    """Lines of words with spaces between, as other segmenters write them; blank lines are left out."""
    return df.where(F.trim(value) != "").select(F.filter(F.split(F.trim(value), "\\s+"), lambda p: p != "").alias("words"))


def standoff_of(sentences: Column) -> Column:
    """struct<text, annotations> of a document's sentence records in stand-off form."""
    form = mapped(lambda rs: [dict(zip(("text", "annotations"), records.standoff(rs)))], "array<struct<text: string, annotations: string>>", sentences)
    return F.get(form, F.lit(0))


def tasks_of(sentences: Column) -> Column:
    """Each sentence record as a labelling task, in JSON."""
    return mapped(lambda rs: [json.dumps(records.task(r), ensure_ascii=False) for r in rs], "array<string>", sentences)


def json_of(sentences: Column) -> Column:
    """All sentence records of a document as one JSON object; null fields are left out."""
    return F.to_json(F.struct(sentences.alias("sentences")))


def renumbered(df: DataFrame, doc_col: str, sentences: str) -> DataFrame:
    """One row per sentence record with ids that go on over all documents, in order of the document."""
    flat = df.select(doc_col, F.posexplode(sentences).alias("_k", "r"))
    return numbered(flat, doc_col, "_k", out="id").select("id", doc_col, F.col("r").dropFields("id").alias("record"))


def write_standoff(df: DataFrame, sentences: str, path: str) -> None:
    """Texts and annotations of the documents, a row each, under two folders."""
    s = df.select(standoff_of(F.col(sentences)).alias("s"))
    s.select(F.col("s.text").alias("value")).write.text(f"{path}/txt")
    s.select(F.col("s.annotations").alias("value")).write.text(f"{path}/ann")
