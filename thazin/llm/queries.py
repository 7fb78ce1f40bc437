"""Queries of the training-data operators, by problem, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thazin.llm import encoding, gazetteer, language, ngrams, packing, sentences, skeleton, stuffing, tokens
from thazin.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "gazetteer_entries")
    parts = []
    for src, id_col, value in (("candidate_keys", "cand_id", "span"), ("gazetteer_hits", "hit_id", "text")):
        m = gazetteer.match(table(spark, d, src), entries, id_col, value)
        parts.append(m.select(F.lit(src).alias("src"), "rec_id", "entry_id"))
    return parts[0].unionByName(parts[1])


def _languages(spark: SparkSession, d: str) -> DataFrame:
    return language.identify(table(spark, d, "paragraph_reports"), table(spark, d, "lang_samples"), "report_id", "text", "lang")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return language.mislabelled(_languages(spark, d), "report_id")


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    s = _languages(spark, d).select("report_id", F.posexplode("segments").alias("segment_no", "s"))
    return s.select("report_id", "segment_no", F.col("s.text").alias("text"), F.col("s.lang").alias("lang"), F.col("s.confidence").alias("confidence"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for src, id_col, value in (("candidate_keys", "cand_id", "span"), ("parsed_documents", "parsed_id", "raw_text")):
        parts.append(skeleton.same_look(table(spark, d, src), id_col, value, "batch_id").select(F.lit(src).alias("src"), "id_a", "id_b"))
    return parts[0].unionByName(parts[1])


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for src, id_col, value in (("candidate_keys", "cand_id", "span"), ("parsed_documents", "parsed_id", "raw_text")):
        parts.append(skeleton.classes(table(spark, d, src), id_col, value).select(F.lit(src).alias("src"), F.col(id_col).alias("id"), "look", "n_forms", "n_links"))
    return parts[0].unionByName(parts[1])


_BLANK = "(?U)^\\s*$"


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    words = ngrams.marked_terms(table(spark, d, "parsed_documents"), "parsed_id", "parsed_id", "words", None, F.col("records") == 1)
    keys = table(spark, d, "candidate_keys")
    spans = keys.where(F.col("span").isNotNull() & ~F.col("span").rlike(_BLANK)).withColumn("_terms", F.array("span"))
    batches = keys.agg(F.countDistinct("batch_id").alias("n_all"))
    spans = ngrams.marked_terms(spans, "cand_id", "batch_id", "_terms", "count", F.col("total") <= 3, n_records=batches)
    both = words.withColumn("src", F.lit("words")).unionByName(spans.withColumn("src", F.lit("span")))
    return both.where("mark is not null").select("src", "term", "mark")


def p4_ngrams(spark: SparkSession, d: str) -> DataFrame:
    counts = ngrams.term_counts(table(spark, d, "parsed_documents"), "parsed_id", "words", max_n=3)
    return counts.select(F.array_join("ngram", "\u0001").alias("ngram"), "n", "total", "records")


def _repaired(spark: SparkSession, d: str) -> DataFrame:
    # converted texts are left out of the frequencies: they are what may have been converted wrongly
    return encoding.repaired(table(spark, d, "paragraph_reports"), "report_id", ("text", "converted_text"), model_columns=("text",), derived={"converted_text": "text"})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d).where("garbled").select("report_id", "field").distinct()


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d).where("garbled").select("report_id", "field", "channel", "restored")


def p6_budget(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_budget(table(spark, d, "fertility_results"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_spans(table(spark, d, "parsed_documents"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed(table(spark, d, "documents")).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fns = (p1_found, p2_found, p2_segments, p3_found, p3_classes, p4_found, p4_ngrams, p5_found, p5_restored, p6_budget, p7_found, p8_ids, p9_containers, p10_found)
    return {f.__name__: f for f in fns}


_DOCS = "SELECT parsed_id, any_value(words) AS words FROM parsed_documents WHERE parsed_id IS NOT NULL AND words IS NOT NULL GROUP BY parsed_id"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8239) || chr(8287) || chr(12288)"

SQL = {
    "p4_found": f"""
WITH docs AS ({_DOCS}),
w AS (SELECT parsed_id, unnest(words) AS term FROM docs),
wc AS (SELECT term, count(DISTINCT parsed_id) AS records FROM w WHERE term IS NOT NULL GROUP BY term),
wm AS (SELECT term, CASE WHEN records = 1 THEN 'rare' WHEN records > 0.25 * (SELECT count(*) FROM docs) THEN 'common' END AS mark FROM wc),
keys AS (SELECT cand_id, any_value(batch_id) AS batch_id, any_value(span) AS span, any_value("count") AS n FROM candidate_keys GROUP BY cand_id),
s AS (SELECT span AS term, sum(coalesce(n, 0)) AS total, count(DISTINCT batch_id) AS records FROM keys WHERE span IS NOT NULL AND trim(span, {_SPACES}) <> '' AND batch_id IS NOT NULL GROUP BY span),
sm AS (SELECT term, CASE WHEN total <= 3 THEN 'rare' WHEN records > 0.25 * (SELECT count(DISTINCT batch_id) FROM candidate_keys) THEN 'common' END AS mark FROM s)
SELECT 'words' AS src, term, mark FROM wm WHERE mark IS NOT NULL
UNION ALL SELECT 'span', term, mark FROM sm WHERE mark IS NOT NULL""",
    "p4_ngrams": f"""
WITH docs AS ({_DOCS}),
d AS (SELECT parsed_id, list_filter(words, lambda x: x IS NOT NULL) AS words FROM docs),
g AS (SELECT parsed_id, unnest(range(1, len(words) + 1)) AS i, words FROM d),
n AS (SELECT parsed_id, words[i:i + k - 1] AS gram, k AS n FROM g, (VALUES (1), (2), (3)) AS t(k) WHERE i + k - 1 <= len(words))
SELECT array_to_string(gram, chr(1)) AS ngram, n, count(*) AS total, count(DISTINCT parsed_id) AS records FROM n GROUP BY gram, n""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
