"""Registered queries over the test tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thazin.functions import native
from thazin.kernels import analysis, syntax
from thazin.kernels.lexicon import Lexicon
from thazin.kernels.repair import OrderModel
from thazin.kernels.text import standard_to_legacy
from thazin.operators import evaluation, text
from thazin.plans import sql
from thazin.session import small, spread, table
from thazin.sources.export import conll, standoff_of, tasks_of
from thazin.streaming.counters import windowed_counts


def _lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w, list(t)) for w, t in Lexicon.seed().entries.items()], "word string, tags array<string>")


def _documents(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return spread(table(spark, d, "parsed_documents").select("parsed_id", *cols), "parsed_id").dropDuplicates(["parsed_id"])


def syllable_counts(spark, d):
    s = table(spark, d, "sentence_rows").where("text is not null").select(F.explode(native.syllables(native.visible(F.col("text")))).alias("syllable"))
    return s.where(F.col("syllable").rlike("^[က-႟]")).groupBy("syllable").agg(F.count(F.lit(1)).alias("n"))


def normalized_texts(spark, d):
    t = table(spark, d, "paragraph_reports").where("text is not null").select("report_id", text.normalized(F.col("text")).alias("t"))
    return t.select("report_id", F.length("t").alias("chars"), F.md5("t").alias("digest")).distinct()


def legacy_hints(spark, d):
    return table(spark, d, "paragraph_reports").where("text is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(native.is_legacy(F.col("text")).cast("int")).alias("legacy"))


def legacy_converted(spark, d):
    t = table(spark, d, "paragraph_reports").where(native.is_legacy(F.col("text"))).select("report_id", "text").distinct()
    return t.select("report_id", native.legacy_to_standard(F.col("text")).alias("standard"))


def canonical_variants(spark, d):
    v = table(spark, d, "candidate_keys").where("span is not null").select("span").distinct()
    return v.select(text.canonical(F.col("span")).alias("canonical"), "span").groupBy("canonical").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1")


def rewrite_categories(spark, d):
    r = table(spark, d, "paragraph_reports").select(F.explode("repairs").alias("r"))
    return r.select(native.rewrite_category(F.col("r.matched_text"), F.col("r.replacement_text")).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def paragraph_sizes(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.size(native.paragraphs(F.col("text"))).alias("paragraphs"), F.octet_length("text").alias("bytes"), F.length("text").alias("chars"))


def script_runs(spark, d):
    t = table(spark, d, "documents").where("text is not null").select(F.explode(native.script_runs(F.col("text"))).alias("r"))
    return t.groupBy("r.script").agg(F.count(F.lit(1)).alias("runs"), F.sum(F.length("r.text")).alias("chars"))


def lexicon_lookup(spark, d):
    w = _documents(spark, d, "words").select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return w.join(F.broadcast(_lexicon(spark)), "word").select("word", "n", F.array_join("tags", ",").alias("tags"))


def word_counts(spark, d):
    t = text.segmented(table(spark, d, "sentence_rows").where("text is not null").select("text"), "text")
    return t.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def tag_histogram(spark, d):
    t = text.tagged(_documents(spark, d, "words").where("words is not null"), "words")
    return t.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def _names(spark, d):
    return [(r["name"], r["entity_type"], {}) for r in small(table(spark, d, "gazetteer_entries").where("name is not null").select("name", "entity_type").orderBy("entry_id"), 50_000)]


def processed_documents(spark, d):
    t = text.processed(_documents(spark, d, "raw_text").where("raw_text is not null"), "raw_text", entities=_names(spark, d))
    return t.select("parsed_id", F.posexplode("document.phrases").alias("n", "c")).select("parsed_id", "n", F.col("c.sentence").alias("sentence"), F.col("c.depth").alias("depth"), F.col("c.type").alias("type"), F.col("c.part").alias("part"), F.col("c.role").alias("role"), F.col("c.first").alias("first"), F.col("c.last").alias("last"))


def entities(spark, d):
    """Listed names over the syllables of each document."""
    t = _documents(spark, d, "raw_text").where("raw_text is not null").select("parsed_id", native.syllables(native.visible(text.normalized(F.col("raw_text")))).alias("s"))
    found = t.select("parsed_id", F.explode(text.entities_of(F.col("s"), None, spark, _names(spark, d), Lexicon({}))).alias("e"))
    return found.select("parsed_id", F.col("e.text").alias("text"), F.col("e.type").alias("type"), F.col("e.first").alias("first"), F.col("e.last").alias("last"))


def processed_entities(spark, d):
    t = text.processed(_documents(spark, d, "raw_text").where("raw_text is not null"), "raw_text", entities=_names(spark, d))
    return t.select(F.explode("document.entities").alias("e")).groupBy("e.type", "e.text").agg(F.count(F.lit(1)).alias("n"))


def document_stats(spark, d):
    t = text.processed(_documents(spark, d, "raw_text").where("raw_text is not null"), "raw_text")
    s = t.select("parsed_id", text.stats(F.col("document")).alias("s"))
    return s.select("parsed_id", "s.char_count", "s.syllable_count", "s.word_count", (F.col("s.syllable_count") / F.greatest(F.col("s.word_count"), F.lit(1))).alias("avg_syllables_per_word"))


def sentence_spans(spark, d):
    """Sentences partition the normalized text: (id, sentences, whether they do)."""
    t = text.processed(_documents(spark, d, "raw_text").where("raw_text is not null"), "raw_text")
    joined = F.array_join(F.transform("document.sentences", lambda x: x["text"]), "")
    return t.select("parsed_id", F.length(joined).alias("chars"), ((F.size("document.sentences") == 0) | (joined == F.col("document.text"))).alias("whole"))


def sentence_records(spark, d):
    t = text.recorded(_documents(spark, d, "raw_text").where("raw_text is not null"), "raw_text", entities=_names(spark, d))
    r = t.select("parsed_id", F.explode("records").alias("r"))
    return r.select("parsed_id", F.col("r.id").alias("sentence"), F.size("r.tokens").alias("tokens"), F.size("r.chunks").alias("chunks"), F.size("r.clauses").alias("clauses"), F.size("r.entities").alias("entities"))


def annotations(spark, d):
    t = text.recorded(_documents(spark, d, "raw_text").where("raw_text is not null"), "raw_text", entities=_names(spark, d))
    return t.select("parsed_id", standoff_of(F.col("records")).alias("s")).select("parsed_id", F.length("s.text").alias("chars"), F.size(F.split("s.annotations", "\n")).alias("lines"))


def labelling_tasks(spark, d):
    t = text.recorded(_documents(spark, d, "raw_text").where("raw_text is not null"), "raw_text", entities=_names(spark, d))
    return t.select("parsed_id", F.posexplode(tasks_of(F.col("records"))).alias("sentence", "task"))


def clause_kinds(spark, d):
    t = text.processed(_documents(spark, d, "raw_text").where("raw_text is not null"), "raw_text")
    return t.select(F.explode("document.clauses").alias("c")).groupBy("c.kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c.marker").alias("markers"))


def repair_reports(spark, d):
    samples = [r["text"] for r in small(table(spark, d, "lang_samples").where("lang = 'my' and text is not null").select("text"), 20_000)]
    model = OrderModel.fit(samples, [standard_to_legacy(s) for s in samples])
    t = table(spark, d, "paragraph_reports").where("text is not null").select("report_id", "text").distinct()
    p = text.repaired(t, "text", model).select("report_id", F.posexplode("report.paragraphs").alias("paragraph", "p"))
    return p.select("report_id", "paragraph", "p.converted", "p.converted_text", F.size("p.repairs").alias("repairs"))


def gazetteer_lookup(spark, d):
    e = table(spark, d, "gazetteer_entries").select(F.col("name").alias("text"), "entity_type")
    return evaluation.listed(table(spark, d, "gazetteer_hits").select("hit_id", "text").distinct(), e, "text").groupBy("entity_type").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("text").alias("names"))


def legacy_patterns(spark, d):
    return table(spark, d, "paragraph_reports").where("text is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(native.looks_legacy(F.col("text")).cast("int")).alias("hinted"))


def romanized_names(spark, d):
    return table(spark, d, "gazetteer_entries").select("entry_id", text.romanized(F.col("name")).alias("latin"))


def neighbour_features(spark, d):
    f = evaluation.neighbour_features(_documents(spark, d, "words").where("words is not null"), "parsed_id", "words")
    return f.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("prev_item").alias("lefts"), F.countDistinct("next_item").alias("rights"), F.sum(F.col("bos").cast("int")).alias("first"), F.sum(F.col("eos").cast("int")).alias("last"))


def _resegmented(spark, d, *cols):
    """Documents with a second segmentation of their words: every third word joined to the next, every fourth cut after two characters."""
    w = _documents(spark, d, "words", *cols).where("words is not null and size(words) > 0").withColumn("words", F.transform("words", lambda x: F.coalesce(x, F.lit(""))))
    cut = lambda x, i: F.when((i % 4 == 3) & (F.length(x) > 2), F.concat(F.substring(x, F.lit(1), F.lit(2)), F.lit("\u0001"), F.substring(x, F.lit(3), F.length(x)))).otherwise(x)
    marked = F.array_join(F.transform("words", lambda x, i: F.concat(cut(x, i), F.when(i % 3 == 0, "").otherwise("\u0001"))), "")
    return w.withColumn("hyp", F.filter(F.split(marked, "\u0001"), lambda x: x != ""))


def boundary_scores(spark, d):
    return evaluation.boundary_scores(_resegmented(spark, d, "source"), "words", "hyp", "source")


def stratified_scores(spark, d):
    return evaluation.stratified_scores(_resegmented(spark, d), "parsed_id", "words", "hyp", _lexicon(spark))


def _merged(spark, d):
    """Words as they are and merged in pairs, against words merged in threes as gold."""
    w = _documents(spark, d, "words").where("words is not null and size(words) > 2").withColumn("words", F.transform("words", lambda x: F.coalesce(x, F.lit(""))))
    group = lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / n).cast("int")), lambda i: F.array_join(F.slice("words", i * n + 1, F.lit(n)), ""))
    return w.withColumns({"gold": group(3), "merged": group(2)})


def disagreements(spark, d):
    found = evaluation.disagreements(_merged(spark, d), "parsed_id", "gold", "words", "merged")
    return found.select("parsed_id", "position", "direction", "span_text", "span_start", "span_end", "compound", "crosses_punctuation")


def disagreement_categories(spark, d):
    found = evaluation.disagreements(_merged(spark, d), "parsed_id", "gold", "words", "merged")
    return evaluation.categories(found, table(spark, d, "gazetteer_entries").select("name")).groupBy("direction", "category").agg(F.count(F.lit(1)).alias("n"))


def disagreement_sample(spark, d):
    found = evaluation.disagreements(_merged(spark, d), "parsed_id", "gold", "words", "merged")
    return evaluation.diverse_sample(found.select("parsed_id", "position", "direction"), "parsed_id", ["position", "direction"], 20)


def segmentation_diff(spark, d):
    return evaluation.differences(_merged(spark, d), "parsed_id", "gold", "merged")


def collapse_stats(spark, d):
    return evaluation.collapse(table(spark, d, "candidate_keys").select(F.array("span").alias("w")), "w")


def stop_sentences(spark, d):
    w = _documents(spark, d, "words").where("words is not null")
    s = w.select("parsed_id", F.posexplode(native.stop_sentences(F.col("words"))).alias("sentence", "w"))
    return s.select("parsed_id", "sentence", F.size("w").alias("words"))


def denominators(spark, d):
    m = evaluation.measured(table(spark, d, "fertility_results").where("text is not null").select("fert_id", "text").distinct(), "text")
    return m.select("fert_id", F.col("denominators.bytes").alias("bytes"), F.col("denominators.chars").alias("chars"), F.col("denominators.syllables").alias("syllables"), F.col("denominators.words").alias("words"), F.col("tokens")["utf8_bytes"].alias("utf8_bytes"), F.col("tokens")["code_points"].alias("code_points"))


def token_ratios(spark, d):
    m = evaluation.measured(table(spark, d, "fertility_results").where("text is not null").select("fert_id", "lang", "text").distinct(), "text")
    return evaluation.distribution(evaluation.ratios(m, "utf8_bytes"), "tokens_per_syllable", "lang")


def tokens_by_script(spark, d):
    m = evaluation.measured(table(spark, d, "fertility_results").where("text is not null").select("fert_id", "text").distinct(), "text", canonicalize=False)
    return m.select(F.explode("runs").alias("r")).groupBy("r.script").agg(F.count(F.lit(1)).alias("runs"), F.sum(F.col("r.tokens")["utf8_bytes"]).alias("tokens"))


def known_words(spark, d):
    w = _documents(spark, d, "words").select(F.explode("words").alias("word"))
    return evaluation.known_words(w, _lexicon(spark))


def syllable_features(spark, d):
    f = evaluation.syllable_features(table(spark, d, "candidate_keys").select("cand_id", "span").distinct(), "cand_id", "span")
    n = lambda c: F.sum(F.col(c).cast("int")).alias(c)
    return f.groupBy("syllable").agg(F.count(F.lit(1)).alias("n"), n("has_medial"), n("has_vowel_sign"), n("has_tone"), n("has_asat"), n("has_stacked"), n("bos"), n("eos"), F.countDistinct("prev_syllable").alias("lefts"), F.countDistinct("next_syllable").alias("rights"), F.max("bigram_last").alias("bigram_last"))


# Words with the tags they must get, and inputs with the phrases, clauses and Latin letters they must give.
TAG_CASES = [
    (["မြန်မာ", "စာပေ", "ကို", "စီစဉ်", "ခြင်း"], ["NOUN", "NOUN", "POSTP", "VERB", None]), (["။"], ["PUNCT"]), (["၊"], ["PUNCT"]), (["၁၂၃"], ["NUM"]), (["123"], ["NUM"]), (["သုံးခု"], ["NUM"]), (["Hello"], ["FW"]),
    (["သူ", "စာ", "ဖတ်", "သည်"], ["PRON", None, None, None]), (["ကျောင်း", "၏", "ဆရာ"], [None, "POSTP", None]), (["စာ", "ဖတ်", "၏"], [None, None, "PART"]), (["ရွာ", "မှာ", "နေ", "သည်"], [None, None, "VERB", None]),
    (["သွား", "သည်"], ["VERB", "SFP"]), (["မ", "သွား"], ["PART", "VERB"]), (["သွား", "ကို"], ["NOUN", "POSTP"]), (["ပို", "လုပ်"], ["ADV", "VERB"]), (["ခံစား", "နေ", "တယ်"], ["VERB", "AUX", "SFP"]),
    (["ကျွန်တော်", "ကျောင်း", "သို့", "သွား", "သည်", "။"], ["PRON", "NOUN", "POSTP", "VERB", "SFP", "PUNCT"]), (["ကျောင်း", "နှင့်", "အိမ်"], [None, "CONJ", None]), (["သူ", "နှင့်", "သွား"], [None, "POSTP", None]), (["ဆောက်လုပ်ရေး"], ["NOUN"]),
]
PHRASE_CASES = [
    (["ကောင်း", "စာ"], ["ADJ", "NOUN"], ["NP 0 1"]), (["ခံစား", "နေ", "တယ်"], ["VERB", "AUX", "SFP"], ["VP 0 2"]), (["မ", "သွား", "ဘူး"], ["PART", "VERB", "PART"], ["VP 0 2"]), (["ရန်ကုန်", "ကို"], ["NOUN", "POSTP"], ["PP 0 1"]),
    (["မန္တလေး", "ပွဲ", "က"], ["NOUN", "NOUN", "POSTP"], ["PP 0 2"]), (["အရမ်း", "ကောင်း"], ["ADV", "ADJ"], ["ADJP 0 1"]), (["ရန်ကုန်", "ကို", "သွား", "သည်"], ["NOUN", "POSTP", "VERB", "SFP"], ["PP 0 1", "VP 2 3"]), (["မင်္ဂလာ", "ပါ"], ["NOUN", "PART"], ["GREETING 0 1"]),
]
CLAUSE_CASES = [
    (["ကျွန်တော်", "စာ", "ဖတ်", "နေ", "သည်", "။"], ["PRON", "NOUN", "VERB", "AUX", "SFP", "PUNCT"], ["main matrix -"]), (["သွား"], ["VERB"], []), (["သွား", "သည်"], ["VERB", "SFP"], ["main matrix -"]), (["သူ", "သည်"], ["PRON", "POSTP"], []), (["မင်္ဂလာ", "ပါ"], ["NOUN", "PART"], ["main matrix -"]),
    (["မိုး", "ရွာ", "လျှင်", "အိမ်", "မှာ", "နေ", "မည်", "။"], ["NOUN", "VERB", "PART", "NOUN", "POSTP", "VERB", "SFP", "PUNCT"], ["conditional condition လျှင်", "main matrix -"]), (["စာ", "ဖတ်", "ရန်"], ["NOUN", "VERB", "PART"], ["purpose purpose ရန်"]), (["ဖတ်", "ရန်"], ["VERB", "PART"], []),
    (["လိုအပ်", "သော", "စာအုပ်"], ["VERB", "PART", "NOUN"], []), (["လျှင်"], ["PART"], []), (["မိုး", "ရွာ", "သောကြောင့်", "မ", "သွား", "ဘူး", "။"], ["NOUN", "VERB", "PART", "PART", "VERB", "PART", "PUNCT"], ["reason cause သောကြောင့်", "main matrix -"]),
    (["သူ", "ရန်ကုန်", "ကို", "မနေ့က", "မှာ", "သွား", "သည်"], ["PRON", "NOUN", "POSTP", "NOUN", "POSTP", "VERB", "SFP"], ["main matrix -"]),
]
LATIN_CASES = [("ရန်ကုန်", "yangôn"), ("မင်္ဂလာ", "mingala"), ("မဒမ", "madama"), ("အက", "aga"), ("ကလိ", "kali"), ("အပ်", "at"), ("သာငယ်", "thangè"), ("အိုဘဲ့", "obè"), ("ok", "ok")]
LEGACY_CASES = [("ျမန္မာစာေပ", "မြန်မာစာပေ")]


def tag_cases(spark, d):
    t = spark.createDataFrame([(i, w) for i, (w, _) in enumerate(TAG_CASES)], "k int, words array<string>")
    tags = text.tagged(t, "words").select("k", F.posexplode("tags").alias("i", "tag"))
    told = [(i, j) for i, (_, want) in enumerate(TAG_CASES) for j, x in enumerate(want) if x]
    return tags.join(F.broadcast(spark.createDataFrame(told, "k int, i int")), ["k", "i"])


def tag_histogram_by_word(spark, d):
    """Tags of words that only one class of words decides: stops, digits and foreign words."""
    t = text.tagged(_documents(spark, d, "words").where("words is not null"), "words")
    z = t.select(F.explode(F.arrays_zip(F.col("words").alias("w"), F.col("tags").alias("t"))).alias("z")).select("z.w", "z.t")
    sure = F.col("w").rlike("^[!-/:-@\\[-`{-~]+$|^[၊။]$|^[0-9၀-၉]+$|^[A-Za-z]+$")
    return z.where(sure).groupBy(F.col("w").alias("word"), F.col("t").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


def phrase_cases(spark, d):
    rows = [(i, f"{c[0]} {c[2]} {c[3]}") for i, (w, t, _) in enumerate(PHRASE_CASES) for c in analysis.chunks(w, t)]
    return spark.createDataFrame(rows, "k int, phrase string")


def clause_cases(spark, d):
    rows = [(i, f"{c[0]} {c[1]} {c[2] or '-'}") for i, (w, t, _) in enumerate(CLAUSE_CASES) for c in syntax.parsed(w, analysis.chunks(w, t), (0, len(w)))[1]]
    return spark.createDataFrame(rows, "k int, clause string")


def latin_cases(spark, d):
    return spark.createDataFrame([(x,) for x, _ in LATIN_CASES], "name string").select("name", text.romanized(F.col("name")).alias("latin"))


def legacy_cases(spark, d):
    return spark.createDataFrame(LEGACY_CASES, "legacy string, standard string").select("legacy", native.legacy_to_standard(F.col("legacy")).alias("standard"), text.reordered(native.legacy_to_standard(native.standard_to_legacy(F.col("standard")))).alias("there_and_back"))


def fertility_distribution(spark, d):
    f = table(spark, d, "fertility_results").select("fert_id", "lang", "text", F.col("denominators.words").alias("w")).distinct()
    return evaluation.distribution(f.where("w > 0").select("lang", (F.octet_length("text") / F.col("w")).alias("x")), "x", "lang")


def recorded_tokens(spark, d):
    t = table(spark, d, "fertility_results").select("fert_id", "source", F.explode("whole_document_tokens").alias("scheme", "tokens")).distinct()
    return t.groupBy("source", "scheme").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))


def spelling(spark, d):
    w = _documents(spark, d, "words").select(F.explode("words").alias("word")).distinct()
    return evaluation.spelling_suggestions(w, _lexicon(spark)).select("word", F.array_join("suggestions", ",").alias("suggestions"))


def conll_lines(spark, d):
    t = _documents(spark, d, "words", "tags").where("words is not null and tags is not null")
    return t.select("parsed_id", conll(F.col("words"), F.col("tags")).alias("conll"))


def event_windows(spark, d):
    w = windowed_counts(table(spark, d, "events"))
    return w.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


_ALL = (
    syllable_counts, normalized_texts, legacy_hints, legacy_patterns, legacy_converted, canonical_variants, rewrite_categories, paragraph_sizes, script_runs, lexicon_lookup, word_counts, tag_histogram, tag_histogram_by_word,
    processed_documents, processed_entities, entities, document_stats, sentence_spans, sentence_records, annotations, labelling_tasks, clause_kinds, repair_reports, gazetteer_lookup, romanized_names, neighbour_features, syllable_features,
    boundary_scores, stratified_scores, disagreements, disagreement_categories, disagreement_sample, segmentation_diff, collapse_stats, stop_sentences, denominators, token_ratios, tokens_by_script, fertility_distribution, recorded_tokens,
    known_words, spelling, conll_lines, event_windows, tag_cases, phrase_cases, clause_cases, latin_cases, legacy_cases,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


_INVISIBLE = sql.INVISIBLE
_DOCS = "SELECT parsed_id, any_value(source) AS source, any_value(raw_text) AS raw_text, any_value(words) AS words, any_value(tags) AS tags FROM parsed_documents GROUP BY parsed_id"
_GOLD = f"WITH docs AS ({_DOCS}), w AS (SELECT parsed_id, source, list_transform(words, lambda x: coalesce(x, '')) AS words FROM docs WHERE words IS NOT NULL AND len(words) > 0)"
# one row a word with where it starts and ends
_PLACES = "p AS (SELECT *, CAST(sum(length(word)) OVER (PARTITION BY parsed_id ORDER BY i) AS BIGINT) AS stop FROM (SELECT parsed_id, source, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w)), q AS (SELECT *, stop - length(word) AS start FROM p)"
_SETS = """g AS (SELECT DISTINCT parsed_id, source, stop AS pos FROM q WHERE i < n),
total AS (SELECT parsed_id, max(stop) AS size FROM q GROUP BY parsed_id),
h AS (SELECT DISTINCT q.parsed_id, q.source, x AS pos FROM (SELECT parsed_id, source, stop AS x FROM q WHERE i < n AND (i - 1) % 3 <> 0 UNION ALL SELECT parsed_id, source, start + 2 FROM q WHERE (i - 1) % 4 = 3 AND length(word) > 2) q JOIN total t ON t.parsed_id = q.parsed_id WHERE x > 0 AND x < size)"""
_MERGED = f"""WITH docs AS ({_DOCS}), w AS (SELECT parsed_id, source, list_transform(words, lambda x: coalesce(x, '')) AS words FROM docs WHERE words IS NOT NULL AND len(words) > 2), {_PLACES},
t AS (SELECT parsed_id, string_agg(word, '' ORDER BY i) AS t FROM q GROUP BY parsed_id),
pb AS (SELECT DISTINCT parsed_id, stop AS pos FROM q WHERE i < n), gb AS (SELECT DISTINCT parsed_id, stop AS pos FROM q WHERE i < n AND i % 3 = 0), mb AS (SELECT DISTINCT parsed_id, stop AS pos FROM q WHERE i < n AND i % 2 = 0),
d AS (SELECT pb.parsed_id, pb.pos AS position, 'merged_gold_split' AS direction FROM pb JOIN gb USING (parsed_id, pos) ANTI JOIN mb USING (parsed_id, pos) UNION ALL SELECT pb.parsed_id, pb.pos, 'split_gold_merged' FROM pb JOIN mb USING (parsed_id, pos) ANTI JOIN gb USING (parsed_id, pos)),
e AS (SELECT d.*, t.t, coalesce((SELECT max(pos) FROM gb WHERE gb.parsed_id = d.parsed_id AND pos <= position), 0) AS span_start, coalesce((SELECT min(pos) FROM gb WHERE gb.parsed_id = d.parsed_id AND pos >= position), length(t.t)) AS span_end FROM d JOIN t ON t.parsed_id = d.parsed_id),
f AS (SELECT parsed_id, position, direction, substr(t, greatest(position - 10, 0) + 1, least(position, 10)) || '|' || substr(t, position + 1, 10) AS span_text, span_start, span_end, substr(t, span_start + 1, span_end - span_start) AS compound FROM e),
x AS (SELECT *, regexp_matches(compound, '[\\p{{P}}၊။]') AS crosses_punctuation FROM f)"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in rows)


def _entity_sql() -> str:
    """Names over syllables: all places where one stands, those that count, then from left to right what doesn't overlap."""
    return f"""
WITH RECURSIVE docs AS ({_DOCS}), src AS (SELECT parsed_id AS id, {sql.normal("raw_text")} AS t FROM docs WHERE raw_text IS NOT NULL),
tok AS (SELECT id, list_filter({sql.tokens("t")}, lambda x: x <> chr(3)) AS ws FROM src),
nam AS (SELECT entity_type AS kind, entry_id, list_filter({sql.tokens(sql.normal("name"))}, lambda x: x <> chr(3)) AS ns FROM gazetteer_entries WHERE name IS NOT NULL),
one AS (SELECT ns, arg_min(kind, entry_id) AS kind, len(ns) AS n FROM nam WHERE len(ns) > 0 GROUP BY ns),
pos AS (SELECT id, ws, unnest(range(1, len(ws) + 1)) AS i FROM tok),
hit AS (SELECT id, i, n, kind, ws FROM pos JOIN one ON ws[i] = ns[1] AND ws[i:i + n - 1] = ns),
top AS (SELECT id, i, max(n) AS n FROM hit GROUP BY id, i),
best AS (SELECT hit.* FROM hit JOIN top USING (id, i, n)),
ok AS (SELECT id, i, i + n AS stop, kind, array_to_string(ws[i:i + n - 1], '') AS text FROM best
  WHERE kind NOT IN ('TOWN', 'VILLAGE', 'DISTRICT', 'STATE', 'ZONE', 'RIVER', 'MOUNTAIN') OR n >= 2 OR len(list_intersect(ws[greatest(i - 3, 1):i - 1] || ws[i + n:i + n + 2], ['မှာ', 'တွင်', '၌', 'သို့', 'မှ', 'မြို့', 'ရွာ', 'ခရိုင်', 'တိုင်း', 'ပြည်နယ်', 'မြို့နယ်', 'ကျေးရွာ'])) > 0),
walk(id, i, stop, kind, text) AS (SELECT id, i, stop, kind, text FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS k FROM ok) WHERE k = 1
  UNION ALL SELECT id, i, stop, kind, text FROM (SELECT ok.*, row_number() OVER (PARTITION BY ok.id ORDER BY ok.i) AS k FROM walk JOIN ok ON ok.id = walk.id AND ok.i >= walk.stop) WHERE k = 1)
SELECT id AS parsed_id, text, kind AS type, i - 1 AS "first", stop - 2 AS "last" FROM walk"""


def oracle_sql() -> dict[str, str]:
    return {
        "syllable_counts": f"""
WITH t AS (SELECT translate(text, {_INVISIBLE}, '') AS t FROM sentence_rows WHERE text IS NOT NULL),
r AS (SELECT unnest(regexp_extract_all(t, '[က-႟]+')) AS r FROM t),
a AS (SELECT regexp_replace(regexp_replace(r, '([က-အ])([်္])', chr(1) || '\\1\\2', 'g'), '(္)([က-အ])', '\\1' || chr(1) || '\\2', 'g') AS r FROM r),
b AS (SELECT regexp_replace(r, '(' || chr(1) || '?[က-အဣ-ဪဿ၌-၏]|[၀-၉]+|[၊။])', chr(2) || '\\1', 'g') AS r FROM a),
s AS (SELECT unnest(string_split(replace(replace(r, chr(2) || chr(1), ''), chr(1), ''), chr(2))) AS syllable FROM b)
SELECT syllable, count(*) AS n FROM s WHERE syllable <> '' GROUP BY syllable""",
        "normalized_texts": f"SELECT DISTINCT report_id, length(t) AS chars, md5(t) AS digest FROM (SELECT report_id, nfc_normalize(translate(text, {_INVISIBLE}, '')) AS t FROM paragraph_reports WHERE text IS NOT NULL)",
        "legacy_hints": "SELECT source, count(*) AS n, sum(CAST(regexp_matches(text, '[ၚၠ-႗]|္([^က-အ]|$)|(^|[^က-အျ-ှ])[ေျ]|ေေ|််') AS INT)) AS legacy FROM paragraph_reports WHERE text IS NOT NULL GROUP BY source",
        "rewrite_categories": """
WITH r AS (SELECT unnest(repairs) AS r FROM paragraph_reports), x AS (SELECT r.matched_text AS a, r.replacement_text AS b FROM r)
SELECT CASE WHEN length(a) <> length(b) THEN 'length_change' WHEN list_sort(string_split(a, '')) = list_sort(string_split(b, '')) AND a <> b THEN 'reorder' ELSE 'substitution' END AS category, count(*) AS n FROM x GROUP BY 1""",
        "paragraph_sizes": "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\n+'), lambda p: trim(p) <> '')) AS paragraphs, strlen(text) AS bytes, length(text) AS chars FROM documents WHERE text IS NOT NULL",
        "lexicon_lookup": f"""
WITH lex(word, tags) AS (VALUES {sql.lexicon_rows()}), docs AS ({_DOCS}), w AS (SELECT unnest(words) AS word FROM docs), c AS (SELECT word, count(*) AS n FROM w GROUP BY word)
SELECT c.word, c.n, lex.tags FROM c JOIN lex ON c.word = lex.word""",
        "gazetteer_lookup": "SELECT e.entity_type, count(*) AS hits, count(DISTINCT h.text) AS names FROM (SELECT DISTINCT hit_id, text FROM gazetteer_hits) h JOIN gazetteer_entries e ON e.name = h.text GROUP BY e.entity_type",
        "neighbour_features": f"""
WITH docs AS ({_DOCS}), p AS (SELECT parsed_id, unnest(words) AS item, generate_subscripts(words, 1) AS i FROM docs WHERE words IS NOT NULL),
f AS (SELECT item, i, lag(item) OVER w AS l, lead(item) OVER w AS r, lead(i) OVER w AS nx FROM p WINDOW w AS (PARTITION BY parsed_id ORDER BY i))
SELECT item, count(*) AS n, count(DISTINCT l) AS lefts, count(DISTINCT r) AS rights, sum(CAST(i = 1 AS INT)) AS "first", sum(CAST(nx IS NULL AS INT)) AS "last" FROM f GROUP BY item""",
        "boundary_scores": f"""{_GOLD}, {_PLACES}, {_SETS},
c AS (SELECT source, sum(CAST(a AND b AS INT)) AS tp, sum(CAST(b AND NOT a AS INT)) AS fp, sum(CAST(a AND NOT b AS INT)) AS fn FROM (SELECT coalesce(g.source, h.source) AS source, g.pos IS NOT NULL AS a, h.pos IS NOT NULL AS b FROM g FULL JOIN h ON g.parsed_id = h.parsed_id AND g.pos = h.pos) GROUP BY source),
e AS (SELECT DISTINCT source FROM w), r AS (SELECT e.source, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM e LEFT JOIN c ON e.source IS NOT DISTINCT FROM c.source),
z AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END::DOUBLE AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END::DOUBLE AS recall FROM r)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END::DOUBLE AS f1 FROM z""",
        "stratified_scores": f"""{_GOLD}, lex(word, tags) AS (VALUES {sql.lexicon_rows()}), {_PLACES}, {_SETS},
k AS (SELECT q.*, q.word IN (SELECT word FROM lex) AS iv, lead(q.word) OVER (PARTITION BY parsed_id ORDER BY i) IN (SELECT word FROM lex) AS next_iv FROM q),
j AS (SELECT parsed_id, stop AS pos, bool_or(iv) AS iv, bool_or(next_iv) AS next_iv FROM k WHERE i < n GROUP BY parsed_id, stop),
x AS (SELECT coalesce(g.parsed_id, h.parsed_id) AS parsed_id, coalesce(g.pos, h.pos) AS pos, g.pos IS NOT NULL AS a, h.pos IS NOT NULL AS b FROM g FULL JOIN h ON g.parsed_id = h.parsed_id AND g.pos = h.pos),
y AS (SELECT x.*, CASE WHEN a THEN (SELECT iv AND next_iv FROM j WHERE j.parsed_id = x.parsed_id AND j.pos = x.pos) ELSE (SELECT iv FROM k WHERE k.parsed_id = x.parsed_id AND k.start < x.pos AND x.pos < k.stop) END AS known FROM x),
c AS (SELECT known, sum(CAST(a AND b AS INT)) AS tp, sum(CAST(b AND NOT a AS INT)) AS fp, sum(CAST(a AND NOT b AS INT)) AS fn FROM y GROUP BY known),
s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END::DOUBLE AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END::DOUBLE AS recall FROM c)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END::DOUBLE AS f1 FROM s""",
        "disagreements": f"{_MERGED} SELECT * FROM x",
        "disagreement_categories": f"""{_MERGED}, y AS (SELECT direction, CASE WHEN crosses_punctuation OR regexp_matches(compound, '[0-9၀-၉]') THEN 'date_number' WHEN regexp_matches(compound, '(မှု|ရေး|ခြင်း|စရာ|နိုင်|ခွင့်)$') THEN 'productive_derivation'
  WHEN compound IN (SELECT name FROM gazetteer_entries) THEN 'proper_noun' ELSE 'genuine_compound' END AS category FROM x) SELECT direction, category, count(*) AS n FROM y GROUP BY direction, category""",
        "disagreement_sample": f"""{_MERGED}, o AS (SELECT parsed_id, position, direction, row_number() OVER (ORDER BY parsed_id, position, direction) - 1 AS k, count(*) OVER () AS c FROM x),
s AS (SELECT *, row_number() OVER (PARTITION BY parsed_id ORDER BY k) AS r FROM o WHERE k % greatest(1, c // 400) = 0) SELECT parsed_id, position, direction FROM s WHERE r = 1 ORDER BY k LIMIT 20""",
        "segmentation_diff": f"""{_MERGED}, y AS (SELECT gb.parsed_id, gb.pos, 'a' AS side FROM gb ANTI JOIN mb USING (parsed_id, pos) UNION ALL SELECT mb.parsed_id, mb.pos, 'b' FROM mb ANTI JOIN gb USING (parsed_id, pos))
SELECT y.parsed_id, pos AS position, side AS "only", substr(t, greatest(pos - 8, 0) + 1, least(pos, 8)) || '[' || side || ']' || substr(t, pos + 1, 8) AS context FROM y JOIN t ON t.parsed_id = y.parsed_id""",
        "collapse_stats": f"WITH s AS (SELECT DISTINCT span FROM candidate_keys WHERE span IS NOT NULL) SELECT count(*) AS raw, count(DISTINCT {sql.canonical('span')}) AS canonical, count(*) - count(DISTINCT {sql.canonical('span')}) AS collapsed FROM s",
        "canonical_variants": f"WITH s AS (SELECT DISTINCT span FROM candidate_keys WHERE span IS NOT NULL), c AS (SELECT {sql.canonical(sql.normal('span'))} AS canonical FROM s) SELECT canonical, count(*) AS variants FROM c GROUP BY canonical HAVING count(*) > 1",
        "known_words": f"""WITH docs AS ({_DOCS}), lex(word, tags) AS (VALUES {sql.lexicon_rows()}), w AS (SELECT DISTINCT unnest(words) AS word FROM docs), c AS (SELECT word, {sql.canonical(sql.normal('word'))} AS canonical FROM w WHERE word IS NOT NULL)
SELECT word, canonical, canonical IN (SELECT {sql.canonical('word')} FROM lex) AS known FROM c""",
        "spelling": f"""WITH docs AS ({_DOCS}), lex(word, tags) AS (VALUES {sql.lexicon_rows()}), l AS (SELECT DISTINCT {sql.canonical('word')} AS entry FROM lex), w AS (SELECT DISTINCT unnest(words) AS word FROM docs),
c AS (SELECT word, {sql.canonical(sql.normal('word'))} AS key FROM w WHERE word IS NOT NULL), u AS (SELECT DISTINCT key FROM c WHERE key <> '' AND key NOT IN (SELECT entry FROM l)),
m AS (SELECT key, entry, damerau_levenshtein({sql.one_byte('key')}, {sql.one_byte('entry')}) AS dist FROM u JOIN l ON abs(length(key) - length(entry)) <= 2), b AS (SELECT key, min(dist) AS dist FROM m WHERE dist <= 2 GROUP BY key),
s AS (SELECT key, array_to_string(list_sort(list(entry))[1:5], ',') AS s FROM m JOIN b USING (key, dist) GROUP BY key) SELECT word, coalesce(s, '') AS suggestions FROM c LEFT JOIN s USING (key)""",
        "script_runs": f"{sql.script_runs('SELECT text FROM documents WHERE text IS NOT NULL')} SELECT script, count(*) AS runs, sum(length(r)) AS chars FROM s GROUP BY script",
        "tokens_by_script": f"{sql.script_runs('SELECT text FROM (SELECT DISTINCT fert_id, text FROM fertility_results WHERE text IS NOT NULL)')} SELECT script, count(*) AS runs, sum(strlen(r)) AS tokens FROM s GROUP BY script",
        "word_counts": f"""WITH RECURSIVE src AS (SELECT row_number() OVER () AS id, t, n FROM (SELECT {sql.normal('text')} AS t, count(*) AS n FROM sentence_rows WHERE text IS NOT NULL GROUP BY 1)), {sql.words('src')}
SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cover JOIN src USING (id) GROUP BY word""",
        "document_stats": f"""WITH RECURSIVE docs AS ({_DOCS}), src AS (SELECT parsed_id AS id, {sql.normal('raw_text')} AS t FROM docs WHERE raw_text IS NOT NULL), {sql.words('src')},
wc AS (SELECT id, count(*) AS n FROM cover GROUP BY id), sc AS (SELECT id, count(*) AS n FROM tok2 GROUP BY id)
SELECT src.id AS parsed_id, length(t) AS char_count, coalesce(sc.n, 0) AS syllable_count, coalesce(wc.n, 0) AS word_count, coalesce(sc.n, 0) / greatest(coalesce(wc.n, 0), 1) AS avg_syllables_per_word FROM src LEFT JOIN wc USING (id) LEFT JOIN sc USING (id)""",
        "denominators": f"""WITH RECURSIVE f AS (SELECT DISTINCT fert_id, text FROM fertility_results WHERE text IS NOT NULL), g AS (SELECT row_number() OVER () AS id, fert_id, {sql.normal(sql.canonical('text'))} AS t FROM f), src AS (SELECT id, t FROM g), {sql.words('src')},
wc AS (SELECT id, count(*) AS n FROM cover GROUP BY id), sc AS (SELECT id, count(*) AS n FROM tok2 GROUP BY id)
SELECT fert_id, strlen(t) AS bytes, length(t) AS chars, coalesce(sc.n, 0) AS syllables, coalesce(wc.n, 0) AS words, strlen(t) AS utf8_bytes, length(t) AS code_points FROM g LEFT JOIN wc USING (id) LEFT JOIN sc USING (id)""",
        "token_ratios": f"""WITH f AS (SELECT DISTINCT fert_id, lang, text FROM fertility_results WHERE text IS NOT NULL), g AS (SELECT lang, {sql.normal(sql.canonical('text'))} AS t FROM f),
x AS (SELECT lang, strlen(t)::DOUBLE / len(list_filter({sql.tokens('t')}, lambda y: y <> chr(3))) AS x FROM g WHERE len(list_filter({sql.tokens('t')}, lambda y: y <> chr(3))) > 0)
SELECT lang, count(*) AS n, avg(x) AS mean, min(x) AS least, quantile_cont(x, 0.1) AS p10, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS p75, quantile_cont(x, 0.9) AS p90, max(x) AS most, max(x) - min(x) AS spread FROM x GROUP BY lang""",
        "sentence_spans": f"WITH docs AS ({_DOCS}) SELECT parsed_id, CASE WHEN len(list_filter({sql.tokens(sql.normal('raw_text'))}, lambda x: x <> chr(3))) > 0 THEN length({sql.normal('raw_text')}) ELSE 0 END AS chars, true AS whole FROM docs WHERE raw_text IS NOT NULL",
        "entities": _entity_sql(),
        "legacy_patterns": "SELECT source, count(*) AS n, sum(CAST(regexp_matches(text, '[ၚၠ-႗]|(^|[^က-အျ-ှ])[ေျ]|ေေ|််') AS INT)) AS hinted FROM paragraph_reports WHERE text IS NOT NULL GROUP BY source",
        "syllable_features": f"""WITH s AS (SELECT DISTINCT cand_id, span FROM candidate_keys WHERE span IS NOT NULL), k AS (SELECT row_number() OVER () AS id, list_filter({sql.tokens(sql.normal('span'))}, lambda x: x <> chr(3)) AS ws FROM s),
p AS (SELECT id, unnest(ws) AS y, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM k), f AS (SELECT *, lag(y) OVER (PARTITION BY id ORDER BY i) AS l, lead(y) OVER (PARTITION BY id ORDER BY i) AS r FROM p),
b AS (SELECT *, CASE WHEN length(y) >= 2 THEN substr(y, length(y) - 1, 2) END AS two FROM f)
SELECT y AS syllable, count(*) AS n, sum(CAST(regexp_matches(y, '[ျ-ှ]') AS INT)) AS has_medial, sum(CAST(regexp_matches(y, '[ါ-ဲ]') AS INT)) AS has_vowel_sign, sum(CAST(regexp_matches(y, '[့း]') AS INT)) AS has_tone, sum(CAST(contains(y, '်') AS INT)) AS has_asat, sum(CAST(contains(y, '္') AS INT)) AS has_stacked,
  sum(CAST(i = 1 AS INT)) AS bos, sum(CAST(i = n AS INT)) AS eos, count(DISTINCT l) AS lefts, count(DISTINCT r) AS rights, max(two) AS bigram_last FROM b GROUP BY y""",
        "legacy_converted": f"SELECT DISTINCT report_id, {sql.legacy_to_standard('text')} AS standard FROM paragraph_reports WHERE regexp_matches(text, '[ၚၠ-႗]|္([^က-အ]|$)|(^|[^က-အျ-ှ])[ေျ]|ေေ|််')",
        "tag_cases": f"SELECT * FROM (VALUES {_values((i, j, x) for i, (_, want) in enumerate(TAG_CASES) for j, x in enumerate(want) if x)}) AS t(k, i, tag)",
        "tag_histogram_by_word": f"""WITH docs AS ({_DOCS}), w AS (SELECT unnest(words) AS word FROM docs WHERE words IS NOT NULL) SELECT word, CASE WHEN regexp_full_match(word, '[!-/:-@\\[-`{{-~]+|[၊။]') THEN 'PUNCT' WHEN regexp_full_match(word, '[0-9၀-၉]+') THEN 'NUM' ELSE 'FW' END AS tag, count(*) AS n
FROM w WHERE regexp_full_match(word, '[!-/:-@\\[-`{{-~]+|[၊။]|[0-9၀-၉]+|[A-Za-z]+') GROUP BY 1, 2""",
        "phrase_cases": f"SELECT * FROM (VALUES {_values((i, x) for i, (_, _, want) in enumerate(PHRASE_CASES) for x in want)}) AS t(k, phrase)",
        "clause_cases": f"SELECT * FROM (VALUES {_values((i, x) for i, (_, _, want) in enumerate(CLAUSE_CASES) for x in want)}) AS t(k, clause)",
        "latin_cases": f"SELECT * FROM (VALUES {_values(LATIN_CASES)}) AS t(name, latin)",
        "legacy_cases": f"SELECT *, standard AS there_and_back FROM (VALUES {_values(LEGACY_CASES)}) AS t(legacy, standard)",
        "stop_sentences": f"""
WITH docs AS ({_DOCS}), p AS (SELECT parsed_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM docs WHERE words IS NOT NULL),
s AS (SELECT parsed_id, coalesce(sum(CAST(coalesce(w IN ('။', '.', '!', '?', '…'), false) AS INT)) OVER (PARTITION BY parsed_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM p)
SELECT parsed_id, sentence, count(*) AS words FROM s GROUP BY parsed_id, sentence""",
        "fertility_distribution": """
WITH f AS (SELECT DISTINCT fert_id, lang, text, denominators.words AS w FROM fertility_results), x AS (SELECT lang, strlen(text)::DOUBLE / w AS x FROM f WHERE w > 0 AND text IS NOT NULL)
SELECT lang, count(*) AS n, avg(x) AS mean, min(x) AS least, quantile_cont(x, 0.1) AS p10, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS p75, quantile_cont(x, 0.9) AS p90, max(x) AS most, max(x) - min(x) AS spread FROM x GROUP BY lang""",
        "recorded_tokens": "SELECT source, e.key AS scheme, count(*) AS n, sum(e.value) AS tokens FROM (SELECT fert_id, source, unnest(map_entries(whole_document_tokens)) AS e FROM (SELECT DISTINCT fert_id, source, whole_document_tokens FROM fertility_results)) GROUP BY source, e.key",
        "conll_lines": f"""
WITH docs AS ({_DOCS}) SELECT parsed_id, array_to_string(list_transform(range(1, len(words) + 1), lambda i: i::VARCHAR || chr(9) || words[i] || chr(9) || '_' || chr(9) || tags[i] || chr(9) || '_'), chr(10)) AS conll
FROM docs WHERE words IS NOT NULL AND tags IS NOT NULL""",
        "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    }
