"""Cases of the language operators that need whole inputs: repair, entities, grammar, records, spelling, fertility, bench."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from thazin.__main__ import main
from thazin.api import Analyzer
from thazin.functions import native
from thazin.kernels import analysis, grammar, records, repair, spelling, syntax
from thazin.kernels import text as T
from thazin.kernels.entities import Entities
from thazin.kernels.lexicon import Lexicon, LexiconError
from thazin.operators import evaluation, text
from thazin.plans import queries
from thazin.sources import export


def test_any_letter_carries_marks():
    assert T.canonical_order("ၵာေ") == "ၵော" and T.canonical_order("xာေ") == "xော"
    assert T.canonical_order("ယောက်ျား") == "ယောက်ျား" and T.canonical_order("င္်က") == "င်္က"
    assert T.canonical_order("ောက") == "ောက"  # marks without a letter stay


def test_log_goes_back_to_the_original():
    new, log = repair.convert_logged("ျမန္မာစာေပ")
    assert new == "မြန်မာစာပေ" and log and all("ျမန္မာစာေပ"[r["origin_start"] : r["origin_end"]] for r in log if r["matched_text"])
    assert {r["category"] for r in log} <= {"length_change", "reorder", "substitution"}


def test_report_keeps_separators_and_invisible_characters():
    r = repair.repair_report("abc\n\n ျမန္မာ \ufeffx\n\n\nx", lambda p: 0.9 if "မ" in p else float("-inf"))
    assert r["text"].startswith("abc\n\n ") and r["text"].endswith("\n\n\nx") and "\ufeff" in r["text"]
    assert [p["converted"] for p in r["paragraphs"]] == [False, True, False] and r["summary"] == {"min": 0.9, "max": 0.9, "spread": 0.0}
    assert repair.repair_report("x", lambda p: float("-inf"))["summary"] == {"min": None, "max": None, "spread": None}
    assert repair.standard("ျမန္မာ", lambda t: 0.95) == "မြန်မာ" and repair.standard("ျမန္မာ", lambda t: 0.5) == "ျမန္မာ"


def test_binary_model(tmp_path):
    m = repair.MarkovModel
    size = sum(b - a + 1 for a, b in m.RANGES) + 1
    rows = b"".join(struct.pack(">h", 0) if i != 1 else struct.pack(">hfhf", 1, 0.0, 2, -3.0) for i in range(size))
    path = tmp_path / "m.dat"
    path.write_bytes(b"UZMODEL " + struct.pack(">ii", 2, 1) + b"BMARKOV " + struct.pack(">ih", 0, size) + rows)
    model = m.read(str(path))
    assert model.probability("ကခ") == pytest.approx(1 / (1 + 2.718281828 ** -3.0)) and model.probability("abc") == float("-inf")
    path.write_bytes(b"nonsense" + bytes(40))
    with pytest.raises(ValueError):
        m.read(str(path))


@pytest.fixture(scope="module")
def names(tmp_path_factory):
    d = tmp_path_factory.mktemp("names")
    for name, data in {"towns": ["ရန်ကုန်", "ရေး"], "villages": ["မြင်သာ"], "male_names": ["ကျော်ကျော်ထက်"], "religions": ["ဗုဒ္ဓဘာသာ"], "holidays": {"holidays": [{"name": "လွတ်လပ်ရေးနေ့", "date": "၄ ဇန်နဝါရီ"}]}, "metadata": {}}.items():
        (d / f"{name}.json").write_text(json.dumps(data, ensure_ascii=False), encoding="utf-8")
    return Entities.load(str(d))


def test_entities(names):
    assert "ရန်ကုန်" in names and names.lookup("ကျော်ကျော်ထက်")[0][1:] == ("PERSON", {"gender": "male", "source": "male_names"}) and names.lookup("လွတ်လပ်ရေးနေ့")[0][2]["date"] == "၄ ဇန်နဝါရီ"
    cut = lambda *ws: [s for w in ws for s in T.syllables(w)]
    assert [h.text for h in names.find(["ဦး", *cut("ကျော်ကျော်ထက်")])] == ["ဦးကျော်ကျော်ထက်"]
    assert [h.text for h in names.find(["ဦးကျော်ကျော်ထက်", "လာ"])] == ["ဦးကျော်ကျော်ထက်"]
    assert names.find(["ရေး", "သည်"], ["VERB", "SFP"]) == [] and names.find(cut("မြင်သာ", "သည်"), ["VERB", "VERB", "SFP"]) == []
    assert [h.kind for h in names.find(["ရေး", "မှာ"], ["NOUN", "POSTP"])] == ["TOWN"]
    assert [h.text for h in names.find([*cut("ရန်ကုန်"), "က"], ["NOUN", "NOUN", "POSTP"])] == ["ရန်ကုန်"]
    assert names.find(["x", *cut("ဗုဒ္ဓဘာသာ"), "y"], ["NOUN"] * (len(cut("ဗုဒ္ဓဘာသာ")) + 2)) == []
    with pytest.raises(ValueError):
        names.find(["a"], [])
    with pytest.raises(FileNotFoundError):
        Entities.load("/nowhere")


def test_cases_of_tags_phrases_clauses_and_letters():
    lex = Lexicon.seed()
    for words, want in queries.TAG_CASES:
        assert all(w in (None, t) for w, t in zip(want, analysis.pos_tags(words, lex))), words
    assert analysis.pos_tags(["သွား", "က", "စား"], lex)[0] == "VERB"
    for words, tags, want in queries.PHRASE_CASES:
        assert [f"{c[0]} {c[2]} {c[3]}" for c in analysis.chunks(words, tags)] == want
    for words, tags, want in queries.CLAUSE_CASES:
        assert [f"{c[0]} {c[1]} {c[2] or '-'}" for c in syntax.clauses(words, analysis.chunks(words, tags), (0, len(words)))] == want


def test_relative_clauses_nest_and_purposes_get_a_part():
    words, tags = ["ကျောင်း", "မှာ", "သင်", "တဲ့", "ဆရာ"], ["NOUN", "POSTP", "VERB", "PART", "NOUN"]
    phrases, _ = syntax.parsed(words, analysis.chunks(words, tags), (0, 5))
    assert [(d, p.kind, p.part) for d, p in syntax.flat(phrases)] == [(0, "NP", None), (1, "VP", "RelativeModifier"), (2, "PP", None), (2, "VP", None), (1, "NP", "HeadNoun")]
    phrases, found = syntax.parsed(["ဖတ်", "ရန်"], analysis.chunks(["ဖတ်", "ရန်"], ["VERB", "PART"]), (0, 2))
    assert found == [] and phrases[0].part == "PurposeVP"
    assert syntax.matches(["ADJP", "NP", "VP"], ["NP VP"]) and not syntax.matches(["NP"], ["NP VP"]) and syntax.matches(["NP", "PP", "VP"], ["(NP|PP)+ VP"]) and syntax.matches(["X"], [])


def test_grammar():
    g = grammar.Grammar([("VP", 10, ["ADV? VERB AUX* SFP?"]), ("PP", 5, ["NOUN_PHRASE POSTP"]), ("NP", 1, ["(NOUN|PRON)+", "word=ဟေ့"])], {})
    at = lambda w, t: [(c[0], c[2], c[3]) for c in analysis.chunks(w, t, (), g)]
    assert at(["ပို", "လုပ်", "ထား", "တယ်"], ["ADV", "VERB", "AUX", "SFP"]) == [("VP", 0, 3)] and at(["ဟေ့", "x"], ["UNK", "UNK"]) == [("NP", 0, 0)]
    for bad in ("NOPE", "NOUN_PHRASE* VERB", "(NOUN_PHRASE|VERB)", "NOUN )", "  "):
        with pytest.raises(grammar.GrammarError):
            grammar.Grammar([("NP", 1, ["NOUN"]), ("X", 1, [bad])])
    assert analysis.chunks(["a", "b"], ["NOUN", "NOUN"], [(0, 0)]) == [("NP", "a", 0, 0), ("NP", "b", 1, 1)]


def test_units_from_files(tmp_path):
    lex = Lexicon({"က": ["NOUN"], "ခဂ": ["NOUN"]})
    (tmp_path / "idioms.json").write_text(json.dumps(["ကခဂ", {"text": "ခဂက", "priority": 3, "category": "PERSON"}, "က"], ensure_ascii=False), encoding="utf-8")
    u = analysis.Units.from_file(str(tmp_path / "idioms.json"), lex)
    assert u.merge(["က", "ခဂ", "က"])[1] == [("ကခဂ", "IDIOM", 0, 1, 0)] and analysis.Units.category("/x/org/y.txt") == "ORGANIZATION" and analysis.Units.category("a") == "MWE"
    refused = analysis.Units([(("က", "ခဂ"), "MWE", 0)], valid=lambda seq, a, b: False)
    assert refused.merge(["က", "ခဂ"])[0] == ["က", "ခဂ"]
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(LexiconError):
        analysis.Units.from_file(str(tmp_path / "bad.json"), lex)


def test_default_lexicon_unites_files(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"စာ": ["VERB"], "က": ["NOUN"]}, ensure_ascii=False), encoding="utf-8")
    lex = Lexicon.default(str(tmp_path))
    assert lex.tags("စာ") == ("VERB", "NOUN") and "NOUN" not in lex.tags("က") and "ဃ" in lex.with_word("ဃ", ["NOUN"])


@pytest.mark.parametrize("a, b, d", [("ca", "abc", 2), ("ab", "ba", 1), ("abc", "abc", 0), ("", "ab", 2), ("abcd", "a", 3), ("abcdef", "ghijkl", 3)])
def test_distance(a, b, d):
    assert spelling.distance(a, b) == spelling.distance(b, a) == d


def test_spelling_at_two_edits_and_corrections(spark):
    lex = spark.createDataFrame([("ကျောင်း",), ("abc",), ("xyz",)], "word string")
    ask = spark.createDataFrame([(1, ["ca", "abc", "qqq", None, ""]), (2, None)], "id long, w array<string>")
    r = {x.id: x.corrected for x in evaluation.corrected(ask, "w", lex, "id").collect()}
    assert r[1] == ["abc", "abc", "qqq", None, ""] and r[2] is None
    k = {x.word: x.known for x in evaluation.known_words(spark.createDataFrame([("ကေျာင်း",), ("xyzz",)], "word string"), lex).collect()}
    assert k == {"ကေျာင်း": True, "xyzz": False}


def test_process_and_records(spark):
    df = spark.createDataFrame([(1, "သူသည် စာဖတ်သည်။ hello ရေးမှာ"), (2, ""), (3, None), (4, "  \n")], "id long, t string")
    out = {r.id: r.d for r in text.processed(df, "t", entities=[("ရေး", "TOWN", {"source": "x"})], out="d").collect()}
    d = out[1]
    assert "".join(s.text for s in d.sentences) == d.text and [d.text[s.start : s.end] for s in d.spans] == d.words and out[3] is None and out[2].words == []
    assert [(e.text, e.attributes) for e in d.entities] == [("ရေး", {"source": "x"})] and d.tags[d.entities[0].first] == "PROPN"
    s = text.processed(df, "t").select("id", text.stats(F.col("document")).alias("s")).where("id = 2").first().s
    assert s.word_count == 0 and s.avg_words_per_sentence == 0
    r = text.recorded(df, "t").where("t is not null").select("id", "records", export.standoff_of(F.col("records")).alias("s"), export.tasks_of(F.col("records")).alias("k"), export.json_of(F.col("records")).alias("j"))
    one = r.where("id = 1").first()
    for line in one.s.annotations.splitlines():
        _, place, mention = line.split("\t")
        a, b = map(int, place.split()[1:])
        assert one.s.text[a:b] == mention
    assert [json.loads(k)["data"]["text"] for k in one.k] == [x.text for x in one.records] and "relation" in one.j
    ids = [x.id for x in export.renumbered(text.recorded(df, "t"), "id", "records").orderBy("id").collect()]
    assert ids == list(range(len(ids)))


def test_token_spans_fall_back():
    assert records.token_spans("ab c", ["ab", "", "c", "zz"]) == [(0, 2), (2, 2), (3, 4), (4, 4)]


def test_measures(spark):
    df = spark.createDataFrame([("a", "GDP 5% မြန်မာ"), ("a", None), ("b", "")], "k string, text string")
    m = evaluation.measured(df, "text", {"chars": len})
    r = m.where("text like 'GDP%'").first()
    assert r.denominators.bytes == 25 and r.tokens["chars"] == 13 and [x.script for x in r.runs] == ["latin", "digit", "punctuation", "myanmar"] and sum(x.tokens["chars"] for x in r.runs) == 13
    q = {x.k: x for x in evaluation.ratios(m, "chars").select("k", "text", "tokens_per_word", "tokens_per_char").collect() if x.text is not None}
    assert q["a"].tokens_per_char == 1.0 and q["b"].tokens_per_char is None
    d = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", 4.0), ("b", 7.0), ("c", None), (None, 3.0)], "k string, x double")
    s = {x.k: x for x in evaluation.distribution(d, "x", "k").collect()}
    assert (s["a"].n, s["a"].mean, s["a"].median, s["a"].p25, s["a"].spread) == (4, 2.75, 3.0, 1.75, 3.0) and s["b"].p90 == 7.0 and s[None].n == 1 and "c" not in s


def test_bench(spark, tmp_path):
    d = spark.createDataFrame([(1, ["ab", "cd", "e1"], ["abcd", "e", "1"], ["a", "b", "cd", "e1"]), (2, [], ["x"], ["x"]), (3, None, None, None)], "id long, gold array<string>, merged array<string>, plain array<string>")
    lex = spark.createDataFrame([("ab",), ("cd",)], "word string")
    s = {x.known: (x.tp, x.fp, x.fn) for x in evaluation.stratified_scores(d, "id", "gold", "merged", lex).collect()}
    assert s == {True: (0, 0, 1), False: (1, 1, 0)}
    f = {(x.position, x.direction): x for x in evaluation.disagreements(d, "id", "gold", "plain", "merged").collect()}
    assert set(f) == {(2, "merged_gold_split")} and f[2, "merged_gold_split"].span_text == "ab|cde1"
    c = evaluation.categories(spark.createDataFrame([("a၊b", True), ("x5", False), ("လုပ်ရေး", False), ("ရန်ကုန်", False), ("က", False)], "compound string, crosses_punctuation boolean"), spark.createDataFrame([("ရန်ကုန်",)], "name string"))
    assert {x.compound: x.category for x in c.collect()} == {"a၊b": "date_number", "x5": "date_number", "လုပ်ရေး": "productive_derivation", "ရန်ကုန်": "proper_noun", "က": "genuine_compound"}
    assert {(x.position, x.only) for x in evaluation.differences(d.where("id = 1"), "id", "gold", "merged").collect()} == {(2, "a"), (5, "b")}
    with pytest.raises(ValueError):
        evaluation.aligned(d.select("id", "gold"), d.select("id", F.col("plain").alias("gold")).where("id = 2"), "id", "gold")
    assert evaluation.collapse(spark.createDataFrame([(["ကေျ", "ကျေ"],)], "w array<string>"), "w").first()[:] == (2, 1, 1)
    n = evaluation.numbered(spark.range(50).select((F.col("id") * 7 % 50).alias("x")), "x").orderBy("x").collect()
    assert [r.n for r in n] == list(range(50))
    path = str(tmp_path / "v")
    assert evaluation.frozen_vocabulary(d, "gold", path) and not evaluation.frozen_vocabulary(d, "gold", path)
    evaluation.log_run(str(tmp_path / "log"), f1=1.0)
    assert json.loads((tmp_path / "log").read_text())["f1"] == 1.0
    assert {r.stratum for r in evaluation.report(d, "id", "gold", "merged", lex).collect()} == {"all", "in_lexicon", "out_of_lexicon"}


def test_compound_lines_and_sentences_by_stops(spark):
    g = export.gold_compounds(spark.createDataFrame([("အ/n အက/n|အခ/v ။/punc x",)], "value string")).first()
    assert g.words == ["အ", "အကအခ", "။", "x"] and g.tags == ["n", "n", "punc", None]
    assert export.segmented_lines(spark.createDataFrame([("ab cd",), (" ",)], "value string")).collect()[0].words == ["ab", "cd"]
    s = spark.createDataFrame([(["a", "။", "b", "?!", None],), ([],), (None,)], "w array<string>").select(native.stop_sentences(F.col("w")).alias("s")).collect()
    assert s[0].s == [["a", "။"], ["b", "?!"], [None]] and s[1].s == [] and s[2].s is None
    assert [tuple(x) for x in spark.range(1).select(native.spans(F.array(F.lit("ab"), F.lit("c"))).alias("s")).first().s] == [(0, 2), (2, 3)]


def test_analyzer(spark, tmp_path):
    (tmp_path / "towns.json").write_text(json.dumps(["ရန်ကုန်"], ensure_ascii=False), encoding="utf-8")
    nlp = Analyzer(entities=str(tmp_path)).with_word("ခဂ", ["NOUN"])
    df = spark.createDataFrame([(1, "သူသည် ရန်ကုန်မှာ ခဂ ဖတ်သည်။"), (2, None)], "id long, t string")
    w = nlp.tags(nlp.words(df, "t"), "words").collect()
    assert "ခဂ" in w[0].words and len(w[0].tags) == len(w[0].words) and w[1].words is None
    assert nlp.sentences(df, "t").first().sentences[0].start == 0 and nlp.stats(df, "t").first().stats.word_count > 3
    assert [e.type for e in nlp.process(df, "t").first().document.entities] == ["TOWN"] and nlp.chunk(df, "t").first().chunks
    assert nlp.phrases(spark.createDataFrame([(["a", "b"], ["NOUN", "POSTP"])], "w array<string>, t array<string>"), "w", "t").first().chunks[0].type == "PP"
    assert nlp.features(df, "id", "t").where("bos").first().syllable == "သူ" and df.select(nlp.syllables(F.col("t")).alias("s")).first().s[0] == "သူ"
    with pytest.raises(ValueError):
        nlp.words(df, "t", engine="none")
    runs = df.select(native.placed_runs(F.lit("ab 12 မာ ")).alias("r")).first().r
    assert [(r.script, r.start, r.end) for r in runs] == [("latin", 0, 2), ("digit", 2, 5), ("myanmar", 5, 8), ("whitespace", 8, 9)]
    nlp.save_dictionary(str(tmp_path / "d.json"))
    assert "ခဂ" in Analyzer(dictionary_path=str(tmp_path / "d.json")).lexicon


@pytest.mark.parametrize("mode", ["syllables", "words", "pos", "sentences", "all", "zg2uni", "uni2zg", "fertility", "bench"])
def test_command_line(spark, tmp_path, mode):
    (tmp_path / "in.txt").write_text("သူ/pron စာ/n ဖတ်/v သည်/ppm\n" if mode == "bench" else "သူစာဖတ်သည်။\n", encoding="utf-8")
    assert main([mode, str(tmp_path / "in.txt"), str(tmp_path / "out")]) == 0
    assert spark.read.json(str(tmp_path / "out")).count() >= 1
    (tmp_path / "bad.txt").write_text("x\n", encoding="utf-8")
    assert main(["words", str(tmp_path / "in.txt"), str(tmp_path / "out2"), "--dictionary", str(tmp_path / "bad.txt")]) == 2
