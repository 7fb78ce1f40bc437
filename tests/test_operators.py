import pytest
from pyspark.sql import functions as F

from thazin.functions import native
from thazin.kernels import text as T
from thazin.operators import evaluation, text
from thazin.sources import export
from thazin.streaming.counters import windowed_counts

TEXTS = ["မြန်မာစာပေ", "ကျွန်တော် ၁၂ ok။", "ျမန္မာစာေပ", "", None, "အင်္ဂလိပ်၊ abc!", "ဥ် ၀င်း"]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string").repartition(3)


def test_native_forms_equal_the_kernels(df):
    rows = df.select("t", native.syllables(native.normalized(F.col("t"))).alias("s"), native.legacy_to_standard(F.col("t")).alias("l"), native.standard_to_legacy(F.col("t")).alias("z"), native.is_legacy(F.col("t")).alias("i"), text.normalized(F.col("t")).alias("n")).collect()
    for r in rows:
        if r.t is None:
            assert r.s is None and r.l is None and r.i is None and r.n is None
            continue
        assert r.s == T.syllables(r.t) and r.n == T.normalize(r.t)
        assert r.l == T.legacy_to_standard(r.t) and r.z == T.standard_to_legacy(r.t) and r.i == T.is_legacy(r.t)


def test_script_runs_cover_the_text(df):
    for r in df.where("t is not null").select("t", native.script_runs(F.col("t")).alias("r")).collect():
        assert "".join(x.text for x in r.r) == r.t


def test_process(df, spark):
    out = {r.id: r.document for r in text.processed(df, "t", entities=[("စာပေ", "TOWN", {})]).collect()}
    assert out[4] is None and out[3].words == [] and "PROPN" in out[0].tags


def test_boundaries(spark):
    d = spark.createDataFrame([("a", ["ab", "cd"], ["abcd"]), ("a", ["x"], None), ("b", ["a", "b"], ["a", "b"])], "k string, g array<string>, h array<string>")
    r = {x.k: x for x in evaluation.boundary_scores(d, "g", "h", "k").collect()}
    assert (r["a"].tp, r["a"].fp, r["a"].fn, r["a"].f1) == (0, 0, 1, 0.0) and r["b"].f1 == 1.0


def test_spelling(spark):
    lex = spark.createDataFrame([("abc",), ("abd",), ("zz",)], "word string")
    ask = spark.createDataFrame([("acb",), ("abc",), ("abx",), ("qqq",), (None,)], "word string")
    r = {x.word: x.suggestions for x in evaluation.spelling_suggestions(ask, lex).collect()}
    assert r == {"acb": ["abc"], "abc": [], "abx": ["abc", "abd"], "qqq": []}
    with pytest.raises(ValueError):
        evaluation.spelling_suggestions(ask, lex, 0)


def test_gold_lines(spark):
    d = spark.createDataFrame([("အ/n ။/punc",), ("",)], "value string")
    r = export.gold_lines(d).collect()
    assert len(r) == 1 and r[0].words == ["အ", "။"] and r[0].tags == ["n", "punc"]
    t = export.treebank_lines(spark.createDataFrame([("S.1\t(ROOT (N (n က)) (v ခ))",)], "value string")).collect()[0]
    assert (t.id, t.words, t.tags) == ("S.1", ["က", "ခ"], ["n", "v"])


def test_conll(spark):
    d = spark.createDataFrame([(["a", "b"], ["X", "Y"])], "w array<string>, t array<string>")
    assert d.select(export.conll(F.col("w"), F.col("t"))).first()[0] == "1\ta\t_\tX\t_\n2\tb\t_\tY\t_"


def test_stream(spark, tmp_path):
    batch = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' event_type, 1.0d value union all select timestamp'2024-01-01 05:10:00', 'a', 2.0d")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 1
    s = text.tokenized(F.col("event_type"))
    assert stream.select(s.alias("s")).isStreaming
