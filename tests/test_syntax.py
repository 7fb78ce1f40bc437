from thazin.kernels import records, repair, syntax
from thazin.kernels import text as T


def test_stops_and_soft_cuts():
    words = ["သူ", "သွား", "သည်", "ကလေး", "စား", "တယ်", "။"]
    tags = ["PRON", "VERB", "SFP", "NOUN", "VERB", "SFP", "PUNCT"]
    chunks = [("NP", "သူ", 0, 0), ("VP", "သွားသည်", 1, 2), ("NP", "ကလေး", 3, 3), ("VP", "စားတယ်", 4, 5)]
    assert syntax.sentences(words, tags, chunks) == [(0, 3), (3, 7)]
    assert syntax.sentences(words, tags, chunks, soft=False) == [(0, 7)]
    assert syntax.sentences([], [], []) == []


def test_clauses():
    words = ["သူ", "လာ", "လျှင်", "ငါ", "သွား", "မည်"]
    chunks = [("NP", "သူ", 0, 0), ("VP", "လာ", 1, 1), ("NP", "ငါ", 3, 3), ("VP", "သွားမည်", 4, 5)]
    assert syntax.clauses(words, chunks, (0, 6)) == [("conditional", "condition", "လျှင်", 0, 1), ("main", "matrix", None, 3, 5)]
    assert syntax.phrase_role(["ရန်ကုန်", "ကို"], ("PP", "", 0, 1)) == ("OBJECT", "OBJECT")


def test_logged_conversion_equals_the_cascade():
    for t in ("ျမန္မာစာေပ", "", "abc", "ေဈးက အိမ္သို႔ ေျပာပါသည္။"):
        new, log = repair.convert_logged(t)
        assert new == T.legacy_to_standard(t)
        assert all(0 <= x["origin_start"] < x["origin_end"] <= len(t) for x in log)


def test_report():
    good = ["မြန်မာစာပေ ကောင်းသည်။", "ကျောင်းသားတို့ စာကို ဖတ်ပါသည်။"]
    m = repair.OrderModel.fit(good, [T.standard_to_legacy(g) for g in good])
    r = repair.repair_report(good[0] + "\n\n" + T.standard_to_legacy(good[1]) + "\nabc", m.probability)
    assert r["text"] == good[0] + "\n\n" + T.canonical_order(good[1]) + "\nabc"
    assert [p["converted"] for p in r["paragraphs"]] == [False, True, False] and r["summary"]["spread"] > 0.5
    assert repair.repair_report("", m.probability)["summary"]["min"] is None


def test_standoff():
    record = lambda text, words, **more: {"text": text, "tokens": [{"text": w} for w in words], "entities": [], "chunks": [], "mwe": [], "clauses": [], **more}
    t, a = records.standoff([record("abc", ["ab", "c"], entities=[{"label": "TOWN", "start": 0, "end": 0}]), record("de", ["de"], chunks=[{"type": "NP", "start": 0, "end": 0}])])
    assert t == "abc\nde" and a == "T1\tTOWN 0 2\tab\nT2\tCHUNK/NP 4 6\tde\n"
