import collections
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from thazin.llm import bpe, encoding, gazetteer, language, ngrams, packing, sentences, skeleton, stuffing, tokens

TEXTS = ["I bought the kettle.", "", None, "မြန်မာစာပေ", "<|endoftext|>  \n\n x", "a" * 3000, "😀😀 zqxj", "abcab" * 300]


@pytest.fixture(scope="module")
def ranks():
    return bpe.parse(open(bpe.VOCABULARY, "rb").read())


def test_encoder_and_counter_agree_with_the_library(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    ref = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    e, c = bpe.Encoder(ranks), bpe.Counter(ranks)
    for t in TEXTS:
        want = ref.encode_ordinary(t) if t else []
        assert e.encode(t) == want and c.count(t) == len(want)


def test_corpus_ids(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    r = {x.doc_id: x.ids for x in tokens.encode_corpus(df).collect()}
    assert len(r) == len(TEXTS) and r[1] == r[2] == []


def test_budget_counts_ids_once_and_keeps_null_groups(spark):
    rows = [(1, "a", None, "d", "two words", 2, 1), (1, "a", None, "d", "two words", 2, 2), (2, "b", "en", None, None, None, 1), (None, "b", "en", None, "x", 0, 1), (None, "b", "en", None, "x", 0, 1)]
    df = spark.createDataFrame(rows, "fert_id long, source string, lang string, domain string, text string, w int, ingested_at int")
    r = tokens.token_budget(df, words_col="w").collect()
    total = next(x for x in r if x.total_source and x.total_lang and x.total_domain)
    assert total.n_docs == 4 and total.tokens == 4 and total.tokens_per_word == 1.0
    assert any(x.lang is None and not x.total_lang for x in r)


@pytest.mark.parametrize("capacity", [10, 2048])
def test_packing(spark, capacity):
    rng = np.random.default_rng(3)
    sizes = [int(x) for x in rng.integers(0, capacity + capacity // 2, 400)]
    df = spark.createDataFrame([*enumerate(sizes), (1000, None)], "doc_id long, tokens int")
    out = packing.pack(df, capacity=capacity, block_items=150).collect()
    by, fill = collections.defaultdict(list), collections.Counter()
    for r in out:
        by[r.doc_id].append(r.tokens)
        fill[r.container_id] += r.tokens
    assert max(fill.values()) <= capacity and len(by) == 401
    for i, n in enumerate(sizes):
        assert sum(by[i]) == n and (len(by[i]) == 1 or n > capacity)
    assert packing.pack(df.limit(0), capacity=capacity).count() == 0


def _triplets(n: int, capacity: int, seed: int) -> list[int]:
    """Sizes between a quarter and half of the capacity that fill n bins without any waste."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < 3 * n:
        a, b = (int(x) for x in rng.integers(capacity // 4 + 1, capacity // 2, 2))
        if capacity // 4 < capacity - a - b < capacity // 2:
            out += [a, b, capacity - a - b]
    return [int(x) for x in rng.permutation(out)]


def test_islands_beat_best_fit_decreasing_on_tight_items(spark):
    saved = 0
    for seed in range(3):
        sizes = _triplets(20, 1000, seed)
        down = sorted(range(len(sizes)), key=lambda i: -sizes[i])
        plain = len(packing.best_fit(down, sizes, [], 1000))
        df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, tokens int")
        out = packing.pack(df, capacity=1000, generations=150).collect()
        bins = len({r.container_id for r in out})
        assert sorted(r.doc_id for r in out) == list(range(60)) and 20 <= bins < plain
        saved += plain - bins
    assert saved >= 3


def test_repeated_ids_never_share_a_full_container(spark):
    df = spark.createDataFrame([(1, 5000), (1, 5000), (None, 4096), (1, 10), (None, None)], "doc_id long, tokens int")
    out = packing.pack(df, capacity=2048).collect()
    fill = collections.Counter()
    for r in out:
        fill[r.container_id] += r.tokens
    assert max(fill.values()) <= 2048 and sum(fill.values()) == 14106 and all(fill[r.container_id] == r.container_tokens for r in out)


def test_crossover_keeps_every_item_once():
    import random

    rng, sizes = random.Random(1), [random.Random(i).randint(1, 60) for i in range(300)]
    a, b = (packing.best_fit(rng.sample(range(300), 300), sizes, [], 100) for _ in range(2))
    for _ in range(20):
        child = packing.mutate(packing.cross(a, b, sizes, 100, rng), sizes, 100, rng)
        assert sorted(i for _, items in child for i in items) == list(range(300))
        assert all(f == sum(sizes[i] for i in items) <= 100 for f, items in child)
        a, b = b, child


def test_skeleton_pairs(spark):
    assert skeleton.skeleton("Café") == skeleton.skeleton("Café") == skeleton.skeleton("Ｃａf​é")
    assert skeleton.skeleton("ခရိုင်") == skeleton.skeleton("ခရုိင်")
    assert skeleton.skeleton("a b") == skeleton.skeleton("a　b") != skeleton.skeleton("ab")
    assert skeleton.skeleton("Mini") == skeleton.skeleton("Мini") != skeleton.skeleton("mini")
    rows = [(1, 1, "Mini"), (2, 1, "Мini"), (3, 1, "Mini"), (4, 2, "Мini"), (5, None, "Mini"), (6, 1, None), (1, 1, "Mini")]
    df = spark.createDataFrame(rows, "cand_id long, batch_id long, span string")
    assert sorted(tuple(r) for r in skeleton.same_look(df, "cand_id", "span", "batch_id").collect()) == [(1, 2), (2, 3)]
    assert skeleton.same_look(df.limit(0), "cand_id", "span", "batch_id").count() == 0


@pytest.mark.parametrize("a, b", [("O", "0"), ("l", "1"), ("I", "l"), ("ﬁ", "fi"), ("Ⅳ", "IV"), ("rn", "m"), ("ա", "w"), ("Ꭺ", "A"), ("ⲟ", "o"), ("ᴀ", "A"), ("Ｍini", "Mini"), ("ｱ", "ア")])
def test_look_alikes(a, b):
    assert skeleton.skeleton(f"x{a}y") == skeleton.skeleton(f"x{b}y")


def test_large_classes_are_split(spark, monkeypatch):
    monkeypatch.setattr(skeleton, "CLASS_ROWS", 3)
    rows = [(i, 1, "Mini" if i % 3 else "Мini") for i in range(20)] + [(i, 1, "other") for i in range(20, 25)]
    df = spark.createDataFrame(rows, "cand_id long, batch_id long, span string")
    want = {(a, b) for a in range(20) for b in range(a + 1, 20) if (a % 3 == 0) != (b % 3 == 0)}
    assert {tuple(r) for r in skeleton.same_look(df, "cand_id", "span", "batch_id").collect()} == want
    c = {r.cand_id: (r.n_forms, r.n_links) for r in skeleton.classes(df, "cand_id", "span").collect()}
    assert c[0] == (2, 13) and c[1] == (2, 7) and c[24] == (1, 0)


def test_suffix_array_against_sorted_suffixes():
    rng = np.random.default_rng(4)
    for _ in range(40):
        rows = [[int(x) for x in rng.integers(0, 3, rng.integers(1, 15))] for _ in range(int(rng.integers(1, 8)))]
        ids, row = np.array([t for r in rows for t in r]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        order, common, length = ngrams.suffix_array(ids, row)
        suffix = {at: rows[k][at - sum(map(len, rows[:k])) :] for at, k in enumerate(row)}
        assert [suffix[i] for i in order] == sorted(suffix.values()) and list(length) == [len(suffix[i]) for i in order]
        agree = lambda x, y: next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        assert list(common) == [0, *(agree(suffix[i], suffix[j]) for i, j in zip(order[1:], order))]


def test_rows_of_a_record_may_lie_in_several_tasks(spark):
    rows = [(i, i % 3, ["a", "b"] if i % 2 else ["a"], i) for i in range(30)] + [(4, 1, ["a"], 4), (None, 1, ["z"], 1), (99, None, ["z"], 1)]
    df = spark.createDataFrame(rows, "id long, rec long, w array<string>, k int").repartition(5)
    r = {tuple(x.ngram): (x.total, x.records) for x in ngrams.term_counts(df, "rec", "w", "k", max_n=None, chunk_tokens=2, row_id="id").collect()}
    assert r == {("a",): (435, 3), ("b",): (225, 3), ("a", "b"): (225, 3)}
    deep = spark.createDataFrame([(1, list("abcabc")), (2, list("xabcab"))], "id long, w array<string>")
    grams = {tuple(x.ngram): (x.total, x.records) for x in ngrams.term_counts(deep, "id", "w", max_n=None).collect()}
    assert grams[tuple("abcab")] == (2, 2) and grams[tuple("abc")] == (3, 2) and grams[tuple("xabcab")] == (1, 1)


def test_long_lists_are_joined_with_the_same_result(spark):
    entries = spark.createDataFrame([(1, "RIVER", "ယဲကိုက်ကိုဂျီမြစ်", "Yeikaikkogyi Myit"), (2, "TOWN", "သွောသဲယားမြို့", None), (3, "TOWN", None, None), (4, None, " ", "x"), (5, "TOWN", "ကောလင်းမြို့", "Kawlin"), (6, "DISTRICT", "ကောလင်းခရိုင်", None)], "entry_id long, entity_type string, name string, latin string")
    values = ["ယဲကိုက်ကိုဂျီမြစ်ကြီး", "YEIKAIKKOGYI River", "Yeikaikogyi Myit", "Thwawtheyar", "သွောသယား", "ကောလင်း", "ကောလင်", "kawlin town", "kawln", "Kersolquil Café", " ", None, "x", "ကောလင်းမြို့"]
    df = spark.createDataFrame(list(enumerate([*values, *values[:3]])), "hit_id long, text string")
    a, b = ({(x.rec_id, x.entry_id) for x in gazetteer.match(df, entries, "hit_id", "text", max_entries=n).collect()} for n in (100, 2))
    assert a == b and len(a) == 14 and {e for _, e in a} >= {1, 2, 5, -1}


def test_suffix_counts_against_brute_force():
    rng = np.random.default_rng(1)
    recs = [[int(x) for x in rng.integers(0, 4, rng.integers(0, 12))] for _ in range(60)]
    ids, rec = np.array([t for r in recs for t in r]), np.array([k for k, r in enumerate(recs) for _ in r])
    for n, at, occ, records, _ in ngrams.suffix_counts(ids, rec, np.ones(len(ids), int), 3):
        grams = lambda x, n=n: [tuple(x[i : i + n]) for i in range(len(x) - n + 1)]
        tf = collections.Counter(g for x in recs for g in grams(x))
        df = collections.Counter(g for x in recs for g in set(grams(x)))
        assert {tuple(ids[a : a + n]): (int(o), int(r)) for a, o, r in zip(at, occ, records)} == {g: (tf[g], df[g]) for g in tf}


def test_term_counts(spark):
    rows = [(1, ["a", "b", "a"]), (1, ["a", "b", "a"]), (2, ["a", None, "b"]), (3, None), (None, ["a"]), (4, [])]
    df = spark.createDataFrame(rows, "id long, w array<string>")
    for chunk in (1, 1000):
        r = {tuple(x.ngram): (x.total, x.records) for x in ngrams.term_counts(df, "id", "w", max_n=2, chunk_tokens=chunk).collect()}
        assert r == {("a",): (3, 2), ("b",): (2, 2), ("a", "b"): (2, 2), ("b", "a"): (1, 1)}
    assert ngrams.term_counts(df.limit(0), "id", "w").count() == 0


def test_names(spark):
    entries = spark.createDataFrame([(1, "RIVER", "ယဲကိုက်ကိုဂျီမြစ်", "Yeikaikkogyi Myit"), (2, "TOWN", "သွောသဲယားမြို့", None), (3, "TOWN", None, None)], "entry_id long, entity_type string, name string, latin string")
    values = ["ယဲကိုက်ကိုဂျီမြစ်", "ယဲကိုက်ကိုဂျီမြစ်ကြီး", "YEIKAIKKOGYI River", "Thwawtheyar", "သွောသဲယား", "ေသြာသဲယားျမိဳ႔", "လက်ဖက်ရည် ငှက်", "Kersolquil Café", " ", None, "“သွောသဲယားမြို့”"]
    df = spark.createDataFrame(list(enumerate(values)), "hit_id long, text string")
    r = {x.rec_id: x.entry_id for x in gazetteer.match(df, entries, "hit_id", "text").collect()}
    assert r == {1: 1, 2: 1, 3: 2, 4: 2, 5: 2, 6: -1, 7: -1, 10: 2}


LATIN = {"en": ["The manager bought the railway before noon and closed the old school.", "Nobody knew why the driver studied the budget."], "fr": ["Le médecin a mesuré le petit marché avant midi près du château.", "Personne ne sait pourquoi le voisin a vendu ce collège."], "my": ["ညနေ အိမ်သည် သင်ကြားခဲ့တယ်။ ကျောင်းသားတို့ စာအုပ်ကို ဖတ်ပါသည်။", "ယခုအခါ ဆရာက ကျောင်းမှာ စာကို ရေးမည်။"]}


def test_code_lengths_are_exact():
    m = language.Ppm({"a": ["abab"], "b": ["bbbb"]}, order=2)
    bits = m.bits(["ab", "bb", ""])
    assert bits[0][0] < bits[0][1] and bits[1][1] < bits[1][0] and bits[2].sum() == 0
    # a chain of independent symbols costs the sum of its parts
    assert np.allclose(m.bits(["ab", "bb"]), [m.bits(["ab"])[0], m.bits(["bb"])[0]])


def test_languages(spark):
    samples = spark.createDataFrame([(i, k, t) for i, (k, ts) in enumerate(LATIN.items()) for t in ts], "sample_id long, lang string, text string")
    rows = [(1, "en-US", LATIN["en"][0]), (2, None, LATIN["fr"][0]), (3, "fr", LATIN["en"][1]), (4, "my", LATIN["my"][0] + " / " + LATIN["en"][0]), (5, "und", "123 — 4"), (6, "zxx", "၊ ။"), (7, "en", ""), (8, "en", None)]
    df = spark.createDataFrame(rows, "report_id long, lang string, text string")
    found = sorted(tuple(r) for r in language.mislabelled(language.identify(df, samples, "report_id", "text", "lang"), "report_id").collect())
    assert found == [(2, "fr"), (3, "en"), (4, "en"), (4, "my")]
    none = language.identify(df, samples.limit(0), "report_id", "text", "lang").collect()
    assert {r.languages[0].lang for r in none} == {"und"} and len(none) == 6
    assert language.identify(df.limit(0), samples, "report_id", "text", "lang").count() == 0
    assert language.label_code("Burmese") == language.label_code("my-MM") == "my" and language.label_code("??") is None


def test_repair(spark):
    texts = [t for ts in LATIN.values() for t in ts] * 5
    word, tri = collections.Counter(), collections.Counter()
    for t in texts:
        word.update(encoding.words(t))
        tri.update(encoding.trigrams(t))
    m = encoding.Model(dict(word), dict(tri))
    good = LATIN["fr"][0]
    for codec in ("cp1252", "mac_roman", "cp437"):
        assert encoding.repair(good.encode().decode(codec), m)[:2] == (True, good)
    assert encoding.repair(good.encode("latin-1").decode("utf-8", "replace"), m)[:2] == (True, good)
    twice = good.encode().decode("cp1252").encode().decode("cp1252")
    assert encoding.repair(twice, m)[1] == good
    for t in (*texts, "", "abc", "၊ ။"):
        assert encoding.repair(t, m)[0] is False
    from thazin.kernels.text import standard_to_legacy

    assert encoding.repair(standard_to_legacy(LATIN["my"][0]), m)[0]
    df = spark.createDataFrame([(1, good, None), (2, good.encode().decode("cp1252"), good), (2, good.encode().decode("cp1252"), good)], "report_id long, text string, converted_text string")
    out = [(r.report_id, r.field) for r in encoding.repaired(df, "report_id", ("text", "converted_text"), ("converted_text",)).where("garbled").collect()]
    assert out == [(2, "text")]


def test_all_lost_letters_are_tried():
    word = {f"x{c}y": 1 for c in "ßàáâãäåæçèéêëìíîïñòóôõöøùúûü"} | {"révélé": 50, "révèle": 9, "dégénéré": 40, "rêvé": 7}
    tri = collections.Counter()
    for w, n in word.items():
        for t in encoding.trigrams(w):
            tri[t] += n
    m = encoding.Model(word, dict(tri))
    for w in ("révélé", "dégénéré", "rêvé"):
        lost = "".join("�" if c > "z" else c for c in w)
        assert encoding.restore_lost(f"Il {lost}, {lost.upper()}", m) == f"Il {w}, {w.upper()}"
    assert m.completed("rév�l�") == "révélé" and m.completed("rêv�") == "rêvé"
    latin = sorted(m.letters - set(map(chr, range(128))))
    for pattern in ("r�n�r", "��", "v��é", "q�"):  # no such words: the most probable spelling of all
        every = [""]
        for c in pattern:
            every = [o + x for o in every for x in (latin if c == "�" else [c])]
        assert m.spelled(m.completed(pattern)) == pytest.approx(max(map(m.spelled, every)))


def test_lattice_paths_are_the_best_of_all():
    """Against a sum over every cut of every reading."""
    words = ["ကို", "မှာ", "သည်", "သူ", "မီး", "café", "chat"]
    word, tri = collections.Counter(), collections.Counter()
    for w in words * 3:
        word.update(encoding.words(w))
        tri.update(encoding.trigrams(w))
    m = encoding.Model(word, dict(tri))

    def value(text, at=0, state=""):
        if at == len(text):
            return max((p for p, _ in m.follow(state, "")), default=-1e9)
        return max((p + value(text, at + 1, new) for p, new in m.follow(state, text[at])), default=-1e9)

    rng = np.random.default_rng(3)
    for _ in range(60):
        original = "".join(words[int(rng.integers(5))] for _ in range(2))
        garbled = original.encode().decode("cp1252", "replace")
        got, _ = encoding.decode_bytes(garbled, "cp1252", m)
        undefined = encoding._undefined("cp1252")
        # every letter whose bytes agree where nothing was lost
        options = []
        for i in range(0, len(garbled), 3):
            seq = [-1 if c == encoding.LOST else c.encode("cp1252")[0] for c in garbled[i : i + 3]]
            fits = [(c, sum(-0.5 if b in undefined else -3.0 for b, x in zip(c.encode(), seq) if x == -1)) for c in m.letters if len(c.encode()) == 3 and all(x in (-1, b) for b, x in zip(c.encode(), seq))]
            options.append(fits)
        best = max((sum(p for _, p in way) + value("".join(c for c, _ in way)), "".join(c for c, _ in way)) for way in itertools.product(*options))
        cost = sum(next(p for c, p in o if c == g) for o, g in zip(options, got))
        assert cost + value(got) == pytest.approx(best[0])


def test_single_letters_are_swapped_back():
    texts = ["Le médecin a mesuré le petit marché avant midi.", "Personne ne sait où le père à la fête était."] * 5
    word, tri = collections.Counter(), collections.Counter()
    for t in texts:
        word.update(encoding.words(t))
        tri.update(encoding.trigrams(t))
    m = encoding.Model(word, dict(tri))
    for codec in ("cp1251", "mac_roman", "cp437", "cp850"):
        for t in texts[:2]:
            garbled = t.encode("cp1252").decode(codec)
            assert encoding.repair(garbled, m)[:2] == (True, t), (codec, garbled)
    assert encoding.repair("Le m?decin a mesur? le petit march?", m)[1].startswith("Le médecin")
    assert encoding.repair("???? ????? ??", m) == (True, "???? ????? ??", "replaced")
    assert encoding.repair("Quoi ? Où ?? Le petit marché ?", m)[0] is False


def test_repeated_misreadings_are_undone_to_the_end():
    good = LATIN["fr"][0]
    word, tri = collections.Counter(encoding.words(good)), collections.Counter(encoding.trigrams(good))
    m, t = encoding.Model(dict(word), dict(tri)), good
    for _ in range(5):
        t = t.encode().decode("latin-1")
    assert encoding.repair(t, m)[1] == good


def test_bracketed_languages_count_whatever_the_length_of_the_text():
    short, long = "A (မနေ့က ကျောင်းသားတို့ စာဖတ်ခဲ့သည်။) b", "word " * 40 + "(မနေ့က ကျောင်းသားတို့ စာဖတ်ခဲ့သည်။ " + "နောက်တစ်နေ့ သွားသည်။ " * 5 + ") end of it"
    for t in (short, long):
        parts = language.segments(t)
        assert "".join(c for p in parts for c in p if c.isalpha()) == "".join(c for c in t if c.isalpha()) or sorted("".join(parts).replace(" ", "")) == sorted(t.replace(" ", "").replace("(", "").replace(")", ""))
        assert any("ကျောင်း" in p and language.weight(p) for p in parts)


def test_lost_bytes_by_words_with_all_states():
    # the trigrams alone prefer "é" in m?d; the word list knows only "mèdu"; more letters fit than twelve
    word = {"mèdu": 500, "axéd": 1, "méda": 1} | {f"m{c}" : 900 for c in "àáâãäåæçéêëìíîïñòóôõö"}
    tri = collections.Counter({"^m": 1000, "^mè": 2, "mèd": 2, "èdu": 300, "du$": 300, "^mé": 300, "méd": 300, "éda": 2, "édu": 250})
    for c in "àáâãäåæçêëìíîïñòóôõö":
        tri[f"^m{c}"] = 400
    m = encoding.Model(word, dict(tri))
    assert encoding.decode_bytes("mÃ�du", "cp1252", m)[0] == "mèdu"


def test_sentences(spark):
    rng = np.random.default_rng(5)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    nouns, verbs, who = ["market", "school", "bridge", "garden", "report"], ["closed", "opened", "sold", "painted"], ["clerk", "farmer", "student", "editor"]
    kinds = (
        lambda: f"The {pick(who)} {pick(verbs)} the {pick(nouns)}.",
        lambda: f"Dr. {pick(['Lin', 'Soe', 'Kyaw'])} {pick(verbs)} the {pick(nouns)} at 2.10 a.m. on the first day.",
        lambda: f"Was the {pick(nouns)} open?",
        lambda: f"\u201cIs the {pick(nouns)} open? I waited!\u201d asked the {pick(who)} near St. {pick(['Lin', 'Soe'])} school.",
    )
    rows, gold = [], set()
    for i in range(200):
        text = ""
        for _ in range(int(rng.integers(1, 6))):
            text += pick([" ", " ", "\n\n"]) if text else ""
            start, sentence = len(text), pick(kinds)()
            text += sentence
            gold.add((i, start, len(text)))
        rows.append((i, text))
    df = spark.createDataFrame([*rows, (1000, ""), (1001, None), (1002, "  "), (1003, "x" * 20_000)], "parsed_id long, raw_text string")
    out = {tuple(r) for r in sentences.sentence_spans(df.unionByName(df)).collect()}
    assert not {1000, 1001, 1002} & {r[0] for r in out} and {r for r in out if r[0] == 1003} == {(1003, 0, 20_000)}
    out = {r for r in out if r[0] < 1000}
    assert 2 * len(out & gold) / (len(out) + len(gold)) > 0.97
    texts = dict(rows)
    assert all(texts[i][a:b] == texts[i][a:b].strip() for i, a, b in out)


def test_rare_tokens_lose_both_counts(spark):
    # over 1e5 uses a kind, so that the share is more than one use
    rows = [(i, " ".join(f"The clerk saw {'Zoltan' if (i, k) == (3, 7) else 'Maria'} near the old bridge today." for k in range(500)) + (" Zoltan left." if i == 5 else "")) for i in range(60)]
    counts, _ = sentences.fitted(spark.createDataFrame(rows, "parsed_id long, raw_text string"), "raw_text", "parsed_id", train_documents=5)
    assert counts["start", "Maria"] > 20_000 and ("start", "Zoltan") not in counts and ("start+", "Zoltan") not in counts
    assert all((kind.rstrip("+"), token) in counts for kind, token in counts)
    stats = sentences.Stats(counts)
    assert stats.ratio("start", "Zoltan") == stats.ratio("start", "Qwertz")  # a word of the same shape that never occurs
    assert counts["start", "The"] == 30_000 and counts["start+", "The"] == 60


def test_stuffing(spark):
    prose = ["I bought the kettle for my sister and it works as described, so we use it every morning.", "The handle of this lamp broke after two weeks and nobody answered my e-mails about it.", "It is a bit heavier than the old one but the colour is the same and I would buy it again."]
    good = [" ".join(prose[(i + k) % 3] for k in range(3)) for i in range(60)]
    bad = ["toaster blender tent camera " * 20, "#kettle #lamp #mat " * 20, "https://a.test/1 https://b.test/2 " * 15]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*good, *bad, "good", "", None])], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in stuffing.stuffed(df).collect()) == [60, 61, 62]
    assert stuffing.stuffed(df.limit(0)).count() == 0


def test_short_pages_and_rare_languages_are_judged(spark):
    prose = ["I bought the kettle for my sister and it works as described, so we use it every morning.", "The handle of this lamp broke after two weeks and nobody answered my e-mails about it.", "It is a bit heavier than the old one but the colour is the same and I would buy it again."]
    good = [(i, " ".join(prose[(i + k) % 3] for k in range(3)), "en") for i in range(300)]
    bad = [(300 + i, "#kettle #lamp #mat " * 12, "en") for i in range(4)] + [(304 + i, "https://a.test/1 https://b.test/2 " * 9, "en") for i in range(4)] + [(310, "#kettle #lamp #mat #tent #pan", "en"), (311, "https://a.test/1 https://b.test/2 https://c.test/3", None)]
    fine = [(320, "Good kettle", "en"), (321, "Keittimen kahva on hieno ja se toimii hyvin joka aamu. Ostin sen siskolleni.", "fi"), (322, "It is good. It is good. It is good.", "en")]
    df = spark.createDataFrame([*good, *bad, *fine], "doc_id long, text string, lang string")
    found = sorted(r.doc_id for r in stuffing.stuffed(df).collect())
    assert found == [*range(300, 308), 310, 311]
    few = stuffing.heads(df.select(F.col("text").alias("_t"), F.col("lang").alias("_l")))
    assert {"the", "it"} <= few["en"] and "keittimen" in few["fi"]


def test_terms_keep_prose_and_list_counts_together(spark):
    rows = [("+en", "rare", 9, 1_000_000), ("-False", "rare", 5, 1000), ("+en", "gone", 9, 1_000_000), ("+en", "the", 500, 1_000_000), ("+my", "rare", 1, 1_000_000)]
    df = spark.createDataFrame(rows, "g string, token string, n long, all long")
    assert stuffing._paired(df, [("en", False), ("my", True)], 1e-5) == {("+en", "rare"): 9, ("-False", "rare"): 5, ("+en", "the"): 500}
