"""Pieces of SQL that state the text rules again, for checking the operators; without lookaround, which the checker lacks."""

from __future__ import annotations

from thazin.functions.zawgyi_rules import LEGACY_TO_STANDARD
from thazin.kernels import lexicon as L
from thazin.kernels.text import CONTRACTIONS, MARK_RANK, NGA, VIRAMA

INVISIBLE = "chr(8203) || chr(8204) || chr(8205) || chr(8288) || chr(65279)"
SPACE = "\\t-\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
PUNCT = "!-/:-@\\[-`{-~\\x{2010}-\\x{201f}\\x{2026}\\x{ab}\\x{bb}"
_MARKS = "".join(MARK_RANK)
_BASE = f"[^{_MARKS}{VIRAMA}]"
_KINZI = [f"{NGA}်{VIRAMA}", f"{NGA}{VIRAMA}်"]


def normal(t: str) -> str:
    return f"nfc_normalize(translate({t}, {INVISIBLE}, ''))"


def canonical(t: str) -> str:
    """Marks sorted by rank in each cluster."""
    cluster = f"({'|'.join([*CONTRACTIONS, *_KINZI])}|{_BASE}(?:{VIRAMA}{_BASE})?[{_MARKS}]*|(?s:.))"
    ranks = "".join(f"{MARK_RANK[m]:02d}" for m in _MARKS)
    head = f"regexp_extract(c, '^(?s:{_BASE}(?:{VIRAMA}{_BASE})?)')"
    key = f"substr('{ranks}', 2 * instr('{_MARKS}', substr(c, i, 1)) - 1, 2) || lpad(i::VARCHAR, 5, '0') || substr(c, i, 1)"
    marks = f"array_to_string(list_transform(list_sort(list_transform(range(length({head}) + 1, length(c) + 1), lambda i: {key})), lambda k: substr(k, 8)), '')"
    fixed = ", ".join(f"'{c}'" for c in CONTRACTIONS)
    kinzi = ", ".join(f"'{k}'" for k in _KINZI)
    return f"array_to_string(list_transform(regexp_extract_all({t}, '{cluster}'), lambda c: CASE WHEN c IN ({fixed}) THEN c WHEN c IN ({kinzi}) THEN '{_KINZI[0]}' WHEN regexp_matches(c, '^(?s:{_BASE})') THEN {head} || {marks} ELSE c END), '')"


def tokens(t: str) -> str:
    """The syllable tokens of normalized text as a list; chr(3) stands for white space."""
    s = f"regexp_replace({t}, '([က-အ])([်္])', chr(1) || '\\1\\2', 'g')"
    s = f"regexp_replace({s}, '(္)([က-အ])', '\\1' || chr(1) || '\\2', 'g')"
    s = f"regexp_replace({s}, '(' || chr(1) || '?[က-အဣ-ဪဿ၌-၏]|[၀-၉]+|[၊။])', chr(2) || '\\1', 'g')"
    s = f"replace(replace({s}, chr(2) || chr(1), ''), chr(1), '')"
    s = f"regexp_replace({s}, '([^က-႟{SPACE}\\x{{2}}]+)', chr(2) || '\\1' || chr(2), 'g')"
    s = f"regexp_replace({s}, '([{PUNCT}]+)', chr(2) || '\\1' || chr(2), 'g')"
    s = f"regexp_replace({s}, '[{SPACE}]+', chr(2) || chr(3) || chr(2), 'g')"
    return f"list_filter(string_split({s}, chr(2)), lambda x: x <> '')"


def kind(w: str) -> str:
    return f"CASE WHEN regexp_full_match({w}, '[၀-၉]+') THEN 'digits' WHEN {w} IN ('၊', '။') THEN 'punct' WHEN regexp_matches({w}, '^[က-႟]') THEN 'syllable' WHEN regexp_matches({w}, '^[{PUNCT}]') THEN 'punct' ELSE 'other' END"


def script_runs(texts: str) -> str:
    """CTEs to ``s`` (r, script): the runs of texts, by the script of their last character."""
    kinds = {"digit": "0-9၀-၉႐-႙", "punctuation": "\\p{P}", "myanmar": "က-ဿ၌-ႏႚ-႟ꧠ-꧿ꩠ-ꩿ", "latin": "A-Za-zÀ-ÖØ-öø-ɏ"}
    runs = "|".join(f"[{k}]+" for k in kinds.values())
    other = f"[^{SPACE}\\p{{P}}0-9A-Za-zÀ-ÖØ-öø-ɏက-႟ꧠ-꧿ꩠ-ꩿ]+"
    cases = " ".join(f"WHEN regexp_matches(c, '[{k}]') THEN '{name}'" for name, k in kinds.items())
    return f"WITH r AS (SELECT unnest(regexp_extract_all(text, '[{SPACE}]*(?:{runs}|{other})|[{SPACE}]+$')) AS r FROM ({texts})), k AS (SELECT r, right(r, 1) AS c FROM r), s AS (SELECT r, CASE {cases} WHEN regexp_matches(c, '[{SPACE}]') THEN 'whitespace' ELSE 'other' END AS script FROM k)"


# The rules with lookaround or a reference in the pattern, said without them: what must not be touched is put aside as chr(1), and what follows is kept as a group.
_SAID_OTHERWISE = {
    0: [(f"{c}{{2,}}", c) for c in "ိီွု့႕"],
    60: [("၇([ာ-ူဲံ-းွး])", "ရ\\1")],
    64: [("၀ါး", "\x01"), ("([၀၁၂၃၄၅၆၇၈၉])၀ါ", "\\1ဝါ"), ("\x01", "၀ါး")],
    65: [("^၀(ါ)", "ဝ\\1")],
    66: [("၀ိ( ?/)", "\x01\\1"), ("၀ိ", "ဝိ"), ("\x01", "၀ိ")],
    68: [("([^၀-၉])၀([\\f\\n\\r])", "\\1ဝ\\2")] * 2,
    69: [("([^၀-၉])၀(\\n?)$", "\\1ဝ\\2")],
    79: [("ဥ([့]?[်ာ])", "ဉ\\1")],
    117: [("၇([က-အ]်|[ာ-ူဲံ-းွှ])", "ရ\\1")],
}


def legacy_to_standard(t: str) -> str:
    for i, rule in enumerate(LEGACY_TO_STANDARD):
        for pattern, to in _SAID_OTHERWISE.get(i, [rule]):
            t = f"regexp_replace({t}, '{pattern}', '{to}', 'g')"
    return t


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def lexicon_rows() -> str:
    """The seed list again from its definitions, apart from the class that loads it."""
    tags: dict[str, set[str]] = {}
    for tag, words in [*L.SEED.items(), ("POSTP", L.POSTPOSITIONS), ("CONJ", L.CONJUNCTIONS), ("NUM", L.NUMERALS)]:
        for w in words:
            tags.setdefault(w, set()).add(tag)
    tags |= {w: set(t) for w, t in L.OVERRIDES.items()}
    return ", ".join(f"('{w}', '{','.join(t for t in L.TAGS if t in s)}')" for w, s in tags.items())


def one_byte(t: str) -> str:
    """Text with a byte for each character, as the distance of the checker counts bytes: letters of the seed list each by its own, all others by one."""
    letters = "".join(sorted({c for ws in L.SEED.values() for w in ws for c in w} | {c for w in [*L.OVERRIDES, *L.POSTPOSITIONS, *L.CONJUNCTIONS, *L.NUMERALS] for c in w}))
    codes = "".join(c for c in map(chr, range(35, 126)) if c not in "'\\\\")[: len(letters)]
    return f"translate(regexp_replace({t}, '[^{letters}]', '~', 'g'), '{letters}', '{codes}')"


def words(source: str, longest: int = 9) -> str:
    """CTEs from ``source`` (id, t) to ``cover`` (id, i, word): the greedy cover of each text by the longest words of the seed list."""
    return f"""
lex(word, tags) AS (VALUES {lexicon_rows()}),
raw_tok AS (SELECT id, unnest(x) AS w, generate_subscripts(x, 1) AS k FROM (SELECT id, {tokens('t')} AS x FROM {source})),
tok AS (SELECT id, w, k, row_number() OVER (PARTITION BY id ORDER BY k) AS i, {kind('w')} AS kind, lag(w) OVER (PARTITION BY id ORDER BY k) AS before FROM raw_tok),
tok2 AS (SELECT id, w, kind, k, before, row_number() OVER (PARTITION BY id ORDER BY k) AS i FROM tok WHERE w <> chr(3)),
tok3 AS (SELECT *, sum(CASE WHEN kind <> 'syllable' OR before = chr(3) OR before_kind <> 'syllable' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS run
  FROM (SELECT *, lag(kind) OVER (PARTITION BY id ORDER BY i) AS before_kind FROM tok2)),
runs AS (SELECT id, run, min(i) AS q, list(w ORDER BY i) AS ws, len(list(w)) AS n FROM tok3 WHERE kind = 'syllable' GROUP BY id, run),
start AS (SELECT id, run, q, ws, n, unnest(range(q, q + n)) AS i FROM runs),
sized AS (SELECT *, unnest(range(2, least({longest}, n - (i - q)) + 1)) AS s FROM start),
fits AS (SELECT id, i, s, q, ws FROM sized JOIN lex ON lex.word = array_to_string(ws[i - q + 1:i - q + s], '')),
free AS (SELECT id, i, max(s) AS s FROM fits WHERE NOT ({" OR ".join(f"list_contains(list_transform(range(i - q + 2, i - q + s + 1), lambda p: ws[p:p + {len(f) - 1}] = [{quoted(f)}]), true)" for f in L.FROZEN)}) GROUP BY id, i),
counted AS (SELECT s.id, s.i, 2 AS s FROM start s WHERE ws[i - q + 1] IN ({quoted(L.NUMERALS)}) AND i - q + 1 < n AND ws[i - q + 2] IN ({quoted(L.CLASSIFIERS)})
  UNION ALL SELECT a.id, a.i, 2 FROM tok3 a JOIN tok3 b ON a.id = b.id AND b.i = a.i + 1 WHERE a.kind = 'digits' AND b.kind = 'syllable' AND b.before <> chr(3) AND b.w IN ({quoted(L.CLASSIFIERS)})),
step AS (SELECT t.id, t.i, coalesce(f.s, c.s, 1) AS s FROM tok3 t LEFT JOIN free f ON f.id = t.id AND f.i = t.i LEFT JOIN counted c ON c.id = t.id AND c.i = t.i),
walk(id, i, s) AS (SELECT id, i, s FROM step WHERE i = 1 UNION ALL SELECT step.id, step.i, step.s FROM walk JOIN step ON step.id = walk.id AND step.i = walk.i + walk.s),
cover AS (SELECT walk.id, walk.i, string_agg(tok3.w, '' ORDER BY tok3.i) AS word FROM walk JOIN tok3 ON tok3.id = walk.id AND tok3.i >= walk.i AND tok3.i < walk.i + walk.s GROUP BY walk.id, walk.i)"""
