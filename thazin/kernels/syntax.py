"""Sentences from phrases, roles of phrases, and clauses of a sentence."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from dataclasses import replace as dc_replace
from functools import lru_cache
from itertools import accumulate, islice
from typing import NamedTuple

from thazin.kernels import lexicon as L
from thazin.kernels.analysis import greedy_cover

Chunk = tuple[str, str, int, int]  # type, text, first word, last word (inclusive)

# Phrase types that complete or open a sentence, words that belong to a verb's tail, words that continue one.
PREDICATES = {"VP", "FIXED_VERB", "GREETING"}
OPENERS = {"NP", "NUMP", "GREETING"}
TAIL = {"ပါတယ်", "ပါဘူး", "ချင်ပါတယ်", "သည်", "တယ်", "မည်", "ပြီ", "ပါ", "ဘူး", "လား", "မလား"}
CONTINUING = {*L.CONTINUATIONS, *L.CONJUNCTIONS, "ပေမဲ့", "ဒါပေမယ့်", "သော်လည်း", "သို့သော်", "လို့", "ဆို", "ဆိုတဲ့"}
# Function and role by postposition.
ROLES = {
    "က": ("SUBJECT", "AGENT"), "သည်": ("SUBJECT", "SUBJECT"), "ကတော့": ("SUBJECT", "TOPIC"), "ကို": ("OBJECT", "OBJECT"), "အား": ("OBJECT", "OBJECT"), "မှ": ("ADJUNCT", "SOURCE"), "သို့": ("ADJUNCT", "DESTINATION"),
    "မှာ": ("ADJUNCT", "LOCATION"), "တွင်": ("ADJUNCT", "LOCATION"), "၌": ("ADJUNCT", "LOCATION"), "၏": ("POSSESSOR", "POSSESSOR"), "ရဲ့": ("POSSESSOR", "POSSESSOR"), "ထက်": ("ADJUNCT", "STANDARD"), "ဖြင့်": ("ADJUNCT", "INSTRUMENT"), "နှင့်": ("ADJUNCT", "COMITATIVE"),
}
# Relation and markers by kind of clause.
MAIN_ENDS = ["သည်", "တယ်", "ပါ", "လေ", "ရယ်", "မယ်", "ပြီ", "ဘူး", "မည်", "၏", "ပါတယ်", "ပါဘူး"]
MARKERS = {
    "conditional": ("condition", ["လျှင်မူ", "လျှင်", "ရင်"]),
    "reason": ("cause", ["သောကြောင့်", "ကြောင့်", "သဖြင့်", "ထို့ကြောင့်"]),
    "purpose": ("purpose", ["ရန်", "အောင်", "ဖို့"]),
    "contrast": ("contrast", ["သော်လည်း", "သော်", "သို့သော်", "ဒါပေမယ့်", "ပေမဲ့"]),
    "relative": ("modifier", ["သော", "သည့်", "ဆိုတဲ့", "တဲ့", "မည့်"]),
}
TEMPLATES = ["NP PP PP VP", "NP PP VP", "NP NP VP", "NP VP", "PP VP", "VP", "GREETING"]
RELATIVE_TEMPLATES = ["NP PP VP NP", "PP VP NP", "NP VP NP", "VP NP"]
CLAUSE_CHUNK = {"main": "MAIN_CLAUSE", "conditional": "CONDITIONAL_CLAUSE", "reason": "REASON_CLAUSE", "purpose": "PURPOSE_CLAUSE", "contrast": "CONTRAST_CLAUSE"}

_LONGEST = sorted(((m, kind) for kind, (_, markers) in MARKERS.items() for m in markers), key=lambda x: -len(x[0]))
_RELATIVE = set(MARKERS["relative"][1])
_RELATIVE_LABELS = sorted((t.split() for t in RELATIVE_TEMPLATES), key=lambda t: -len(t))
_ANY_MARKER = re.compile("|".join(m for m, _ in _LONGEST))
_BY_MARKER = {m: (m, kind) for m, kind in reversed(_LONGEST)}
_ENDS_WITH_MARKER = re.compile(f"(?:{'|'.join(m for m, _ in _LONGEST)})$")


def terminal(word: str) -> bool:
    return word == "။" or bool(word) and all(c in ".!?…" for c in word)


def units(n: int, chunks: Sequence[Chunk]) -> list[tuple[str | None, int, int]]:
    """Non-overlapping phrases from the left, the longest first, and single words between them."""
    starts: dict[int, Chunk] = {}
    for c in chunks:
        if c[2] not in starts or c[3] > starts[c[2]][3]:
            starts[c[2]] = c
    spans = greedy_cover(n, lambda i: starts[i][3] - i + 1 if i in starts else 0)
    return [(starts[i][0] if i in starts else None, i, j - 1) for i, j in spans]


class _Facts(NamedTuple):
    """What a unit means for cuts."""

    end: int
    stop: bool  # only end marks
    predicate: bool
    finite: bool  # a predicate whose tail is finite
    tail: bool  # a single word that makes the predicate before it finite
    opens: bool  # may begin a sentence after a finite predicate


def _facts(words: Sequence[str], tags: Sequence[str], unit: tuple[str | None, int, int]) -> _Facts:
    kind, a, b = unit
    ends = [tags[j] in ("SFP", "PART") or words[j] in TAIL for j in range(b, a - 1, -1)]
    passed = [tags[j] in ("VERB", "AUX", "IDIOM") for j in range(b, a - 1, -1)]
    # from the end over verbs and auxiliaries to the first word of another kind
    finite = next((e for e, p in zip(ends, passed) if e or not p), False)
    goes_on = words[a] in TAIL or words[a] in CONTINUING or tags[a] in ("SFP", "PART", "AUX", "CONJ", "POSTP", "PUNCT") or all(t == "PUNCT" for t in tags[a : b + 1])
    opens = kind in OPENERS or kind is None and tags[a] in ("PRON", "NOUN", "NUM")
    return _Facts(b + 1, all(map(terminal, words[a : b + 1])), kind in PREDICATES, kind in PREDICATES and finite, kind is None and tags[a] in ("SFP", "PART", "AUX"), opens and not goes_on)


def sentences(words: Sequence[str], tags: Sequence[str], chunks: Sequence[Chunk], soft: bool = True) -> list[tuple[int, int]]:
    """Half-open word spans.  A stop ends a sentence; so does, if ``soft``, a finite predicate before a phrase that opens another."""
    facts = [_facts(words, tags, u) for u in units(len(words), chunks)]
    follows = [f.opens for f in facts[1:]] + [False]

    def step(open_before: tuple[bool, bool], k: int) -> tuple[bool, bool]:
        """(a predicate is open after unit k, it is cut there)"""
        f, was = facts[k], open_before[0]
        cut = f.stop or soft and follows[k] and (f.finite or was and f.tail)
        return (was or f.predicate) and not cut, cut

    states = accumulate(range(len(facts)), step, initial=(False, False))
    cuts = [f.end for f, (_, cut) in zip(facts, islice(states, 1, None)) if cut]
    if words and cuts[-1:] != [len(words)]:
        cuts.append(len(words))
    return list(zip([0, *cuts], cuts))


def char_spans(text: str, words: Sequence[tuple[int, int]], spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open character spans of sentences that partition the text: white space between two belongs to the second, what surrounds the text to its edges."""
    ends = [words[b - 1][1] for _, b in spans]
    if ends:
        ends[-1] = len(text)
    return list(zip([0, *ends], ends))


@dataclass(frozen=True)
class Phrase:
    """A phrase with its function and role; a relative phrase has a modifier and a head noun as children."""

    kind: str
    words: tuple[str, ...]
    first: int
    last: int
    function: str | None = None
    role: str | None = None
    part: str | None = None
    children: tuple[Phrase, ...] = ()

    @property
    def text(self) -> str:
        return "".join(self.words)


def phrase_role(words: Sequence[str], chunk: Chunk) -> tuple[str | None, str | None]:
    """(function, role) of a phrase: a predicate, or by the postposition at its end."""
    if chunk[0] in PREDICATES:
        return "PREDICATE", None
    return ROLES.get(words[chunk[3]], ("ADJUNCT", None)) if chunk[0] == "PP" else (None, None)


def enriched(words: Sequence[str], chunks: Sequence[Chunk]) -> list[Phrase]:
    return sorted((Phrase(c[0], tuple(words[c[2] : c[3] + 1]), c[2], c[3], *phrase_role(words, c)) for c in chunks), key=lambda p: (p.first, p.last))


_CODES: dict[str, str] = {}


def _code(label: str) -> str:
    return _CODES.setdefault(label, chr(0x100 + len(_CODES)))


@lru_cache(64)
def _template(templates: tuple[str, ...]) -> tuple[re.Pattern, re.Pattern]:
    """Templates as expressions over one character a label: those with repetition match whole sequences, the others any part of one."""

    def coded(t: str) -> str:
        return "".join(re.sub("[A-Z_]+", lambda m: _code(m.group()), atom) for atom in t.split())

    rigid = [coded(t) for t in templates if not re.search("[*+?]", t) and "|" not in t]
    loose = [coded(t) for t in templates if re.search("[*+?]", t) or "|" in t]
    never = "(?!)"
    return re.compile("|".join(rigid) or never), re.compile(f"(?:{'|'.join([_code('ADJP'), _code('NUMP'), _code('FIXED_EXPRESSION')])})*(?:{'|'.join(loose) or never})")


def matches(labels: Sequence[str], templates: Sequence[str]) -> bool:
    """Whether a sequence of labels is licensed: a plain template anywhere in it, or one with repetition or choice over all of it but leading modifiers; no templates license all."""
    coded = "".join(map(_code, labels))
    part, whole = _template(tuple(templates))
    return not templates or part.search(coded) is not None or whole.fullmatch(coded) is not None


def _marker_inside(words: Sequence[str]) -> tuple[int, str] | None:
    """(words up to the end of the marker, kind) of the first clause marker made of whole words, the longest where several begin."""
    if not _ANY_MARKER.search("".join(words)):
        return None
    for i in range(len(words)):
        found = [(j, kind) for m, kind in _LONGEST for j in range(i + 1, len(words) + 1) if "".join(words[i:j]) == m]
        if found:
            return max(found, key=lambda x: x[0])
    return None


def _split(p: Phrase) -> list[Phrase]:
    """A predicate cut once behind its first marker; a relative marker at its end stays."""
    found = _marker_inside(p.words) if p.kind in PREDICATES else None
    if not found or found[0] == len(p.words):
        return [p]
    k = found[0]
    return [dc_replace(p, words=p.words[:k], last=p.first + k - 1), dc_replace(p, words=p.words[k:], first=p.first + k)]


def _relative(phrases: Sequence[Phrase], words: Sequence[str]) -> Phrase | None:
    """The noun phrase a window of phrases forms if its verb ends with a relative marker or only one stands behind it."""
    *before, head = phrases
    verb = next((p for p in reversed(before) if p.kind in PREDICATES), None)
    if verb is None or head.kind != "NP":
        return None
    gap = tuple(words[verb.last + 1 : head.first])
    apart = "".join(gap) in _RELATIVE
    if not apart and not any(verb.text.endswith(m) for m in _RELATIVE):
        return None
    inside = tuple(w for p in before for w in p.words) + (gap if apart else ())
    alone = len(before) == 1
    modifier = Phrase(verb.kind if alone else "VP", inside, before[0].first, head.first - 1 if apart else before[-1].last, "MODIFIER", verb.role if alone else None, "RelativeModifier", () if alone else tuple(before))
    return Phrase("NP", inside + head.words, before[0].first, head.last, head.function, head.role, None, (modifier, dc_replace(head, part="HeadNoun", children=())))


def nested(phrases: Sequence[Phrase], words: Sequence[str]) -> list[Phrase]:
    """Relative clauses folded into the noun phrase they modify, the longest template first; what was folded isn't scanned again."""
    templates = _RELATIVE_LABELS

    kinds = [p.kind for p in phrases]

    def fold(i: int) -> tuple[int, Phrase | None]:
        for t in templates:
            if kinds[i : i + len(t)] == t and (whole := _relative(phrases[i : i + len(t)], words)):
                return len(t), whole
        return 1, None

    folded = {i: fold(i) for i in range(len(phrases))}
    return [folded[i][1] or phrases[i] for i, _ in greedy_cover(len(phrases), lambda i: folded[i][0])]


def _is_main(rest: Sequence[Phrase]) -> bool:
    labels = [p.kind for p in rest]
    if "GREETING" in labels:
        return True
    return bool(rest) and rest[-1].kind in PREDICATES and any(rest[-1].text.endswith(m) for m in MAIN_ENDS) and matches(labels, TEMPLATES)


def parsed(words: Sequence[str], chunks: Sequence[Chunk], span: tuple[int, int]) -> tuple[list[Phrase], list[tuple[str, str, str | None, int, int]]]:
    """(phrases, clauses as (kind, relation, marker, first word, last word)) of one sentence.

    From the left, a verb phrase that ends with a marker, or is followed by
    just one, closes a clause of the marker's kind; relative markers tie a
    phrase to the noun behind it instead.  A purpose without a noun phrase
    before its verb is no clause: the verb gets the part PurposeVP.  What
    remains is the main clause if it ends in a verb phrase with a main ending,
    or greets.
    """
    inside = [c for c in chunks if c[2] < span[1] and c[3] >= span[0]]
    phrases = nested([q for p in enriched(words, inside) for q in _split(p)], words)
    out, start = [], 0
    for i, p in enumerate(phrases):
        if p.kind not in PREDICATES:
            continue
        gap = "".join(words[p.last + 1 : phrases[i + 1].first if i + 1 < len(phrases) else len(words)])
        text = p.text
        found = next((x for x in _LONGEST if text.endswith(x[0])), None) if _ENDS_WITH_MARKER.search(text) else _BY_MARKER.get(gap)
        if not found or found[1] == "relative":
            continue
        marker, kind = found
        if kind == "purpose" and not any(q.kind == "NP" for q in phrases[start:i]):
            phrases[i] = dc_replace(p, part="PurposeVP")
        else:
            out.append((kind, MARKERS[kind][0], marker, phrases[start].first, p.last))
        start = i + 1
    if _is_main(phrases[start:]):
        out.append(("main", "matrix", None, phrases[start].first, phrases[-1].last))
    return phrases, out


def clauses(words: Sequence[str], chunks: Sequence[Chunk], span: tuple[int, int]) -> list[tuple[str, str, str | None, int, int]]:
    return parsed(words, chunks, span)[1]


def flat(phrases: Sequence[Phrase], depth: int = 0) -> Iterator[tuple[int, Phrase]]:
    """(depth, phrase) of a tree in pre-order; there are at most three levels."""
    for p in phrases:
        yield depth, p
        yield from flat(p.children, depth + 1)
