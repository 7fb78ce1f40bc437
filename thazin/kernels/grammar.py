"""Phrase grammars: patterns over tags and words, compiled to regular expressions.

A pattern is a row of atoms: NAME, (A|B) or word=..., each with an optional
?, * or +.  A token is coded as two characters, one for its tag and one for
its word, so an atom is a choice between a class of tags and one of words.
The name of another phrase stands for its core pattern.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping, Sequence
from pathlib import Path

from thazin.kernels import lexicon as L

Rule = tuple[str, int, Sequence[str]]  # type, priority, patterns

# Phrase patterns over tags, by type and priority.
PHRASES: list[Rule] = [
    ("FIXED_EXPRESSION", 250, ["IDIOM"]),
    ("VP", 200, ["PART VERB AUX* PART* SFP?", "ADV? VERB AUX+ PART* SFP?", "VERB AUX PART SFP", "VERB AUX SFP", "VERB AUX", "VERB AUX+ SFP?", "VERB PART+ SFP?", "VERB AUX PART*", "PART VERB PART+ SFP?", "PART VERB SFP", "VERB SFP", "VERB"]),
    ("PP", 150, ["NOUN_PHRASE POSTP", "(PROPN|NOUN|PRON)+ PART* POSTP", "(PROPN|NOUN|PRON)+ POSTP", "NOUN POSTP"]),
    ("NP", 100, ["PRON PART SFP?", "PRON PART", "ADJ NOUN", "NUM NOUN", "NOUN NOUN+", "(PROPN|NOUN|PRON)+ PART", "(PROPN|NOUN|PRON)+", "NOUN", "PRON"]),
    ("ADJP", 80, ["ADV ADJ", "ADJ"]),
    ("NUMP", 70, ["NUM NOUN", "NUM"]),
]
NAMES = {"NOUN_PHRASE": "NP", "VERB_PHRASE": "VP", "POSTPOSITIONAL_PHRASE": "PP", "ADJECTIVE_PHRASE": "ADJP", "NUMBER_PHRASE": "NUMP"}
ALIASES = {"PROPN": ["NOUN"]}
# Texts that make a phrase of their own, with its type.
EXCEPTIONS = {"မင်္ဂလာပါ": "GREETING", "ကျေးဇူးတင်ပါတယ်": "FIXED_EXPRESSION", "အားနာပါတယ်": "FIXED_VERB"}


class GrammarError(ValueError):
    """A grammar or one of its patterns is invalid."""


_ATOM = re.compile("\\s*(?:\\(([^()]*)\\)|(word=[^\\s?*+]+)|([A-Za-z_]+))([?*+]?)")


class Grammar:
    """Rules with their patterns compiled; matching takes the longest span, then the higher priority, then the first rule."""

    def __init__(self, rules: Iterable[Rule] = PHRASES, exceptions: Mapping[str, str] | None = None, aliases: Mapping[str, Sequence[str]] = ALIASES):
        self.rules = list(rules)
        self.exceptions = dict(EXCEPTIONS if exceptions is None else exceptions)
        self.aliases = dict(aliases)
        self.tag_codes = {t: chr(0x100 + i) for i, t in enumerate([*L.TAGS, "PROPN"])}
        self.word_codes: dict[str, str] = {}
        self.cores = {name: self._core(kind) for name, kind in NAMES.items()}
        self.by_first: dict[str, list[tuple[int, int, str, re.Pattern]]] = {}  # patterns by the code of a tag they may begin with
        for k, (kind, priority, patterns) in enumerate(self.rules):
            for text in patterns:
                atoms = self._atoms(text, ())
                pattern = re.compile("".join(f"(?:{choice}){times}" for choice, _, times in atoms))
                for code in self._begins(atoms):
                    self.by_first.setdefault(code, []).append((priority, -k, kind, pattern))

    def _core(self, kind: str) -> str | None:
        """The shortest pattern of a type's rule of highest priority that doesn't end in a postposition."""
        rule = max((r for r in self.rules if r[0] == kind), key=lambda r: r[1], default=None)
        return min((p for p in rule[2] if not p.split()[-1].startswith("POSTP")), key=len, default=None) if rule else None

    def _atoms(self, text: str, inside: tuple[str, ...]) -> list[tuple[str, str | None, str]]:
        """(choice as an expression, codes of its tags or None for any, repetition) of each atom, references replaced."""
        out, at = [], 0
        while text[at:].strip():
            m = _ATOM.match(text, at)
            if not m:
                raise GrammarError(f"invalid pattern {text!r} near {text[at : at + 12]!r}")
            group, word, name, times = m.groups()
            at = m.end()
            if name in NAMES:
                if times or name in inside or self.cores[name] is None:
                    raise GrammarError(f"a phrase can't be repeated, refer to itself or be without a pattern: {name!r} in {text!r}")
                out += self._atoms(self.cores[name], (*inside, name))
                continue
            parts = [p.strip() for p in (group or word or name).split("|") if p.strip()]
            if any(p in NAMES for p in parts):
                raise GrammarError(f"a phrase can't be one of several choices in {text!r}")
            out.append((*self._choice(parts, text), times))
        if not out:
            raise GrammarError("empty pattern")
        return out

    def _begins(self, atoms: Sequence[tuple[str, str | None, str]]) -> str:
        """Codes of the tags a match may begin with."""
        out = ""
        for _, tags, times in atoms:
            if tags is None:
                return "".join(self.tag_codes.values()) + "~"
            out += tags
            if times not in ("?", "*"):
                return out
        return out

    def _choice(self, parts: Sequence[str], text: str) -> tuple[str, str | None]:
        tags, words = "", ""
        for p in parts:
            if p.startswith("word="):
                words += self.word_codes.setdefault(p[5:], chr(0x4E00 + len(self.word_codes)))
            elif p in self.aliases:
                tags += "".join(self.tag_codes[t] for t in self.aliases[p])
            elif p in L.TAGS:
                tags += self.tag_codes[p]
            else:
                raise GrammarError(f"unknown symbol {p!r} in {text!r}")
        if not tags and not words:
            raise GrammarError(f"no choice in {text!r}")
        return "|".join(x for x in (f"[{tags}]." if tags else "", f".[{words}]" if words else "") if x), None if words else tags

    def coded(self, words: Sequence[str], tags: Sequence[str]) -> str:
        return "".join(self.tag_codes.get(t, "~") + self.word_codes.get(w, "~") for w, t in zip(words, tags))

    def longest(self, coded: str, i: int, stop: int) -> tuple[int, str] | None:
        """(words, type) of the best match at a word, not beyond another."""
        best = None
        for priority, rank, kind, pattern in self.by_first.get(coded[2 * i], ()):
            m = pattern.match(coded, 2 * i, 2 * stop)
            if m and m.end() > 2 * i and (best is None or (m.end(), priority, rank) > best[:3]):
                best = (m.end(), priority, rank, kind)
        return (best[0] // 2 - i, best[3]) if best else None

    @classmethod
    def from_file(cls, path: str, exceptions: str | None = None) -> Grammar:
        """Rules from a JSON (or, where a reader is installed, YAML) list of objects with type, priority and patterns; exceptions from one of texts to types."""
        data = _read(path)
        if not isinstance(data, list):
            raise GrammarError(f"expected a list of rules: {path}")
        rules = []
        for r in data:
            if not isinstance(r, dict) or not isinstance(r.get("type"), str) or not isinstance(r.get("patterns"), list):
                raise GrammarError(f"a rule needs a type and patterns: {r!r}")
            rules.append((r["type"], int(r.get("priority", 0)), [str(p) for p in r["patterns"]]))
        return cls(rules, _read(exceptions) if exceptions else None)


def _read(path: str):
    text = Path(path).read_text(encoding="utf-8-sig")
    if path.endswith((".yml", ".yaml")):
        try:
            import yaml
        except ImportError as e:
            raise GrammarError("no reader for YAML is installed") from e
        return yaml.safe_load(text)
    return json.loads(text)


_DEFAULT: list[Grammar] = []


def default() -> Grammar:
    if not _DEFAULT:
        _DEFAULT.append(Grammar())
    return _DEFAULT[0]
