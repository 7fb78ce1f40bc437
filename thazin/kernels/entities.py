"""Dictionary entities over the words of a text."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from pathlib import Path
from typing import NamedTuple

from thazin.kernels.analysis import words
from thazin.kernels.lexicon import Lexicon
from thazin.kernels.text import normalize, syllables

# Kinds of entities by the name of their list, and the gender some lists tell.
KINDS = {
    "male_names": "PERSON", "female_names": "PERSON", "towns": "TOWN", "villages": "VILLAGE", "districts": "DISTRICT", "states": "STATE", "self_administered_zones": "ZONE", "rivers": "RIVER", "mountains": "MOUNTAIN",
    "organizations": "ORGANIZATION", "universities": "UNIVERSITY", "religions": "RELIGION", "ethnic_groups": "ETHNIC_GROUP", "holidays": "HOLIDAY", "pagodas": "PAGODA",
}
GENDERS = {"male_names": "male", "female_names": "female"}
# Places, whose short names need support; words that support them; tags that speak against them.
PLACES = {"TOWN", "VILLAGE", "DISTRICT", "STATE", "ZONE", "RIVER", "MOUNTAIN"}
CUES = {"မှာ", "တွင်", "၌", "သို့", "မှ", "မြို့", "ရွာ", "ခရိုင်", "တိုင်း", "ပြည်နယ်", "မြို့နယ်", "ကျေးရွာ"}
AGAINST = {"VERB", "ADJ", "ADV", "AUX", "PART", "SFP", "CONJ", "POSTP"}
HONORIFICS = {"ဦး", "ဒေါ်", "မောင်", "ရှင်", "ဆရာ", "ဆရာမ"}
EMBEDDABLE = {"RELIGION", "ETHNIC_GROUP"}
REACH = 3  # words on either side in which a cue counts


class Hit(NamedTuple):
    text: str
    kind: str
    first: int
    last: int  # inclusive
    attributes: dict[str, str | None]


def cut_name(name: str, lexicon: Lexicon) -> tuple[str, ...]:
    """A name in the words the lexicon sees in it, as they will be seen in texts."""
    return tuple(w[0] for w in words(normalize(name), lexicon))


class Entities:
    """Names of entities, filed by their words; of equally long ones the first listed wins."""

    def __init__(self, entries: Iterable[tuple[str, str, dict[str, str | None]]], lexicon: Lexicon | None = None):
        self.lexicon = lexicon or Lexicon.seed()
        self.by_words: dict[tuple[str, ...], tuple[str, str, dict]] = {}
        self.by_text: dict[str, list[tuple[str, str, dict]]] = {}
        for name, kind, attributes in entries:
            key = cut_name(name, self.lexicon)
            if not key:
                continue
            entry = (name, kind, attributes)
            self.by_words.setdefault(key, entry)
            for text in {"".join(key), "".join(name.split())}:
                self.by_text.setdefault(text, []).append(entry)
        self.longest = max(map(len, self.by_words), default=0)

    @classmethod
    def load(cls, path: str, lexicon: Lexicon | None = None) -> Entities:
        """A JSON list, or the lists of a folder in order of name; the name of a file tells the kind, and files of other names are left out.  Holidays are objects with date, days and remarks."""
        files = [Path(path)] if Path(path).is_file() else sorted(Path(path).glob("*.json"))
        if not Path(path).exists():
            raise FileNotFoundError(path)
        entries: list[tuple[str, str, dict]] = []
        for file in files:
            kind = KINDS.get(file.stem)
            if kind is None:
                continue
            data = json.loads(file.read_text(encoding="utf-8-sig"))
            if kind == "HOLIDAY":
                if not isinstance(data, dict) or not isinstance(data.get("holidays") or [], list):
                    raise ValueError(f"{file.name}: expected an object with a list of holidays")
                rows = [(x["name"], {k: x.get(k) for k in ("date", "days", "remarks")}) for x in data.get("holidays") or [] if isinstance(x, dict) and isinstance(x.get("name"), str)]
            elif isinstance(data, list):
                rows = [(x, {"gender": GENDERS[file.stem]} if file.stem in GENDERS else {}) for x in data if isinstance(x, str)]
            else:
                raise ValueError(f"{file.name}: expected a list")
            entries += [(name.strip(), kind, {**more, "source": file.stem}) for name, more in rows if name.strip()]
        return cls(entries, lexicon)

    def lookup(self, text: str) -> list[tuple[str, str, dict]]:
        """All entries of a text, cut into words or without its spaces."""
        return self.by_text.get("".join(cut_name(text, self.lexicon))) or self.by_text.get("".join(text.split()), [])

    def __contains__(self, text: str) -> bool:
        return bool(self.lookup(text))

    def at(self, seq: Sequence[str], i: int) -> Hit | None:
        """The longest entity that begins at a word."""
        for n in range(min(self.longest, len(seq) - i), 0, -1):
            if (entry := self.by_words.get(tuple(seq[i : i + n]))) is not None:
                return Hit("".join(seq[i : i + n]), entry[1], i, i + n - 1, entry[2])
        return None

    def _fused(self, word: str, i: int) -> Hit | None:
        """A word that is an honorific and the name of a person."""
        for h in sorted(HONORIFICS, key=len, reverse=True):
            if word.startswith(h) and len(word) > len(h):
                person = next((e for e in self.lookup(word[len(h) :]) if e[1] == "PERSON"), None)
                if person:
                    return Hit(word, "PERSON", i, i, person[2])
        return None

    def find(self, seq: Sequence[str], tags: Sequence[str] | None = None) -> list[Hit]:
        """From left to right the longest entities that the text around them supports; a person takes the honorific before it."""
        if tags is not None and len(tags) != len(seq):
            raise ValueError("one tag for each word is needed")
        out, free = [], 0
        for i, word in enumerate(seq):
            if i < free or (hit := self.at(seq, i) or self._fused(word, i)) is None:
                continue
            if hit.kind == "PERSON" and hit.first and seq[hit.first - 1] in HONORIFICS:
                hit = hit._replace(text=seq[hit.first - 1] + hit.text, first=hit.first - 1)
            if supported(hit, seq, tags):
                out.append(hit)
                free = hit.last + 1
        return out


def supported(hit: Hit, seq: Sequence[str], tags: Sequence[str] | None) -> bool:
    """Whether a hit stands as an entity: no religion or people inside a compound of nouns, and no short name of a place without a cue or against its tags."""
    around = [tags[k] if tags and 0 <= k < len(tags) else None for k in (hit.first - 1, hit.last + 1)]
    if hit.kind in EMBEDDABLE and around == ["NOUN", "NOUN"]:
        return False
    size = len(syllables(hit.text))
    if hit.kind not in PLACES or size > 2:
        return True
    if CUES & {*seq[max(0, hit.first - REACH) : hit.first], *seq[hit.last + 1 : hit.last + 1 + REACH]}:
        return True
    return size == 2 and not (tags and AGAINST & set(tags[hit.first : hit.last + 1]))
