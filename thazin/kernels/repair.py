"""Paragraph-wise conversion of legacy font order with a log, and a bigram model of the two orders."""

from __future__ import annotations

import math
import re
import struct
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable
from pathlib import Path

from thazin.functions.zawgyi_rules import LEGACY_TO_STANDARD
from thazin.kernels.text import canonical_order, legacy_to_standard

_RULES = [(re.compile(a), b) for a, b in LEGACY_TO_STANDARD]
_LOSSY = {i for i, (a, b) in enumerate(LEGACY_TO_STANDARD) if re.fullmatch("\\((.\\|)+.\\)", a) and "\\" not in b}  # several characters become one
_AMBIGUOUS = {67}  # fixed value: the rule that takes some zeros for a letter


class OrderModel:
    """Log-likelihood ratios of character bigrams between standard and legacy order; trained here, as no weights are shipped."""

    def __init__(self, ratio: dict[tuple[str, str], float]):
        self.ratio = ratio

    @classmethod
    def fit(cls, standard: Iterable[str], legacy: Iterable[str], smoothing: float = 0.5) -> OrderModel:
        counts = []
        for texts in (standard, legacy):
            c = Counter()
            for t in texts:
                c.update(p for p in cls._pairs(t))
            counts.append(c)
        size = len(counts[0] | counts[1]) + 1
        total = [sum(c.values()) + smoothing * size for c in counts]
        return cls({p: math.log((counts[0][p] + smoothing) / total[0]) - math.log((counts[1][p] + smoothing) / total[1]) for p in counts[0] | counts[1]})

    @staticmethod
    def _pairs(text: str) -> Iterable[tuple[str, str]]:
        s = ["", *text, ""]
        return ((a, b) for a, b in zip(s, s[1:]) if "က" <= a <= "႟" or "က" <= b <= "႟")

    def probability(self, text: str) -> float:
        """That a text is in legacy order; minus infinity where no bigram is known."""
        known = [self.ratio[p] for p in self._pairs(text) if p in self.ratio]
        if not known:
            return -math.inf
        x = sum(known)
        return 1 / (1 + math.exp(x)) if x < 700 else 0.0


class MarkovModel:
    """The published binary model: log-likelihood ratios between all pairs of states, where state 0 is any other character or the text's edge."""

    # The letters of the states, in the order of the file.
    RANGES = [(0x1000, 0x103F), (0x104A, 0x109F), (0xAA60, 0xAA7F), (0xA9E0, 0xA9FF)]
    SPACES = (0x2000, 0x200B)  # only in the first character set

    def __init__(self, letters: str, table: list[list[float]]):
        self.letters, self.table = letters, table

    @classmethod
    def read(cls, path: str) -> MarkovModel:
        """Tag, version, character set, tag, version, number of states; then a row each: how many entries, the usual value and the entries that differ."""
        data = memoryview(Path(path).read_bytes())
        fields = struct.Struct(">8si")
        tag, version = fields.unpack_from(data)
        at = fields.size
        if tag != b"UZMODEL " or version not in (1, 2):
            raise ValueError("no model of a known version")
        charset = 0
        if version == 2:
            (charset,) = struct.unpack_from(">i", data, at)
            at += 4
        if charset not in (0, 1):
            raise ValueError("unknown character set")
        tag, version, size = struct.unpack_from(">8sih", data, at)
        at += 14
        if tag != b"BMARKOV " or version != 0:
            raise ValueError("no table of a known version")
        letters = "".join(chr(c) for a, b in [*cls.RANGES, *([cls.SPACES] if charset == 0 else [])] for c in range(a, b + 1))
        if size != len(letters) + 1:
            raise ValueError(f"expected {len(letters) + 1} states, found {size}")
        table = []
        for _ in range(size):
            (entries,) = struct.unpack_from(">h", data, at)
            at += 2
            row = [0.0] * size
            if entries:
                row = [struct.unpack_from(">f", data, at)[0]] * size
                for j, value in struct.iter_unpack(">hf", data[at + 4 : at + 4 + 6 * entries]):
                    row[j] = value
                at += 4 + 6 * entries
            table.append(row)
        return cls(letters, table)

    def _state(self, c: str) -> int:
        i = bisect_left(self.letters, c)  # letters out of order are not found, as where the file is made
        return i + 1 if self.letters[i : i + 1] == c else 0

    def probability(self, text: str) -> float:
        """That a text is in legacy order; minus infinity where no pair of states is known."""
        states = [0, *map(self._state, text), 0]
        known = [self.table[a][b] for a, b in zip(states, states[1:]) if a or b]
        if not known:
            return -math.inf
        x = sum(known)
        return math.exp(-x) / (1 + math.exp(-x)) if x >= 0 else 1 / (1 + math.exp(x))


def category(matched: str, replacement: str) -> str:
    if len(matched) != len(replacement):
        return "length_change"
    return "reorder" if sorted(matched) == sorted(replacement) and matched != replacement else "substitution"


class Traced:
    """A text whose every character knows the span of the original it comes from."""

    def __init__(self, text: str, first: list[int] | None = None, last: list[int] | None = None, size: int | None = None):
        self.text, self.size = text, len(text) if size is None else size
        self.first = list(range(len(text))) if first is None else first
        self.last = list(range(1, len(text) + 1)) if last is None else last

    def origin(self, a: int, b: int) -> tuple[int, int]:
        """Where the piece [a, b) comes from; an empty one from the point before the next character."""
        if a < b:
            return self.first[a], self.last[b - 1]
        point = self.first[a] if a < len(self.first) else self.size
        return point, point

    def spliced(self, edits: list[tuple[int, int, str]]) -> Traced:
        """With pieces replaced; all of a replacement comes from where the piece came from."""
        keep = [0, *(b for _, b, _ in edits)]
        text, first, last = [], [], []
        for start, (a, b, new) in zip(keep, [*edits, (len(self.text), len(self.text), "")]):
            x, y = self.origin(a, b)
            text += [self.text[start:a], new]
            first += self.first[start:a] + [x] * len(new)
            last += self.last[start:a] + [y] * len(new)
        return Traced("".join(text), first, last, self.size)


def convert_logged(text: str) -> tuple[str, list[dict]]:
    """The rule cascade with every change: rule, what matched, what it became, the span of the original it goes back to, kind, and whether it loses a difference or is known to guess."""
    at, log = Traced(text), []
    for index, (pattern, to) in enumerate(_RULES):
        edits = [(*m.span(), m.expand(to)) for m in pattern.finditer(at.text)]
        if not edits:
            continue
        for a, b, new in edits:
            if new != (old := at.text[a:b]):
                x, y = at.origin(a, b)
                log.append({"rule_index": index, "matched_text": old, "replacement_text": new, "origin_start": x, "origin_end": y, "category": category(old, new), "lossy": index in _LOSSY, "ambiguous": index in _AMBIGUOUS})
        at = at.spliced(edits)
    return at.text, log


def standard(text: str, score: Callable[[str], float], threshold: float = 0.9) -> str:
    """The whole text converted if its score is above the threshold, then composed (NFC)."""
    return unicodedata.normalize("NFC", legacy_to_standard(text) if score(text) > threshold else text)


def scored_paragraphs(text: str, score: Callable[[str], float]) -> list[tuple[str, float]]:
    """The pieces between line breaks that aren't blank, each with its score."""
    return [(p, score(p)) for p in re.split("\n+", text) if p.strip()]


def repair_report(text: str, score: Callable[[str], float], threshold: float = 0.5) -> dict:
    """Each paragraph scored and, above the threshold, converted; separators kept as they are; summary over finite scores."""
    reports = []

    def one(m: re.Match) -> str:
        p = m.group()
        if not p.strip():
            return p
        s = score(p)
        new, log = convert_logged(p) if s > threshold else (p, [])
        if s > threshold:
            new = unicodedata.normalize("NFC", canonical_order(new))
        reports.append({"text": p, "converted_text": new, "probability": s, "converted": s > threshold, "repairs": log})
        return new

    out = re.sub("[^\n]+", one, text)
    finite = [r["probability"] for r in reports if r["probability"] > -math.inf]
    summary = dict.fromkeys(("min", "max", "spread"))
    if finite:
        summary = {"min": min(finite), "max": max(finite), "spread": max(finite) - min(finite)}
    return {"text": out, "paragraphs": reports, "summary": summary}
