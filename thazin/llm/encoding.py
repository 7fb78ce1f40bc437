"""Garbled text from a wrong encoding (problem 5): noisy-channel decoding.

A stored text is what a channel made of an original: UTF-8 bytes read in a
one-byte or two-byte encoding (once or repeatedly, with lost bytes), one-byte
text read as UTF-8, legacy font order kept as standard Unicode, or standard
Unicode put through the legacy conversion.  For each channel the stored
characters give a lattice of bytes, in which a lost byte is a wildcard; a
Viterbi search picks the path whose words and characters are most frequent in
the corpus.  A reading replaces the stored text where it is more probable.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thazin.kernels.text import canonical_order, legacy_to_standard, standard_to_legacy
from thazin.session import built, shared, spread

# Encodings in which UTF-8 bytes are read by mistake.
CODECS = ("cp1252", "latin-1", "cp1251", "cp437", "mac_roman", "cp850", "cp866", "koi8_r", "cp1250", "cp1253", "cp1254", "gbk")
# One-byte encodings read as others (read as, meant).
SWAPS = (("cp1252", "cp874"), ("latin-1", "cp874"), ("cp1251", "cp1252"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"))
PLAIN = frozenset("“”‘’«»„…–—€။၊·¿¡°§£​‌‍⁠﻿\u00a0\u00ad\u2009\u202f\u3000၀၁၂၃၄၅၆၇၈၉၏၌၍၎")
WORD_SHARE = 1e-5  # words below this share of all words aren't sent to the tasks, so at most 1 / WORD_SHARE are
_WORDS = re.compile("[က-႟]+|[^\\W\\d_က-႟]+")
_SYLLABLES = re.compile("[က-အဣ-ဪဿၐ-ၕၚ-ၝၡၥၦၮ-ၰၵ-ႁႎ](?:္[က-အၐ-ႁ])*(?:(?![က-အဣ-ဪဿ၀-၏ၐ-ၕၚ-ၝၡၥၦၮ-ၰၵ-ႁႎ]).|[က-အၵ-ႁ](?=[့း]*်))*", re.S)
_MYANMAR = re.compile("[က-႟]")
LOST = "�"
SYMBOL = 6.0  # log cost of a symbol where a letter is expected
SWAP_GAIN = 10.0  # log probability that the words of a text must gain together
KEPT = -9.0  # log cost of a character of the codec that is kept within a run


def words(text: str) -> Iterator[str]:
    """Syllables of Myanmar script and runs of other letters, in lower case."""
    for m in _WORDS.finditer(text):
        w = m.group()
        if "က" <= w[0] <= "႟":
            yield from _SYLLABLES.findall(w)
        else:
            yield w.lower()


def trigrams(text: str) -> Iterator[str]:
    for m in _WORDS.finditer(text):
        w = f"^{m.group().lower()}$"
        for i in range(len(w) - 1):
            yield w[max(0, i - 1) : i + 2]


class Model:
    """Word frequencies over character trigrams, both of the corpus."""

    def __init__(self, word: dict[str, int], tri: dict[str, int]):
        self.word = word
        self.total = sum(word.values()) + 1
        self.tri = tri
        self.bi = Counter()
        for t, n in tri.items():
            self.bi[t[:-1]] += n
        self.letters = {c for t in tri for c in t} - {"^", "$"}
        self.floor = math.log(1e-6)
        self.memo: dict[str, float] = {}
        self.scores: dict[str, float] = {}
        self.runs: dict[tuple[str, str], list[tuple[str, int, int]]] = {}
        self.moves: dict[tuple[str, str], tuple[tuple[float, str], ...]] = {}
        self.standard: dict[str, str] = {}  # chunks converted from legacy order, and to it
        self.legacy: dict[str, str] = {}
        self.steps: dict[tuple[tuple[str, ...], ...], np.ndarray] = {}

    def char(self, before: str, c: str) -> float:
        return math.log((self.tri.get(before + c, 0) + 0.02) / (self.bi.get(before, 0) + 2.0))

    def spelled(self, w: str) -> float:
        known = self.memo.get(w)
        if known is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            s = f"^{w}$"
            known = self.memo[w] = sum(self.char(s[max(0, i - 2) : i], s[i]) for i in range(1, len(s)))
        return known

    def _score(self, run: str) -> float:
        low = run.lower()
        parts = _SYLLABLES.findall(run) if "က" <= run[0] <= "႟" else [low]
        seen = (self.floor - 2.5) * (len(run) - sum(map(len, parts)))  # characters outside any syllable
        seen += sum(map(self.whole, parts))
        return 0.5 * seen + 0.5 * self.spelled(low)

    def score(self, text: str) -> float:
        """Log probability of the words; a letter run's spelling stands in for rare words."""
        total = 0.0
        for m in _WORDS.finditer(text):
            run = m.group()
            known = self.scores.get(run)
            if known is None:
                if len(self.scores) > 100_000:
                    self.scores.clear()
                known = self.scores[run] = self._score(run)
            total += known
        return total

    def whole(self, w: str) -> float:
        """Log probability of a word or syllable."""
        n = self.word.get(w, 0)
        return math.log(n / self.total) if n else self.floor - 2.5 * len(w)

    @cached_property
    def prefixes(self) -> frozenset[str]:
        return frozenset(w[:i] for w in self.word for i in range(1, len(w) + 1))

    @cached_property
    def pairs(self) -> Counter:
        """Counts of neighbouring letters."""
        out: Counter = Counter()
        for t, n in self.tri.items():
            out[t[-2:]] += n
        return out

    @cached_property
    def firsts(self) -> Counter:
        out: Counter = Counter()
        for t, n in self.pairs.items():
            out[t[0]] += n
        return out

    def pair(self, a: str, b: str) -> float:
        return math.log((self.pairs.get(a + b, 0) + 0.02) / (self.firsts.get(a, 0) + 2.0))

    def follow(self, state: str, c: str) -> tuple[tuple[float, str], ...]:
        """(log probability, new state) of each way on when a lower-case letter, or "" for anything else, follows.

        A state is what later scores depend on: "" between words, a prefix of
        a corpus word, or \\0 and the last letter of a word the corpus lacks,
        which is paid by its pairs of letters.  Burmese syllables follow each
        other without a gap; other words end where their letters end.
        """
        known = self.moves.get((state, c))
        if known is None:
            if len(self.moves) > 200_000:
                self.moves.clear()
            known = self.moves[state, c] = tuple(self._follow(state, c))
        return known

    def _follow(self, state: str, c: str) -> Iterator[tuple[float, str]]:
        burmese = bool(_MYANMAR.match(state[-1:]))
        joined = bool(state and c) and burmese == bool(_MYANMAR.match(c))
        unknown = state[:1] == "\0"
        if joined and unknown:
            yield self.pair(state[1], c), "\0" + c
        elif joined and state + c in self.prefixes:
            yield 0.0, state + c
        if joined and not burmese:
            return
        # the word is over
        if not state or unknown or state in self.word:
            paid = 0.0 if not state else self.pair(state[1], "$") if unknown else self.whole(state)
            if not c:
                yield paid, ""
                return
            if c in self.prefixes:
                yield paid, c
            if not (joined and unknown):
                yield paid + self.floor + self.pair("^", c), "\0" + c

    @cached_property
    def blocks(self) -> frozenset[int]:
        """Blocks of code points that hold many of the corpus letters, so that rare ones of the same scripts are letters too."""
        seen = Counter(ord(c) >> 7 for c in self.letters)
        return frozenset(b for b, n in seen.items() if n > 9)

    def spelt(self, c: str) -> bool:
        """Whether a character may stand in the corpus."""
        low = c.lower()
        return low in self.letters or not c.isalnum() or c.isdigit() or ord(c) >> 7 in self.blocks

    @cached_property
    def latin(self) -> tuple[str, ...]:
        """The letters beyond ASCII that a lost byte may have been."""
        return tuple(c for c in sorted(self.letters) if "ß" <= c <= "ɏ") or ("é",)

    @cached_property
    def by_pattern(self) -> dict[str, list[str]]:
        """The corpus words by what is left of them when all those letters are lost."""
        gone, out = str.maketrans(dict.fromkeys(self.latin, LOST)), {}
        for w in sorted(self.word):
            if (left := w.translate(gone)) != w:
                out.setdefault(left, []).append(w)
        return out

    def _step(self, a: tuple[str, ...], b: tuple[str, ...], c: tuple[str, ...]) -> np.ndarray:
        known = self.steps.get((a, b, c))
        if known is None:
            known = np.array([[[self.char(x + y, z) for z in c] for y in b] for x in a])
            if len(self.steps) > 500:
                self.steps.clear()
            if known.size <= 500_000:
                self.steps[a, b, c] = known
        return known

    def likeliest(self, options: list[tuple[str, ...]]) -> str:
        """Of all words with one of the given letters at each place the one of most probable spelling: Viterbi by the last two letters."""
        places = [("",), ("^",), *options, ("$",)]
        score, back = np.zeros((1, 1)), []
        for a, b, c in zip(places, places[1:], places[2:]):
            ways = score[:, :, None] + self._step(a, b, c)
            back.append(ways.argmax(axis=0))
            score = ways.max(axis=0)
        j, k, out = int(score[:, 0].argmax()), 0, []
        for opts, best in zip(options[::-1], back[::-1]):
            out.append(opts[j])
            j, k = int(best[j, k]), j
        return "".join(reversed(out))

    def fitting(self, pattern: str) -> str | None:
        """The most frequent corpus word that a word in lower case with lost letters may be."""
        gone = str.maketrans(dict.fromkeys(self.latin, LOST))
        fits = [w for w in self.by_pattern.get(pattern.translate(gone), ()) if all(p in (c, LOST) for p, c in zip(pattern, w))]
        return max(fits, key=lambda w: (self.word[w], self.spelled(w)), default=None)

    def completed(self, pattern: str) -> str:
        """A word with its lost letters: the most frequent corpus word that fits, else the most probable spelling."""
        return self.fitting(pattern) or self.likeliest([self.latin if c == LOST else (c,) for c in pattern])


# ------------------------------------------------------------------ byte channels


@lru_cache(None)
def _bytes_of(codec: str) -> dict[str, bytes]:
    """Character to byte of a one-byte codec; bytes it leaves undefined appear as C1 controls."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out.setdefault(bytes([b]).decode(codec), bytes([b]))
        except UnicodeDecodeError:
            pass
    for b in range(0x80, 0xA0):
        if bytes([b]) not in out.values():
            out.setdefault(chr(b), bytes([b]))
    return out


@lru_cache(None)
def _hint(codec: str) -> re.Pattern:
    """A lead byte's character followed by a continuation's (or a lost one)."""
    if codec == "gbk":
        return re.compile("[㐀-鿿豈-﫿—-]")
    table = _bytes_of(codec)
    of = lambda lo, hi: "".join(re.escape(c) for c, b in table.items() if lo <= b[0] <= hi)
    return re.compile(f"[{of(0xC2, 0xF4)}{LOST}][{of(0x80, 0xBF)}{LOST}]")


def _to_bytes(text: str, codec: str) -> list[tuple[int, str]] | None:
    """(byte or -1 for a wildcard or -2 for a character the codec doesn't have, character) for each byte."""
    table = _bytes_of(codec) if codec != "gbk" else None
    out: list[tuple[int, str]] = []
    for c in text:
        if c < "\x80":
            out.append((ord(c), c))
        elif c == LOST:
            out.append((-1, c))
        elif table is not None:
            b = table.get(c)
            out.append((b[0], c) if b else (-2, c))
        else:
            try:
                b = c.encode(codec)
            except UnicodeEncodeError:
                b = b""
            if len(b) == 2:
                out += [(b[0], c), (b[1], "")]
            else:
                out.append((-2, c))
    return out


def _lead(b: int) -> int:
    return 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0


def _fill(seq: list[int], letters: frozenset[str]) -> list[str]:
    """The letters a byte sequence with wildcards can stand for."""
    lost = [i for i, b in enumerate(seq) if b == -1]
    if not lost:
        try:
            return [bytes(seq).decode("utf-8")]
        except UnicodeDecodeError:
            return []
    return [c for c, coded in _by_length(letters).get(len(seq), ()) if all(b == -1 or b == x for b, x in zip(seq, coded))]


@lru_cache(2)
def _by_length(letters: frozenset[str]) -> dict[int, list[tuple[str, bytes]]]:
    out: dict[int, list[tuple[str, bytes]]] = {}
    for c in sorted(letters | PLAIN):
        out.setdefault(len(c.encode("utf-8")), []).append((c, c.encode("utf-8")))
    return out


@lru_cache(None)
def _undefined(codec: str) -> frozenset[int]:
    """Bytes a one-byte codec has no character for: those that are lost in reading."""
    out = set()
    for b in range(0x80, 0x100):
        try:
            bytes([b]).decode(codec)
        except UnicodeDecodeError:
            out.add(b)
    return frozenset(out)


_RUN = re.compile("[^\x00-\x7f]+")
_STRETCH = re.compile("[A-Za-z]*(?:[^\x00-\x7f]+[A-Za-z]*)+")


def decode_bytes(text: str, codec: str, model: Model) -> tuple[str, int]:
    """(best reading, bytes decoded) under one byte channel.

    ASCII never is part of a longer sequence, so each run of other characters
    with the letters around it has its own lattice.  A run is read anew only
    if most of it decodes.
    """
    out, at, total = [], 0, 0
    hint = _hint(codec)
    for m in _STRETCH.finditer(text):
        stretch = m.group()
        if hint.search(stretch):
            key = (codec, stretch)
            known = model.runs.get(key)
            if known is None:
                if len(model.runs) > 50_000:
                    model.runs.clear()
                known = model.runs[key] = _decode_stretch(stretch, codec, model)
            for run, (reading, decoded, kept) in zip(_RUN.finditer(stretch), known):
                if decoded and kept <= 0.34 * len(run.group()):
                    out += [text[at : m.start() + run.start()], reading]
                    at, total = m.start() + run.end(), total + decoded
    return "".join(out) + text[at:], total


def _letter(c: str) -> bool:
    return c.isalpha() or "\u102b" <= c <= "\u103e" or "\u1056" <= c <= "\u109f"


def _decode_stretch(stretch: str, codec: str, model: Model) -> list[tuple[str, int, int]]:
    """(reading, bytes decoded, characters of the codec kept) of each run: Viterbi over the byte lattice of a stretch of words.

    The words of a path are paid by their frequencies in the corpus.  All
    states are kept, so the path is the best one.
    """
    data: list[tuple[int, str]] = []
    of: list[int] = []  # number of the run, or -1 where nothing can be read anew
    hint, at = _hint(codec), 0
    for k, m in enumerate(_RUN.finditer(stretch)):
        data += [(-2, c) for c in stretch[at : m.start()]]
        of += [-1] * (m.start() - at)
        part = _to_bytes(m.group(), codec) if hint.search(m.group()) else None
        data += [(-2, c) for c in m.group()] if part is None else part
        of += [-1] * len(m.group()) if part is None else [k] * len(part)
        at = m.end()
    data += [(-2, c) for c in stretch[at:]]
    of += [-1] * (len(stretch) - at)
    n, letters = len(data), frozenset(model.letters)
    undefined = _undefined(codec) if codec != "gbk" else frozenset()
    # at each byte position, by state: (score, value before, run, character, decoded, kept)
    ways: list[dict[str, tuple]] = [{} for _ in range(n + 5)]
    ways[0][""] = (0.0, None, -1, "", 0, 0)
    follow, moves = model.follow, model.moves
    for i in range(n):
        if not ways[i]:
            continue
        b, c = data[i]
        options: list[tuple[int, str, float, int, int]] = []
        if of[i] < 0:
            options.append((1, c, 0.0, 0, 0))
        elif c:
            step = 2 if i + 1 < n and data[i + 1][1] == "" else 1
            options.append((step, c, KEPT, 0, int(b >= 0)))
        else:
            options.append((1, LOST, KEPT - 3.0, 0, 1))  # second half of a character whose first half was used
        for size in (2, 3, 4) if of[i] >= 0 else ():
            if i + size > n or (b != -1 and _lead(b) != size):
                continue
            seq = [x for x, _ in data[i : i + size]]
            if all(x == -1 for x in seq[: 2 if b == -1 else 1]) or any(x != -1 and not 0x80 <= x <= 0xBF for x in seq[1:]):
                continue
            lost = [k for k, x in enumerate(seq) if x == -1]
            for ch in _fill(seq, letters):
                if model.spelt(ch):
                    coded = ch.encode("utf-8") if lost else b""
                    options.append((size, ch, sum(-0.5 if coded[k] in undefined else -3.0 for k in lost) - (0.0 if not lost or _letter(ch) else 8.0), size, 0))
                elif not lost and ch in _bytes_of("cp1252"):  # it may have been misread twice
                    options.append((size, ch, -3.0, size, 0))
        here = ways[i].items()
        for step, ch, cost, d, k in options:
            low = ch.lower() if len(ch.lower()) == 1 else ch
            low, to, run = low if _letter(low) else "", ways[i + step], of[i]
            for state, before in here:
                sofar = before[0] + cost
                for paid, new in moves.get((state, low)) or follow(state, low):
                    old = to.get(new)
                    if old is None or sofar + paid > old[0]:
                        to[new] = (sofar + paid, before, run, ch, d, k)
    runs: list[list] = [["", 0, 0] for _ in _RUN.finditer(stretch)]
    ends = [(v[0] + paid, v) for state, v in ways[n].items() for paid, _ in follow(state, "")]
    way = max(ends, key=lambda x: x[0])[1] if ends else None
    while way:
        _, way, k, ch, decoded, kept = way
        if k >= 0:
            runs[k] = [ch + runs[k][0], runs[k][1] + decoded, runs[k][2] + kept]
    return [tuple(r) for r in runs]


@lru_cache(None)
def _swap(read: str, meant: str) -> dict[str, str]:
    """Characters as read, and as meant, of the bytes that are letters or marks in the encoding meant."""
    out = {}
    for c, b in _bytes_of(read).items():
        try:
            new = b.decode(meant)
        except UnicodeDecodeError:
            continue
        if new != c and unicodedata.category(new)[0] in "LMN":
            out[c] = new
    return out


def swap_bytes(text: str, model: Model) -> tuple[str, str | None]:
    """One-byte text read in another one-byte encoding: the words whose letters beyond ASCII all are bytes of letters of the other one.

    A channel holds for a whole text: where its words gain enough together,
    each word that gains is read anew, whatever its length.
    """
    found, odd = None, {c for c in text if c > "\x7f"}
    for read, meant in SWAPS:
        table, gain = _swap(read, meant), 0.0
        if odd.isdisjoint(table):
            continue

        def fix(m: re.Match) -> str:
            nonlocal gain
            word = m.group()
            new = "".join(c if c < "\x80" else table.get(c, "") for c in word)
            if len(new) < len(word) or not all(c < "\x80" or model.spelt(c) for c in new):
                return word
            more = model.score(new) - model.score(word) + SYMBOL * sum(c in table and not c.isalnum() for c in word)
            gain += max(0.0, more)
            return new if more > 0 else word

        reading = _STRETCH.sub(fix, text)
        if gain > SWAP_GAIN and (found is None or gain > found[0]):
            found = (gain, reading, f"{meant} as {read}")
    return (found[1], found[2]) if found else (text, None)


def restore_lost(text: str, model: Model) -> str:
    """One-byte text read as UTF-8: every lost character is one letter, chosen by the frequency of its word."""
    if LOST not in text:
        return text

    def fix(m: re.Match) -> str:
        w = m.group()
        best = model.completed(w.lower())
        return "".join(b.upper() if a.isupper() or (a == LOST and w.isupper()) else b for a, b in zip(w, best))

    return re.sub(f"[^\\W\\d_]*{LOST}[^\\W\\d_{LOST}]*(?:{LOST}[^\\W\\d_]*)*", fix, text)


_GONE = re.compile("(?<!\\S)\\?{2,}")
_HOLED = re.compile("[^\\W\\d_]+(?:\\?[^\\W\\d_]+)+")


def replaced(text: str, model: Model) -> tuple[str, bool]:
    """(text, whether letters of it were replaced by question marks).

    A question mark inside a word is restored where that gives a corpus word.
    Words that only consist of question marks can't be, but four or more such
    marks tell that something was there.
    """
    if "?" not in text:
        return text, False

    def fix(m: re.Match) -> str:
        best = model.fitting(m.group().lower().replace("?", LOST))
        return "".join(b if a == "?" else a for a, b in zip(m.group(), best)) if best else m.group()

    new = _HOLED.sub(fix, text)
    return new, new != text or sum(len(m.group()) for m in _GONE.finditer(text)) >= 4


# ------------------------------------------------------------------ font-order channels

_CHUNK = re.compile("[^\\s။၊]*[\\s။၊]*")
SWITCH = 7.0  # log cost of a change of channel between chunks


# Only rules about this digit, and about this mark after a space, look beyond a chunk.
_ACROSS = re.compile("၀|\\s့")


def _readings(chunks: list[str], text: str, rewrite, memo: dict[str, str]) -> list[str]:
    """The rewritten chunks: each by itself where no rule looks beyond it, else from one pass over the whole text where its chunks stay aligned."""
    if not _ACROSS.search(text):
        out = []
        for c in chunks:
            known = memo.get(c)
            if known is None:
                if len(memo) > 100_000:
                    memo.clear()
                known = memo[c] = canonical_order(rewrite(c)) if _MYANMAR.search(c) else c
            out.append(known)
        return out
    whole = [m.group() for m in _CHUNK.finditer(rewrite(text)) if m.group()]
    if len(whole) != len(chunks):
        whole = [rewrite(c) if _MYANMAR.search(c) else c for c in chunks]
    return [canonical_order(c) for c in whole]


def font_order(text: str, model: Model, sibling: str | None = None) -> list[tuple[str, str | None, str]]:
    """(chunk, channel, reading) in text order: Viterbi over the chunks between spaces and stops, each kept, in legacy order or wrongly converted.

    ``sibling`` may hold what the text was converted from; a chunk that is
    just the conversion of its counterpart there can be undone exactly.
    """
    chunks = [m.group() for m in _CHUNK.finditer(text) if m.group()]
    if not chunks:
        return []
    legacy, converted = _readings(chunks, text, legacy_to_standard, model.standard), _readings(chunks, text, standard_to_legacy, model.legacy)
    source: list[str | None] = [None] * len(chunks)
    if sibling and sibling != text:
        other = [m.group() for m in _CHUNK.finditer(sibling) if m.group()]
        if len(other) == len(chunks):
            source = [o if o != c and canonical_order(r) == canonical_order(c) else None for o, c, r in zip(other, chunks, _readings(other, sibling, legacy_to_standard, model.standard))]
    out: list[tuple[str, list[tuple[str | None, str, float]]]] = []
    for s, a, b, o in zip(chunks, legacy, converted, source):
        if not _MYANMAR.search(s):
            out.append((s, [(k, s, 0.0) for k in (None, "legacy", "converted")]))
            continue
        here = model.score(s)
        undone = ("converted", b, model.score(b) - here if b != s else 0.0)
        if o is not None:
            undone = ("converted", o, model.score(o) - here + 4.0)
        out.append((s, [(None, s, 0.0), ("legacy", a, model.score(a) - here if a != s else 0.0), undone]))
    paths, back = [-SWITCH * (k > 0) for k in range(3)], []
    for _, options in out:
        before = [max(range(3), key=lambda j, k=k: (paths[j] - SWITCH * (j != k), -j)) for k in range(3)]
        paths = [paths[j] - SWITCH * (j != k) + options[k][2] for k, j in enumerate(before)]
        back.append(before)
    k, way = max(range(3), key=lambda j: (paths[j], -j)), []
    for before in reversed(back):
        way.append(k)
        k = before[k]
    way.reverse()
    return [(s, o[k][0] if o[k][1] != s else None, o[k][1]) for (s, o), k in zip(out, way)]


def repair(text: str | None, model: Model, sibling: str | None = None) -> tuple[bool, str | None, str | None]:
    """(garbled, restored text, channels, as names joined by +).  Null gives (False, null, null)."""
    if text is None:
        return False, None, None
    channels: list[str] = []
    while not text.isascii():  # a text may have been misread repeatedly; each reading is shorter
        found = None
        for codec in CODECS:
            if not _hint(codec).search(text):
                continue
            reading, decoded = decode_bytes(text, codec, model)
            if not decoded or len(reading.encode()) >= len(text.encode()):
                continue
            left = sum(c > "\x7f" and c.lower() not in model.letters and c not in PLAIN for c in reading)
            odd = sum(c > "\x7f" and c.lower() not in model.letters and c not in PLAIN or c == LOST for c in text)
            covered = decoded / (2 if codec == "gbk" else 1) / max(1, odd)
            rank = (round(min(1.0, covered), 2), -left, model.score(reading) / max(1, len(reading)))
            if found is None or rank > found[0]:
                found = (rank, codec, reading)
        if found is None:
            break
        text = found[2]
        channels.append(found[1])
    if not text.isascii():
        text, swap = swap_bytes(text, model)
        channels += [swap] if swap else []
    if LOST in text:
        text = restore_lost(text, model)
        channels.append("lost")
    text, gone = replaced(text, model)
    if gone:
        channels.append("replaced")
    if _MYANMAR.search(text):
        segments = font_order(text, model, sibling)
        kinds = {k for _, k, _ in segments if k}
        if kinds:
            text = "".join(r for _, _, r in segments)
            channels += sorted(kinds)
    return bool(channels), text, "+".join(channels) or None


def counted(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(kind, token, n): word and trigram counts of all values of the columns; summed per task before the one shuffle."""
    columns = list(columns)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out(held: dict[str, Counter]) -> pd.DataFrame:
            return pd.concat([pd.DataFrame({"kind": k, "token": list(c), "n": list(c.values())}) for k, c in held.items()])

        held = {"word": Counter(), "tri": Counter()}
        for batch in batches:
            for c in columns:
                for t in batch[c]:
                    if t:
                        held["word"].update(words(t))
                        held["tri"].update(trigrams(t))
            if len(held["word"]) > 200_000:
                yield out(held)
                held = {"word": Counter(), "tri": Counter()}
        if held["word"] or held["tri"]:
            yield out(held)

    return df.select(*columns).mapInPandas(count, "kind string, token string, n long").groupBy("kind", "token").agg(F.sum("n").alias("n"))


def corpus_model(df: DataFrame, columns: Iterable[str], share: float = WORD_SHARE) -> tuple[dict[str, int], dict[str, int]]:
    """Word and trigram counts for :class:`Model`, over all rows.

    Entries below a share of their kind's total are left to smoothing, so at
    most 2 / share entries reach the driver however large the corpus is.
    """
    counts = counted(df, columns)
    total = counts.groupBy("kind").agg(F.sum("n").alias("all"))
    kept = counts.join(F.broadcast(total), "kind").where(F.col("n") >= F.greatest(F.col("all") * share, F.lit(1)))
    word, tri = {}, {}
    for r in kept.select("kind", "token", "n").toLocalIterator():
        (word if r[0] == "word" else tri)[r[1]] = r[2]
    return word, tri


def model_of(counts: tuple[dict[str, int], dict[str, int]]) -> Model:
    return Model(*counts)


def repaired(df: DataFrame, id_col: str, fields: tuple[str, ...], model_columns: tuple[str, ...] | None = None, model=None, derived: dict[str, str] | None = None) -> DataFrame:
    """(id, field, garbled, restored, channel): one row per distinct id and non-null field.

    ``derived`` names for a field the one it was converted from.  The model
    comes from ``model_columns`` (default: the fields) of all rows.  Empty and
    blank values are not garbled.  Repeated rows count once, rows that differ
    in a field each.  A lost letter is restored by the most frequent fitting
    word, equal ones by spelling; a value in which something was lost is
    garbled even if it can't be restored.
    """
    if model is None:
        model = shared(df.sparkSession, corpus_model(df, model_columns or fields))
    derived = derived or {}
    names = [f"_f{i}" for i in range(len(fields))]
    rows = df.select(F.col(id_col).alias("_id"), *(F.col(f).alias(n) for f, n in zip(fields, names)))
    rows = spread(rows, "_id", *names).distinct()
    of = {n: names[fields.index(derived[f])] if f in derived else None for f, n in zip(fields, names)}

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        m = built(model, model_of)
        for batch in batches:
            batch = (batch,) if isinstance(batch, pd.Series) else batch
            out = []
            for values in zip(*batch):
                row, done = dict(zip(names, values)), {}
                for n, v in row.items():
                    key = (v, row.get(of[n]) if v is not None and v != row.get(of[n]) else None)
                    if key not in done:
                        done[key] = repair(v, m, key[1])
                out.append([done[(v, row.get(of[n]) if v is not None and v != row.get(of[n]) else None)] for n, v in row.items()])
            yield pd.Series([[{"garbled": g, "restored": r, "channel": c} for g, r, c in x] for x in out], dtype=object)

    fix = F.pandas_udf(run, "array<struct<garbled: boolean, restored: string, channel: string>>", F.PandasUDFType.SCALAR_ITER)(*names)
    stack = F.arrays_zip(F.array(*map(F.lit, fields)).alias("field"), F.array(*names).alias("value"), F.col("_r"))
    flat = rows.select("_id", *names, fix.alias("_r")).select("_id", F.explode(stack).alias("e")).where("e.value is not null")
    return flat.select(F.col("_id").alias(id_col), F.col("e.field").alias("field"), F.col("e._r.garbled").alias("garbled"), F.col("e._r.restored").alias("restored"), F.col("e._r.channel").alias("channel"))
