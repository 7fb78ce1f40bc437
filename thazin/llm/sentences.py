"""Sentence boundaries across scripts (problem 7): candidates classified by maximum entropy.

Candidate positions are end marks with what closes after them, white space
without an end mark, and Burmese syllable borders after a word that usually
ends sentences.  Each gets features of its neighbouring tokens, their case,
length, digits and script; the weights are fitted on reliable boundaries
only: blank lines, unmistakable marks outside quotations, and the same places
with their mark taken away.  How often a token ends or starts a unit at such
places is counted over all documents.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thazin.llm.encoding import _SYLLABLES
from thazin.llm.skeleton import prototypes
from thazin.session import built, cut, shared, spread

TRAIN_DOCUMENTS = 4_000  # documents whose reliable places fit the weights
TOKEN_SHARE = 1e-5  # tokens whose uses are rarer are known by their shape only
MARKS = ".!?။…。！？"
OPEN, CLOSE, BOTH = "“„«「『(（[‘", "”»」』)）]’", '"'
_PAIRS = {"“": "”“", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", '"': '"'}
_TAIL = re.compile("[.!?။…。！？]+")


def _table() -> dict[int, str | None]:
    t = {}
    for cp, to in prototypes().items():
        if not 0x1000 <= cp <= 0x109F and chr(cp) not in MARKS + OPEN + CLOSE + "，：；":
            if to == "" or len(to) == 1:
                t[cp] = to
    return t


_CLEAN: dict[int, str | None] = {}
_DIRTY: set[str] = set()


def cleaned(text: str) -> tuple[str, Sequence[int]]:
    """The text without invisible characters, one form for spaces and widths, and the place of each kept character."""
    if not _CLEAN:
        _CLEAN.update(_table())
        _DIRTY.update(chr(c) for c in _CLEAN if c > 126)
    if _DIRTY.isdisjoint(set(text)):
        return text, range(len(text))
    out, at = [], []
    for i, c in enumerate(text):
        new = _CLEAN.get(ord(c), c) if c > "~" else c
        if new:
            out.append(new)
            at.append(i)
    return "".join(out), at


def _script(c: str) -> str:
    if "က" <= c <= "႟":
        return "digit" if "၀" <= c <= "၉" else "my"
    if "฀" <= c <= "๿":
        return "th"
    if "㐀" <= c <= "鿿":
        return "zh"
    if c.isdigit():
        return "digit"
    return "word" if c.isalpha() or "̀" <= c <= "ͯ" else "other"


_TOKEN = re.compile("[၀-၉\\d]+(?:[.,][၀-၉\\d]+)*|[က-႟]+|[฀-๿]+|[㐀-鿿]+|[^\\W\\d_က-႟฀-๿㐀-鿿]+(?:[.'][^\\W\\d_က-႟]+)*")


class Paragraph:
    """A text with its tokens, for the word before and after a place."""

    def __init__(self, text: str):
        self.text = text
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.words: list[str] = []
        self.parts: dict[int, list[str]] = {}  # syllables of a Burmese word, by its start
        for m in _TOKEN.finditer(text):
            w, at = m.group(), m.start()
            if "က" <= w[0] <= "႟" and not "၀" <= w[0] <= "၉":
                for piece in re.finditer("[^၊။၀-၉]+", w):  # stops and digits aren't part of words
                    self._add(piece.group(), at + piece.start())
            else:
                self._add(w, at)

    def _add(self, w: str, at: int) -> None:
        self.starts.append(at)
        self.ends.append(at + len(w))
        self.words.append(w)
        if "က" <= w[0] <= "႟" and not "၀" <= w[0] <= "၉":
            parts = _SYLLABLES.findall(w)
            self.parts[at] = parts if sum(map(len, parts)) == len(w) else [w]

    def left(self, pos: int) -> tuple[str, str]:
        """(token, script) before a place; the last two syllables or characters of a text without spaces."""
        k = bisect.bisect_left(self.starts, pos) - 1
        if k < 0 or pos - self.ends[k] > 3:
            return "<none>", "other"
        w = self.words[k]
        s = _script(w[-1])
        if s == "my":
            parts, cut = self.parts[self.starts[k]], pos - self.starts[k]
            if cut < len(w):
                n, got = 0, []
                for p in parts:
                    n += len(p)
                    if n > cut:
                        break
                    got.append(p)
                parts = got
            return "|".join(parts[-3:]) or "<none>", s
        if s in ("th", "zh"):
            return w[: pos - self.starts[k]][-2:], s
        return ("<num>" if s == "digit" else w.lower()), s

    def right(self, pos: int) -> tuple[str, str]:
        k = bisect.bisect_right(self.ends, pos)
        if k == len(self.starts) or self.starts[k] - pos > 3:
            return "<none>", "other"
        w, at = self.words[k], max(0, pos - self.starts[k])
        s = _script(w[at])
        if s == "my":
            parts = self.parts[self.starts[k]]
            if at:
                n = 0
                for i, p in enumerate(parts):
                    if n >= at:
                        parts = parts[i:]
                        break
                    n += len(p)
            return "".join(parts[:2]), s
        if s in ("th", "zh"):
            return w[at : at + 2], s
        return ("<num>" if s == "digit" else w), s


def shape(token: str) -> str:
    if token[0] == "<":
        return token
    s = _script(token[0])
    if s == "word":
        return f"<{'W' if token[0].isupper() else 'w'}{min(len(token), 4)}{'.' if '.' in token else ''}>"
    return f"<{s}>"


Place = tuple[int, int, str, str, bool, bool]  # end of the left side, start of the right, mark, space, inside quotation, something closed


def places(text: str, joined: frozenset[int] | set[int] = frozenset()) -> Iterator[Place]:
    """All candidates of a paragraph without blank lines, from left to right; joined: those inside Burmese words."""
    stack: list[str] = []
    n, i, run_start = len(text), 0, 0
    while i < n:
        c = text[i]
        if c in MARKS:
            m = _TAIL.match(text, i)
            j = m.end()
            mark = "dot" if m.group() == "." else "ellipsis" if m.group()[0] == "…" or m.group().startswith("..") else "strong"
            closed = False
            while True:
                k = j
                while k < n and text[k] == " ":
                    k += 1
                # a closing mark may stand after a space (« … ! »)
                if k < n and stack and text[k] in _PAIRS.get(stack[-1], "") and (k == j or text[k] == "»"):
                    quote = stack.pop() not in "(（["
                    j, closed = k + 1, closed or quote
                    t = _TAIL.match(text, j)
                    if t:
                        j = t.end()
                        mark = "strong"
                else:
                    break
            k = j
            while k < n and text[k].isspace():
                k += 1
            if k < n:
                space = "none" if k == j else "line" if "\n" in text[j:k] else "space"
                yield j, k, mark, space, bool(stack), closed
            i = max(j, i + 1)
            if k > j:
                i = k
            run_start = i
            continue
        if c.isspace():
            k = i
            while k < n and text[k].isspace():
                k += 1
            if k < n and text[k] not in MARKS and i > 0 and text[i - 1] not in OPEN:
                yield i, k, "nothing", "line" if "\n" in text[i:k] else "space", bool(stack), False
            i = run_start = k
            continue
        if stack and c in _PAIRS.get(stack[-1], ""):
            stack.pop()
            i += 1
            continue
        if c in OPEN and c != "‘" or c == '"':
            if i > run_start and text[i - 1] not in OPEN + '"' and not text[i - 1].isascii():
                yield i, i, "nothing", "none", bool(stack), False
            stack.append(c)
            i += 1
            continue
        if i in joined:
            yield i, i, "nothing", "none", bool(stack), False
        i += 1


class Stats:
    """How often tokens end and start units at reliable places."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.counts = counts
        self.memo: dict[tuple[str, str], float] = {}

    def finals(self, para: Paragraph) -> set[int]:
        """Places inside Burmese words after two syllables that usually end a sentence."""
        out = set()
        for at, parts in para.parts.items():
            if len(parts) > 3:
                n = at
                for i in range(len(parts) - 1):
                    n += len(parts[i])
                    if i and self.ratio("my", "|".join(parts[max(0, i - 2) : i + 1])) > -1.5:
                        out.add(n)
        return out

    def ratio(self, kind: str, token: str) -> float:
        """Log odds that a token of a kind stands at a unit's border; by shape where the token is rare."""
        known = self.memo.get((kind, token))
        if known is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            known = self.memo[kind, token] = self._ratio(kind, token)
        return known

    def _ratio(self, kind: str, token: str) -> float:
        get = self.counts.get
        longer = None
        if kind == "my" and "|" in token:
            longer, token = token.replace("|", ""), "".join(token.split("|")[-2:])
        total, hit = get((kind, shape(token)), 0), get((kind + "+", shape(token)), 0)
        prior = (hit + 0.5) / (total + 10.0)
        n, h = (get((kind, token), 0), get((kind + "+", token), 0)) if token[0] != "<" else (total, hit)
        p = min(0.999, (h + 4.0 * prior) / (n + 4.0))
        if longer and longer != token:
            p = min(0.999, (get(("my3+", longer), 0) + 4.0 * p) / (get(("my3", longer), 0) + 4.0))
        return math.log((p + 1e-4) / (1 - p + 1e-4))


NAMES = ["dot", "strong", "ellipsis", "quote", "space", "line", "joined"]
_BASE = 3 * len(NAMES)
LOW, NUMBER, THAI, THAI_EDGE = _BASE, _BASE + 6, _BASE + 7, _BASE + 8
WIDTH = _BASE + 20


def features(para: Paragraph, p: Place, stats: Stats, first: int) -> tuple[str, list[float]]:
    """(group, features) of a place in a paragraph; first: where the current unit began."""
    text = para.text
    end, start, mark, space, inside, closed = p
    group = "quote" if closed else mark if mark != "nothing" else {"space": "space", "line": "line", "none": "joined"}[space]
    left, s_left = para.left(end)
    right, s_right = para.right(start)
    nxt = text[start] if start < len(text) else " "
    s_next = _script(nxt)
    x_left = stats.ratio("my" if s_left == "my" else "dot" if mark == "dot" else "end", left)
    x_right = stats.ratio("start", right)
    size = end - first
    number = size < 8 and re.fullmatch("[(（]?[၀-၉\\d]{1,3}[)）]?[.။]?", text[first:end].strip()) is not None
    row = [0.0] * WIDTH
    g = NAMES.index(group) * 3
    row[g : g + 3] = [1.0, x_left, x_right]
    bare = mark == "nothing"
    row[_BASE:] = [
        float(nxt.islower() or nxt in ",;:၊，-–—/%)"),
        float(s_next == "digit"),
        float(s_left == "digit"),
        float(nxt in OPEN or nxt == '"'),
        float(inside),
        float(closed and space == "none"),
        float(number),
        float(bare and s_left == "th" and s_next == "th"),
        float(bare and (s_left == "th") != (s_next == "th") and "digit" not in (s_left, s_next)),
        float(bare and {s_left, s_next} == {"th", "digit"}),
        float(space == "none" and mark == "dot"),
        float(space == "none" and not bare and nxt.isascii() and nxt.isalnum() and text[max(0, end - 2)].isascii()),
        float(bare and s_left != s_next and {s_left, s_next} <= {"my", "word", "zh", "th"}),
        float(s_next == "word" and nxt.isupper()),
        float(bare) * min(size, 80) / 80.0,
        float(bare and size < 16),
        float(bare and s_left == "my" and " " not in text[first:end].strip()),
        float(size < 4),
        float(mark == "dot" and s_left == "word" and len(left) >= 5 and "." not in left),
        float(mark == "dot" and s_left == "word" and len(left) <= 2),
    ]
    return group, row


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Half-open spans between blank lines."""
    out, at = [], 0
    for m in re.finditer("\\n[^\\S\\n]*\\n\\s*", text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


def count_document(raw: str, held: Counter) -> None:
    """Add (kind, token) events of a document: all occurrences, and with + those at reliable borders."""
    text, _ = cleaned(raw)

    def both(kind: str, token: str, hit: bool, seen: bool = True) -> None:
        if "|" in token:
            parts = token.split("|")
            token = "".join(parts[-2:])
            if len(parts) > 2 and hit:
                held["my3+", "".join(parts)] += 1
        form = shape(token)
        for t in (token,) if form == token else (token, form):
            if seen:
                held[kind, t] += 1
            if hit:
                held[kind + "+", t] += 1

    for a, b in paragraphs(text):
        para = Paragraph(text[a:b].rstrip())
        for parts in para.parts.values():  # every pair of syllables
            last = len(parts) - 1
            for i, part in enumerate(parts):
                before = parts[i - 1] + part if i else part
                after = part + parts[i + 1] if i < last else part
                held["my", before] += 1
                held["start", after] += 1
                held["my", "<my>"] += 1
                held["start", "<my>"] += 1
                if i > 1:
                    held["my3", parts[i - 2] + before] += 1
        if para.words:
            w, s = para.right(0)
            both("start", w, True, s != "my")
            last = para.ends[-1]
            w, s = para.left(last)
            rest = para.text[last:]
            if len(rest) < 4:
                both("my" if s == "my" else "end", w, True, s != "my")
                if rest == ".":
                    both("dot", w, True)
        for end, start, mark, _space, inside, closed in places(para.text):
            left, s_left = para.left(end)
            right, s_right = para.right(start)
            sure = mark == "strong" and not inside and not closed and s_left != "digit"
            both("my" if s_left == "my" else "dot" if mark == "dot" else "end", left, sure and mark != "dot", s_left != "my")
            both("start", right, sure, s_right != "my")


def _ahead(text: str, start: int) -> str:
    """The text from a place to the end of the token behind it, which is all that features see of it."""
    m = _TOKEN.search(text, start)
    return text[start : m.end() + 1] if m else text[start:]


def examples(raw: str, stats: Stats) -> Iterator[tuple[list[float], int]]:
    """Features and labels of the reliable places of a document."""
    text, _ = cleaned(raw)
    spans = paragraphs(text)
    for k, (a, b) in enumerate(spans):
        para = Paragraph(text[a:b].rstrip())
        t, first = para.text, 0
        for p in places(t, stats.finals(para)):
            end, start, mark, space, inside, closed = p
            group, x = features(para, p, stats, first)
            g = NAMES.index(group) * 3
            nxt, label = t[start], None
            if mark == "nothing":
                if inside or x[LOW] or x[_BASE + 9]:
                    label = 0
                elif not (x[g + 1] > -1.5 and x[g + 2] > -2.5 or x[THAI] or x[THAI_EDGE]):
                    label = 0
            elif inside or x[LOW] or closed and space == "none" or x[NUMBER] or x[_BASE + 11]:
                label = 0
            elif mark == "dot":
                label = 0 if x[_BASE + 1] or space == "none" and _script(nxt) == "word" else None
            elif mark == "ellipsis":
                label = 0 if x[g + 1] < -1.5 else None
            elif closed:
                label = 0 if x[g + 2] < -3.0 else None
            else:
                label = 1
            if label is None:
                continue
            yield x, label
            if label:
                # the same place without its mark
                bare = _TAIL.sub("", t[first:end]).rstrip()
                if bare and _script(bare[-1]) != "digit":
                    gap = {"none": "", "space": " ", "line": "\n"}[space]
                    q = (len(bare), len(bare) + len(gap), "nothing", space, inside, False)
                    yield features(Paragraph(bare + gap + _ahead(t, start)), q, stats, 0)[1], 1
                first = start
        if k + 1 < len(spans):
            follows = _ahead(text, spans[k + 1][0])
            m = re.search(f"([{re.escape(MARKS)}]+)[{re.escape(CLOSE)}\"“]*$", t)
            marks = m.group(1) if m else ""
            mark = "nothing" if not marks else "dot" if marks == "." else "ellipsis" if marks[0] == "…" or marks.startswith("..") else "strong"
            closed = bool(m) and len(m.group()) > len(marks)
            for gap, space in ((" ", "space"), ("\n", "line")):
                joined = Paragraph(t[first:] + gap + follows)
                at = len(t) - first
                yield features(joined, (at, at + 1, mark, space, False, closed), stats, 0)[1], 1


def sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, weight: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, Hessian) of the weighted log loss over some rows; ``weight`` is that of a row with label 0 and 1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    c = np.where(y == 1, weight[1], weight[0])
    return x.T @ (c * (p - y)), (x * (c * p * (1 - p))[:, None]).T @ x


def fit(rows: DataFrame, penalty: float = 1e-3, rounds: int = 40) -> np.ndarray | None:
    """Maximum entropy weights (logistic, both labels of equal weight in total) by Newton steps; None without rows of both labels.

    Each step adds up gradient and Hessian where the rows (x, y) are, so only
    those come to the driver.
    """
    n = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    if len(n) < 2:
        return None
    weight = (0.5 / n[0], 0.5 / n[1])
    w = np.zeros(WIDTH + 1)

    def part(at: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            grad, hess = np.zeros(WIDTH + 1), np.zeros((WIDTH + 1, WIDTH + 1))
            for b in batches:
                if len(b):
                    g, h = sums(np.stack(b["x"].to_numpy()), b["y"].to_numpy(), at, weight)
                    grad, hess = grad + g, hess + h
            yield pd.DataFrame({"g": [grad.tolist()], "h": [hess.ravel().tolist()]})

        return run

    for _ in range(rounds):
        parts = rows.mapInPandas(part(w), "g array<double>, h array<double>").collect()  # a row a task
        grad = sum(np.array(r["g"]) for r in parts) + penalty * w
        hess = sum(np.array(r["h"]) for r in parts).reshape(WIDTH + 1, WIDTH + 1) + penalty * np.eye(WIDTH + 1)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    return w


def split(raw: str | None, stats: Stats, weights: list[float]) -> list[tuple[int, int]]:
    """Half-open offsets of the sentences in code points of the stored text."""
    if not raw:
        return []
    text, at = cleaned(raw)
    cuts = []
    for a, b in paragraphs(text):
        para = Paragraph(text[a:b].rstrip())
        cuts.append(a)
        first = 0
        for p in places(para.text, stats.finals(para)):
            _, x = features(para, p, stats, first)
            if x[NUMBER] or x[_BASE + 5]:  # a list number, or a frame that follows its quotation at once
                continue
            if math.sumprod(weights[:-1], x) + weights[-1] > 0 and para.text[first : p[0]].strip():
                cuts.append(a + p[1])
                first = p[1]
    out = []
    for k, c in enumerate(cuts):
        s = 0 if k == 0 else at[c]
        e = at[cuts[k + 1]] if k + 1 < len(cuts) else len(raw)
        piece = raw[s:e]
        lead = len(piece) - len(piece.lstrip())
        body = piece.strip()
        if body:
            out.append((s + lead, s + lead + len(body)))
    return out


def classifier(model: tuple[dict, np.ndarray]) -> tuple[Stats, list[float]]:
    return Stats(model[0]), model[1].tolist()


def fitted(df: DataFrame, text_col: str, id_col: str, train_documents: int = TRAIN_DOCUMENTS) -> tuple[dict, np.ndarray]:
    """(counts, weights): counts over all documents, weights from at most train_documents of them, chosen by hash."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            for t in batch["_t"]:
                if t:
                    count_document(t, held)
            if len(held) > 200_000:
                yield pd.DataFrame([(k, t, n) for (k, t), n in held.items()], columns=["kind", "token", "n"])
                held = Counter()
        if held:
            yield pd.DataFrame([(k, t, n) for (k, t), n in held.items()], columns=["kind", "token", "n"])

    src = df.select(F.col(text_col).alias("_t"), F.col(id_col).alias("_id")).where("_t is not null and _t <> ''")
    events = src.select("_t").mapInPandas(count, "kind string, token string, n long")
    at_border = F.col("kind").endswith("+")
    # all uses of a token and those at borders side by side, so that both are kept or neither
    sums = events.groupBy(F.rtrim(F.col("kind"), F.lit("+")).alias("kind"), "token").agg(F.sum(F.when(at_border, 0).otherwise(F.col("n"))).alias("n"), F.sum(F.when(at_border, F.col("n")).otherwise(0)).alias("hits"))
    sums = cut(sums)  # read twice below
    total = sums.where("substring(token, 1, 1) <> '<'").groupBy("kind").agg(F.sum("n").alias("all"))
    kept = sums.join(F.broadcast(total), "kind", "left").where((F.col("n") >= F.col("all") * TOKEN_SHARE) | F.col("token").startswith("<"))
    counts = {}
    for kind, token, n, hits in kept.select("kind", "token", "n", "hits").toLocalIterator():
        counts |= {k: v for k, v in (((kind, token), n), ((kind + "+", token), hits)) if v}
    handle = shared(df.sparkSession, counts)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stats = built(handle, Stats)
        for batch in batches:
            rows = [e for t in batch["_t"] for e in examples(t, stats)]
            if rows:
                yield pd.DataFrame(rows, columns=["x", "y"])

    chosen = src.orderBy(F.xxhash64("_id", "_t"), "_id", "_t").limit(train_documents).select("_t").repartition(df.sparkSession.sparkContext.defaultParallelism, "_t")
    weights = fit(cut(chosen.mapInPandas(learn, "x array<double>, y int")))
    if weights is None:
        weights = np.zeros(WIDTH + 1)
        weights[[0, 3]] = 1.0  # without examples every end mark ends a sentence
        weights[-1] = -0.5
    return counts, weights


def sentence_spans(df: DataFrame, id_col: str = "parsed_id", text_col: str = "raw_text", model: tuple[dict, np.ndarray] | None = None) -> DataFrame:
    """(id, sent_start, sent_end) for every sentence of every non-empty text, each id and text once.

    Null and blank texts give no rows.  Offsets count code points of the text
    as stored; white space at either end of a sentence is left out.
    """
    model = model or fitted(df, text_col, id_col)
    handle = shared(df.sparkSession, model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        stats, weights = built(handle, classifier)
        for texts in batches:
            yield pd.Series([[{"sent_start": s, "sent_end": e} for s, e in split(t, stats, weights)] for t in texts], dtype=object)

    rows = spread(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where("_t is not null and _t <> ''"), "_id", "_t").distinct()
    find = F.pandas_udf(run, "array<struct<sent_start: int, sent_end: int>>", F.PandasUDFType.SCALAR_ITER).asNondeterministic()
    return rows.select("_id", F.explode(find("_t")).alias("s")).select(F.col("_id").alias(id_col), "s.sent_start", "s.sent_end")
