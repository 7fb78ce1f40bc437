"""Byte-level BPE encoding: segment-tree merging and automaton counting.

Two independent exact algorithms over the same vocabulary:

* :meth:`Encoder.encode` keeps the ranks of adjacent pairs in a segment tree.
  Its root is the leftmost pair of lowest rank; a merge is two point updates
  of logarithmic cost, until no pair can be merged.
* :meth:`Counter.count` runs an Aho-Corasick automaton of all vocabulary
  entries over a piece.  At every end position the one entry that is
  compatible with the last token of what lies before it extends the exact
  encoding, so that only counts are kept and never identifiers.
"""

from __future__ import annotations

import base64

import regex

# Fixed value: the pre-tokenization pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_CACHE_ENTRIES = 200_000  # of one Python worker; it starts again when full


def parse(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Encoder:
    """Whole texts to ids; pieces are remembered, as most of them recur."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pieces = regex.compile(PATTERN).findall
        self.memo: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        ranks, n = self.ranks, len(piece)
        parts = [piece[i : i + 1] for i in range(n)]
        if n == 1:
            return [ranks[piece]]
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        none = (1 << 60) * n
        tree = [none] * (2 * size)
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                tree[size + i] = rank * n + i
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(leaf: int, value: int) -> None:
            k = size + leaf
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                best = a if a < b else b
                if tree[k] == best:
                    break
                tree[k] = best
                k >>= 1

        def pair(i: int) -> int:
            j = after[i]
            rank = ranks.get(parts[i] + parts[j]) if j < n else None
            return none if rank is None else rank * n + i

        while tree[1] < none:
            i = tree[1] % n
            j = after[i]
            parts[i] += parts[j]
            parts[j] = b""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if j < n - 1:
                put(j, none)
            put(i, pair(i)) if i < n - 1 else None
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        return [ranks[p] for p in parts if p]

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; null and empty texts give the empty list."""
        if not text:
            return []
        memo, out = self.memo, []
        for piece in self.pieces(text):
            ids = memo.get(piece)
            if ids is None:
                if len(memo) >= _CACHE_ENTRIES:
                    memo.clear()
                ids = self.merge(piece.encode())
                if len(piece) < 100:
                    memo[piece] = ids
            out += ids
        return out


class Counter:
    """Token counts without ids."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.encoder = Encoder(ranks)
        self.pieces = self.encoder.pieces
        self.tokens = [b""] * (max(ranks.values()) + 1)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.tokens[rank] = token
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, int] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether b may follow a: the bytes of both together encode to just these two."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= _CACHE_ENTRIES:
                self.fits.clear()
            known = self.fits[a, b] = self.encoder.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def _count(self, piece: bytes) -> int:
        n = len(piece)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        # the automaton yields, for each end, the longest entry first
        for end, (length, rank) in self.automaton.iter(piece.decode("latin-1")):
            if last[end + 1] < 0:
                start = end + 1 - length
                if self.whole(rank) if start == 0 else last[start] >= 0 and self.compatible(last[start], rank):
                    last[end + 1], count[end + 1] = rank, count[start] + 1
        return count[n]

    def whole(self, rank: int) -> bool:
        known = self.fits.get((-1, rank))
        if known is None:
            known = self.fits[-1, rank] = self.encoder.merge(self.tokens[rank]) == [rank]
        return known

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        memo, total = self.memo, 0
        for piece in self.pieces(text):
            n = memo.get(piece)
            if n is None:
                if len(memo) >= _CACHE_ENTRIES:
                    memo.clear()
                n = self._count(piece.encode())
                if len(piece) < 100:
                    memo[piece] = n
            total += n
        return total


def encoder(data: bytes) -> Encoder:
    return Encoder(parse(data))


def counter(data: bytes) -> Counter:
    return Counter(parse(data))
