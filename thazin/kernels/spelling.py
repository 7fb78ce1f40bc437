"""Edit distance in which a swap of neighbours is one edit and later edits may touch what earlier ones made."""

from __future__ import annotations


def distance(a: str, b: str, limit: int = 2) -> int:
    """The unrestricted Damerau-Levenshtein distance; limit + 1 stands for any larger one."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    big = len(a) + len(b)
    seen: dict[str, int] = {}  # last row in which a character of a stood
    table = {(-1, -1): big}
    for i in range(len(a) + 1):
        table[i, 0], table[i, -1] = i, big
    for j in range(len(b) + 1):
        table[0, j], table[-1, j] = j, big
    for i, x in enumerate(a, 1):
        column = 0  # last column in which x was met in this row
        for j, y in enumerate(b, 1):
            row, before = seen.get(y, 0), column
            if x == y:
                column = j
            swap = table[row - 1, before - 1] + (i - row - 1) + 1 + (j - before - 1)
            table[i, j] = min(table[i - 1, j - 1] + (x != y), table[i, j - 1] + 1, table[i - 1, j] + 1, swap)
        seen[x] = i
    return min(table[len(a), len(b)], limit + 1)
