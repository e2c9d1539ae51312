"""A shortest edit script between two sequences of lines: a helper of snapshots.line_diff, which runs it by pairs in tasks.

Lines are numbers. Those that only one side has can't match, and go first. What is left is searched from both ends at once
for the middle of a shortest script, and each half again, so that memory grows with the edits searched, not with the lines.
A search beyond EFFORT edits is split where it has come furthest: the script is then valid, but may be longer.
"""

from __future__ import annotations

EFFORT = 3000


def _middle(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int, effort: int) -> tuple[int, int, int, int]:
    """A run of equal lines, maybe empty, on a shortest script: where it begins and ends in a and b."""
    n, m = a1 - a0, b1 - b0
    odd = (n - m) % 2
    ahead, back = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for reached, other, forward in ((ahead, back, True), (back, ahead, False)):
            for k in range(-(d - 2 * max(0, d - m)), d - 2 * max(0, d - n) + 1, 2):
                down = k == -d or k != d and reached.get(k - 1, -1) < reached.get(k + 1, -1)
                x = reached[k + 1] if down else reached[k - 1] + 1
                y = x - k
                begin, from_y = x, y
                if forward:
                    while x < n and y < m and a[a0 + x] == b[b0 + y]:
                        x, y = x + 1, y + 1
                else:
                    while x < n and y < m and a[a1 - 1 - x] == b[b1 - 1 - y]:
                        x, y = x + 1, y + 1
                reached[k] = x
                there = n - m - k
                within = d - 1 if forward else d
                if odd == forward and -within <= there <= within and there in other and x + other[there] >= n:
                    return (a0 + begin, b0 + from_y, a0 + x, b0 + y) if forward else (a1 - x, b1 - y, a1 - begin, b1 - from_y)
        if d >= max(effort, 1):
            x, y = max(((x, x - k) for k, x in ahead.items() if 0 <= x - k <= m and x <= n), key=sum)
            return a0 + x, b0 + y, a0 + x, b0 + y
    raise AssertionError("the two searches meet")


def matches(a: list[int], b: list[int], effort: int = EFFORT) -> list[tuple[int, int]]:
    """Pairs of places of equal lines, ascending in both: as many as there can be, within the effort."""
    known_a, known_b = set(a), set(b)
    at_a, at_b = [i for i, x in enumerate(a) if x in known_b], [j for j, y in enumerate(b) if y in known_a]
    x, y = [a[i] for i in at_a], [b[j] for j in at_b]
    found, stack = [], [(0, len(x), 0, len(y))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and x[a0] == y[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and x[a1 - 1] == y[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        i, j, k, m = _middle(x, y, a0, a1, b0, b1, effort)
        found += zip(range(i, k), range(j, m))
        stack += [(a0, i, b0, j), (k, a1, m, b1)]
    return sorted((at_a[i], at_b[j]) for i, j in found)


def hunks(a: list[str], b: list[str], effort: int = EFFORT) -> list[tuple[list[str], list[str]]]:
    """Lines that go and lines that come, between lines that stay."""
    number: dict[str, int] = {}
    ids = [[number.setdefault(x, len(number)) for x in side] for side in (a, b)]
    out, i, j = [], 0, 0
    for k, m in [*matches(*ids, effort), (len(a), len(b))]:
        if k > i or m > j:
            out.append((a[i:k], b[j:m]))
        i, j = k + 1, m + 1
    return out
