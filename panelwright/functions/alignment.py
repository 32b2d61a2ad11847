"""Alignment of two sequences of lines: anchors unique to both sides, and shortest edit scripts between them."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Hashable, Sequence


def anchors(old: Sequence[Hashable], new: Sequence[Hashable]) -> list[tuple[int, int]]:
    """Places of lines that stand once on each side, as the longest chain that rises on both."""
    once_old, once_new = ({x for x, n in Counter(side).items() if n == 1} for side in (old, new))
    place = {x: j for j, x in enumerate(new) if x in once_new}
    pairs = [(i, place[x]) for i, x in enumerate(old) if x in once_old and x in place]
    tops: list[int] = []  # smallest last place of a chain of each length
    chain: list[int] = []  # pair that ends it
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        before.append(chain[at - 1] if at else -1)
        tops[at:at + 1], chain[at:at + 1] = [j], [k]
    out, k = [], chain[-1] if chain else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _halfway(a: Sequence[Hashable], b: Sequence[Hashable]) -> tuple[int, int]:
    """A point in the middle of a shortest edit path; both sides have lines, and no common first or last one.

    Furthest-reaching paths are followed from both ends, one edit at a time, until they meet; only the last front of
    each is kept.
    """
    n, m = len(a), len(b)
    skew = n - m
    fronts: tuple[dict[int, int], dict[int, int]] = ({1: 0}, {1: 0})
    for edits in range((n + m + 1) // 2 + 1):
        for back in (0, 1):
            own, other = fronts[back], fronts[1 - back]
            for k in range(-edits + 2 * max(0, edits - m), edits - 2 * max(0, edits - n) + 1, 2):
                down, right = own.get(k + 1, -1), own.get(k - 1, -1) + 1
                x = down if k == -edits or (k != edits and right <= down) else right
                y = x - k
                if back:
                    while x < n and y < m and a[n - 1 - x] == b[m - 1 - y]:
                        x, y = x + 1, y + 1
                else:
                    while x < n and y < m and a[x] == b[y]:
                        x, y = x + 1, y + 1
                own[k] = x
                met = other.get(skew - k)
                if met is not None and abs(skew - k) <= edits - (1 - back) and (skew % 2 == 1) != bool(back) and x + met >= n:
                    return (n - x, m - y) if back else (x, y)
    raise AssertionError("two paths always meet")


def _between(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int]]:
    """Matched places of a longest common subsequence."""
    in_a, in_b = set(a), set(b)
    rows, columns = [i for i, x in enumerate(a) if x in in_b], [j for j, x in enumerate(b) if x in in_a]
    left, right = [a[i] for i in rows], [b[j] for j in columns]
    out: list[tuple[int, int]] = []
    todo = [(0, len(left), 0, len(right))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and left[a0] == right[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and left[a1 - 1] == right[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 < a1 and b0 < b1:
            x, y = _halfway(left[a0:a1], right[b0:b1])
            todo += [(a0, a0 + x, b0, b0 + y), (a0 + x, a1, b0 + y, b1)]
    return sorted((rows[i], columns[j]) for i, j in out)


def matches(old: Sequence[Hashable], new: Sequence[Hashable]) -> list[tuple[int, int]]:
    """Places (in old, in new) of the lines that stay, rising on both sides.

    Lines that stand once on each side are matched first (their longest rising chain); between two of them the
    match is a longest common subsequence. Memory is linear in the lines, time in lines times edits of a stretch.
    """
    out: list[tuple[int, int]] = []
    i0 = j0 = 0
    for i, j in [*anchors(old, new), (len(old), len(new))]:
        out += [(i0 + x, j0 + y) for x, y in _between(old[i0:i], new[j0:j])]
        if i < len(old):
            out.append((i, j))
        i0, j0 = i + 1, j + 1
    return out


def script(old: Sequence[str], new: Sequence[str], context: int | None = 3) -> list[tuple[int, str, int, int, str]]:
    """(hunk, op, old_no, new_no, line): op is ``-``, ``+`` or, for kept lines, a blank; line numbers begin at 1.

    A removed line has the number of the new line before it, an added one that of the old line before it (0: none). With
    ``context`` only kept lines that near to a change are listed, and changes whose lines touch share a hunk; with None all are.
    """
    rows, i0, j0 = [], 0, 0
    for i, j in [*matches(old, new), (len(old), len(new))]:
        rows += [("-", k + 1, j0, old[k]) for k in range(i0, i)]
        rows += [("+", i, k + 1, new[k]) for k in range(j0, j)]
        if i < len(old):
            rows.append((" ", i + 1, j + 1, old[i]))
        i0, j0 = i + 1, j + 1
    changed = [k for k, row in enumerate(rows) if row[0] != " "]
    if context is None:
        return [(1, *row) for row in rows] if rows else []
    out, hunk, listed = [], 0, -1
    for k in changed:
        low, high = max(k - context, listed + 1), min(k + context, len(rows) - 1)
        if k - context > listed + 1 or hunk == 0:
            hunk += 1
        out += [(hunk, *rows[x]) for x in range(low, high + 1)]
        listed = max(listed, high)
    return out
