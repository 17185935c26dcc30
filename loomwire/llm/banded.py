"""Bit-parallel edit distance inside a band (Myers 1999, Hyyro 2003), on strings or lists of words."""

from __future__ import annotations

from collections.abc import Sequence


def within(a: Sequence, b: Sequence, limit: int) -> int | None:
    """The edit distance of a and b if it is at most `limit`, else None.

    Only the 2 * limit + 1 diagonals around the main one are computed; a column of the band is one integer.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > limit:
        return None
    start, end_a, end_b = 0, len(a), len(b)
    while start < end_b and a[start] == b[start]:
        start += 1
    while end_b > start and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    m, n = end_a - start, end_b - start
    if not n:
        return m if m <= limit else None
    k = min(limit, m)
    if not k:
        return None
    places: dict = {}
    for i in range(m):
        c = a[start + i]
        places[c] = places.get(c, 0) | (1 << i)
    width = 2 * k + 1
    full, top = (1 << width) - 1, 1 << (2 * k)
    # the band's lowest row is k rows below the column; its distance is followed down, then along the last row
    up, down, now, shift = (full >> k) << k, 0, k, -k
    row = top >> 1
    for j in range(n):
        here = places.get(b[start + j], 0)
        x = (here >> shift if shift >= 0 else here << -shift) & full
        same = ((((x & up) + up) ^ up) | x | down) & full
        right, left = (down | ~(same | up)) & full, same & up
        if j < m - k:
            now += not same & top
            if now > 2 * k + n - m:
                return None
        else:
            now += bool(right & row) - bool(left & row)
            row >>= 1
        half = same >> 1
        up, down = (left | ~(half | right)) & full, half & right
        shift += 1
    return now if now <= limit else None
