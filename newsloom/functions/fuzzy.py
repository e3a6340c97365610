"""Fuzzy token-set comparison of short strings."""

from __future__ import annotations


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    best = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            above = best[j]
            best[j] = corner + 1 if x == y else max(above, best[j - 1])
            corner = above
    return best[-1]


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (length of both): similarity under insertions and deletions only."""
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * common_subsequence(a, b) / total


def token_set_ratio(a: str, b: str) -> float:
    """Best indel ratio between the shared words and the shared words plus either rest.

    0 if a side has no word; 100 if the words of one side contain those of the other.
    """
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared, only_left, only_right = left & right, left - right, right - left
    if shared and (not only_left or not only_right):
        return 100.0
    base = " ".join(sorted(shared))
    long_left = " ".join([*([base] if base else []), *sorted(only_left)])
    long_right = " ".join([*([base] if base else []), *sorted(only_right)])
    best = indel_ratio(long_left, long_right)
    if shared:
        best = max(best, indel_ratio(base, long_left), indel_ratio(base, long_right))
    return best
