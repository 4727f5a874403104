"""String similarities that Spark lacks, as Arrow-batched functions."""

from __future__ import annotations

import re

from pyspark.sql import Column

from .arrow import arrow_udf


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence by bit-parallel rows: one big integer step per character."""
    if not a or not b:
        return 0
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & place.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str | None, b: str | None) -> float:
    """100 * 2 LCS / (lengths); two empty strings are equal, a missing one gives 0."""
    if a is None or b is None:
        return 0.0
    return 100.0 if not a and not b else 200.0 * lcs_length(a, b) / (len(a) + len(b))


def sorted_tokens(s: str | None) -> str:
    return " ".join(sorted(re.sub(r"[^\w]+", " ", (s or "").lower()).split()))


def bigram_places(s: str | None) -> list[str]:
    """Bigrams of characters, each with the number of its earlier occurrences, so that shared ones count as in multisets."""
    seen: dict[str, int] = {}
    out = []
    for g in map("".join, zip(s or "", (s or "")[1:])):
        seen[g] = seen.get(g, -1) + 1
        out.append(f"{g}{seen[g]}")
    return out


def partial_indel(a: str, b: str) -> float:
    """Best ratio of the shorter string with any window of its length in the longer one."""
    short, long = sorted((a or "", b or ""), key=len)
    if not short:
        return 100.0 if not long else 0.0
    return max(indel_ratio(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1))


def jaro_winkler_value(a: str | None, b: str | None) -> float:
    """Jaro-Winkler with prefix weight 0.1, applied above a Jaro similarity of 0.7."""
    if a is None or b is None:
        return 0.0
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(mine, (c for c, u in zip(b, used) if u))) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def _arrow(f):
    return arrow_udf(f, "double")


def ratio(a, b) -> Column:
    return _arrow(indel_ratio)(a, b)


def token_sort_ratio(a, b) -> Column:
    return _arrow(lambda x, y: indel_ratio(sorted_tokens(x), sorted_tokens(y)))(a, b)


def partial_ratio(a, b) -> Column:
    return _arrow(partial_indel)(a, b)


def jaro_winkler(a, b) -> Column:
    return _arrow(jaro_winkler_value)(a, b)


def sorted_key(a) -> Column:
    return arrow_udf(sorted_tokens, "string")(a)


def numbered_bigrams(a) -> Column:
    return arrow_udf(bigram_places, "array<string>")(a)
