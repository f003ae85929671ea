"""Scalar planning rules: budgets that follow the search-list size, chunk layouts, memory."""

from __future__ import annotations

import math


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def approach_hops(size: int, base: int, divisor: int, cap: int, low: int = 0, extra: int = 0) -> int:
    return min(cap, base + ceil_div(size, divisor) + (extra if size <= low else 0))


def refine_hops(size: int, base: int, divisor: int, cap: int, low: int = 0, extra: int = 0) -> int:
    return min(cap, base + size // divisor + (extra if size <= low else 0))


def refine_candidates(size: int, base: int = 9, divisor: int = 25, cap: int = 14, least: int = 0) -> int:
    return 0 if size < least else min(cap, base + ceil_div(size, divisor))


def routed_cells(size: int, base: int, divisor: int, cap: int, low: int = 0, extra: int = 0, high: int = 0, decay: int = 0) -> int:
    cells = min(cap, max(base, ceil_div(size, divisor)) + (extra if size <= low else 0))
    return min(cells, max(1, cap - (size - high) // decay)) if decay and size >= high else cells


def pq_chunk_bounds(dim: int, chunks: int) -> list[int]:
    """First coordinates of chunks, and dim: the first dim mod chunks of them are one longer."""
    if not 0 < chunks <= dim:
        raise ValueError("chunks must be from 1 to the dimension")
    return [i * (dim // chunks) + min(i, dim % chunks) for i in range(chunks + 1)]


def pq_chunks_for(bytes_limit: int, n: int, dim: int) -> int:
    return max(1, min(bytes_limit // max(1, n), dim, 512))


def index_bytes(n: int, dim: int, degree: int, item: int = 4, slack: float = 1.3, overhead: float = 1.1) -> float:
    return overhead * (n * dim * item + n * degree * 4 * slack)


def guard_allows(size: int, fraction: float, unexpanded: int) -> bool:
    """Whether another candidate from outside the graph fits a search list of which a fraction is kept for the graph."""
    return unexpanded < size - min(size, math.ceil(fraction * size))


def next_beam(width: int, expanded: int, useful: int, hop: int, marker: int, most: int, threshold: float = 0.1) -> int:
    """The width of the next hop: one more, up to `most`, once past the marker with at most that share of rows wasted."""
    if min(width, expanded, useful, hop) < 0 or useful > expanded:
        raise ValueError("useful rows are some of those expanded")
    wasted = 1 - useful / expanded if expanded else 1.0
    return min(width + 1, most) if hop > marker and wasted <= threshold else width
