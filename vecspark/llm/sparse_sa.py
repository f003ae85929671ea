"""Suffix-array dedup: sparse suffix arrays over content-selected positions.

Only suffixes that begin at a selected gram are kept. In a shard they are sorted, each is compared with
its neighbour (the longest common prefix, to the right), and for every reach to the left the runs of
suffixes that agree far enough to the right are split by the words before them: matches of at least W
words remain.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .base import mix
from .passages import GRAM, Segment, remove_repeats

#: Words that a repeated passage has at least.
WINDOW = 50


def match_by_suffixes(segments: list[Segment], window: int) -> list[int]:
    n = len(segments)
    gram = np.array([x[0] for x in segments], np.int64)
    weight, count, place = (np.array([x[i] for x in segments], np.int64) for i in (2, 3, 4))
    right = [x[5][x[4] :] for x in segments]
    order = np.array(sorted(range(n), key=lambda i: (segments[i][0], right[i].astype(">u8").tobytes())))
    wide = max(len(r) for r in right)
    table = np.zeros((n, wide), np.int64)
    for row, i in enumerate(order):
        table[row, : len(right[i])] = right[i]
    size = np.array([len(right[i]) for i in order])
    common = np.cumprod(table[1:] == table[:-1], axis=1).sum(axis=1)
    common = np.where(gram[order][1:] == gram[order][:-1], np.minimum(common, np.minimum(size[1:], size[:-1])), -1)
    reach = int(place.max())
    left = np.zeros((n, reach + 1), np.uint64)  # a hash of the words before the gram, by how many
    for i, x in enumerate(segments):
        for k, word in enumerate(x[5][: x[4]][::-1].view(np.uint64).tolist(), 1):
            left[i, k] = (int(left[i, k - 1]) * 0x9E3779B97F4A7C15 + word + 1) & 0xFFFFFFFFFFFFFFFF
    masks = np.zeros(n, np.int64)
    for back in range(reach + 1):
        run = np.append(0, np.cumsum(common < window - back))
        rows = order[(place[order] >= back) & (place[order] - back < count[order])]
        if not len(rows):
            continue
        of = np.empty(n, np.int64)
        of[order] = run
        key = mix(mix(left[rows, back] + np.uint64(1)) + of[rows].astype(np.uint64))
        _, which = np.unique(key, return_inverse=True)
        twice = np.bincount(which, weights=weight[rows])[which] > 1
        masks[rows[twice]] |= np.int64(1) << (place[rows[twice]] - back)
    return masks.tolist()


def suffix_array_dedup(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """remove_repeats by sparse suffix arrays; see there for the columns and for nulls and repeated rows."""
    return remove_repeats(documents, window, gram, match_by_suffixes)
