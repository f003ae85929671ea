"""Substring dedup with suffix automata of reference shards.

A shard is the segments of some grams that may match (see passages). Its automaton counts where each
of its states ends; the segments are then streamed through it, and matching statistics give, at each
word, the longest match and how often its last W words occur. Spans of at least W words go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .passages import GRAM, Segment, remove_repeats


class SuffixAutomaton:
    """Of several word sequences; each end position weighs as much as its sequence."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.link) - 1

    def _extend(self, last: int, word: int) -> int:
        there = self.next[last].get(word)
        if there is not None and self.length[there] == self.length[last] + 1:
            return there
        now = -1 if there is not None else self._state(self.length[last] + 1, {}, 0)
        at = last
        if there is None:
            while at >= 0 and word not in self.next[at]:
                self.next[at][word] = now
                at = self.link[at]
            if at < 0:
                return now
            there = self.next[at][word]
            if self.length[there] == self.length[at] + 1:
                self.link[now] = there
                return now
        copy = self._state(self.length[at] + 1, dict(self.next[there]), self.link[there])
        self.link[there] = copy
        while at >= 0 and self.next[at].get(word) == there:
            self.next[at][word] = copy
            at = self.link[at]
        if now < 0:
            return copy
        self.link[now] = copy
        return now

    def add(self, words: list[int], weight: int) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)
            self.count[last] += weight

    def close(self) -> None:
        """Sum the counts of longer states into the states they end in."""
        for at in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[at] > 0:
                self.count[self.link[at]] += self.count[at]

    def statistics(self, words: list[int], window: int):
        """At each word: the longest match ending there, and the occurrences of its last `window` words (0 if shorter)."""
        at, size = 0, 0
        for word in words:
            while at and word not in self.next[at]:
                at = self.link[at]
                size = self.length[at]
            if word in self.next[at]:
                at, size = self.next[at][word], size + 1
            state = at
            while self.length[self.link[state]] >= window if state else False:
                state = self.link[state]
            yield size, self.count[state] if size >= window else 0


def match_by_automaton(segments: list[Segment], window: int) -> list[int]:
    shard = SuffixAutomaton()
    lists = [x[5].tolist() for x in segments]
    for segment, words in zip(segments, lists, strict=True):
        shard.add(words, segment[2])
    shard.close()
    masks = []
    for words in lists:
        mask = 0
        for end, (_, times) in enumerate(shard.statistics(words, window)):
            if times > 1:
                mask |= 1 << (end - window + 1)
        masks.append(mask)
    return masks


def substring_dedup(documents: DataFrame, window: int = 35, gram: int = GRAM) -> DataFrame:
    """remove_repeats by suffix automata; see there for the columns and for nulls and repeated rows."""
    return remove_repeats(documents, window, gram, match_by_automaton)
