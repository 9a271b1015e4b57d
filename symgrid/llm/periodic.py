"""Periodic runs of words: maximal stretches that repeat a sequence of words at least four times.

Many texts are laid end to end as numbers of words. For every period p of a text a grid of points, 3p
apart, is compared with the words p later: a run of length 4p or more has words that agree with those
p later over 3p places at least, so it holds a point. From every point where the words agree, the
extension to both sides is found by binary search over prefix hashes, for all periods and points at
once; points number n ln n for n words, not n * n. Words then verify what the hashes found.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from symgrid.llm.common import quoted, tidied

#: A run has at least so many words and so many periods.
WORDS, PERIODS = 6, 4
PRIME = (1 << 31) - 1
#: Texts are laid together up to so many words; so many grid points are compared at once.
CHUNK, POINTS = 200_000, 1 << 20

RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])


class Hashes:
    """Prefix sums of value(word) * base^place modulo a prime. `seed` chooses values and base."""

    def __init__(self, words: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        values = rng.integers(1, PRIME, int(words.max(initial=0)) + 1)
        n, base = len(words), int(rng.integers(1 << 20, PRIME))
        self.power = np.ones(n + 1, np.int64)
        done = 1
        while done <= n:
            more = min(done, n + 1 - done)
            self.power[done : done + more] = self.power[:more] * pow(base, done, PRIME) % PRIME
            done += more
        self.sums = np.zeros(n + 1, np.int64)
        # Fewer than 2^32 terms below 2^31 stay within 63 bits.
        np.cumsum(values[words] * self.power[:n] % PRIME, out=self.sums[1:])
        self.sums %= PRIME

    def equal(self, at: np.ndarray, size: np.ndarray | int, period: np.ndarray) -> np.ndarray:
        """Whether `size` words from `at` and those one period later seem equal."""
        one = (self.sums[at + size] - self.sums[at] + PRIME) * self.power[period] % PRIME
        two = (self.sums[at + period + size] - self.sums[at + period] + PRIME) % PRIME
        return one == two


def _extend(hashes: Hashes, at: np.ndarray, period: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
    """How many words from `at` on (before it, if back), at most `limit`, agree with those a period later."""
    size = np.zeros(len(at), np.int64)
    step = 1 << max(int(limit.max(initial=0)).bit_length() - 1, 0)
    while step:
        own = np.flatnonzero(size + step <= limit)
        first = at[own] - size[own] - step if back else at[own] + size[own]
        size[own[hashes.equal(first, step, period[own])]] += step
        step >>= 1
    return size


def _points(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of text, period and place of the grid points of all texts."""
    periods = np.where(sizes >= WORDS, sizes // PERIODS, 0)
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    many = (sizes[text] - period + 3 * period - 1) // (3 * period)
    block = np.cumsum(many) // POINTS
    for own in np.split(np.arange(len(text)), np.flatnonzero(np.diff(block)) + 1):
        n = many[own]
        which = np.repeat(own, n)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        yield text[which], period[which], starts[text[which]] + nth * 3 * period[which]


def _verified(words: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> bool:
    """Whether all words of these stretches equal those one period later."""
    size = end - start - period
    for own in np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size) // POINTS)) + 1):
        n = size[own]
        at = np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        if not np.array_equal(words[at], words[at + np.repeat(period[own], n)]):
            return False
    return True


def runs(words: np.ndarray, sizes: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of texts that lie end to end in `words` (numbers of words): text, first place and end in
    `words`, smallest period; by first place, then period.

    Hashes err to one side only: a stretch is found too long, which its words show, and then all is
    done again with another seed.
    """
    ends = np.cumsum(sizes)
    starts, hashes, found = ends - sizes, Hashes(words, seed), [np.zeros((4, 0), np.int64)]
    for text, period, at in _points(starts, sizes):
        own = np.flatnonzero(words[at] == words[at + period])
        text, period, at = text[own], period[own], at[own]
        right = _extend(hashes, at, period, ends[text] - at - period, False)
        left = _extend(hashes, at, period, at - starts[text], True)
        first, end = at - left, at + right + period
        own = np.flatnonzero(end - first >= np.maximum(WORDS, PERIODS * period))
        found.append(np.stack([text[own], first[own], end[own], period[own]]))
    text, first, end, period = np.concatenate(found, axis=1)
    # A stretch is found by all its points, and by the multiples of its period; the smallest is its own.
    order = np.lexsort((period, end, first))
    text, first, end, period = text[order], first[order], end[order], period[order]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (end[1:] != end[:-1])
    text, first, end, period = text[new], first[new], end[new], period[new]
    if not _verified(words, first, end, period):
        return runs(words, sizes, seed + 1)
    order = np.lexsort((period, first))
    return text[order], first[order], end[order], period[order]


def kept(n: int, first: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words no run holds after its first period."""
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, first + period, 1)
    np.add.at(inside, end, -1)
    return np.cumsum(inside[:n]) == 0


def _chunk(texts: list[list[bytes]]) -> tuple[pa.Array, list[bytes]]:
    """The runs of some texts, and the texts without repeated periods."""
    sizes = np.array([len(t) for t in texts], np.int64)
    number = defaultdict(count().__next__)
    words = np.fromiter((number[w] for t in texts for w in t), np.int64, int(sizes.sum()))
    text, first, end, period = runs(words, sizes)
    left = kept(len(words), first, end, period)
    starts = np.cumsum(sizes) - sizes
    short = set(np.unique(text).tolist())
    out = []
    for i, t in enumerate(texts):
        own = [t[j] for j in np.flatnonzero(left[starts[i] : starts[i] + sizes[i]])] if i in short else t
        out.append(b" ".join(own))
    edges = np.searchsorted(text, np.arange(len(texts) + 1))
    rows = pa.StructArray.from_arrays([pa.array(first - starts[text]), pa.array(end - first), pa.array(period)], names=["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), rows), out


def find(df: DataFrame, text: str = "text", to: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """df with the columns `to`, an array of start (number of a word, from 0), length and period of every
    run, by start, then period; and `collapsed`, the text without the words that any run holds after
    its first period, joined by single spaces. Columns of these names are replaced.

    Words are what lies between spaces, tabs and line ends. Null texts give no runs and null, empty ones
    and those without words no runs and an empty text. Texts of any length are read whole, periods
    included up to a quarter of it; repeated rows get equal results. Nothing is shuffled.
    """
    names = [c for c in df.columns if c not in (to, collapsed)]
    base = df.select(*[quoted(c) for c in names], quoted(text).cast("binary").alias("__text"))
    schema = base.drop("__text").schema.add(to, T.ArrayType(RUN, False), False).add(collapsed, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, n = batch.column(len(names)), batch.num_rows
            at = 0
            while at < n:
                texts, size, a = [], 0, at
                while at < n and size < CHUNK:
                    texts.append((column[at].as_py() or b"").split())
                    size += len(texts[-1])
                    at += 1
                found, short = _chunk(texts)
                left = pa.array([s if column[a + i].is_valid else None for i, s in enumerate(short)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(c.slice(a, at - a) for c in batch.columns[: len(names)]), found, left], [*names, to, collapsed])

    return base.mapInArrow(tidied(run), schema)
