"""Periodic runs of words: stretches that repeat with a period at least three times over at least 24 words.

Every word of such a run occurs in it three times or more. So a word that occurs
less often in a segment belongs to no run of it and splits it; the parts are
counted anew until nothing changes, and parts under 24 words go. Only what survives
is scanned, lag by lag. Short lags compare a segment with itself shifted. A run of a
long lag holds two equal neighbouring blocks at multiples of the lag, so these
are compared, by prefix hashes, and what agrees is extended word by word: all
lags together take time in proportion to n log n.

Documents are worked on where they are read, nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tapeloom.llm.common import map_texts

#: A run is at least so long, and at least so many times its period.
SHORTEST, TIMES = 24, 3
#: Lags compared by shifting; longer ones go by blocks.
SHIFTED = 256
#: Rounds of splitting. A segment that could still be split gives the same runs, so this only bounds the time.
ROUNDS = 64
#: Bytes of a text split into words at once, and pairs of blocks compared at once.
PIECE_BYTES, PAIRS = 1 << 20, 1 << 20
BLANK = re.compile(rb"[\x20\x09-\x0D]")

Run = tuple[int, int, int]  # start, length, period


def pieces(text: bytes, most: int = PIECE_BYTES) -> Iterator[bytes]:
    """The text in pieces cut at blanks, so that no list holds all words of a very long one."""
    start = 0
    while len(text) - start > most:
        cut = BLANK.search(text, start + most)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:] if start else text


def coded(text: bytes, ids: dict[bytes, int]) -> np.ndarray:
    """The words of a text as numbers; new ones are added to `ids`."""
    found = []
    for piece in pieces(text):
        words = piece.split()
        found.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)))
    return found[0] if len(found) == 1 else np.concatenate(found)


def surviving(codes: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Segments (start, end) of the texts that end at `ends`, in which every word occurs often enough for a run."""
    sizes = np.diff(np.r_[0, ends])
    segment = np.repeat(np.arange(len(ends)), sizes)
    at = np.flatnonzero(sizes[segment] >= SHORTEST)
    segment, done = segment[at], []
    spread = int(codes.max(initial=0)) + 1
    for turn in range(ROUNDS):
        if not len(at):
            break
        _, inverse, counts = np.unique(segment * spread + codes[at], return_inverse=True, return_counts=True)
        often = counts[inverse] >= TIMES
        begin = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        stable = np.logical_and.reduceat(often, begin)
        stop = np.r_[begin[1:], len(at)]
        if turn == ROUNDS - 1:
            stable[:] = True
        done += zip(at[begin[stable]].tolist(), (at[stop[stable] - 1] + 1).tolist(), strict=True)
        keep = often & ~np.repeat(stable, stop - begin)
        at, segment = at[keep], segment[keep]
        if not len(at):
            break
        new = np.r_[True, (at[1:] != at[:-1] + 1) | (segment[1:] != segment[:-1])]
        segment = np.cumsum(new) - 1
        long = np.bincount(segment)[segment] >= SHORTEST
        at, segment = at[long], segment[long]
    return done


def shifted(codes: np.ndarray, segments: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """Runs (start, end) with a period of at most SHIFTED, all segments at once, the longest first."""
    segments = sorted(segments, key=lambda s: s[0] - s[1])
    sizes = np.array([e - s for s, e in segments])
    row = np.concatenate([np.r_[codes[s:e], -1 - i] for i, (s, e) in enumerate(segments)])  # signs that equal nothing
    first = np.r_[0, np.cumsum(sizes + 1)]
    found: dict[tuple[int, int], int] = {}
    for lag in range(1, min(SHIFTED, int(sizes[0]) // TIMES) + 1):
        least = max(SHORTEST, TIMES * lag)
        part = row[: first[np.count_nonzero(sizes >= least)]]
        differ = np.r_[-1, np.flatnonzero(part[lag:] != part[:-lag]), len(part) - lag]
        long = np.flatnonzero(np.diff(differ) > least - lag)
        for s, e in zip((differ[long] + 1).tolist(), differ[long + 1].tolist(), strict=True):
            k = int(np.searchsorted(first, s, "right")) - 1
            place = segments[k][0] + s - int(first[k])
            found.setdefault((place, place + e - s + lag), lag)  # a multiple of a period gives the same run again
    return found


def extended(c: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The stretch around `at` whose words equal those `lag` further on, as the run it makes."""
    n, right, left, step = len(c) - lag, at, at, 64
    while right < n:
        differ = np.flatnonzero(c[right : min(n, right + step)] != c[right + lag : min(n, right + step) + lag])
        if len(differ):
            right += int(differ[0])
            break
        right, step = min(n, right + step), 2 * step
    step = 64
    while left > 0:
        low = max(0, left - step)
        differ = np.flatnonzero(c[low:left] != c[low + lag : left + lag])
        if len(differ):
            left = low + int(differ[-1]) + 1
            break
        left, step = low, 2 * step
    return left, right + lag


def by_blocks(c: np.ndarray, known: list[tuple[int, int]]) -> list[Run]:
    """Runs (start, end, period) of a segment with a period beyond SHIFTED; `known` are those of shorter ones."""
    n, found = len(c), []
    reach = np.zeros(n, np.int64)  # how far a known run over a place goes
    for s, e in known:
        reach[s:e] = np.maximum(reach[s:e], e)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.r_[np.uint64(1), np.full(n, 0x9E3779B97F4A7C15, np.uint64)])
        mixed = (c.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        sums = np.r_[np.uint64(0), np.cumsum(mixed * powers[:-1])]
        lags = np.arange(SHIFTED + 1, n // TIMES + 1)
        blocks = n // lags - 1  # neighbouring pairs
        at = 0
        while at < len(lags):
            most = max(1, int(np.searchsorted(np.cumsum(blocks[at : at + PAIRS]), PAIRS, "right")))
            q, many = lags[at : at + most], blocks[at : at + most]
            at += most
            lag = np.repeat(q, many)
            a = (np.arange(len(lag)) - np.repeat(np.cumsum(many) - many, many)) * lag
            same = (sums[a + lag] - sums[a]) * powers[lag] == sums[a + 2 * lag] - sums[a + lag]
            same &= reach[a] < a + 2 * lag
            for place, p in zip(a[same].tolist(), lag[same].tolist(), strict=True):
                if reach[place] >= place + 2 * p or not np.array_equal(c[place : place + p], c[place + p : place + 2 * p]):
                    continue
                s, e = extended(c, place, p)
                if e - s >= max(SHORTEST, TIMES * p):
                    reach[s:e] = np.maximum(reach[s:e], e)
                    found.append((s, e, p))
    return found


def runs_of(codes: np.ndarray, ends: np.ndarray) -> list[list[Run]]:
    """For each of the texts that end at `ends` in `codes` its runs, by start and period."""
    found: list[list[Run]] = [[] for _ in ends]
    segments = surviving(codes, ends)
    if not segments:
        return found
    short = shifted(codes, segments)
    every = [(s, e, q) for (s, e), q in short.items()]
    for start, end in segments:
        if end - start > TIMES * SHIFTED:
            known = [(s - start, e - start) for s, e in short if start <= s < end]
            every += [(s + start, e + start, q) for s, e, q in by_blocks(codes[start:end], known)]
    firsts = np.r_[0, ends[:-1]]
    for s, e, q in every:
        text = int(np.searchsorted(ends, s, "right"))
        found[text].append((s - int(firsts[text]), e - s, q))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def greatest(runs: list[Run]) -> Run | None:
    """The run with the greatest length by period; of equal ones the first, then that with the shortest period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def dropped_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    gone = np.zeros(n, bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return gone


#: Words of a text, as numbers, in another arrangement: (value of the column `beside`, numbers) to numbers.
Arrange = Callable[[object, np.ndarray], np.ndarray]
RUN = StructType([StructField(n, LongType(), False) for n in ("start", "length", "period")])
FIELDS = [
    StructField("n_words", LongType()), StructField("runs", ArrayType(RUN, False)), StructField("greatest", RUN),
    StructField("collapsed", StringType()),
]


def find_runs(docs: DataFrame, text: str = "text", beside: str | None = None, arrange: Arrange | None = None) -> DataFrame:
    """`docs` with n_words, runs, greatest and collapsed in the place of the text column.

    `runs` are all runs (start, length, period) by start and period, numbered by words from 0;
    `greatest` is the one with the greatest length by period, null if there is none;
    `collapsed` the words without those that lie in a run after its first period, joined by
    one space. `arrange` may deal the words of a text anew before, told by the column `beside`.

    Null, empty and blank texts have no words, no runs and an empty `collapsed`. A very
    long text is handled alone, as one number a word. Repeated rows are answered each, an
    empty table gives an empty table; other columns pass through whatever their nulls, but
    one with the name of a new column is replaced.
    """
    names = {f.name for f in FIELDS} - {text}
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c not in names])

    def work(texts: list[bytes], others: list) -> list[pa.Array]:
        ids: dict[bytes, int] = {}
        codes = [coded(t, ids) for t in texts]
        moved = [False] * len(texts)
        if arrange:
            dealt = [arrange(o, c) for o, c in zip(others, codes, strict=True)]
            moved = [d is not c for d, c in zip(dealt, codes, strict=True)]
            codes = dealt
        found = runs_of(np.concatenate(codes), np.cumsum([len(c) for c in codes])) if texts else []
        words: list[bytes] = []
        if any(moved):
            words = list(ids)
        shown = []
        for t, c, runs, anew in zip(texts, codes, found, moved, strict=True):
            if not runs and not anew:
                shown.append(b" ".join([b" ".join(p.split()) for p in pieces(t) if p.strip()]))
            elif anew:
                shown.append(b" ".join([words[i] for i in c[~dropped_words(len(c), runs)].tolist()]))
            else:
                keep, at, kept = ~dropped_words(len(c), runs), 0, []
                for p in pieces(t):
                    some = p.split()
                    kept += [b" ".join([w for w, k in zip(some, keep[at : at + len(some)].tolist(), strict=True) if k])]
                    at += len(some)
                shown.append(b" ".join([k for k in kept if k]))
        def as_run(r: Run | None) -> dict | None:
            return dict(zip(("start", "length", "period"), r, strict=True)) if r else None

        kind = pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")])
        return [
            pa.array([len(c) for c in codes], pa.int64()),
            pa.array([[as_run(r) for r in runs] for runs in found], pa.list_(pa.field("element", kind, False))),
            pa.array([as_run(greatest(runs)) for runs in found], kind),
            pa.array(shown, pa.binary()).cast(pa.string()),
        ]

    def make():
        return work if beside else lambda texts: work(texts, [None] * len(texts))

    return map_texts(docs, text, FIELDS, make, beside)
