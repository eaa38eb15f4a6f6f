"""Periodic runs of words: maximal stretches that repeat a period three times or more.

A text's words become numbers. Every run of period ``q`` and length ``3 q`` or more
covers two neighbouring points of the grid ``0, q, 2q, ...``, so points whose words
differ a period later are left out, and the others are extended both ways by
longest-common-extension queries; the grids of all periods have n log n points.

An extension query compares the few words up to the next pair of synchronised
samples, positions whose residues lie in a difference cover, and answers the rest
from the samples alone: their suffixes are sorted, first by windows of one cover
length, then by doubling, and a sparse table holds minima over the common prefixes
of neighbours. The table is built when the first query reaches a sample.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: A perfect difference set: every residue modulo 31 is a difference of two of these.
CYCLE = 31
COVER = (1, 5, 11, 24, 25, 27)
MIN_WORDS = 24
MIN_REPEATS = 3
GRID_POINTS = 1 << 19
BATCH_BYTES = 4 << 20


def _first_shift() -> np.ndarray:
    """``[a, b]``: the fewest steps after which positions of residues a and b are both samples."""
    table = np.full((CYCLE, CYCLE), CYCLE, dtype=np.int64)
    for c in COVER:
        for d in COVER:
            for k in range(CYCLE):
                a, b = (c - k) % CYCLE, (d - k) % CYCLE
                table[a, b] = min(table[a, b], k)
    return table


SHIFT = _first_shift()
_SLOT = np.zeros(CYCLE, dtype=np.int64)
_SLOT[list(COVER)] = np.arange(len(COVER))


def _ranks(order: np.ndarray, keys: Sequence[np.ndarray]) -> np.ndarray:
    """Rank from 1 of every element, equal for equal keys; ``order`` sorts by them."""
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for key in keys:
        in_order = key[order]
        new[1:] |= in_order[1:] != in_order[:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


class Extensions:
    """Longest common extensions of two positions of one sequence of numbers >= 1."""

    def __init__(self, words: np.ndarray) -> None:
        self.size = len(words)
        self.words = np.concatenate([words, np.zeros(CYCLE + 1, dtype=words.dtype)])
        self._table: list[np.ndarray] | None = None

    def _windows(self, at: np.ndarray) -> list[np.ndarray]:
        """The next ``CYCLE`` words of each sample, several to a key, first words first."""
        bits = max(1, int(self.words.max()).bit_length())
        per_key = max(1, 62 // bits)
        keys = []
        for first in range(0, CYCLE, per_key):
            key = np.zeros(len(at), dtype=np.int64)
            for k in range(first, min(first + per_key, CYCLE)):
                key = (key << bits) | self.words[at + k]
            keys.append(key)
        return keys

    def _sort_samples(self) -> None:
        blocks = np.arange(0, self.size, CYCLE)[:, None] + np.array(COVER)[None, :]
        at = blocks.ravel()
        at = at[at < self.size]
        many = len(at)
        keys = self._windows(at)
        order = np.lexsort(keys[::-1])
        levels = [_ranks(order, keys)]
        step = len(COVER)  # a sample's neighbour one cover length on lies this many samples on
        while levels[-1].max() < many:
            rank = levels[-1]
            later = np.zeros(many, dtype=np.int64)
            later[: max(0, many - step)] = rank[step:]
            key = rank * (many + 1) + later
            order = np.argsort(key, kind="stable")
            levels.append(_ranks(order, [key]))
            step *= 2
        self._rank = levels[-1] - 1
        a, b = order[:-1].copy(), order[1:].copy()
        first, second = at[a], at[b]
        common = np.zeros(max(0, many - 1), dtype=np.int64)
        for t in range(len(levels) - 2, -1, -1):
            rank, step = levels[t], len(COVER) << t
            inside = (a < many) & (b < many)
            same = inside & (rank[np.minimum(a, many - 1)] == rank[np.minimum(b, many - 1)])
            common[same] += CYCLE << t
            a[same] += step
            b[same] += step
        open_ = np.arange(len(common))
        for _ in range(CYCLE):
            x, y = first[open_] + common[open_], second[open_] + common[open_]
            inside = (x < self.size) & (y < self.size)
            same = inside & (self.words[np.minimum(x, self.size)] == self.words[np.minimum(y, self.size)])
            open_ = open_[same]
            common[open_] += 1
            if not len(open_):
                break
        table, width = [common], 1
        while 2 * width <= len(common):
            last = table[-1]
            table.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        self._table = table

    def _between(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common prefix of two different samples: a range minimum over neighbours in suffix order."""
        if self._table is None:
            self._sort_samples()
        rx = self._rank[(x // CYCLE) * len(COVER) + _SLOT[x % CYCLE]]
        ry = self._rank[(y // CYCLE) * len(COVER) + _SLOT[y % CYCLE]]
        low, high = np.minimum(rx, ry), np.maximum(rx, ry)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), dtype=np.int64)
        for t in np.unique(level):
            pick = level == t
            row = self._table[t]
            out[pick] = np.minimum(row[low[pick]], row[high[pick] - (1 << int(t))])
        return out

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from ``i`` and ``j`` on; needs ``i < j``."""
        out = np.zeros(len(i), dtype=np.int64)
        meet = SHIFT[i % CYCLE, j % CYCLE]
        left, reached, t = np.arange(len(i)), [], 0
        while len(left):
            there = meet[left] == t
            if there.any():
                reached.append(left[there])
                left = left[~there]
            same = self.words[i[left] + t] == self.words[j[left] + t]
            out[left[~same]] = t
            left = left[same]
            t += 1
        if reached:
            far = np.concatenate(reached)
            out[far] = meet[far]
            far = far[j[far] + meet[far] < self.size]
            if len(far):
                out[far] += self._between(i[far] + meet[far], j[far] + meet[far])
        return out


def _grids(size: int, longest: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(point, period)`` of the grids of all periods, in blocks of about ``limit`` points."""
    periods = np.arange(1, longest + 1)
    counts = (size - 1) // periods - 1  # a point, its neighbour and the one after lie inside
    ends = np.cumsum(counts)
    first = 0
    while first < longest:
        done = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + limit, side="right")))
        q = np.repeat(periods[first:last], counts[first:last])
        k = np.arange(len(q)) - np.repeat(ends[first:last] - counts[first:last] - done, counts[first:last])
        yield k * q, q
        first = last


def find_runs(words: np.ndarray, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS, limit: int = GRID_POINTS) -> np.ndarray:
    """Rows ``(start, length, period)`` by start, then period, of a sequence of numbers >= 1.

    ``period`` is the smallest of its stretch, and no neighbouring word extends it.
    """
    if min_repeats < 3:
        raise ValueError("two neighbouring grid points lie in a run only from three repeats on")
    size = len(words)
    none = np.empty((0, 3), dtype=np.int64)
    if size < min_words:
        return none
    ahead, back, found = Extensions(words), None, []
    for g, q in _grids(size, size // min_repeats, limit):
        here = words[g + q]
        hit = np.flatnonzero(words[g] == here)
        hit = hit[here[hit] == words[g[hit] + 2 * q[hit]]]
        if not len(hit):
            continue
        g, q = g[hit], q[hit]
        reach = ahead.forward(g, g + q)
        hit = reach > q
        g, q, reach = g[hit], q[hit], reach[hit]
        if not len(g):
            continue
        back = back or Extensions(words[::-1])
        inner = g > 0
        before = np.zeros(len(g), dtype=np.int64)
        before[inner] = back.forward(size - g[inner] - q[inner], size - g[inner])
        length = before + reach + q
        hit = length >= np.maximum(min_words, min_repeats * q)
        found.append(np.stack([g - before, length, q], axis=1)[hit])
    if not found:
        return none
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    if len(rows):  # multiples of a period give its stretch again
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; equal ones by start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])


def _numbers(words: list[bytes]) -> np.ndarray:
    number = {w: k for k, w in enumerate(dict.fromkeys(words), 1)}
    return np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))


RUN = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])


def periodic_runs(
    docs: DataFrame,
    text: str = "text",
    carry: Sequence[str] = ("doc_id",),
    min_words: int = MIN_WORDS,
    min_repeats: int = MIN_REPEATS,
) -> DataFrame:
    """Per row: ``carry``, ``n_words``, ``runs``, ``strongest`` and the ``collapsed`` text.

    Words are runs of characters outside ``[\\x20\\x09-\\x0D]`` and numbered from 0.
    ``runs`` lists (start, length, period) by start, then period; ``strongest`` is
    NULL without runs. A NULL text counts as empty: no words, no runs, an empty
    collapsed text. Rows are independent: NULL, repeated or tied ids pass through,
    an empty table gives none, and columns beside ``carry`` and ``text`` are not
    read, so their names don't matter. A long text is searched whole; memory is a
    few numbers a word and blocks of bounded size.
    """
    names = list(carry)
    fields = [StructField(n, docs.schema[n].dataType) for n in names]
    schema = StructType(
        [*fields, StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("strongest", RUN), StructField("collapsed", StringType())]
    )
    run_type = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def as_dict(run: tuple[int, int, int]) -> dict[str, int]:
        return dict(zip(("start", "length", "period"), run, strict=True))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size, rows = 0, 0, []

            def flush(last: int, batch=batch) -> pa.RecordBatch:
                kept = [batch.column(k).slice(first, last - first) for k in range(len(names))]
                n, runs, best, rest = zip(*rows, strict=True)
                made = [
                    pa.array(n, pa.int64()),
                    pa.array(runs, pa.list_(run_type)),
                    pa.array(best, run_type),
                    pa.array(rest, pa.binary()).cast(pa.string()),
                ]
                return pa.RecordBatch.from_arrays([*kept, *made], names=schema.names)

            for k, value in enumerate(batch.column(len(names)).cast(pa.large_binary())):
                words = (value.as_py() or b"").split()  # the same six blanks
                runs = [] if len(words) < min_words else [tuple(r) for r in find_runs(_numbers(words), min_words, min_repeats).tolist()]
                best = strongest(runs)
                rest = collapsed(words, runs)
                rows.append((len(words), [as_dict(r) for r in runs], as_dict(best) if best else None, rest))
                size += len(rest)
                if size >= BATCH_BYTES:
                    yield flush(k + 1)
                    first, size, rows = k + 1, 0, []
            if rows:
                yield flush(batch.num_rows)

    return docs.select(*[docs[n] for n in names], docs[text]).mapInArrow(search, schema)
