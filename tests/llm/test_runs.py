"""Periodic runs against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tallyframe.llm.periodic_runs import CYCLE, SHIFT, Extensions, find_runs, periodic_runs, strongest
from tests.llm.cases import TEXTS, documents, empty


def brute_runs(words, min_words=24, min_repeats=3):
    found = {}
    for q in range(1, len(words) // min_repeats + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(min_words, min_repeats * q):
                found.setdefault((start, length), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def drawn(draw):
    """Words from a small or large stock, with stretches that repeat."""
    n, stock = draw.randint(0, 260), draw.choice([1, 2, 2, 3, 5, 50])
    words = [draw.randint(1, stock) for _ in range(n)]
    for _ in range(draw.randint(0, 3) if n > 30 else 0):
        a, p = draw.randrange(n), draw.randint(1, n // 4)
        for i in range(a, min(n, a + draw.randint(1, n))):
            words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("min_words", [3, 24])
def test_runs(min_words):
    draw = random.Random(min_words)
    for _ in range(400):
        words = drawn(draw)
        got = find_runs(np.array(words, dtype=np.int64), min_words, limit=draw.choice([5, 100, 1 << 19]))
        assert [tuple(r) for r in got.tolist()] == brute_runs(words, min_words)


def test_four_repeats():
    draw = random.Random(4)
    for _ in range(200):
        words = drawn(draw)
        assert [tuple(r) for r in find_runs(np.array(words, dtype=np.int64), 8, 4).tolist()] == brute_runs(words, 8, 4)


def test_extensions_reach_past_samples():
    assert SHIFT.max() < CYCLE
    draw = random.Random(5)
    for stock in (1, 2, 40):
        words = np.array([draw.randint(1, stock) for _ in range(500)], dtype=np.int64)
        words[200:460] = words[200 + np.arange(260) % 65]
        i = np.array([draw.randrange(400) for _ in range(800)])
        j = i + np.array([draw.randrange(1, 100) for _ in range(800)])
        want = []
        for a, b in zip(i.tolist(), j.tolist()):
            n = 0
            while b + n < 500 and words[a + n] == words[b + n]:
                n += 1
            want.append(n)
        assert Extensions(words).forward(i, j).tolist() == want


def test_strongest_compares_exactly():
    assert strongest([(0, 30, 7), (3, 60, 14), (2, 27, 9)]) == (0, 30, 7)
    assert strongest([(0, 10**17 + 1, 10**16), (5, 10**17 + 2, 10**16)]) == (5, 10**17 + 2, 10**16)
    assert strongest([]) is None


def test_long_text_in_linear_steps():
    words = np.arange(1, 300_001, dtype=np.int64)
    words[1000:] = words[1000 + np.arange(299_000) % 70_000]
    assert find_runs(words).tolist() == [[1000, 299_000, 70_000]]


def test_awkward_rows(spark):
    docs = documents(spark, [*TEXTS, (20, "x y " * 40, "en", "a"), (20, "x y " * 40, "en", "a"), (None, "\u00a0 " * 30, "en", "a")])
    rows = {r.doc_id if r.doc_id is not None else (None, r.n_words): r for r in periodic_runs(docs).collect()}
    assert [tuple(r) for r in rows[20].runs] == [(0, 80, 2)] and rows[20].collapsed == "x y" and tuple(rows[20].strongest) == (0, 80, 2)
    assert rows[None, 30].collapsed == "\u00a0"  # a no-break space is a word
    assert rows[5].n_words == rows[6].n_words == rows[7].n_words == 0 and rows[5].collapsed == "" and rows[5].strongest is None
    assert rows[8].collapsed.count(" ") == rows[8].n_words - 1 and rows[8].runs == []
    assert periodic_runs(docs).count() == len(TEXTS) + 3
    assert periodic_runs(empty(docs)).collect() == []


def test_clashing_names_and_other_columns(spark):
    docs = documents(spark).selectExpr("doc_id AS n_chars", "text AS runs", "lang AS n_words").where("n_chars = 9")
    row = periodic_runs(docs, text="runs", carry=("n_chars",)).first()
    assert tuple(row)[:2] == (9, 2)
