"""Line dedup against brute force, forwards and backwards."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyframe.llm import line_dedup
from tallyframe.llm.cuckoo import CuckooFilter, Full, filter_of
from tallyframe.llm.line_dedup import cleaned_documents, delete_documents, empty_index, insert_documents
from tests.llm.cases import TEXTS, documents, empty


def key_of(line):
    bare = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in bare)


def brute(rows, min_docs, min_chars=1, counted=None):
    seen = Counter(k for r in (rows if counted is None else counted) for k in {key_of(line) for line in (r[1] or "").split("\n")})
    gone = {k for k, n in seen.items() if n >= min_docs and len(k) >= min_chars}
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        left = [line for line in lines if key_of(line) not in gone]
        out.append((doc, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=str)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def drawn(n, seed):
    draw = random.Random(seed)
    stock = ["", " ", "Sign up", "sign UP \t", "été", "ÉTÉ", "x", "\x0bread more\r", " "] + [f"line {k}" for k in range(40)]
    return [(k, "\n".join(draw.choices(stock, k=draw.randint(1, 8))), "en", "a") for k in range(n)]


def state(index):
    return sorted((bytes(r.key), r.docs) for r in index.counts.collect()), sorted((r.shard, bytes(r.members)) for r in index.shards.collect())


@pytest.mark.parametrize("broadcast_bytes", [0, 32 << 20])
@pytest.mark.parametrize("min_docs,min_chars", [(2, 1), (3, 2), (1, 1)])
def test_awkward_rows(spark, broadcast_bytes, min_docs, min_chars):
    rows = [*TEXTS, (20, "A\n\n b \na", "en", "a"), (21, "\n", "en", "a"), (22, " a\nB", "en", "a"), (22, " a\nB", "en", "a")]
    docs = documents(spark, rows)
    index = insert_documents(empty_index(spark, min_docs, min_chars), docs)
    assert as_rows(cleaned_documents(index, docs, broadcast_bytes=broadcast_bytes)) == brute(rows, min_docs, min_chars)
    assert cleaned_documents(index, empty(docs), broadcast_bytes=broadcast_bytes).collect() == []


def test_no_documents(spark):
    docs = documents(spark)
    index = insert_documents(empty_index(spark), empty(docs))
    assert state(index) == ([], [])
    assert as_rows(cleaned_documents(index, docs)) == brute(TEXTS, 99)


@pytest.mark.parametrize("shard_keys", [3, 1 << 15])
def test_batches_and_deletions_are_reversible(spark, monkeypatch, shard_keys):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", shard_keys)
    monkeypatch.setattr(line_dedup, "ROWS_A_TASK", 20)
    rows = drawn(60, 1)
    table = lambda part: documents(spark, part)
    one = insert_documents(empty_index(spark, 4), table(rows[:40]))
    two = insert_documents(one, table(rows[40:]))
    whole = insert_documents(empty_index(spark, 4), table(rows))
    assert state(two)[0] == state(whole)[0] and two.bits == whole.bits
    assert (two.bits > 1) == (shard_keys == 3)
    for index, counted in ((one, rows[:40]), (two, rows), (whole, rows)):
        want = brute(rows, 4, counted=counted)
        assert as_rows(cleaned_documents(index, table(rows))) == want
        assert as_rows(cleaned_documents(index, table(rows), broadcast_bytes=0)) == want
    back = delete_documents(two, table(rows[40:]))
    assert state(back)[0] == state(one)[0]
    assert as_rows(cleaned_documents(back, table(rows))) == brute(rows, 4, counted=rows[:40])
    none = delete_documents(back, table(rows[:40]))
    assert state(none) == ([], [])


def test_deleting_what_was_not_inserted_fails(spark):
    index = insert_documents(empty_index(spark, 2), documents(spark, drawn(5, 2)))
    with pytest.raises(Exception, match="not in the index"):
        delete_documents(index, documents(spark, [(1, "never seen", "en", "a")]))


def digests(n, seed):
    draw = np.random.default_rng(seed)
    return draw.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2), draw.integers(0, 2**63, n, dtype=np.uint64)


def test_filter_holds_what_was_inserted_until_deleted():
    high, low = digests(5000, 3)
    made = filter_of(high, low)
    assert made.contains(high, low).all()
    other = digests(200_000, 4)
    assert made.contains(*other).mean() < 0.001
    made.delete(high[::2], low[::2])
    assert made.contains(high[1::2], low[1::2]).all()
    assert made.contains(high[::2], low[::2]).mean() < 0.01
    again = CuckooFilter(made.buckets, made.table())
    again.insert(high[::2], low[::2])
    assert again.contains(high, low).all()
    with pytest.raises(KeyError):
        made.delete(high[:4000:2], low[:4000:2])


def test_full_filter_keeps_its_members():
    high, low = digests(64, 5)
    small, put = CuckooFilter(8), 0
    with pytest.raises(Full):
        for k in range(64):
            small.insert(high[k : k + 1], low[k : k + 1])
            put += 1
    assert put >= 20 and small.contains(high[:put], low[:put]).all()
    assert filter_of(high, low, 8).contains(high, low).all()
