"""Targets, epochs and the fractional selection."""

from __future__ import annotations

import math
from collections import defaultdict

import pytest

from tallyframe.llm.mixing import mixed_documents, mixed_sizes, source_targets, word_count
from tests.llm.cases import TEXTS, documents, empty


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        unit = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * unit >= 3 * sizes[s]}
        if not above:
            return target | {s: weight[s] * unit for s in open_}
        for s in above:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= above
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 2, None: 50}, {"a": 0, "b": 7}, {None: 5}, {"a": 0}, {f"s{k:02}": k * k for k in range(20)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


@pytest.mark.parametrize("bin_rows", [1, 4, 4096])
def test_each_source_comes_near_its_target(spark, bin_rows):
    rows = [(k, "w " * (1 + k * 7 % 23), "en", ["a", "b", "c", None][min(k % 7, 3)]) for k in range(400)]
    found = mixed_sizes(documents(spark, rows), bin_rows=bin_rows).collect()
    by = defaultdict(list)
    for r in found:
        by[r.source].append(r)
        assert r.taken == r.copies * r.size <= 3 * r.size
        assert r.copies - math.floor(r.target / r.source_size) in (0, 1)  # complete epochs come first
    for part in by.values():
        assert abs(sum(r.taken for r in part) - part[0].target) <= max(r.size for r in part) / 2 + 1e-6
    again = mixed_sizes(documents(spark, rows, parts=7), bin_rows=64).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in found)


def test_weights_matter(spark):
    rows = [(k, ("good words here " if k % 2 else "## $$ %% ") * 5, "en", "ab"[k > 1999]) for k in range(2400)]
    taken = defaultdict(int)
    for r in mixed_sizes(documents(spark, rows)).where("source = 'a'").collect():
        taken[r.doc_id % 2] += r.copies
    assert taken[1] > 1.4 * taken[0]


def test_awkward_rows_and_empty_table(spark):
    docs = documents(spark)
    found = mixed_sizes(docs).collect()
    assert len(found) == len(TEXTS)
    sizes = docs.select("doc_id", word_count(docs.text).alias("s")).collect()
    want = sorted(((r[0], len((r[1] or "").encode().split())) for r in TEXTS), key=str)
    assert sorted(((r.doc_id, r.s) for r in sizes), key=str) == want == sorted(((r.doc_id, r.size) for r in found), key=str)
    rows = mixed_documents(docs)
    assert rows.columns == docs.columns and rows.count() == sum(r.copies for r in found)
    assert mixed_sizes(empty(docs)).isEmpty() and mixed_documents(empty(docs)).isEmpty()
