"""Registered queries against their SQL, and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tallyframe.llm.catalog import QUERIES, SQL
from tests.llm.cases import documents, empty
from tests.llm.test_copies import brute_components, brute_groups
from tests.llm.test_mixing import brute_targets
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, name):
    ok, why = compare(QUERIES[name](spark, sf), connect(sf), SQL[name])
    assert ok, why


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_covers_its_table(spark, sf, name):
    source = "pages" if name.startswith("op4") else "documents"
    assert QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{source}.parquet").count()


def test_entry_has_all_operators_and_the_pipeline():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_no_python_in_native_queries(spark, sf):
    for name in ("op2_license_digests", "op10_quality_rules"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_stages_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    rows = lambda df: [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]
    (_, quality), (_, exact), (_, near), (_, mix), (_, pieces) = corpus_pipeline.STAGES
    good = quality(spark, docs, sf)
    assert good.columns == names
    score = {r.doc_id: r.predicted for r in QUERIES["op8_quality_vote"](spark, sf).collect()}
    assert sorted(r[0] for r in rows(good)) == sorted(d for d, p in score.items() if p)
    single = exact(spark, good, sf)
    assert sorted(r[0] for r in rows(single)) == sorted(r[0] for r in brute_groups(rows(good)) if r[3])
    apart = near(spark, single, sf)
    assert sorted(r[0] for r in rows(apart)) == sorted(d for d, _, c in brute_components(rows(single)) if d == c)
    mixed = mix(spark, apart, sf)
    assert single.columns == apart.columns == mixed.columns == names
    assert {r[0] for r in rows(mixed)} <= {r[0] for r in rows(apart)}
    assert pieces(spark, mixed, sf).count() == mixed.count()


def test_stages_take_awkward_rows(spark, sf):
    for start in (documents(spark), empty(documents(spark))):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        assert docs.count() >= 0


def test_stages_keep_columns_that_begin_with_an_underscore(spark, sf):
    clashes = "_score _times _plan _source _other _own _id _nth _sha _points".split()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        marked = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in clashes])
        out = stage(spark, marked, sf)
        assert out.columns == marked.columns
        plain = stage(spark, docs, sf)
        assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in plain.select("doc_id").collect())
        assert out.where(" or ".join(f"{c} != concat('{c}', doc_id)" for c in clashes)).isEmpty()


def brute_mix(rows):
    """How often each id is taken: complete epochs, then documents by key while that comes nearer to the target."""
    by = defaultdict(list)
    for doc, text, _, source in rows:
        signs = sum(c < "\x7f" and c > " " and not c.isalnum() for c in text)
        uniform = (int(hashlib.md5(f"mix:{doc}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        weight = 0.1 + 0.9 * (len(text) - signs) / len(text) if text else 0.1
        by[source].append((-math.log(uniform) / weight, doc, len(re.findall(r"[^\x20\x09-\x0D]+", text))))
    sizes = {s: sum(size for *_, size in part) for s, part in by.items()}
    taken = Counter()
    for source, target in brute_targets(sizes).items():
        epochs = math.floor(target / sizes[source]) if sizes[source] else 0
        under = target - epochs * sizes[source]
        for _, doc, size in sorted(by[source]):
            taken[doc] += epochs + (under > 0 and under >= size / 2)
            under -= size
    return +taken


def test_mix_and_encoding_stages_row_by_row(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text or "", r.lang, r.source) for r in docs.collect()]
    (_, mix), (_, pieces) = corpus_pipeline.STAGES[3:]
    mixed = mix(spark, docs, sf)
    found = mixed.collect()
    want = brute_mix(rows)
    assert want and Counter(r.doc_id for r in found) == want
    text = {doc: (t, lang, source) for doc, t, lang, source in rows}
    assert all((r.text or "", r.lang, r.source) == text[r.doc_id] for r in found)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.MODEL))
    encoded = pieces(spark, mixed, sf).collect()
    assert Counter(r.doc_id for r in encoded) == want
    ids = {doc: library.encode(text[doc][0], add_eos=True) for doc in want}
    assert all(list(r.ids) == ids[r.doc_id] and r.n_tokens == len(r.ids) for r in encoded)
