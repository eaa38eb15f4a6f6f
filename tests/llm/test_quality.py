"""Classifier accuracy, rules and licence digests."""

from __future__ import annotations

import hashlib
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyframe.llm.arrays import text_bytes
from tallyframe.llm.license_digests import ISC, KNOWN, MIT, license_matches
from tallyframe.llm.license_store import STORED
from tallyframe.llm.quality_rules import measures, quality_rules
from tallyframe.llm.quality_vote import Model, TERMS, fit, latent_basis, quality, scored, term_counts
from tests.llm.cases import LONG, TEXTS, documents, empty
from tests.llm.licences import FOLDER, common_licences


@pytest.fixture(scope="module")
def tables(spark):
    top = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{top}/documents.parquet"), spark.read.parquet(f"{top}/labels.parquet")


def test_held_out_accuracy(tables):
    docs, labels = tables
    found = quality(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    tested = [r for r in found if r.held_out]
    for label in (0, 1):
        part = [r.predicted == label for r in tested if r.quality == label]
        assert len(part) > 10 and np.mean(part) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)


def test_held_out_labels_do_not_matter(tables):
    docs, labels = tables
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(tuple, quality(docs, turned).collect())) == sorted(map(tuple, quality(docs, labels).collect()))


def test_votes_are_weighted_by_cosine():
    vectors = np.array([[1, 0], [0.6, 0.8], [0, 1]], dtype=np.float32)
    model = Model(np.ones(TERMS, np.float32), np.eye(TERMS, 2, dtype=np.float32), vectors, np.array([1.0, 0.0, 0.0]), 0.7, 2, 1.0)
    counts = np.zeros((2, TERMS), dtype=np.int64)
    counts[0, 0] = 1
    assert model.scores(counts) == pytest.approx([1 / 1.6, 0.7])  # an empty text gets the share of label 1


def test_votes_over_a_table_by_brute_force(tables):
    """Every document against every labelled vector, one by one in double precision."""
    docs, labels = tables
    model = fit(docs, labels)
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r.score for r in scored(docs.select("doc_id", "text"), model).collect()}
    vectors, basis, idf = (x.astype(np.float64) for x in (model.vectors, model.basis, model.idf))
    off = []
    for r in rows:
        counts = np.concatenate([c for _, _, c in term_counts(*text_bytes(pa.array([r.text], pa.string())))])[0]
        weighted = np.log1p(counts.astype(np.float64)) * idf
        place = (weighted / (np.linalg.norm(weighted) or 1)) @ basis
        cosines = vectors @ (place / (np.linalg.norm(place) or 1))
        best = sorted(range(len(cosines)), key=lambda k: -cosines[k])[: model.neighbours]
        votes = [max(cosines[k], 0) ** model.sharpness for k in best]
        want = sum(v * model.labels[k] for v, k in zip(votes, best)) / sum(votes) if sum(votes) else model.prior
        off.append(abs(got[r.doc_id] - want))
    off = np.array(off)
    assert len(off) == len(got) and (off < 1e-3).mean() > 0.99  # equal cosines at the last place may fall either way
    assert off.max() < 2 / model.neighbours


def test_basis_spans_the_leading_directions():
    rows = np.random.Generator(np.random.PCG64(1)).standard_normal((60, 40)).astype(np.float32) * np.linspace(3, 0.01, 40, dtype=np.float32)
    basis = latent_basis(rows, 5, rounds=30)
    exact = np.linalg.svd(rows, full_matrices=False)[2][:5]
    assert np.linalg.svd(exact @ basis)[1] == pytest.approx(np.ones(5), abs=1e-2)


def test_counts_do_not_depend_on_the_batch():
    texts = ["Ab12## cd cd", "", None, LONG, "é É"]
    whole = np.concatenate([c for _, _, c in term_counts(*text_bytes(pa.array(texts)))])
    alone = np.concatenate([c for t in texts for _, _, c in term_counts(*text_bytes(pa.array([t], pa.string())))])
    assert (whole == alone).all() and not whole[1].any() and not whole[2].any()


def test_classifier_awkward_rows(spark, tables):
    docs = documents(spark)
    rows = scored(docs, fit(*tables))
    assert rows.columns == [c for c in docs.columns if c != "score"] + ["score"] and rows.count() == len(TEXTS)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (8, 1), (8, 1), (12, 0), (9, 5)], "doc_id bigint, quality int")
    assert quality(docs, labels).count() == len(TEXTS)
    assert {r.score for r in quality(docs, empty(labels)).collect()} == {0.5}
    assert quality(empty(docs), labels).isEmpty() and quality(empty(docs), empty(labels)).isEmpty()


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)} if len(words) < 2000 else set()
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rule_counts(spark):
    extra = ["a b c d e f a b c d e x", "x x x x x x", "l\nl\n\n \nl", "##|$ <b> &amp; 50%", "a b c d e a b c d e a b c d e", "p q r s t u p q r s t v q r s t u"]
    rows = [*TEXTS, *((100 + k, t, "en", "a") for k, t in enumerate(extra))]
    found = measures(documents(spark, rows), "doc_id", "text", "lang", "source").collect()
    got = sorted((str(r.doc), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found if r.n_words < 2000)
    assert got == sorted((str(r[0]), *brute_measures(r[1])) for r in rows if len((r[1] or "").split()) < 2000)


def test_fences_follow_the_group(spark):
    rows = [(k, f"{'longerword' if k % 2 else 'tiny'} " * 2 + " ".join(f"{'x' * (9 if k % 2 else 3)}{j}" for j in range(20)), "de" if k % 2 else "en", "s") for k in range(400)]
    rows += [(1000, "a" * 40 + " " + " ".join("b" * 40 + str(j) for j in range(20)), "en", "s"), (1001, " ".join(f"## $$ {j}" for j in range(20)), "de", "s"), (1002, " ".join(f"w{j}" for j in range(12)), "new", None)]
    kept = {r.doc_id: r.kept for r in quality_rules(documents(spark, rows)).collect()}
    assert all(kept[k] for k in range(400)) and not kept[1000] and not kept[1001] and 1002 in kept


def test_each_fence_acts_and_follows_its_group(spark):
    def text(k, lines=12, word="word"):
        return "\n".join(f"{word}{k % 97} line{j} of{j} the{j} text{k % 13} goes{j} on{j}" for j in range(lines))

    # in one group every document repeats a third of its lines and has signs, in the other none does
    noisy = lambda k: text(k) + "\n" + "\n".join(["end | of"] * 6) + "\n" + text(k + 1)
    rows = [(k, noisy(k) if k % 2 else text(k, 29), "en", "noisy" if k % 2 else "plain") for k in range(600)]
    strange = "\n".join([text(5, 29)] + [x for j in range(24) for x in (f"of{j} text{j}", f"of{j} text{j}")])
    signs = text(5, 29) + " " + "# " * 40
    longer = text(7, 29, "extraordinarilylongword" * 2)
    rows += [(1000 + 10 * g + k, t, "en", source) for g, source in enumerate(("plain", "noisy", "rare")) for k, t in enumerate((strange, signs, longer))]
    kept = {r.doc_id: r.kept for r in quality_rules(documents(spark, rows)).collect()}
    assert all(kept[k] for k in range(600))
    assert [kept[1000 + k] for k in range(3)] == [False] * 3
    assert kept[1010] and not kept[1011]  # repeated lines are usual there, that many signs are not
    assert not kept[1022]  # a group of three rows mostly follows its language


def test_rules_and_held_out_labels(tables):
    """Rules know no labels; on the labelled rows they spare the good ones and find most of the bad ones."""
    docs, labels = tables
    found = quality_rules(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    share = {r.quality: r.kept for r in found.collect()}
    assert share[1] > 0.99 and share[0] < 0.2


def test_rules_awkward_rows(spark):
    docs = documents(spark)
    found = quality_rules(docs).collect()
    assert len(found) == len(TEXTS) and all(r.base_failed is not None and r.kept is not None for r in found)
    assert quality_rules(empty(docs)).isEmpty()


def test_licences(spark):
    rows = [
        (1, "Copyright (c) 2020 Some One\n\n" + MIT.upper(), "en", "a"),
        (2, "/* " + ISC.replace("\n", "\n * ") + " */", "en", "a"),
        (3, "MIT Licence\n\n© 1999 A. Person. All rights reserved.\n" + MIT, "en", "a"),
        (4, MIT + " and more", "en", "a"),
        (5, "licensed under  cc by nc 4 0", "en", "a"),
        *((100 + k, *r[1:]) for k, r in enumerate(TEXTS)),
    ]
    known = spark.createDataFrame([*KNOWN, (None, "x"), ("blank", "..."), ("twin", MIT)], "license string, text string")
    got = {r.doc_id: r.license for r in license_matches(documents(spark, rows), known).collect()}
    assert {k: got[k] for k in range(1, 6)} == {1: "MIT", 2: "ISC", 3: "MIT", 4: None, 5: "CC-BY-NC-4.0 notice"}
    assert len(got) == len(rows) and all(got[100 + k] is None for k in range(len(TEXTS)))
    assert license_matches(empty(documents(spark)), known).isEmpty() and license_matches(documents(spark), empty(known)).count() == len(TEXTS)


def line_forms(text, widths=(40, 60, 70, 72, 73, 74, 75, 76, 77, 78, 79, 80, 100, 120)):
    """The text under several line widths, paragraph by paragraph and as one, and on one line."""
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", text)]
    for width in widths:
        yield "\n\n".join(textwrap.fill(p, width) for p in paragraphs)
        yield textwrap.fill(" ".join(paragraphs), width)
    yield "\n".join(paragraphs)
    yield " ".join(paragraphs)


def test_licences_in_any_line_width(spark):
    rows = []
    for name, text in KNOWN:
        title, body = text.split("\n\n", 1) if text.startswith(f"{name} License\n") else ("", text)
        for notice in ("", "Copyright (c) 2020 Some One", "Copyright 1999, 2001 A. Person", "© 2010 Some One. All rights reserved.", "(c) Some One", "Copyright The Some Authors"):
            rows += [(name, form) for form in line_forms("\n\n".join(x for x in (title, notice, body) if x))]
    docs = [(k, text, "en", "a") for k, (_, text) in enumerate(rows)]
    known = spark.createDataFrame(KNOWN, "license string, text string")
    got = {r.doc_id: r.license for r in license_matches(documents(spark, docs), known).collect()}
    wrong = [(name, got[k], text[:120]) for k, (name, text) in enumerate(rows) if got[k] != name]
    assert not wrong, (len(wrong), len(rows), wrong[:3])


def test_titles_and_notices_of_any_length(spark):
    owners = ", ".join(f"Person Number {k} of the Town" for k in range(60))
    leads = [
        "The MIT License (MIT)", "The MIT License", "MIT Licence:", "The MIT License (MIT)\n\nCopyright (c) 2014 Some One",
        f"Copyright (c) 2014 {owners}", f"MIT License\n\nCopyright 2014 {owners}\nAll rights reserved.", "Copyright ACME", "Copyright acme inc.", "copyright acme",
        "The Expat/MIT License (as published by the people who first wrote it down, and by others later on)\n\n(c) Some One\n\nCopyright acme inc.",
    ]
    rows = [(lead + gap + body, "MIT") for lead in leads for gap in ("\n\n", "\n", " ") for body in (MIT, " ".join(MIT.split()))]
    others = ["My notes on the town. License", "Words of my own", "Copyright notices are below", "Is this a license?", "A list, a license"]
    rows += [(f"{lead}\n\n{MIT}", None) for lead in others] + [(f"Copyright ACME\n\nown words\n\n{MIT}", None), ("Copyright ACME\n\n" + MIT + " more", None)]
    docs = [(k, text, "en", "a") for k, (text, _) in enumerate(rows)]
    known = spark.createDataFrame(KNOWN, "license string, text string")
    got = {r.doc_id: r.license for r in license_matches(documents(spark, docs), known).collect()}
    wrong = [(got[k], text[:90]) for k, (text, want) in enumerate(rows) if got[k] != want]
    assert not wrong, (len(wrong), wrong[:4])


def test_only_notices_go(spark):
    texts = [
        ("copyright notice and this permission notice appear", "copyright notice and this permission notice appear"),
        ("COPYRIGHT HOLDERS BE LIABLE\nfor", "copyright holders be liable for"),
        ("(c) You must retain, in the Source form", "c you must retain in the source form"),
        ("Copyright (c) 2020 Some One\nown words", "own words"),
        ("Copyright 2020 Some One\n\nmine\n\n" + MIT, "mine " + " ".join(re.findall("[a-z0-9]+", MIT.lower()))),
        ("All rights reserved.\nown words", "own words"),
        ("All rights reserved by nobody", "all rights reserved by nobody"),
    ]
    docs = [(k, text, "en", "a") for k, (text, _) in enumerate(texts)]
    known = spark.createDataFrame(KNOWN, "license string, text string")
    got = {r.doc_id: r for r in license_matches(documents(spark, docs), known).collect()}
    for k, (_, want) in enumerate(texts):
        assert got[k].digest == hashlib.sha256(want.encode()).hexdigest() and got[k].license is None


@pytest.mark.skipif(not FOLDER.is_dir(), reason="no licence texts on this machine")
def test_whole_common_licences(spark):
    texts = common_licences()
    rows = [(name, form) for name, text in texts for form in (text, *line_forms(text, (60, 72, 79, 100)))]
    rows += [(name, "Copyright (c) 2020 Some One\n\n" + text) for name, text in texts if name in ("BSD-2-Clause", "BSD-3-Clause") and text.startswith("Redis")]
    apache = texts[0][1].replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2020 Some One")
    rows += [("Apache-2.0", form) for form in (apache, *list(line_forms(apache, (60, 72, 79, 100)))[0:8:2])]
    rows += [(None, text + " and more") for _, text in texts]
    docs = [(k, text, "en", "a") for k, (_, text) in enumerate(rows)]
    known = spark.createDataFrame(KNOWN, "license string, text string")
    stored = spark.createDataFrame(STORED, "license string, digest string")
    got = {r.doc_id: r.license for r in license_matches(documents(spark, docs), known, stored=stored).collect()}
    wrong = [(name, got[k], text[:80]) for k, (name, text) in enumerate(rows) if got[k] != name]
    assert not wrong, (len(wrong), len(rows), wrong[:5])
