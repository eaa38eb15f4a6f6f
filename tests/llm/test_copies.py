"""Exact and near copies against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from tallyframe.llm.exact_dedup import Owner, Trie, exact_groups, kept_documents
from tallyframe.llm.ngram_join import near_duplicates, prefix_sizes
from tests.llm.cases import TEXTS, documents, empty


def brute_groups(rows):
    groups = {}
    for row in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", row[1] or ""), []).append(row)
    out = []
    for text, members in groups.items():
        rank = lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)
        best = min(members, key=rank)
        left = 1
        for r in sorted(members, key=rank):
            kept = bool(left and rank(r) == rank(best))
            left -= kept
            out.append((r[0], best[0], len(members), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("trie_bytes", [1, 2_000, 32 << 20])
def test_exact_groups(spark, trie_bytes):
    assert as_rows(exact_groups(documents(spark), trie_bytes=trie_bytes)) == brute_groups(TEXTS)


def test_equal_hashes_do_not_merge_texts(spark):
    rows = [(k, t, "en", "a") for k, t in enumerate(["ab", "b a", "ba", "a b", "cc", "abc", "bac"])]
    weak = lambda text: bytes(32)  # noqa: E731  one hash for all texts
    assert as_rows(exact_groups(documents(spark, rows), digest=weak)) == brute_groups(rows)


def test_kept_documents_have_their_columns(spark):
    docs = documents(spark)
    kept = kept_documents(docs)
    assert kept.columns == docs.columns
    want = sorted((r[0] for r in brute_groups(TEXTS) if r[3]), key=str)
    assert sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str) == want


def test_trie_returns_what_went_in():
    draw = random.Random(3)
    keys = {bytes(draw.choices(b"abc", k=draw.randint(0, 9))) for _ in range(400)}
    trie, seen = Trie(), {}
    for key in sorted(keys, key=lambda k: draw.random()):
        for _ in range(draw.randint(1, 3)):
            trie.insert(key, Owner(1, 7, 1, 1))
            seen[key] = seen.get(key, 0) + 1
    out = list(trie.spill(trie.size // 2)) + list(trie.spill_before(b"b")) + list(trie.drain())
    assert {k: o.rows for k, o in out} == seen
    assert not list(trie.drain()) and trie.size == 0


def test_trie_keeps_the_best_owner():
    trie = Trie()
    for points, doc in ((3, 5), (4, None), (4, 9), (4, 2), (4, 2)):
        trie.insert(b"k", Owner(points, doc, 1, 1))
    ((_, owner),) = trie.drain()
    assert (owner.points, owner.doc, owner.rows, owner.owner_rows) == (4, 2, 5, 2)


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({b" ".join(words)} if words else set())


def brute_components(rows):
    sets = {}
    for doc, text, *_ in rows:
        sets.setdefault(doc, []).append(shingles(text))
    label = {d: d for d in sets}

    def top(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(d for d in sets if d is not None)
    for i, x in enumerate(ids):
        for y in ids[:i]:
            if any(a and b and 100 * len(a & b) >= 75 * len(a | b) for a in sets[x] for b in sets[y]):
                a, b = top(x), top(y)
                label[max(a, b)] = min(a, b)
    return sorted(((r[0], len(shingles(r[1])), None if r[0] is None else top(r[0])) for r in rows), key=str)


def test_near_duplicates_with_awkward_rows(spark):
    assert as_rows(near_duplicates(documents(spark))) == brute_components(TEXTS)


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates_of_mutated_families(spark, seed):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, doc = [], 0
    shared = draw.choices(vocabulary, k=25)
    for _ in range(6):
        base = draw.choices(vocabulary, k=draw.randint(6, 120))
        for _ in range(draw.randint(1, 25)):
            words = list(base)
            for _ in range(draw.randint(0, len(words) // 14)):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            if draw.random() < 0.3:
                words = shared + words
            rows.append((doc, " ".join(words), "en", "a"))
            doc += 1
    assert as_rows(near_duplicates(documents(spark, rows))) == brute_components(rows)


def test_prefixes_reach_every_linked_pair():
    for n in range(1, 200):
        probe, index = prefix_sizes(n, 75)
        assert n - probe + 1 == -(-75 * n // 100) and 1 <= index <= probe


def test_empty_tables(spark):
    nothing = empty(documents(spark))
    assert exact_groups(nothing).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and exact_groups(nothing).isEmpty()
    assert kept_documents(nothing).isEmpty() and near_duplicates(nothing).isEmpty()
