"""Conversation trie against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import conversation_trie
from tallyframe.llm.conversation_trie import ordered_turns, prefix_trie, spliced
from tests.llm.cases import CLASHES

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows, head=lambda c: zlib.crc32(str(c).encode()) % 4):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn, role or "", text or ""))
    tie = lambda t: hashlib.sha256(f"{len(t[2])}:{t[2]}:{t[3]}".encode()).digest()
    turns = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[0], t[1] or 0, tie(t)))] for c, ts in own.items()}
    rebuilt = {c: turns.get(c - int(abs(c) % 20) * (1 if c >= 0 else -1), [])[: head(c)] + turns[c][head(c) :] for c in turns}
    members = defaultdict(list)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)

    def below(node):
        todo, leaves, saved = [node], 0, 0
        while todo:
            x = todo.pop()
            leaves += not kids[x]
            saved += (len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0
            todo += kids[x]
        return leaves, saved

    out = []
    for node, inside in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in inside if len(rebuilt[c]) == len(node)))
        up = min(members[node[:-1]]) if node else None
        out.append((min(inside), len(node), up, len(inside), len(kids[node]), *below(node), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows, extra=False):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:
        table = table.select("*", *[F.lit(k).alias(c) for k, c in enumerate([*CLASHES, "s1", "depth", "rep", "place", "digest2", "leaf", "_chunk"])])
    conv = F.col("conv_id")
    turns = ordered_turns(table)
    rebuilt, ids = spliced(turns, conv - conv % 20, F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(4)), 3)
    return sorted((tuple(r) for r in prefix_trie(rebuilt, ids).collect()), key=str)


def drawn(seed, convs, longest):
    draw = random.Random(seed)
    says = ["", "hi", "hi there", " hi", "one two three", None]
    rows = []
    for c in draw.sample(range(-30, 90), convs):
        rows += [(c, k, draw.choice(["user", "user", "assistant", None]), draw.choice(says)) for k in range(draw.randint(1, longest))]
    return rows


@pytest.mark.parametrize("chunk,block", [(4096, 4096), (2, 2)])
def test_trie(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(conversation_trie, "CHUNK", chunk)
    monkeypatch.setattr(conversation_trie, "IDS_A_BLOCK", block)
    rows = drawn(chunk, 50, 7)
    assert trie(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    same = [(c, k, "user", f"turn {k}") for c in range(100, 160) for k in range(3)]
    rows = [
        *same,
        (1, None, "user", "first"),
        (1, 0, None, None),
        (1, 0, "", ""),
        (1, 0, "", ""),
        (None, 0, "user", "nobody's"),
        (None, None, None, None),
        (20, 5, "user", "x " * 20_000),
        (20, 5, "user", "a tie"),
        (7, 0, "user", "base 0 is absent"),
        (2**62, 1, "user", "far"),
    ]
    assert trie(spark, rows, extra=True) == brute(rows)


def test_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "CHUNK", 64)
    rows = [(c, k * 5000, "user", f"say {k}") for c in (0, 1) for k in range(300)]
    assert trie(spark, rows) == brute(rows)


def test_no_conversations(spark):
    assert trie(spark, []) == [] == brute([])
