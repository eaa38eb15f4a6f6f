"""Prefix trie of conversations from weighted whole sequences, without a nested structure.

1. A turn becomes a SHA-256 of role and text and a word count; texts go no further.
   A sequence's identity is its length and the sums of four 32-bit words, hashes of
   each turn's digest with its place. Sums need no order, so a sequence's identity
   is one aggregate, the identity of every prefix a running sum, and a parent's
   identity the sum without the last turn: 128 bits that add up.
2. Equal conversations collapse into one sequence with a weight and a list of ends.
   Sequences that are no proper prefix, found by an anti-join with the prefixes'
   parents, are the leaves.
3. Prefixes of the weighted sequences are aggregated to nodes. A node's own value
   belongs to one leaf below it, so running sums along the leaves, aggregated again
   by prefix, give every subtree's total with each node counted once.

Ranks and running sums are taken in chunks of ``CHUNK`` turns with offsets from the
chunks' totals, so neither a long conversation nor a much-used prefix meets in one task.
A list of ends is cut into blocks by a range partitioning, and its hash reads
the blocks one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.operators.scale import grouped_rank
from tallyframe.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 4096
IDS_A_BLOCK = 4096
SUMS = ("s1", "s2", "s3", "s4")
NODE = ("depth", *SUMS)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, place, n_turns, digest, words)``: turns by ``turn``, NULL first, ties by digest.

    Rows without ``conv_id`` belong to no conversation and are left out. NULL roles
    and texts count as empty. Repeated rows are turns of their own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    bucket = F.coalesce(F.shiftright("turn", 12), F.lit(-(2**62)))
    ranked = grouped_rank(turns, ["conv_id"], bucket, [F.col("turn").asc_nulls_first(), F.col("digest")], "place", total="n_turns")
    return ranked.select("conv_id", "place", "n_turns", "digest", "words")


def spliced(turns: DataFrame, base: Column, head: Column, longest: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns come from another one: ``(conv_id, place, digest, words)`` and all ``conv_id``.

    ``base`` and ``head`` are expressions of ``conv_id``: the first ``head`` turns, at
    most ``longest``, of conversation ``base`` as it is in ``turns`` replace as many
    own ones; all of them if it has fewer, none if it does not exist. The caller
    keeps the number of conversations with one base small.
    """
    turns = cut_lineage(turns)
    sizes = turns.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"))
    plan = sizes.select("conv_id", base.alias("base"), head.cast("bigint").alias("head"))
    taken = sizes.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("base_turns"))
    plan = plan.join(taken, "base", "left").select("conv_id", "base", "head", F.least("head", F.coalesce("base_turns", F.lit(0))).alias("got"))
    plan = cut_lineage(plan)
    own = turns.join(plan.select("conv_id", "head", "got"), "conv_id").where(F.col("place") > F.col("head"))
    own = own.select("conv_id", (F.col("place") - F.col("head") + F.col("got")).alias("place"), "digest", "words")
    first = turns.where(F.col("place") <= longest).select(F.col("conv_id").alias("base"), "place", "digest", "words")
    lent = plan.where("got > 0").join(first, "base").where(F.col("place") <= F.col("got"))
    return own.unionByName(lent.select("conv_id", "place", "digest", "words")), plan.select("conv_id")


def _parts() -> list[Column]:
    """Four 32-bit words of a turn at its place, as bigints that may be summed."""
    halves = [F.xxhash64(F.lit(seed), "digest", "place") for seed in (1, 2)]
    words = [w for h in halves for w in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    return [w.alias(s) for w, s in zip(words, SUMS, strict=True)]


def _running(df: DataFrame, key: str, order: str, values: Sequence[str], backwards: bool = False) -> DataFrame:
    """Sums of ``values`` up to and with each row of a key, from ``order`` up or down, chunk by chunk."""
    chunk = F.floor(F.col(order) / CHUNK).cast("bigint")
    base = df.withColumn("_chunk", -chunk if backwards else chunk)
    totals = base.groupBy(key, "_chunk").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, "_chunk", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_t_{v}") for v in values])
    inside = Window.partitionBy(key, "_chunk").orderBy(F.col(order).desc() if backwards else F.col(order))
    sums = {v: F.col(f"_t_{v}") + F.sum(v).over(inside.rowsBetween(Window.unboundedPreceding, 0)) for v in values}
    return base.join(offsets, [key, "_chunk"]).select(*[sums[c].alias(c) if c in sums else F.col(c) for c in df.columns])


def _end_blocks(whole: DataFrame) -> DataFrame:
    """``(NODE, first, ids)``: ascending ids of a sequence's conversations, comma-joined in blocks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, ids = [*NODE, "first", "ids"], None, []

        def block() -> list[tuple]:
            return [(*held, ids[0], ",".join(map(str, ids)))] if ids else []

        for batch in batches:
            done = []
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for *node, conv in zip(*columns, strict=True):
                if node != held or len(ids) >= IDS_A_BLOCK:
                    done += block()
                    held, ids = node, []
                ids.append(conv)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=names)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*block(), strict=True)], names=names)

    dealt = whole.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    return dealt.mapInArrow(pack, ", ".join(f"{n} bigint" for n in (*NODE, "first")) + ", ids string")


def _end_digests(blocks: DataFrame) -> DataFrame:
    """``(NODE, ends)``: SHA-256 over a sequence's blocks in order, one block in memory at a time."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, sha = [*NODE, "ends"], None, None
        for batch in batches:
            done = []
            for *node, ids in zip(*[batch.column(k).to_pylist() for k in range(batch.num_columns)], strict=True):
                if node == held:
                    sha.update(b"," + ids.encode())
                    continue
                if sha:
                    done.append((*held, sha.hexdigest()))
                held, sha = node, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=names)
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*held, sha.hexdigest())], names=names)

    sorted_ = blocks.repartition(*NODE).sortWithinPartitions(*NODE, "first").select(*NODE, "ids")
    return sorted_.mapInArrow(digest, ", ".join(f"{n} bigint" for n in NODE) + ", ends string")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations, the empty one of depth 0 included.

    ``turns`` has ``(conv_id, place, digest, words)`` with places from 1 without gaps;
    ``conversations`` has every ``conv_id`` once, also those without turns, which end
    in the root. Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``
    (parent's ``conv_id``, NULL for the root), ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (over the subtree, words that copies of a turn
    repeat) and ``ends_sha256`` (of the ids that end here, ascending, joined by
    commas). Without conversations there is no node, not even the root.
    """
    zero = F.lit(0).cast("bigint")
    parts = cut_lineage(turns.select("conv_id", "place", "words", *_parts()))
    sums = parts.groupBy("conv_id").agg(F.count("*").alias("depth"), *[F.sum(s).alias(s) for s in SUMS])
    whole = conversations.join(sums, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in NODE])
    whole = cut_lineage(whole)

    sequences = cut_lineage(whole.groupBy(*NODE).agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight")))
    chosen = parts.join(sequences.select(F.col("rep").alias("conv_id")), "conv_id")
    prefixes = _running(chosen.withColumns({f"own_{s}": F.col(s) for s in SUMS}), "conv_id", "place", SUMS)
    prefixes = cut_lineage(prefixes.select(F.col("conv_id").alias("rep"), F.col("place").alias("depth"), "words", *SUMS, *[f"own_{s}" for s in SUMS]))

    parent = [(F.col("depth") - 1).alias("depth"), *[(F.col(s) - F.col(f"own_{s}")).alias(s) for s in SUMS]]
    inner = prefixes.select(*parent).distinct()
    leaves = sequences.join(inner, list(NODE), "left_anti").select("rep", F.lit(True).alias("leaf"))
    weights = cut_lineage(sequences.select("rep", "weight").join(leaves, "rep", "left").select("rep", "weight", F.col("leaf").isNotNull().alias("leaf")))

    root = weights.select("rep", zero.alias("depth"), zero.alias("words"), *[zero.alias(s) for s in SUMS], *[zero.alias(f"own_{s}") for s in SUMS], "weight", "leaf")
    rows = root.unionByName(prefixes.join(weights, "rep"))
    nodes = rows.groupBy(*NODE).agg(
        F.min("rep").alias("conv_id"),
        F.sum("weight").alias("n_convs"),
        F.count_if("leaf").alias("n_leaves"),
        F.min(F.when(F.col("leaf"), F.col("rep"))).alias("owner"),
        F.max("words").alias("words"),
        *[F.max(f"own_{s}").alias(f"own_{s}") for s in SUMS],
    )
    nodes = cut_lineage(nodes)

    value = (F.col("n_convs") - 1) * F.col("words")
    valued = nodes.where((F.col("n_convs") > 1) & (F.col("words") > 0)).select(F.col("owner").alias("rep"), "depth", value.alias("saved"))
    paths = rows.where("leaf").select("rep", *NODE).join(valued, ["rep", "depth"], "left").select("rep", *NODE, F.coalesce("saved", zero).alias("saved"))
    below = _running(paths, "rep", "depth", ["saved"], backwards=True)

    facts = {"n_children": zero, "saved_tokens": zero, "ends": F.lit(None).cast("string")}

    def fact(df: DataFrame, node: Sequence[Column | str], **given: Column) -> DataFrame:
        return df.select(*node, *[given.get(n, empty).alias(n) for n, empty in facts.items()])

    child = nodes.where("depth > 0")
    gathered = (
        fact(below, NODE, saved_tokens=F.col("saved"))
        .unionByName(fact(child, parent, n_children=F.lit(1).cast("bigint")))
        .unionByName(fact(_end_digests(_end_blocks(whole)), NODE, ends=F.col("ends")))
        .groupBy(*NODE)
        .agg(F.sum("n_children").alias("n_children"), F.sum("saved_tokens").alias("saved_tokens"), F.max("ends").alias("ends"))
    )
    above = nodes.select(*[F.col(c).alias(f"up_{c}") for c in NODE], F.col("conv_id").alias("parent_conv_id"))
    up = [F.col("depth") - 1 == F.col("up_depth"), *[F.col(s) - F.col(f"own_{s}") == F.col(f"up_{s}") for s in SUMS]]
    placed = child.join(above, up).select(*NODE, "conv_id", "parent_conv_id", "n_convs", "n_leaves")
    top = nodes.where("depth = 0").select(*NODE, "conv_id", F.lit(None).cast("bigint").alias("parent_conv_id"), "n_convs", "n_leaves")
    return (
        placed.unionByName(top)
        .join(gathered, list(NODE))
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
