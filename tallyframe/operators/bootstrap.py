"""Bootstrap intervals over videos, drawn shard by shard.

Videos of a slice lie in shards of at most ``SHARD`` neighbours in digest order. A replicate
of ``v`` videos first learns how many of its draws fall into each shard: the draws of
a range of shards are split in two by a binomial number until one shard is left, which
is a multinomial split. Inside a shard a draw picks a video by hash, and only the sum
over the draws goes on. Replicates go in blocks: a row is a (slice, shard, block), so a
shuffle carries the shard's videos once per block, and numpy draws for the whole block.

All numbers are hashes of (seed, slice, replicate, shard, place): the same on every
run, partitioning and engine that has md5.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.numbers import binomial_hits, binomial_sums, hash_text
from tallyframe.operators.compare import contingency, video_differences
from tallyframe.operators.scale import grouped_rank, hash_bucket
from tallyframe.session import cut_lineage

SHARD = 4096
PICKS = 3  # SHARD ** 3 is 2 ** 36, so the last of three digits of a 60-bit number is even to 2 ** -24
DRAWS_A_ROW = 1 << 18  # draws of one shard in one block of replicates
NODES_A_ROW = 1 << 16  # shards times replicates of a block
DRAWS_A_TASK = 1 << 20


def _numbered(df: DataFrame, keys: Sequence[str], shard: int) -> DataFrame:
    """Number the videos of each slice 0.. in digest order; add shard and slice size."""
    named = df.withColumn("_digest", hash_text("video", F.col("video")))
    out = grouped_rank(named, keys, hash_bucket(F.col("_digest")), [F.col("_digest"), F.col("video")], "_rank", "size")
    slot = F.col("_rank") - 1
    return cut_lineage(out.withColumns({"slot": slot, "shard": F.floor(slot / shard).cast("bigint")}).drop("_rank", "_digest"))


def _digests(heads: Sequence[str], tails: Sequence[Sequence[bytes]]) -> np.ndarray:
    """Both halves of the md5 of every head with each of its tails, as 64-bit numbers."""
    joined = b"".join([md5(h + t).digest() for h, own in zip([h.encode() for h in heads], tails, strict=True) for t in own])
    return np.frombuffer(joined, ">u8").astype(np.uint64).reshape(-1, 2)


def _unit(half: np.ndarray) -> np.ndarray:
    """A number in [0, 1) from the first 13 hex digits of half a digest."""
    return (half >> np.uint64(12)).astype(np.float64) / float(1 << 52)


def _split(head: str, reps: range, size: int, shard: int) -> np.ndarray:
    """Draws of each replicate (row) in each shard (column)."""
    low, high = np.array([0]), np.array([-(-size // shard)])
    draws = np.full((len(reps), 1), size)
    while (wide := high - low > 1).any():
        middle = (low + high) // 2
        p = (middle - low) * shard / (np.minimum(high * shard, size) - low * shard)
        ends = [f"{a}|{b}".encode() for a, b in zip(low[wide], high[wide], strict=True)]
        u = _unit(_digests([f"{head}|{r}|split|" for r in reps], [ends] * len(reps))[:, 0])
        left = draws.copy()
        left[:, wide] = binomial_hits(draws[:, wide].ravel(), np.tile(p[wide], len(reps)), u).reshape(len(reps), -1)
        at = np.repeat(np.arange(len(low)), 1 + wide)
        second = np.r_[False, at[1:] == at[:-1]]
        draws = np.where(second, (draws - left)[:, at], left[:, at])
        low, high = np.where(second, middle[at], low[at]), np.where(second | ~wide[at], high[at], middle[at])
    return draws


def _per_row(columns: Sequence[str], work: Callable[[dict], dict[str, pa.Array]]):
    """A function of Arrow batches: ``work`` makes columns from one row, which follow the row's ``columns``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                made = work({name: batch.column(name)[i] for name in batch.schema.names})
                at = pa.array(np.full(len(next(iter(made.values()))), i))
                kept = [batch.column(name).take(at) for name in columns]
                yield pa.RecordBatch.from_arrays([*kept, *made.values()], [*columns, *made])

    return run


def _schema(df: DataFrame, columns: Sequence[str], **made: T.DataType) -> T.StructType:
    return T.StructType([*[df.schema[c] for c in columns], *[T.StructField(c, t) for c, t in made.items()]])


def _dealt(numbered: DataFrame, keys: Sequence[str], reps: int, seed: int, shard: int, total: int) -> DataFrame:
    """Draws per shard: a row per (keys, shard, first replicate of a block), the block's ``draws`` as a list."""
    shards = F.ceil(F.col("size") / shard)
    most = max(1, min(reps, DRAWS_A_ROW // shard))
    block = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(NODES_A_ROW / shards))).cast("int")
    head = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    slices = numbered.groupBy(*keys).agg(F.max("size").alias("size")).withColumn("_block", block)
    blocks = slices.select(*keys, "size", "_block", head.alias("_head"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1), "_block")).alias("_rep"))
    tasks = max(1, math.ceil(reps * total / shard / NODES_A_ROW))
    same = [*keys, "size", "_head", "_rep"]

    def work(row: dict) -> dict[str, pa.Array]:
        first = row["_rep"].as_py()
        block = range(first, min(first + row["_block"].as_py(), reps))
        draws = _split(row["_head"].as_py(), block, row["size"].as_py(), shard)
        ends = np.arange(draws.shape[1] + 1) * len(block)
        lists = pa.LargeListArray.from_arrays(ends, draws.T.ravel()).cast(pa.list_(pa.int64()))
        return {"shard": pa.array(np.arange(draws.shape[1])), "draws": lists}

    schema = _schema(blocks, same, shard=T.LongType(), draws=T.ArrayType(T.LongType()))
    return blocks.repartition(tasks, *keys, "_rep").mapInArrow(_per_row(same, work), schema)


def shard_draws(numbered: DataFrame, keys: Sequence[str], reps: int, seed: int, shard: int = SHARD) -> DataFrame:
    """How many draws of each replicate fall into each shard: ``(keys, rep, size, shard, draws)``."""
    dealt = _dealt(numbered, keys, reps, seed, shard, numbered.count())
    rows = dealt.select(*keys, "size", "shard", "_rep", F.posexplode("draws").alias("_i", "draws"))
    return rows.where("draws > 0").select(*keys, (F.col("_rep") + F.col("_i")).alias("rep"), "size", "shard", "draws")


def _shard_rows(numbered: DataFrame, keys: Sequence[str], *columns: str) -> DataFrame:
    """One row per shard, each column a list in slot order."""
    videos = F.array_sort(F.collect_list(F.struct("slot", *columns))).alias("_videos")
    rows = numbered.groupBy(*keys, "shard").agg(videos)
    return rows.select(*keys, "shard", *[F.col(f"_videos.{c}").alias(c) for c in columns])


def _replicates(numbered: DataFrame, keys: Sequence[str], reps: int, seed: int, shard: int, columns: Sequence[str], drawn, name: str) -> DataFrame:
    """Mean over the videos of each replicate.

    ``drawn(heads, draws, *columns)`` gives the value of every draw of a shard, and the
    number of its replicate in the block; the columns are arrays in slot order.
    """
    total = numbered.count()
    rows = _dealt(numbered, keys, reps, seed, shard, total).join(_shard_rows(numbered, keys, *columns), [*keys, "shard"])
    rows = rows.repartition(max(1, math.ceil(reps * total / DRAWS_A_TASK)), *keys, "shard", "_rep")
    same = [*keys, "size"]

    def work(row: dict) -> dict[str, pa.Array]:
        draws = row["draws"].values.to_numpy()
        block = np.arange(len(draws)) + row["_rep"].as_py()
        heads = [f"{row['_head'].as_py()}|{r}|{row['shard'].as_py()}|" for r in block]
        values, owner = drawn(heads, draws, *[row[c].values.to_numpy(zero_copy_only=False) for c in columns])
        return {"rep": pa.array(block.astype(np.int32)), "_total": pa.array(np.bincount(owner, values, len(draws)).astype(np.float64))}

    sums = rows.mapInArrow(_per_row(same, work), _schema(rows, same, rep=T.IntegerType(), _total=T.DoubleType()))
    return sums.groupBy(*keys, "rep").agg((F.sum("_total") / F.max("size")).alias(name))


def _numbers(counts: np.ndarray) -> list[list[bytes]]:
    """For each count the numbers 1 to it, as text."""
    every = [str(j).encode() for j in range(1, int(counts.max(initial=0)) + 1)]
    return [every[:c] for c in counts]


def paired_replicates(differences: DataFrame, keys: Sequence[str], reps: int, seed: int, shard: int = SHARD) -> DataFrame:
    """Mean per-video difference ``d`` of every replicate.

    Fifteen hex digits pick ``PICKS`` videos of a shard, as digits of a number to
    the base of the shard's size; half a digest serves one step.
    """

    def drawn(heads: Sequence[str], draws: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        digests = -(-draws // (2 * PICKS))
        x = _digests(heads, _numbers(digests)).ravel() >> np.uint64(4)
        m = np.uint64(len(d))
        places = np.stack([x // m ** np.uint64(k) % m for k in range(PICKS)], axis=1).ravel()
        owner = np.repeat(np.arange(len(draws)), digests * 2 * PICKS)
        first = np.cumsum(digests * 2 * PICKS) - digests * 2 * PICKS
        wanted = np.arange(len(owner)) - first[owner] < draws[owner]
        return d[places[wanted].astype(np.int64)], owner[wanted]

    return _replicates(_numbered(differences, keys, shard), keys, reps, seed, shard, ["d"], drawn, "mean")


def paired_interval(
    differences: DataFrame, keys: Sequence[str], reps: int = 10_000, seed: int = 42, level: float = 0.95, shard: int = SHARD
) -> DataFrame:
    """Video-bootstrap interval of the mean per-video difference."""
    edge = (1 - level) / 2
    return paired_replicates(differences, keys, reps, seed, shard).groupBy(*keys).agg(
        F.percentile("mean", F.lit(edge)).alias("ci_low"),
        F.percentile("mean", F.lit(1 - edge)).alias("ci_high"),
    )


def paired_slices(cells: DataFrame, keys: Sequence[str], reps: int = 10_000, seed: int = 42, shard: int = SHARD) -> DataFrame:
    """Both runs, their delta and its interval for every slice."""
    interval = paired_interval(video_differences(cells, keys), keys, reps, seed, shard=shard)
    return contingency(cells, keys).join(interval, list(keys))


def bootstrap_replicates(cells: DataFrame, keys: Sequence[str], reps: int = 1000, seed: int = 42, shard: int = SHARD) -> DataFrame:
    """Replicate means of the two-level bootstrap: videos, then questions in each.

    A resample of ``n`` right/wrong questions of which ``k`` are right is a
    Binomial(n, k/n) count. The second half of a draw's digest picks the count for the
    drawn video by inverting that distribution.
    """
    per_video = cells.groupBy(*keys, "video").agg(F.sum("n").cast("bigint").alias("n"), F.sum("k").cast("bigint").alias("k"))
    numbered = _numbered(per_video.where("n > 0"), keys, shard)

    def drawn(heads: Sequence[str], draws: np.ndarray, n: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kinds, kind = np.unique(np.stack([n, k], axis=1), axis=0, return_inverse=True)
        low, begin, upto = binomial_sums(kinds[:, 0], kinds[:, 1])
        both = _digests(heads, _numbers(draws))
        place = ((both[:, 0] >> np.uint64(12)) % np.uint64(len(n))).astype(np.int64)
        own = kind.ravel()[place]
        # sums of one kind lie in [its number, its number + 1]
        above = np.searchsorted(upto, own + _unit(both[:, 1]), side="right") - begin[own]
        hits = low[own] + np.minimum(above, begin[own + 1] - begin[own] - 1)
        return hits / n[place], np.repeat(np.arange(len(draws)), draws)

    return _replicates(numbered, keys, reps, seed, shard, ["n", "k"], drawn, "accuracy")


def bootstrap_interval(cells: DataFrame, keys: Sequence[str], reps: int = 1000, seed: int = 42) -> DataFrame:
    """Percentile 95 % interval of the per-video macro accuracy."""
    return bootstrap_replicates(cells, keys, reps, seed).groupBy(*keys).agg(
        F.percentile("accuracy", F.lit(0.025)).alias("ci_low"),
        F.percentile("accuracy", F.lit(0.975)).alias("ci_high"),
    )
