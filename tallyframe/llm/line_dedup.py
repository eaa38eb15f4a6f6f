"""Lines that many documents share: exact reference counts behind sharded cuckoo filters.

An index has two tables. ``counts`` holds in how many documents each line key
occurs, one row per key. ``shards`` holds, for every shard of the key space, a
cuckoo filter over the keys that have reached ``min_docs`` and these keys
themselves, sorted. Both can go back: deleting documents lowers the counts, and a
key that falls under ``min_docs`` leaves its filter, so inserting and deleting the
same documents gives the index that was there before.

A key is the line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z lower-cased;
tables hold its BLAKE2 digest of 128 bits. A document counts once however often it
has the line. Line keys merge in every task before they are shuffled, so a line
that all documents share costs a row per task.

To clean documents, their lines ask the filter, and only lines it lets through are
looked up among the shard's exact keys. If all shards together are small, which is
checked, every task gets them and no text moves. Otherwise (text, key) rows are dealt to
shards, a shard with many rows to several copies of itself as its counts demand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyframe.llm.cuckoo import CuckooFilter, Full, filter_of
from tallyframe.session import cut_lineage

KEY_BYTES = 16
SHARD_KEYS = 1 << 15
BROADCAST_BYTES = 32 << 20
ROWS_A_TASK = 1 << 17
BATCH_BYTES = 4 << 20
SHARD_FIELDS = "shard int, buckets int, filter binary, members binary"


@dataclass(frozen=True)
class LineIndex:
    """Reference counts and filters after some insertions and deletions."""

    counts: DataFrame  # key binary, docs bigint
    shards: DataFrame  # SHARD_FIELDS, only shards with members
    bits: int  # there are 2 ** bits shards
    min_docs: int
    min_chars: int


def empty_index(spark: SparkSession, min_docs: int = 10, min_chars: int = 1) -> LineIndex:
    """No documents yet. Keys shorter than ``min_chars`` code points, at least 1, are never counted."""
    if min_docs < 1 or min_chars < 1:
        raise ValueError("min_docs and min_chars must be at least 1")
    return LineIndex(spark.createDataFrame([], "key binary, docs bigint"), spark.createDataFrame([], SHARD_FIELDS), 0, min_docs, min_chars)


def line_key(line: bytes, min_chars: int = 1) -> bytes | None:
    """Digest of a line's key; None if the key is too short."""
    key = line.strip().lower()  # both know ASCII alone
    if len(key) < min_chars or (min_chars > 1 and len(key.decode("utf-8")) < min_chars):
        return None
    return hashlib.blake2b(key, digest_size=KEY_BYTES).digest()


def _halves(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(keys.tobytes(), dtype=">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 0], both[:, 1]


def _as_keys(found: Sequence[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(found), dtype=f"S{KEY_BYTES}")


def _shard_of(key: Column, bits: int) -> Column:
    first = F.conv(F.hex(F.substring(key, KEY_BYTES // 2 + 1, 4)), 16, 10).cast("bigint")
    return F.shiftrightunsigned(first, 32 - bits).cast("int")


def _shard_rows(keys: np.ndarray, bits: int) -> np.ndarray:
    return (_halves(keys)[1] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)


class Shard:
    """A filter with the exact keys behind it."""

    def __init__(self, buckets: int, table: bytes, members: bytes) -> None:
        self.filter = CuckooFilter(buckets, table)
        self.members = np.frombuffer(members, dtype=f"S{KEY_BYTES}")

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = self.filter.contains(*_halves(keys))
        asked = keys[out]
        at = np.minimum(np.searchsorted(self.members, asked), len(self.members) - 1)
        out[out] = self.members[at] == asked
        return out


def _line_keys(docs: DataFrame, text: str, min_chars: int, with_text: bool = False) -> DataFrame:
    """One row per text and distinct key, with the text's digest where asked for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = [], []

            def flush(keys=keys, texts=texts) -> pa.RecordBatch:
                columns = [pa.array(keys, pa.binary())] + ([pa.array(texts, pa.binary())] if with_text else [])
                names = ["key", "text_digest"][: len(columns)]
                return pa.RecordBatch.from_arrays(columns, names=names)

            for value in batch.column(0).cast(pa.large_binary()):
                whole = value.as_py() or b""
                own = {line_key(line, min_chars) for line in set(whole.split(b"\n"))} - {None}
                keys += own
                if with_text:
                    texts += [hashlib.sha256(whole).digest()] * len(own)
                if len(keys) * KEY_BYTES >= BATCH_BYTES:
                    yield flush()
                    keys.clear()
                    texts.clear()
            yield flush()

    return docs.select(docs[text]).mapInArrow(cut, "key binary, text_digest binary" if with_text else "key binary")


def _changed(index: LineIndex, docs: DataFrame, text: str, sign: int) -> LineIndex:
    zero = F.lit(0).cast("bigint")
    found = _line_keys(docs, text, index.min_chars).groupBy("key").agg((F.count("*") * sign).alias("more"))
    both = index.counts.select("key", F.col("docs").alias("was"), zero.alias("more")).unionByName(found.select("key", zero.alias("was"), "more"))
    merged = both.groupBy("key").agg(F.sum("was").alias("was"), F.sum(F.col("was") + F.col("more")).alias("docs"))
    checked = F.when(F.col("docs") < 0, F.raise_error(F.lit("a document was deleted that is not in the index"))).otherwise(F.col("docs"))
    merged = cut_lineage(merged.select("key", "was", checked.cast("bigint").alias("docs")))
    counts = merged.where("docs > 0").select("key", "docs")
    before, after = F.col("was") >= index.min_docs, F.col("docs") >= index.min_docs
    members = merged.where(after).count()
    bits = min(32, max(index.bits, int(np.ceil(np.log2(max(1, members / SHARD_KEYS))))))
    if bits > index.bits:
        shards = _built(counts.where(F.col("docs") >= index.min_docs).select("key"), bits)
    else:
        turned = merged.where(before != after).select("key", after.alias("enters"), _shard_of(F.col("key"), bits).alias("shard"))
        shards = _turned(index.shards, turned)
    return LineIndex(counts, cut_lineage(shards), bits, index.min_docs, index.min_chars)


def insert_documents(index: LineIndex, docs: DataFrame, text: str = "text") -> LineIndex:
    """The index with these documents too. Every row counts as a document; NULL texts count as empty."""
    return _changed(index, docs, text, 1)


def delete_documents(index: LineIndex, docs: DataFrame, text: str = "text") -> LineIndex:
    """The index without these documents, each of which must have been inserted; else the job fails."""
    return _changed(index, docs, text, -1)


def _row(shard: int, made: CuckooFilter, members: np.ndarray) -> pa.Table:
    values = [[shard], [made.buckets], [made.table()], [members.tobytes()]]
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table({n: pa.array(v, k) for n, v, k in zip(("shard", "buckets", "filter", "members"), values, kinds, strict=True)})


def _built(keys: DataFrame, bits: int) -> DataFrame:
    """Shards of all keys; a shard has about ``SHARD_KEYS`` of them."""

    def build(group: pa.Table) -> pa.Table:
        members = np.sort(_as_keys(group.column("key").to_pylist()))
        return _row(group.column("shard")[0].as_py(), filter_of(*_halves(members)), members)

    return keys.withColumn("shard", _shard_of(F.col("key"), bits)).groupBy("shard").applyInArrow(build, SHARD_FIELDS)


def _turned(shards: DataFrame, turned: DataFrame) -> DataFrame:
    """Shards after keys have entered or left; a filter that runs full is built anew from the exact keys."""

    def turn(old: pa.Table, new: pa.Table) -> pa.Table:
        keys = _as_keys(new.column("key").to_pylist())
        enters = np.array(new.column("enters").to_pylist(), dtype=bool)
        shard = (old if old.num_rows else new).column("shard")[0].as_py()
        if old.num_rows:
            held = CuckooFilter(old.column("buckets")[0].as_py(), old.column("filter")[0].as_py())
            members = np.frombuffer(old.column("members")[0].as_py(), dtype=f"S{KEY_BYTES}")
        else:
            held, members = filter_of(*_halves(keys[:0])), keys[:0]
        stay = members[~np.isin(members, keys[~enters])]
        now = np.sort(np.concatenate([stay, keys[enters]]))
        if not len(now):
            return _row(shard, held, now).slice(0, 0)
        try:
            held.delete(*_halves(keys[~enters]))
            held.insert(*_halves(keys[enters]))
        except Full:
            held = filter_of(*_halves(now), buckets=2 * held.buckets)
        return _row(shard, held, now)

    return shards.groupBy("shard").cogroup(turned.groupBy("shard")).applyInArrow(turn, SHARD_FIELDS)


def _cleaner(schema: StructType, names: list[str], lookup) -> object:
    """``lookup(batch, digests)`` says which digests of a batch's lines go, given per row."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size, rows = 0, 0, []

            def flush(last: int, batch=batch) -> pa.RecordBatch:
                kept = [batch.column(k).slice(first, last - first) for k in range(len(names))]
                n, dropped, rest = zip(*rows, strict=True)
                made = [pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(rest, pa.binary()).cast(pa.string())]
                return pa.RecordBatch.from_arrays([*kept, *made], names=schema.names)

            for k, value in enumerate(batch.column(len(names)).cast(pa.large_binary())):
                lines = (value.as_py() or b"").split(b"\n")
                gone = lookup(batch, k, lines)
                left = [line for line, out in zip(lines, gone, strict=True) if not out]
                rest = b"\n".join(left)
                rows.append((len(lines), len(lines) - len(left), rest))
                size += len(rest)
                if size >= BATCH_BYTES:
                    yield flush(k + 1)
                    first, size, rows = k + 1, 0, []
            if rows:
                yield flush(batch.num_rows)

    return clean


def cleaned_documents(index: LineIndex, docs: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id",), broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row: ``carry``, ``n_lines``, ``n_dropped`` and ``kept``, the text without its blocked lines.

    Lines end at ``\\n``. A NULL or empty text is one empty line, which is never
    blocked. Every row gives one row, also repeated rows and NULL ids; an empty
    table gives none; columns beside ``carry`` and ``text`` are not read. ``docs``
    need not be documents of the index. The result is the same on both sides of
    ``broadcast_bytes``, the most that all shards may take to be sent to every task.
    """
    names = list(carry)
    fields = [StructField(n, docs.schema[n].dataType) for n in names]
    schema = StructType([*fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept", StringType())])
    bits, min_chars = index.bits, index.min_chars
    size = index.shards.agg(F.sum(F.length("filter") + F.length("members"))).first()[0] or 0
    columns = [docs[n] for n in names]
    if size <= broadcast_bytes:
        sent = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in index.shards.collect()])
        opened: dict[int, Shard] = {}

        def among_all(batch: pa.RecordBatch, k: int, lines: list[bytes]) -> list[bool]:
            if not opened and sent.value:
                opened.update((shard, Shard(buckets, bytes(table), bytes(members))) for shard, buckets, table, members in sent.value)
            keys = [line_key(line, min_chars) for line in lines]
            own = list({key for key in keys if key})
            if not own or not opened:
                return [False] * len(lines)
            asked = _as_keys(own)
            places = _shard_rows(asked, bits)
            gone = set()
            for place in np.unique(places).tolist():
                if place in opened:
                    here = asked[places == place]
                    # S16 elements lose zero bytes at their end as Python objects
                    gone.update(bytes(x).ljust(KEY_BYTES, b"\0") for x in here[opened[place].holds(here)])
            return [key in gone for key in keys]

        return docs.select(*columns, docs[text]).mapInArrow(_cleaner(schema, names, among_all), schema)

    blocked = _blocked(index, docs, text).groupBy("text_digest").agg(F.collect_list("key").alias("_blocked"))
    digest = F.unhex(F.sha2(F.coalesce(docs[text], F.lit("")), 256))
    rows = docs.select(*[c.alias(f"_c{k}") for k, c in enumerate(columns)], docs[text].alias("_text"), digest.alias("text_digest"))
    joined = rows.join(blocked, "text_digest", "left").select(*[f"_c{k}" for k in range(len(names))], "_text", "_blocked")

    def own_list(batch: pa.RecordBatch, k: int, lines: list[bytes]) -> list[bool]:
        gone = set(batch.column(len(names) + 1)[k].as_py() or ())
        return [line_key(line, min_chars) in gone for line in lines] if gone else [False] * len(lines)

    return joined.mapInArrow(_cleaner(schema, names, own_list), schema)


def _blocked(index: LineIndex, docs: DataFrame, text: str) -> DataFrame:
    """``(text_digest, key)`` of blocked lines, through copies of shards as many as their rows need."""
    asked = _line_keys(docs, text, index.min_chars, with_text=True).distinct()
    asked = cut_lineage(asked.withColumn("shard", _shard_of(F.col("key"), index.bits)))
    load = asked.groupBy("shard").agg(F.ceil(F.count("*") / ROWS_A_TASK).cast("int").alias("copies"))
    load = cut_lineage(index.shards.select("shard").join(load, "shard"))
    copies = index.shards.join(load, "shard").select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    place = F.pmod(F.xxhash64("text_digest"), F.col("copies")).cast("int") + 1
    dealt = asked.join(load, "shard").select("text_digest", "key", F.col("shard").alias("to_shard"), place.alias("to_copy"))

    def ask(rows: pa.Table, shard: pa.Table) -> pa.Table:
        picked = rows.select(["text_digest", "key"])
        if not rows.num_rows or not shard.num_rows:
            return picked.slice(0, 0)
        held = Shard(*(shard.column(n)[0].as_py() for n in ("buckets", "filter", "members")))
        return picked.filter(pa.array(held.holds(_as_keys(picked.column("key").to_pylist()))))

    grouped = dealt.groupBy("to_shard", "to_copy").cogroup(copies.groupBy("shard", "copy"))
    return grouped.applyInArrow(ask, "text_digest binary, key binary")
