"""Exact Jaccard join on word shingles, reduced to links and components.

A pair with 100 * |x & y| >= percent * |x | y| shares a shingle among the first
``n - ceil(t n) + 1`` of each side in any common order. The order here is rare
first. Only those prefixes are shuffled.

1. ``shingle_table``: one pass gives each document's set size, a 128-bit key of
   its set, counts of its shingles by hash cell, and a fixed-size table of
   shingle counts over the whole corpus, by which prefixes are ordered.
2. ``prefix_links``: rows of a shingle's prefix list become stars. The smallest
   document of the list leads, every other row points to a leader. Lists are
   first reduced inside each task, so a frequent shingle brings one row a task.
3. Star links that pass the length, positional and suffix filters are verified.
4. In lists that still hold several components, members of the largest one lead
   once more, different ones in each list.
5. Lists that are mixed even then are joined with themselves; only pairs across
   components are candidates. All of them are verified, so each link between
   two components is found: components are exact, and the pairs inside a group
   of copies are never listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.llm.arrays import text_bytes
from tallyframe.llm.components import components
from tallyframe.llm.shingles import WIDTH, mix, shingle_sets
from tallyframe.session import cut_lineage, drop_tables

CELLS = 1 << 20  # counters of the corpus-wide shingle table
PART = 1 << 12  # counters in a row of that table
SUFFIX = 64  # hash cells of the suffix filter
CHUNK = 1 << 18  # prefix rows that a task reduces at once
GUIDED = (16,)  # leaders of a list in each round of step 4
CLOSEST = 2  # leaders that a document is compared with in a round of stars
BACK = 4  # earlier shared rows looked at to list a pair once
MAP_BITS = 1 << 25  # bits of the map of documents that take part in a candidate pair


def prefix_sizes(n: np.ndarray | int, percent: int) -> tuple:
    """Lengths of the probing and the indexing prefix of a set of ``n`` shingles."""
    return n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1


def _key(shingles: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def shingle_table(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Rows of documents (``part`` NULL) and of shingle counts (``part`` set)."""
    out = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("cells", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            sizes, keys, cells, pending, held = [], [], [], [], 0
            for _, one in shingle_sets(*text_bytes(batch.column(1)), width):
                sizes.append(len(one))
                keys.append(_key(one))
                cells.append(np.bincount((one >> np.uint64(58)).astype(np.int64), minlength=SUFFIX).astype(np.uint32).tobytes())
                pending.append(one)
                held += len(one)
                if held >= CELLS:
                    counts += np.bincount((np.concatenate(pending) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
                    pending, held = [], 0
            if pending:
                counts += np.bincount((np.concatenate(pending) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
            rows = len(sizes)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(cells, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())],
                    schema=out,
                )
        parts = [p for p in range(CELLS // PART) if counts[p * PART : (p + 1) * PART].any()]
        if parts:
            none = pa.nulls(len(parts), pa.int64())
            blobs = pa.array([counts[p * PART : (p + 1) * PART].tobytes() for p in parts], pa.binary())
            yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(parts), pa.binary()), pa.nulls(len(parts), pa.binary()), pa.array(parts, pa.int32()), blobs], schema=out)

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(scan, "doc bigint, n bigint, key binary, cells binary, part int, counts binary")


def corpus_counts(table: DataFrame) -> np.ndarray:
    """Add up the counts of all tasks, part by part; the result has CELLS counters at any input size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                more = np.frombuffer(blob.as_buffer(), dtype=np.int64)
                sums[part] = sums[part] + more if part in sums else more
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "counts"])

    parts = table.where("part is not null").select("part", "counts").repartition(16, "part").mapInArrow(add, "part int, counts binary")
    counts = np.zeros(CELLS, dtype=np.uint32)
    for row in parts.toLocalIterator():
        counts[row.part * PART : (row.part + 1) * PART] = np.minimum(np.frombuffer(row.counts, dtype=np.int64), 2**32 - 1)
    return counts


def prefix_links(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, counts: np.ndarray) -> DataFrame:
    """Rows ``(shingle, doc, n, pos, lead, lead_n, lead_pos)`` of every list with two documents or more.

    Each row but the leader's own is there once; ``pos`` counts from 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    row = pa.struct([("shingle", pa.int64()), ("doc", pa.int64()), ("place", pa.int64())])

    def reduce_lists(parts: list[tuple]) -> pa.RecordBatch:
        shingle, doc, place = (np.concatenate([p[k] for p in parts]) for k in range(3))
        order = np.lexsort((doc, place, shingle))
        shingle, doc, place = shingle[order], doc[order], place[order]
        first = np.concatenate([[True], shingle[1:] != shingle[:-1]])
        at = np.flatnonzero(first)[np.cumsum(first) - 1]
        # a row that has its leader here is dealt out by itself, and only leaders meet by shingle
        deal = np.where(first, shingle, mix(shingle.view(np.uint64) ^ mix(doc.view(np.uint64))).view(np.int64))
        lead = pa.StructArray.from_arrays([pa.array(shingle), pa.array(doc[at]), pa.array(place[at])], fields=list(row), mask=pa.array(first))
        return pa.RecordBatch.from_arrays([pa.array(deal), pa.array(doc), pa.array(place), lead], names=["deal", "doc", "place", "lead"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = shared.value
        parts, held, seen = [], 0, set()
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for at, one in shingle_sets(*text_bytes(batch.column(1)), width):
                if not len(one) or not known[at]:
                    continue
                key = _key(one)
                if key in seen:  # its equal is in this chunk already, and both have one key
                    continue
                seen.add(key)
                size = prefix_sizes(len(one), percent)[0]
                rare = np.argsort(frequency[(one & np.uint64(CELLS - 1)).astype(np.int64)], kind="stable")[:size]
                parts.append((one[rare].view(np.int64), np.full(size, ids[at], np.int64), (len(one) << 32) + np.arange(size, dtype=np.int64)))
                held += size
                if held >= CHUNK:
                    yield reduce_lists(parts)
                    parts, held, seen = [], 0, set()
        if parts:
            yield reduce_lists(parts)

    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(
        scan, "deal bigint, doc bigint, place bigint, lead struct<shingle: bigint, doc: bigint, place: bigint>"
    )
    # few and narrow columns: this is the one shuffle of all prefixes
    own = F.col("lead").isNotNull()
    top = F.first(F.struct("doc", "place")).over(Window.partitionBy("deal", own).orderBy("place", "doc"))
    rows = rows.withColumn("top", top).where(own | (F.col("top.doc") != F.col("doc")))
    chosen = lambda name: F.when(own, F.col(f"lead.{name}")).otherwise(F.col(f"top.{name}"))
    size, place = lambda c: F.shiftright(c, 32).cast("int"), lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    return rows.select(
        F.when(own, F.col("lead.shingle")).otherwise(F.col("deal")).alias("shingle"),
        "doc", size(F.col("place")).alias("n"), place(F.col("place")).alias("pos"),
        chosen("doc").alias("lead"), size(chosen("place")).alias("lead_n"), place(chosen("place")).alias("lead_pos"),
    )


def _needed(n: Column, m: Column, percent: int) -> Column:
    """The least number of common shingles that links sets of ``n`` and ``m``."""
    return F.ceil(percent * (n + m) / (100 + percent)).cast("bigint")


def _long_enough(n: Column, m: Column, percent: int) -> Column:
    return percent * F.greatest(n, m) <= 100 * F.least(n, m)


def candidate_sets(docs: DataFrame, id_col: str, text_col: str, width: int, pairs: DataFrame, short: bool = False) -> DataFrame:
    """``(doc, items)`` of at least the documents in ``pairs``; ``short`` keeps 16 bits of each shingle.

    A bit map of fixed size names those documents. It reads every row; where so
    many documents take part that the map is full, it lets more sets through.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    slots = pairs.select(F.explode(F.array("a", "b")).alias("doc")).select(slot("doc").alias("s"))
    words = slots.groupBy(F.shiftright("s", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 32 as int)))").alias("bits"))
    found = words.toArrow()
    bits = np.zeros(MAP_BITS // 32, dtype=np.uint32)
    bits[found.column("w").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column(2).to_numpy(zero_copy_only=False)
            named = (shared.value[slots >> 5] >> (slots & 31).astype(np.uint32)) & 1
            batch = batch.filter(pa.array(named.astype(bool)))
            if batch.num_rows:
                kept = [one for _, one in shingle_sets(*text_bytes(batch.column(1)), width)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([((one >> np.uint64(48)).astype(np.uint16) if short else one).tobytes() for one in kept], pa.large_binary()).cast(pa.binary())], names=["doc", "items"])

    source = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null")
    return source.withColumn("slot", slot("doc")).mapInArrow(scan, "doc bigint, items binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sets reach the similarity; each pair is looked at once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    left, right = sets.select(F.col("doc").alias("a"), F.col("items").alias("x")), sets.select(F.col("doc").alias("b"), F.col("items").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(scan, "u bigint, v bigint")


def _short_filter(pairs: DataFrame, short: DataFrame, percent: int) -> DataFrame:
    """Drop pairs whose shingles, cut to 16 bits, overlap too little; cut values can only overlap more.

    Far fewer bytes move than for whole shingles, and most pairs end here.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.bincount(np.frombuffer(v.as_buffer(), np.uint16), minlength=1 << 16) for v in (x, y))
                most = int(np.minimum(x, y).sum())
                good.append(100 * most >= percent * (int(x.sum()) + int(y.sum()) - most))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = short.select(F.col("doc").alias("a"), F.col("items").alias("x")), short.select(F.col("doc").alias("b"), F.col("items").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(scan, "a bigint, b bigint").distinct()


def _suffix_filter(pairs: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """Drop pairs whose counts by hash cell bound the overlap below what is needed."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, SUFFIX).astype(np.int64) for k in (2, 3))
            most = np.minimum(x, y).sum(axis=1)
            enough = 100 * most >= percent * (x.sum(axis=1) + y.sum(axis=1) - most)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(enough))

    cells = table.where("doc is not null and n > 0").select("doc", "cells")
    left, right = cells.select(F.col("doc").alias("a"), F.col("cells").alias("x")), cells.select(F.col("doc").alias("b"), F.col("cells").alias("y"))
    # a repeated id has several rows of counts; the pair stays if any of them allows it
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(scan, "a bigint, b bigint").distinct()


def _closest(rows: DataFrame) -> DataFrame:
    """The CLOSEST pairs of each ``b``, by lists shared, from a row for each shared list.

    What is left out here is not lost: it meets again across components.
    """
    shared = rows.groupBy("a", "b").agg(F.count("*").alias("lists"))
    ranked = F.sort_array(F.collect_list(F.struct("lists", "a")), asc=False)  # at most the lists of one document
    return shared.groupBy("b").agg(F.slice(ranked, 1, CLOSEST).alias("best")).select(F.explode("best.a").alias("a"), "b")


def _mixed_lists(members: DataFrame, label: DataFrame) -> DataFrame:
    """The prefix lists in which several components meet, with each row's component."""
    members = members.select("shingle", "doc", "n", "pos").join(label.withColumnRenamed("id", "doc"), "doc", "left")
    members = cut_lineage(members.withColumn("component", F.coalesce("component", "doc")))
    mixed = members.groupBy("shingle").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 != c1")
    mixed = cut_lineage(mixed.select("shingle"))
    found = cut_lineage(members.join(mixed, "shingle"))
    drop_tables(members, mixed)
    return found


def _guided_stars(members: DataFrame, percent: int, leaders: int) -> DataFrame:
    """Pairs of some members of each list's largest component and the rows outside that component.

    They differ from list to list, so a document beside a large group meets many
    of its members; most of what belongs together joins here, before pairs
    across components are listed.
    """
    sizes = members.select("doc", "component").distinct().groupBy("component").agg(F.count("*").alias("size"))
    sized = members.join(cut_lineage(sizes), "component")
    largest = sized.groupBy("shingle").agg(F.max(F.struct("size", "component"))["component"].alias("component"))
    inside = members.join(cut_lineage(largest), ["shingle", "component"])
    drawn = F.xxhash64("doc", "shingle")
    inside = inside.withColumn("h", drawn).groupBy("shingle", F.pmod("h", F.lit(leaders)).alias("part"))
    lead = inside.agg(F.max_by(F.struct("doc", "n", "pos", "component"), "h").alias("lead")).drop("part")
    rows = members.join(cut_lineage(lead), "shingle").where("component != lead.component")
    n, m = F.col("n"), F.col("lead.n")
    rows = rows.where(_long_enough(n, m, percent) & (F.least(n - F.col("pos"), m - F.col("lead.pos")) >= _needed(n, m, percent)))
    return rows.select(F.col("lead.doc").alias("a"), F.col("doc").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, width: int = WIDTH) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles`` and ``component_id``.

    Documents link when 100 * common shingles >= ``percent`` * shingles of
    either. Rows of one id count as one document. A NULL text is empty; a
    document without words links with nothing. A NULL id takes no part: its row
    has its own size and a NULL component. An empty table gives no rows. Other
    columns are not read, whatever their names.
    """
    scanned = cut_lineage(shingle_table(docs, id_col, text_col, width))
    counts = corpus_counts(scanned)
    table = cut_lineage(scanned.where("part is null").select("doc", "n", "key", "cells"))
    drop_tables(scanned)
    documents = table.select("doc", "n", "key")
    links = cut_lineage(prefix_links(docs, id_col, text_col, width, percent, counts))

    known = documents.where("n > 0 and doc is not null")
    classes = cut_lineage(known.groupBy("n", "key").agg(F.min("doc").alias("v"), F.max("doc").alias("top")).where("v != top").select("n", "key", "v"))
    same = known.join(classes, ["n", "key"]).where("doc != v").select(F.col("doc").alias("u"), "v").distinct()

    n, m = F.col("n"), F.col("lead_n")
    bound = F.least("pos", "lead_pos") + F.least(n - F.col("pos"), m - F.col("lead_pos"))
    stars = links.where(_long_enough(n, m, percent) & (bound >= _needed(n, m, percent)) & (F.col("doc") != F.col("lead")))
    stars = _closest(stars.select(F.col("lead").alias("a"), F.col("doc").alias("b")))
    first = cut_lineage(_suffix_filter(stars, table, percent))
    star_links = cut_lineage(_verified(first, candidate_sets(docs, id_col, text_col, width, first), percent).union(same))
    label = components(star_links)
    drop_tables(first, classes, star_links)

    # a leader may follow another one, and then has two equal rows
    members = links.select("shingle", "doc", "n", "pos").union(links.select("shingle", F.col("lead"), F.col("lead_n"), F.col("lead_pos")).distinct())
    members = _mixed_lists(members, label)
    drop_tables(links)
    for leaders in GUIDED:
        wide = cut_lineage(_suffix_filter(_guided_stars(members, percent, leaders), table, percent))
        near = cut_lineage(_short_filter(wide, candidate_sets(docs, id_col, text_col, width, wide, short=True), percent))
        drop_tables(wide)
        found = _verified(near, candidate_sets(docs, id_col, text_col, width, near), percent)
        last, label = label, components(found.union(label.select(F.col("id").alias("u"), F.col("component").alias("v"))))
        drop_tables(near, last)
        last, members = members, _mixed_lists(members, label)
        drop_tables(last)
    # a pair that shares one of the last few shared rows was listed there already
    ahead = Window.partitionBy("doc", "n").orderBy("pos", "shingle").rowsBetween(-BACK, -1)
    last, members = members, cut_lineage(members.withColumn("before", F.collect_list("shingle").over(ahead)))
    drop_tables(last)
    x, y = members.alias("x"), members.alias("y")
    xn, yn, xp, yp = F.col("x.n"), F.col("y.n"), F.col("x.pos"), F.col("y.pos")
    index = xn - F.ceil(2 * percent * xn / (100 + percent)) + 1
    across = x.join(y, F.col("x.shingle") == F.col("y.shingle")).where(
        (F.col("x.component") != F.col("y.component"))
        & (F.struct("x.n", "x.doc") < F.struct("y.n", "y.doc"))
        & (xp < index)
        & _long_enough(xn, yn, percent)
        & (F.least(xn - xp, yn - yp) >= _needed(xn, yn, percent))  # holds at the first shared row of a linked pair
        & ~F.arrays_overlap("x.before", "y.before")
    )
    pairs = across.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()
    wide = cut_lineage(_suffix_filter(pairs, table, percent))
    drop_tables(members)
    second = cut_lineage(_short_filter(wide, candidate_sets(docs, id_col, text_col, width, wide, short=True), percent))
    drop_tables(wide)
    more = _verified(second, candidate_sets(docs, id_col, text_col, width, second), percent)
    last, label = label, components(more.union(label.select(F.col("id").alias("u"), F.col("component").alias("v"))))
    drop_tables(second, last)
    out = documents.join(label.select(F.col("id").alias("doc"), "component"), "doc", "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))
