"""Files as bytes on executors: listings, digests and large JSON arrays read in parts.

Tasks open files through ``pyarrow.fs``, so a path may be local (``file:`` or plain) or
of any store that library knows. Nothing here holds a whole file.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.session import cut_lineage
from tallyframe.sources import folders

CHUNK = 8 << 20
SPLIT_BYTES = 32 << 20


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if local := re.match(r"(?:file:(?://)?)?(/.*)", path):
        return fs.LocalFileSystem(), local[1]
    return fs.FileSystem.from_uri(path)


def _named(path: str, root: str) -> str:
    """A path as the root names it, with its scheme."""
    scheme = re.match(r"[a-z][a-z0-9+.-]*:(?://[^/]*)?", root)
    return f"{scheme[0]}{path}" if scheme and not path.startswith(scheme[0]) else path


# -- listings ------------------------------------------------------------------------


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, size)`` of every file below a folder, files of no bytes too.

    Every folder directly below the root is listed by a task of its own kind of row,
    so the names of the files never pass through the driver. Hidden names, those that
    begin with a dot or an underscore, are left out, as Spark's readers do.
    """
    top = [(f"{root.rstrip('/')}/{n}",) for n in folders.names(spark, root) if n[0] not in "._"]
    rows = spark.createDataFrame(top, "root string")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in batch.column(0).to_pylist():
                store, path = _store(start)
                info = store.get_file_info(path)
                found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
                for at in range(0, len(found), 10_000):
                    files = [f for f in found[at : at + 10_000] if f.is_file and not re.search(r"/[._][^/]*$", f.path)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([_named(f.path, start) for f in files], pa.string()), pa.array([f.size for f in files], pa.int64())], names=["path", "size"]
                    )

    return rows.repartition("root").mapInArrow(walk, "path string, size long")


# -- digests -------------------------------------------------------------------------


def file_digests(files: DataFrame) -> DataFrame:
    """``(path, size, sha256)`` of the files in column ``path``, read in bounded pieces."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = _store(path)
                sha, size = hashlib.sha256(), 0
                with store.open_input_stream(place) as stream:
                    while piece := stream.read(CHUNK):
                        sha.update(piece)
                        size += len(piece)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([sha.hexdigest()])], names=["path", "size", "sha256"])

    return files.select("path").repartition("path").mapInArrow(digest, "path string, size long, sha256 string")


# -- JSON arrays ---------------------------------------------------------------------
#
# A part of a file does not know whether it begins inside a string, nor how deep. So a
# first pass counts, for each part, its quotes and what it adds to the depth in both
# cases; running sums over a file's parts, a few numbers each, tell every part where it
# stands. In the second pass a part yields the items whose leading bracket or comma lies
# in it.


def _plain(data: bytes) -> np.ndarray:
    """Bytes with escaped characters blanked, so that every quote left begins or ends a string."""
    return np.frombuffer(re.sub(rb"\\.", b"  ", data, flags=re.DOTALL), dtype=np.uint8)


def _marks(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where brackets and commas outside strings stand, and what each adds to the depth."""
    outside = (np.cumsum(data == 34) + inside) % 2 == 0
    opens = ((data == 91) | (data == 123)) & outside
    closes = ((data == 93) | (data == 125)) & outside
    at = np.flatnonzero(opens | closes | ((data == 44) & outside))
    return at, opens[at].astype(np.int64) - closes[at]


def _edges(data: bytes, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets after which an item of the array begins, and at which one ends."""
    at, step = _marks(_plain(data), inside)
    level = depth + np.cumsum(step)
    comma = (step == 0) & (level == 1)
    return at[comma | ((step == 1) & (level == 1))], at[comma | ((step == -1) & (level == 0))]


def _read_part(path: str, start: int, end: int) -> bytes:
    store, place = _store(path)
    with store.open_input_file(place) as file:
        file.seek(start)
        return file.read(end - start)


def _even_start(path: str, start: int, size: int) -> int:
    """The next offset not preceded by a backslash, so that no escape is cut."""
    while 0 < start < size and _read_part(path, start - 1, start) == b"\\":
        start += 1
    return start


def _parts(spark: SparkSession, path: str, split_bytes: int) -> DataFrame:
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"))
    last = F.floor((F.col("size") - 1) / split_bytes).cast("bigint")
    parts = sizes.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, part in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                start, end = (_even_start(name, min(p * split_bytes, size), size) for p in (part, part + 1))
                data = _plain(_read_part(name, start, end))
                delta = [int(_marks(data, inside)[1].sum()) for inside in (False, True)]
                row = (name, size, part, start, end, int((data == 34).sum()), *delta)
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["path", "size", "part", "start", "end", "quotes", "delta0", "delta1"])

    schema = "path string, size long, part long, start long, end long, quotes long, delta0 long, delta1 long"
    counted = cut_lineage(parts.repartition("path", "part").mapInArrow(count, schema))
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    staged = counted.withColumn("inside", inside).withColumn("delta", F.when(F.col("inside"), F.col("delta1")).otherwise(F.col("delta0")))
    return staged.withColumn("depth", F.coalesce(F.sum("delta").over(before), F.lit(0))).select("path", "size", "part", "start", "end", "inside", "depth")


def json_items(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(path, offset, item)``: the items of files that each hold one JSON array, as JSON text.

    Files are cut every ``split_bytes`` and an item belongs to the part in which the
    bracket or comma before it lies, so one large file is read by many tasks. ``path``
    is a folder or a file. A file that does not begin with ``[``, or ends before its
    array does, fails the job.
    """
    parts = cut_lineage(_parts(spark, path, split_bytes))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for name, size, part, start, end, inside, depth in zip(*columns, strict=True):
                data = _read_part(name, start, end)
                if part == 0 and not _read_part(name, 0, min(size, 4096)).lstrip(b"\xef\xbb\xbf \t\r\n").startswith(b"["):
                    raise ValueError(f"{name} holds no JSON array")
                first, last = _edges(data, inside, depth)
                if not len(first):
                    continue
                grown = end
                while not len(last) or last[-1] <= first[-1]:  # the last item ends in a later part
                    if grown >= size:
                        raise ValueError(f"{name} ends inside its array")
                    more = _even_start(name, min(grown + max(1 << 16, len(data)), size), size)
                    data += _read_part(name, grown, more)
                    grown = more
                    last = _edges(data, inside, depth)[1]
                ends = last[np.searchsorted(last, first, side="right")]
                items = [(a + 1 + start, data[a + 1 : b].strip()) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
                items = [(at, text.decode("utf-8")) for at, text in items if text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(items), pa.string()), pa.array([at for at, _ in items], pa.int64()), pa.array([t for _, t in items], pa.string())],
                    names=["path", "offset", "item"],
                )

    return parts.repartition("path", "part").mapInArrow(cut, "path string, offset long, item string")


def write_json_items(items: DataFrame, path: str) -> None:
    """JSON texts in column ``item`` as arrays, one file per task."""

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            rows = batch.column(0).to_pylist()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([lead + rows[0], *[f",{r}" for r in rows[1:]]])], names=["value"])
                lead = ","
        yield pa.RecordBatch.from_arrays([pa.array(["]" if lead == "," else "[]"])], names=["value"])

    items.select("item").mapInArrow(framed, "value string").write.mode("overwrite").text(path)


def write_json_arrays(df: DataFrame, path: str) -> None:
    """The rows as objects of JSON arrays, one file per task."""
    write_json_items(df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("item")), path)


# -- single files --------------------------------------------------------------------


def put_file(path: str, content: bytes) -> None:
    """Write one file and the folders above it; for use inside a task."""
    store, place = _store(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    with store.open_output_stream(place) as out:
        out.write(content)
