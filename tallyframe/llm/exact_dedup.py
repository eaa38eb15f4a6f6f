"""Groups of equal texts, owned by the terminal nodes of compressed radix tries.

Texts are equal when the same bytes remain after deleting ``[\\x20\\x09-\\x0D]``.

1. Every task inserts the full byte strings of its rows into a trie whose keys
   begin with content hash and length. A terminal node keeps the best owner and
   the number of rows, so a group of copies leaves a task as one row. When the
   trie outgrows its bound, its heaviest subtree goes to the shuffle; owners
   merge, so a text may leave a task in several parts.
2. The rows of one hash and length meet in one partition, sorted. A second trie
   merges them; a subtree left of the current key is finished and goes out.
3. Documents find their group by hash and length. Should different texts share
   both, the full text decides for these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.session import cut_lineage

BLANKS = b" \t\n\x0b\x0c\r"
TAILS = bytes(range(0x80, 0xC0))  # UTF-8 bytes that do not begin a code point
TRIE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
HASH_BYTES = 32


class Owner:
    """Best row of a text so far: most code points, then smallest id; NULL ids come last."""

    __slots__ = ("points", "doc", "rows", "owner_rows")

    def __init__(self, points: int, doc: int | None, rows: int, owner_rows: int) -> None:
        self.points, self.doc, self.rows, self.owner_rows = points, doc, rows, owner_rows

    def _rank(self) -> tuple:
        return -self.points, self.doc is None, self.doc or 0

    def merge(self, other: Owner) -> None:
        mine, theirs = self._rank(), other._rank()
        if mine == theirs:
            self.owner_rows += other.owner_rows
        elif theirs < mine:
            self.points, self.doc, self.owner_rows = other.points, other.doc, other.owner_rows
        self.rows += other.rows


class Node:
    __slots__ = ("label", "children", "owner")

    def __init__(self, label: bytes, owner: Owner | None = None) -> None:
        self.label, self.owner = label, owner
        self.children: dict[int, Node] = {}


class Trie:
    """A Patricia trie: every inner node branches or ends a key, and edges carry byte runs."""

    NODE_BYTES = 300  # a node beside its label

    def __init__(self) -> None:
        self.root = Node(b"")
        self.size = 0

    def insert(self, key: bytes, owner: Owner) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                if node.owner:
                    node.owner.merge(owner)
                else:
                    node.owner = owner
                return
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], owner)
                self.size += len(key) - at + self.NODE_BYTES
                return
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = _common(label, key, at)
            middle = Node(label[:same])
            child.label = label[same:]
            middle.children[child.label[0]] = child
            node.children[middle.label[0]] = middle
            self.size += self.NODE_BYTES
            node, at = middle, at + same

    def _walk(self, node: Node, prefix: bytes) -> Iterator[tuple[bytes, Owner]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            if node.owner:
                yield prefix, node.owner
            stack.extend((c, prefix + c.label) for _, c in sorted(node.children.items(), reverse=True))

    def _weight(self, node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            total += len(node.label) + self.NODE_BYTES
            stack.extend(node.children.values())
        return total

    def spill(self, most: int) -> Iterator[tuple[bytes, Owner]]:
        """Take the heaviest subtrees out until at most ``most`` bytes are left."""
        heavy = sorted(((self._weight(c), b) for b, c in self.root.children.items()), reverse=True)
        for weight, first in heavy:
            if self.size <= most:
                return
            child = self.root.children.pop(first)
            self.size -= weight
            yield from self._walk(child, child.label)

    def spill_before(self, key: bytes) -> Iterator[tuple[bytes, Owner]]:
        """Take out all subtrees that lie left of the path of ``key``."""
        node, prefix, at = self.root, b"", 0
        while at < len(key):
            for first in sorted(b for b in node.children if b < key[at]):
                child = node.children.pop(first)
                self.size -= self._weight(child)
                yield from self._walk(child, prefix + child.label)
            child = node.children.get(key[at])
            if child is None:
                return
            if not key.startswith(child.label, at):
                if child.label < key[at:]:
                    node.children.pop(key[at])
                    self.size -= self._weight(child)
                    yield from self._walk(child, prefix + child.label)
                return
            prefix, at, node = prefix + child.label, at + len(child.label), child

    def drain(self) -> Iterator[tuple[bytes, Owner]]:
        found, self.root, self.size = self.root, Node(b""), 0
        yield from self._walk(found, b"")


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common start of ``label`` and the rest of ``key``."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:  # halve: slices compare faster than single bytes
        middle = (low + high + 1) // 2
        if label[low:middle] == key[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def bare(text: bytes) -> bytes:
    return text.translate(None, BLANKS)


def content_hash(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def _texts(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


KEY = "hash binary, length bigint"
OWNER = "points bigint, doc bigint, n_rows bigint, owner_rows bigint"


def _batches(rows: Iterator[tuple[bytes, Owner]], with_text: bool) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size from trie keys and owners."""
    columns: list[list] = [[] for _ in range(7)]
    held = 0

    def batch() -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = ("hash", "length", "bare", "points", "doc", "n_rows", "owner_rows")
        found = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        return found if with_text else found.drop_columns(["bare"])

    for key, owner in rows:
        text = key[HASH_BYTES + 8 :]
        row = (key[:HASH_BYTES], int.from_bytes(key[HASH_BYTES : HASH_BYTES + 8], "big"), text if with_text else None, owner.points, owner.doc, owner.rows, owner.owner_rows)
        for column, value in zip(columns, row):
            column.append(value)
        held += len(text)
        if held >= BATCH_BYTES or len(columns[0]) >= 10_000:
            yield batch()
            columns, held = [[] for _ in range(7)], 0
    if columns[0]:
        yield batch()


def _key(text: bytes, digest) -> bytes:
    return digest(text) + len(text).to_bytes(8, "big") + text


def local_owners(docs: DataFrame, digest=content_hash, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """Owners of the texts inside each task, each with its text once or a few times."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[bytes, Owner]]:
            trie = Trie()
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                    trie.insert(_key(bare(text), digest), Owner(len(text.translate(None, TAILS)), doc, 1, 1))
                    if trie.size > trie_bytes:
                        yield from trie.spill(trie_bytes // 2)
            yield from trie.drain()

        yield from _batches(rows(), True)

    return docs.mapInArrow(scan, f"{KEY}, bare binary, {OWNER}")


def merged_owners(parts: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct text; ``kind`` tells texts of one hash and length apart."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[bytes, Owner]]:
            trie = Trie()
            for batch in batches:
                names = ("hash", "length", "bare", "points", "doc", "n_rows", "owner_rows")
                for digest, length, text, *owner in zip(*(batch.column(n).to_pylist() for n in names)):
                    start = digest + length.to_bytes(8, "big")
                    if trie.size > trie_bytes:
                        yield from trie.spill_before(start)
                    trie.insert(start + text, Owner(*owner))
            yield from trie.drain()

        last, kind, block = None, 0, []
        for key, owner in rows():
            start = key[: HASH_BYTES + 8]
            kind = kind + 1 if start == last else 0
            last = start
            block.append((start[:HASH_BYTES], int.from_bytes(start[HASH_BYTES:], "big"), kind, key[HASH_BYTES + 8 :] if kind else None, owner.points, owner.doc, owner.rows, owner.owner_rows))
            if len(block) >= 5_000:
                yield _rows(block)
                block = []
        if block:
            yield _rows(block)

    ordered = parts.repartition("hash", "length").sortWithinPartitions("hash", "length")
    return ordered.mapInArrow(scan, f"{KEY}, kind int, bare binary, {OWNER}")


def _rows(block: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = ("hash", "length", "kind", "bare", "points", "doc", "n_rows", "owner_rows")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*block), kinds)], names=names)


def document_keys(docs: DataFrame, digest=content_hash) -> DataFrame:
    """Hash and length of every row's text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(digest(b), len(b), hashlib.sha256(b).hexdigest(), len(t.translate(None, TAILS))) for t in _texts(batch.column(1)) for b in (bare(t),)]
            if found:
                columns = [pa.array(c, k) for c, k in zip(zip(*found), (pa.binary(), pa.int64(), pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc", "hash", "length", "text_sha256", "own_points"])

    return docs.mapInArrow(scan, f"doc bigint, {KEY}, text_sha256 string, own_points bigint")


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").cast("binary").alias("text"))


def text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=content_hash, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct text: key, owner and number of rows, kept in the shared folder."""
    parts = local_owners(_plain(docs, id_col, text_col), digest, trie_bytes)
    return cut_lineage(merged_owners(parts, trie_bytes))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=content_hash, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    NULL texts count as empty and form a group with texts of blanks. Of equal
    texts the row with the most code points stays, then the smallest id; a NULL
    id comes last. Of repeated rows that tie in both, one stays. An empty table
    gives no rows. Other columns are not read, whatever their names. ``digest``
    must give 32 bytes.
    """
    plain = _plain(docs, id_col, text_col)
    groups = text_groups(docs, id_col, text_col, digest, trie_bytes)
    best = groups.select("hash", "length", "kind", "bare", "points", F.col("doc").alias("keep_id"), F.col("n_rows").alias("group_size"), "owner_rows")
    clash = groups.where("kind > 0").select("hash", "length").distinct()
    keys = document_keys(plain, digest)
    if not clash.isEmpty():
        rows = keys.join(clash, ["hash", "length"], "left_anti").join(best, ["hash", "length"])
        alike = best.join(clash, ["hash", "length"]).where("kind > 0")
        texts = plain.select("doc", F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", "").alias("own"), F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).alias("own_points"))
        texts = texts.withColumns({"length": F.octet_length("own").cast("bigint"), "text_sha256": F.sha2(F.col("own").cast("binary"), 256), "own": F.col("own").cast("binary")})
        texts = texts.join(clash.select("length").distinct(), "length", "left_semi")
        later = texts.join(alike.withColumnRenamed("bare", "own"), ["length", "own"])
        # the first text of a clashing key is not carried along: its rows are those no later text claims
        first = keys.join(clash, ["hash", "length"]).join(later.select("text_sha256", "length").distinct(), ["text_sha256", "length"], "left_anti")
        first = first.join(best.where("kind = 0"), ["hash", "length"])
        shown = ["doc", "own_points", "text_sha256", "hash", "length", "kind", "points", "keep_id", "group_size", "owner_rows"]
        joined = rows.select(shown).union(later.select(shown)).union(first.select(shown))
    else:
        joined = keys.join(best, ["hash", "length"])
    kept = F.col("doc").eqNullSafe(F.col("keep_id")) & (F.col("own_points") == F.col("points"))
    joined = joined.withColumn("kept", kept)
    if not groups.where("owner_rows > 1").isEmpty():  # repeated rows: one of them stays
        nth = F.row_number().over(Window.partitionBy("hash", "length", "kind", "doc", "own_points").orderBy("text_sha256"))
        joined = joined.withColumn("kept", F.col("kept") & (nth == 1))
    return joined.select(F.col("doc").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; cases as in ``exact_groups``.

    Rows are matched with the owners by id, SHA-256 and code points.
    """
    groups = text_groups(docs, id_col, text_col, content_hash, trie_bytes)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.sha2(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "").cast("binary"), 256)
    rows = docs.withColumn("_own", F.struct(digest.alias("sha"), F.length(text).alias("points")))
    owners = groups.select(F.col("doc").alias("_id"), F.lower(F.hex("hash")).alias("_sha"), F.col("points").alias("_points"))
    fits = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_own.sha") == F.col("_sha")) & (F.col("_own.points") == F.col("_points"))
    rows = rows.join(owners, fits, "left_semi")
    if not groups.where("owner_rows > 1").isEmpty():  # repeated rows: one of them stays
        nth = F.row_number().over(Window.partitionBy(id_col, "_own").orderBy(text_col))
        rows = rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
    return rows.drop("_own")
