"""Document quality by similarity-weighted votes of labelled neighbours.

Texts become counts of terms: runs of character kinds (so ``Ab12##`` and
``Cd34##`` are alike), hashed words, and how often a word repeats the one
before it. A truncated singular value decomposition of the weighted counts of a
bounded labelled sample gives latent-semantic vectors. Their number and width
are parameters, so the broadcast has a fixed bound; every document of the table
is then compared with all of them, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.arrays import text_bytes
from tallyframe.llm.shingles import word_hashes

KINDS = 2048  # hashed runs of character kinds
WORDS = 1024  # hashed words
REPEATS = 8  # a word like the one k places before, k = 1 to 8
TERMS = KINDS + WORDS + REPEATS
RUN = 4  # character kinds in a term
BLOCK = 1 << 18  # bytes of text, and at most ROWS rows, counted at once
ROWS = 128

_KIND = np.zeros(256, dtype=np.int64)
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[9, 11, 12, 13, 32]] = 3
_KIND[10] = 4
for _k, _sign in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _KIND[ord(_sign)] = 5 + _k
_KIND[:9] = _KIND[14:32] = _KIND[127] = 37
_MERGED = np.array([k <= 3 for k in range(38)])  # runs of letters, digits or blanks count as one


def _mixed(codes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)


def term_counts(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(first row, last row, rows x TERMS counts)`` for runs of rows."""
    for a, b, words, per_row in word_hashes(raw, offsets, BLOCK):
        for low in range(a, b, ROWS):
            high = min(low + ROWS, b)
            skip, take = int(per_row[: low - a].sum()), int(per_row[low - a : high - a].sum())
            yield low, high, _block_counts(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], words[skip : skip + take], per_row[low - a : high - a])


def _block_counts(raw: np.ndarray, offsets: np.ndarray, words: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    counts = np.zeros(rows * TERMS, dtype=np.int64)
    for low in range(0, len(raw), 4 * BLOCK):  # a very long row is counted in parts that overlap by a run
        part = raw[max(0, low - 64) : low + 4 * BLOCK]
        owner = np.repeat(np.arange(rows), np.diff(offsets))[max(0, low - 64) : low + 4 * BLOCK] if rows > 1 else np.zeros(len(part), dtype=np.int64)
        kind = _KIND[part]
        keep = np.ones(len(kind), dtype=bool)
        keep[1:] = (kind[1:] != kind[:-1]) | ~_MERGED[kind[1:]] | (owner[1:] != owner[:-1])
        kind, owner = kind[keep], owner[keep]
        if len(kind) >= RUN:
            code = kind[: len(kind) - RUN + 1].copy()
            for k in range(1, RUN):
                code = code * 38 + kind[k : len(kind) - RUN + 1 + k]
            inside = owner[: len(code)] == owner[RUN - 1 :]
            slot = owner[: len(code)] * TERMS + (_mixed(code) % np.uint64(KINDS)).astype(np.int64)
            counts += np.bincount(slot[inside], minlength=len(counts))
    if len(words):
        owner = np.repeat(np.arange(rows), per_row)
        counts += np.bincount(owner * TERMS + KINDS + (words % np.uint64(WORDS)).astype(np.int64), minlength=len(counts))
        for k in range(1, REPEATS + 1):
            again = (words[k:] == words[:-k]) & (owner[k:] == owner[:-k])
            counts += np.bincount(owner[k:][again] * TERMS + KINDS + WORDS + k - 1, minlength=len(counts))
    return counts.reshape(rows, TERMS)


@dataclass(frozen=True)
class Model:
    """Term weights, the projection, and labelled unit vectors; all of bounded size."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int
    sharpness: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_unit(np.log1p(counts).astype(np.float32) * self.idf) @ self.basis)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Votes of the nearest labelled vectors, weighted by cosine; without any, the share of label 1."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        cosine = self.project(counts) @ self.vectors.T
        k = min(self.neighbours, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** self.sharpness
        total = weight.sum(axis=1)
        votes = (weight * self.labels[near]).sum(axis=1)
        return np.where(total > 0, votes / np.where(total > 0, total, 1), self.prior)


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def latent_basis(rows: np.ndarray, width: int, seed: int = 7, rounds: int = 4) -> np.ndarray:
    """Leading right singular vectors by subspace iteration."""
    width = min(width, *rows.shape)
    start = np.random.Generator(np.random.PCG64(seed)).standard_normal((rows.shape[1], width + 8)).astype(np.float32)
    basis = np.linalg.qr(start)[0]
    for _ in range(rounds):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    small = rows @ basis
    _, _, turn = np.linalg.svd(small, full_matrices=False)
    return (basis @ turn[:width].T).astype(np.float32)


def held_out(key: Column) -> Column:
    """Rows that only test: crc32 of the id as text leaves 1 when divided by 3. A NULL id is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    per_label: int = 2000,
    width: int = 48,
    neighbours: int = 15,
    sharpness: float = 8.0,
) -> Model:
    """Learn from at most ``per_label`` rows of each label outside the held-out third.

    The rows with the smallest hash of their id are taken. An id with
    contradictory labels, a NULL id and a NULL label are left out. Texts are
    counted by the executors; what reaches the driver is bounded by ``per_label``.
    """
    known = labels.select(F.col(id_col).alias("doc"), F.col(label_col).cast("int").alias("label")).where("doc is not null and label in (0, 1)")
    known = known.groupBy("doc").agg(F.min("label").alias("label"), F.max("label").alias("top")).where("label = top").drop("top")
    known = known.where(~held_out(F.col("doc")))
    prior = known.agg(F.avg("label")).first()[0]
    picked = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc"), "doc").limit(per_label) for v in (0, 1)]
    sample = F.broadcast(picked[0].union(picked[1]))  # at most twice per_label rows of two numbers
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).join(sample, "doc").select("doc", "label", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, counts = [], []
            for _, _, block in term_counts(*text_bytes(batch.column(2))):
                for row in block:
                    at = np.flatnonzero(row)
                    terms.append(at.astype(np.int32).tobytes())
                    counts.append(row[at].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], names=["doc", "label", "terms", "counts"])

    kind = rows.schema["doc"].dataType.simpleString()
    found = rows.mapInArrow(scan, f"doc {kind}, label int, terms binary, counts binary")
    found = found.groupBy("doc").agg(F.first("label").alias("label"), F.min(F.struct("terms", "counts")).alias("v")).select("doc", "label", "v.*")
    table = found.toArrow().sort_by("doc")
    size = table.num_rows
    counts = np.zeros((size, TERMS), dtype=np.float32)
    for k, (terms, values) in enumerate(zip(table.column("terms").to_pylist(), table.column("counts").to_pylist())):
        counts[k, np.frombuffer(terms, np.int32)] = np.frombuffer(values, np.float32)
    idf = (np.log((1 + size) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    weighted = _unit(np.log1p(counts) * idf)
    basis = latent_basis(weighted, width) if size else np.zeros((TERMS, 1), dtype=np.float32)
    vectors = _unit(weighted @ basis)
    return Model(idf, basis, vectors, table.column("label").to_numpy().astype(np.float64), 0.5 if prior is None else float(prior), neighbours, sharpness)


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with a score from 0 to 1; higher means label 1 is likelier.

    A NULL or empty text, or one without any known term, gets the share of
    label 1 among the labelled rows, and 0.5 where there are none. Repeated rows
    score alike. An input column named like the score is replaced. An empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    at = [c.lower() for c in kept].index(text_col.lower())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.scores(block) for _, _, block in term_counts(*text_bytes(batch.column(at)))]
            scores = np.concatenate(found) if found else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.clip(scores, 0, 1))], names=[*kept, name])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    return docs.select(*kept).mapInArrow(scan, ", ".join([*fields, f"`{name}` double"]))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; see ``fit`` and ``scored``."""
    model = fit(docs, labels, id_col, text_col, **options)
    rows = scored(docs.select(id_col, text_col), model, text_col)
    return rows.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
