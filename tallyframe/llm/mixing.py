"""Mix sources to target weights by Efraimidis-Spirakis sampling.

Every document draws the key ``-ln(u) / w`` from a hash of its id and its
quality weight ``w``. A source whose target is ``e`` times its size and a rest
takes ``e`` complete epochs. The rest is filled in key order by the documents
whose running size comes nearest to it. Keys are cut into bins: bin totals show
the bin in which the rest ends, only the rows of that bin are sorted, and the
plan is one bound per source, which every document compares itself with.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.session import cut_lineage

MOST_TIMES = 3
BIN_ROWS = 4096  # rows of the largest source in a bin, on average
BLANK = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
SIGNS = "[^!-/:-@\\[-`{-~]+"


def word_count(text: Column) -> Column:
    """Runs of characters outside ``[\\x20\\x09-\\x0D]``; NULL has none."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, WORD, "x"), BLANK, "")), F.lit(0)).cast("bigint")


def quality_weight(text: Column) -> Column:
    """A weight from 0.1 to 1 that grows with the share of characters other than ASCII signs."""
    signs = F.length(F.regexp_replace(text, SIGNS, ""))
    return F.coalesce(F.lit(0.1) + F.lit(0.9) * (F.length(text) - signs) / F.when(F.length(text) > 0, F.length(text)), F.lit(0.1))


def draw(key: Column, weight: Column, seed: str) -> Column:
    """The sampling key of a document, the same on every run; smaller keys are taken first."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    uniform = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(uniform) / weight


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = MOST_TIMES) -> DataFrame:
    """``(source, source_size, target)`` from one row per source with its size.

    Sources in code point order, NULL last, weigh ``weights`` in turn and share
    the sum of all sizes; no target exceeds ``most`` times its source. In order
    of cap per weight, sources reach their caps until one stays below it; from
    there on all share what is left by weight. There is one row per source, so
    these windows need no partition.
    """
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_level = Window.orderBy("level", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    turn = ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn)).withColumn("cap", F.col("source_size") * most)
    ranked = ranked.withColumn("level", F.col("cap") / F.col("weight"))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_level), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_level), F.lit(0))
    ranked = ranked.withColumn("share", left / weight_left)
    full = F.col("level") <= F.col("share")
    share = F.min(F.when(~full, F.struct("level", "share"))).over(everything)["share"]
    return ranked.select("source", "source_size", F.when(full, F.col("cap").cast("double")).otherwise(F.col("weight") * share).alias("target"))


@dataclass(frozen=True)
class Mix:
    """Tables in the shared folder: a row per document without its text, a row per source."""

    documents: DataFrame  # doc, source, size, draw
    sources: DataFrame  # source, source_size, target, epochs, edge, bound
    bins: int
    seed: str

    def copies(self, draw: Column, key: Column, plan: Column) -> Column:
        """How often a document is taken under the plan of its source."""
        bin_ = _bin(draw, self.bins)
        mine = F.struct(draw.alias("draw"), key.alias("doc"))
        inside = (bin_ < plan["edge"]) | ((bin_ == plan["edge"]) & (plan["bound"].isNull() | (mine < plan["bound"])))
        return (plan["epochs"] + F.when(inside, 1).otherwise(0)).cast("bigint")


def _bin(draw: Column, bins: int) -> Column:
    """A bin that rises with the key; keys of documents of weight one fill all bins alike."""
    return F.floor((1 - F.exp(-draw)) * bins).cast("bigint")


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    seed: str = "mix",
    bin_rows: int = BIN_ROWS,
) -> Mix:
    """Measure all documents and find the epochs and the bound of each source."""
    text = F.col(text_col).cast("string")
    measured = docs.select(
        F.col(id_col).alias("doc"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), draw(F.col(id_col), quality_weight(text), seed).alias("draw")
    )
    documents = cut_lineage(measured)
    totals = cut_lineage(documents.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    bins = max(1, (totals.agg(F.max("n")).first()[0] or 0) // bin_rows)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    targets = source_targets(totals.select("source", "source_size"), weights).withColumn("epochs", epochs)
    targets = cut_lineage(targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))

    binned = documents.withColumn("bin", _bin(F.col("draw"), bins))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    per_bin = binned.groupBy("source", "bin").agg(F.sum("size").alias("in_bin"))
    per_bin = per_bin.withColumn("before", F.coalesce(F.sum("in_bin").over(upto), F.lit(0)))
    edges = _with_source(per_bin, targets.select("source", "rest"), ["bin", "in_bin", "before"], ["rest"])
    edges = cut_lineage(edges.where("before < rest and before + in_bin >= rest").select("source", "bin", "before", "rest"))
    inside = _with_source(binned, edges.withColumnRenamed("bin", "edge"), ["doc", "draw", "size", "bin"], ["edge", "before", "rest"]).where("bin = edge")
    # repeated rows have one key: they are taken or left together
    inside = inside.groupBy("source", "edge", "before", "rest", "draw", "doc").agg(F.sum("size").alias("size"))
    upto = Window.partitionBy("source").orderBy("draw", "doc").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("under", F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(upto), F.lit(0)))
    left_out = F.col("under") < F.col("size") / 2  # taking it would end further from the rest
    bounds = inside.groupBy("source").agg(F.first("edge").alias("edge"), F.min(F.when(left_out, F.struct("draw", "doc"))).alias("bound"))
    sources = _with_source(targets, bounds, ["source_size", "target", "epochs"], ["edge", "bound"], "left")
    return Mix(documents, cut_lineage(sources), bins, seed)


def _with_source(left: DataFrame, right: DataFrame, keep: Sequence[str], add: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on the source, where NULL is a source like others."""
    joined = left.alias("l").join(right.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source")), how)
    return joined.select("l.source", *[f"l.{c}" for c in keep], *[f"r.{c}" for c in add])


def mixed_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per document: ``doc_id, size, source, source_size, target, copies, taken``.

    A NULL text has no words; a NULL source is a source of its own; a NULL id
    draws like an empty one. A source without words has target 0. Repeated rows
    draw one key and are taken alike. An empty table gives no rows. Other
    columns are not read, whatever their names. Each source ends within half of
    its bounding document of its target (rows of one key count as one document).
    """
    mix = plan_mix(docs, id_col, text_col, source_col, **options)
    plans = mix.sources.withColumn("plan", F.struct("epochs", "edge", "bound"))
    rows = _with_source(mix.documents, plans, ["doc", "size", "draw"], ["source_size", "target", "plan"])
    rows = rows.withColumn("copies", mix.copies(F.col("draw"), F.col("doc"), F.col("plan")))
    return rows.select(F.col("doc").alias(id_col), "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix with their own columns, a row for each copy taken.

    Only the plan's row of the source is joined to the texts, so texts need no shuffle.
    """
    mix = plan_mix(docs, id_col, text_col, source_col, **options)
    plan = mix.sources.select(F.struct("epochs", "edge", "bound").alias("_plan"), F.col("source").alias("_source"))
    rows = docs.join(plan, F.col(source_col).cast("string").eqNullSafe(F.col("_source")))
    key = draw(F.col(id_col), quality_weight(F.col(text_col).cast("string")), mix.seed)
    rows = rows.withColumn("_times", mix.copies(key, F.col(id_col), F.col("_plan"))).where("_times > 0")
    return rows.withColumn("_times", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(*docs.columns)
