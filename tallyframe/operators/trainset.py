"""Training sets: repetition, balancing, subsets and mixtures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions.numbers import hash_text
from tallyframe.functions.prompts import frame_labels, instruction, window_preamble
from tallyframe.operators.frames import window_indices
from tallyframe.operators.scale import first_by_hash, grouped_rank, hash_bucket, range_rank


def repeated(df: DataFrame, times: Column, name: str = "copy_no") -> DataFrame:
    """Every row as often as ``times`` says, numbered from one."""
    return df.select("*", F.explode(F.sequence(F.lit(1), times.cast("int"))).alias(name))


def training_rows(df: DataFrame, strategy: str = "direct", folder: str = "frames") -> DataFrame:
    """Instruction, preamble, frame labels and image paths of every question.

    Frame-track rows show one image; window tracks show the sampled window.
    """
    indices = window_indices(
        F.col("start_s"), F.col("end_s"), F.col("fps"), F.col("stride"), F.col("max_frames")
    )
    staged = df.withColumn("indices", indices)
    many = F.col("track") != "frame"
    stem = F.regexp_replace(F.col("video").cast("string"), r"(.)\.[^./]+$", "$1")
    return staged.select(
        "track",
        "dataset",
        "qid",
        instruction(F.col("question"), F.col("answer_format"), strategy).alias("instruction"),
        F.when(
            many,
            window_preamble(F.col("track"), F.col("start_s"), F.col("end_s"), F.size("indices")),
        ).alias("preamble"),
        F.when(many, frame_labels(F.col("indices"), F.col("fps"))).alias("frame_labels"),
        F.transform(
            F.when(many, F.col("indices")).otherwise(F.slice("indices", 1, 1)),
            lambda i: F.concat(F.lit(folder + "/"), stem, F.format_string("/frame%07d.jpg", i)),
        ).alias("image_paths"),
        F.col("answer").cast("string").alias("answer"),
        "max_pixels",
    )


def count_repetitions(
    df: DataFrame, power: float = 0.5, cap: int = 8, answer: str = "answer"
) -> DataFrame:
    """Copies of each integer answer of the number format, rarer answers more.

    The frequency table is one row per answer; its join is planned at run time
    and splits a frequent answer like any other hot key.
    """
    countable = (F.col("answer_format") == "number") & F.col(answer).rlike(r"^\d+$")
    tagged = df.withColumn("_count", F.when(countable, F.col(answer).try_cast("bigint")))
    freq = tagged.where(F.col("_count").isNotNull()).groupBy("_count").agg(F.count(F.lit(1)).alias("_freq"))
    top = freq.agg(F.max("_freq")).scalar()
    copies = F.rint(F.pow(top / F.col("_freq"), F.lit(power)))
    reps = freq.select(
        "_count", F.least(F.lit(cap), F.greatest(F.lit(1), copies)).cast("int").alias("reps")
    )
    return tagged.join(reps, "_count", "left").withColumn("reps", F.coalesce("reps", F.lit(1))).drop("_count")


def balanced(df: DataFrame, power: float = 0.5, cap: int = 8) -> DataFrame:
    """The balanced set itself."""
    return repeated(count_repetitions(df, power, cap), F.col("reps"))


def count_distribution(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Examples per integer answer."""
    return (
        df.where((F.col("answer_format") == "number") & F.col(answer).rlike(r"^\d+$"))
        .groupBy(F.col(answer).cast("bigint").alias("count"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def first_rows(df: DataFrame, keys: Sequence[str], ordinal: str, limit: int) -> DataFrame:
    """The first rows of each group in input order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal))  # each task keeps its first rows only
    return df.withColumn("_r", place).where(F.col("_r") <= limit).drop("_r")


def seeded_subset(df: DataFrame, rows: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """A uniform subset of ``rows`` rows; the same rows on every run."""
    return first_by_hash(df, [], hash_text(seed, *[F.col(k) for k in key]), rows)


def stratified_subset(
    df: DataFrame, strata: Sequence[str], limit: int, key: Sequence[str], axis: str = "dataset", seed: int = 42
) -> DataFrame:
    """Every stratum keeps its share, and at least one row.

    The fraction is the limit per dataset over all rows, at most one.
    """
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    share = sizes.agg(
        F.least(F.lit(1.0), F.lit(limit) * F.count_distinct(axis) / F.sum("_n"))
    ).scalar()
    quota = sizes.select(
        *strata, F.greatest(F.lit(1), F.rint(F.col("_n") * share)).cast("bigint").alias("_quota")
    )
    digest = hash_text(seed, *[F.col(k) for k in key])
    most = quota.agg(F.max("_quota")).first()[0] or 0  # ranges behind the largest quota are not read again
    ranked = range_rank(df.withColumn("_d", digest), strata, [F.col("_d")], "_r", limit=most)
    return ranked.join(quota, list(strata)).where(F.col("_r") <= F.col("_quota")).drop("_d", "_r", "_quota")


def affected_and_controls(
    df: DataFrame, affected: Column, strata: Sequence[str], image: str, per_stratum: int, key: str, seed: int = 42
) -> DataFrame:
    """All affected rows plus control rows on images of their own.

    Every image goes to one unaffected row, the first by hash over all strata,
    so no image serves two controls. A stratum with fewer images gives fewer
    rows; ``short_strata`` lists these.
    """
    tagged = df.withColumn("_affected", affected)
    hit = tagged.where("_affected").withColumn("selection_group", F.lit("affected_full"))
    digest = hash_text(seed, F.col(key))
    others = tagged.where("NOT _affected").withColumn("_d", digest)
    owner = others.groupBy(image).agg(F.min("_d").alias("_d"))
    pool = others.join(owner, [image, "_d"])
    controls = first_by_hash(pool, strata, F.col("_d"), per_stratum).drop("_d")
    return hit.unionByName(
        controls.withColumn("selection_group", F.lit("control_sample"))
    ).drop("_affected")


def short_strata(selected: DataFrame, df: DataFrame, affected: Column, strata: Sequence[str], per_stratum: int) -> DataFrame:
    """Strata of unaffected rows that got fewer controls than asked for."""
    asked = df.where(~affected).groupBy(*strata).agg(F.count(F.lit(1)).alias("rows"))
    got = selected.where(F.col("selection_group") == "control_sample").groupBy(*strata).agg(F.count(F.lit(1)).alias("controls"))
    out = asked.join(got, list(strata), "left").withColumn("controls", F.coalesce("controls", F.lit(0)))
    return out.where(F.col("controls") < per_stratum)


def dense_index(df: DataFrame, order: Sequence[Column], name: str = "selection_index") -> DataFrame:
    """0-based position in the given order, without one global sort task."""
    return range_rank(df, [], order, "_r").withColumn(name, F.col("_r") - 1).drop("_r")


def shuffled(df: DataFrame, key: Sequence[str], seed: int = 42, name: str = "position") -> DataFrame:
    """Seeded order of the training set as a position column."""
    digest = hash_text(seed, *[F.col(k) for k in key])
    return dense_index(df.withColumn("_d", digest), [F.col("_d")], name).drop("_d")


def rebalanced(
    df: DataFrame,
    totals: dict[str, int],
    holdout: int,
    key: Sequence[str],
    seed: int = 42,
) -> DataFrame:
    """Mixture in which a group's share follows the square root of its natural share.

    The holdout leaves first. Of the rest, each row gets ``quota div size``
    copies and the first rows by hash one more; ``copy_no`` above one asks the
    frame plan for another phase.
    """
    strata = ["track", "group_code"]
    digest = hash_text(seed, *[F.col(k) for k in key])
    ranked = grouped_rank(
        df.withColumn("_d", digest), strata, hash_bucket(F.col("_d")), [F.col("_d")], "_r", "_n"
    ).drop("_d")
    held = ranked.where(F.col("_r") <= holdout).select(
        *df.columns, F.lit("holdout").alias("part"), F.lit(1).alias("copy_no")
    )
    # stratum sizes follow from the ranks already computed
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n")).withColumn("root", F.sqrt(F.col("n").cast("double")))
    roots = sizes.groupBy("track").agg(F.sum("root").alias("roots"))
    wanted = F.lit(None).cast("int")
    for track, total in totals.items():
        wanted = F.when(F.col("track") == track, total).otherwise(wanted)
    quota = sizes.join(roots, "track").select(
        *strata, F.rint(wanted * F.col("root") / F.col("roots")).cast("bigint").alias("_quota")
    )
    rest = ranked.where(F.col("_r") > holdout).join(quota, strata)
    size, place = F.col("_n") - holdout, F.col("_r") - holdout
    copies = F.floor(F.col("_quota") / size) + F.when(place <= F.col("_quota") % size, 1).otherwise(0)
    train = (
        rest.withColumn("_copies", copies.cast("int"))
        .where(F.col("_copies") > 0)
        .select(*df.columns, F.lit("train").alias("part"), F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy_no"))
    )
    return held.unionByName(train)
