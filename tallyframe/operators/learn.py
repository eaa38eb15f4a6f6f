"""Count classifier on cached vectors, cross-fitted by video, on Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.labels import clamp_count
from tallyframe.operators.counting import video_folds
from tallyframe.session import cut_lineage
from tallyframe.taxonomy import MIN_COUNT


def soft_target_rows(df: DataFrame, low: int, high: int, eps: float, target: str = "target") -> DataFrame:
    """Each example as weighted rows: most mass on its count, ``eps`` on the neighbours."""
    y = F.least(F.greatest(F.col(target), F.lit(low)), F.lit(high))
    has_low, has_high = (y > low).cast("int"), (y < high).cast("int")
    sides = has_low + has_high
    share = F.lit(eps) / F.greatest(sides, F.lit(1))
    rows = F.array(
        F.struct((y - low).cast("double").alias("label"), (1 - eps * (sides > 0).cast("double")).alias("weight")),
        F.struct((y - 1 - low).cast("double").alias("label"), (share * has_low).alias("weight")),
        F.struct((y + 1 - low).cast("double").alias("label"), (share * has_high).alias("weight")),
    )
    return df.select("*", F.inline(rows)).where(F.col("weight") > 0)


def cross_fit(
    df: DataFrame,
    low: int,
    high: int,
    folds: int = 5,
    eps: float = 0.1,
    seed: int = 42,
    max_iter: int = 20,
    reg: float = 0.01,
) -> DataFrame:
    """Held-out prediction for every row; scaler and model see the other folds only.

    Needs ``qid, video, X, target``. One fit per fold; each fit is distributed.
    """
    data = df.join(video_folds(df, folds, seed), "video")
    data = cut_lineage(data.select("qid", "video", "fold", "target", "X")).withColumn("raw", array_to_vector(F.col("X")))
    parts = []
    for fold in range(folds):
        fit, held = data.where(F.col("fold") != fold), data.where(F.col("fold") == fold)
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(fit)
        rows = soft_target_rows(scaler.transform(fit), low, high, eps)
        model = LogisticRegression(
            featuresCol="features", labelCol="label", weightCol="weight", maxIter=max_iter, regParam=reg
        ).fit(rows)
        predicted = model.transform(scaler.transform(held))
        parts.append(
            predicted.select(
                "qid", "video", "fold", "target", (F.col("prediction").cast("int") + low).alias("head")
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def report(df: DataFrame, pred: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Exact, near, error and undercount of a count column."""
    p, t = F.col(pred), F.col("target")

    def rate(hit: Column) -> Column:
        return F.avg(hit.cast("double"))

    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        rate(p == t).alias("exact"),
        rate(F.abs(p - t) <= 1).alias("within_1"),
        F.avg(F.abs(p - t)).alias("mae"),
        F.avg(p).alias("mean_pred"),
        F.avg(t).alias("mean_true"),
        F.max(p).alias("max_pred"),
        rate(p < t).alias("undercount"),
    )


def _clamped() -> Column:
    """The baseline inside the range of its template; an unreadable answer is the lowest count."""
    read = F.col("baseline").isNotNull()
    return F.when(read, clamp_count(F.col("baseline"), F.col("template_id"))).otherwise(F.lit(MIN_COUNT))


def fold_baselines(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Per fold and template what a trained head is measured against: truth and the model's own counts.

    Needs ``video, template_id, target, baseline``; a NULL baseline is an unreadable
    answer, which counts as 0 raw and as the lowest count when clamped.
    """
    raw = F.coalesce("baseline", F.lit(0))
    clamped = _clamped()
    t = F.col("target")
    cells = df.withColumns({"_raw": raw, "_clamped": clamped}).groupBy("video", "template_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("target").alias("truth"),
        F.max("target").alias("max_true"),
        F.count_if(F.col("baseline").isNull()).alias("unreadable"),
        F.count_if(F.col("_raw") == t).alias("raw"),
        F.count_if(F.col("_clamped") == t).alias("clamped"),
        F.sum(F.abs(F.col("_clamped") - t)).alias("error"),
    )
    out = cells.join(folds, "video").groupBy("fold", "template_id").agg(
        *[F.sum(c).alias(c) for c in ("n", "unreadable", "raw", "clamped", "truth", "error")], F.max("max_true").alias("max_true")
    )
    n = F.col("n")
    return out.select(
        "fold", "template_id", "n", "unreadable", "max_true", (F.col("truth") / n).alias("mean_true"), (F.col("raw") / n).alias("baseline_raw"),
        (F.col("clamped") / n).alias("baseline_clamped"), (F.col("error") / n).alias("baseline_mae"),
    )


def against_baseline(predicted: DataFrame, df: DataFrame) -> DataFrame:
    """Exact rates of the trained ``head`` and of the clamped baseline on the same rows, per template and in all."""
    both = predicted.select("qid", "head").join(df, "qid")
    clamped = _clamped()
    rows = both.withColumns({"_base": (clamped == F.col("target")).cast("double"), "_head": (F.col("head") == F.col("target")).cast("double")})
    out = rows.rollup("template_id").agg(F.count(F.lit(1)).alias("n"), F.avg("_base").alias("baseline"), F.avg("_head").alias("head"))
    return out.withColumn("head_minus_baseline", F.col("head") - F.col("baseline"))
