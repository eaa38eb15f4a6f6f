"""Diagnostics per answer format: times, numbers, class sets, choices, counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions import text
from tallyframe.operators.metrics import metrics_of, video_cells
from tallyframe.operators.scale import weighted_quantiles
from tallyframe.taxonomy import CLASS_NAMES


def _scoped(df: DataFrame, scopes: Mapping[str, Column]) -> DataFrame:
    """One copy of each row per scope it belongs to; a NULL name leaves the scope out."""
    tags = F.array(
        *[F.struct(F.lit(s).alias("scope"), c.cast("string").alias("name")) for s, c in scopes.items()]
    )
    return df.select("*", F.inline(tags)).where(F.col("name").isNotNull())


def _with_points(rows: DataFrame, keys: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """Point metrics plus summed columns, both over (keys, video) cells."""
    return metrics_of(video_cells(rows, keys, extra=sums), keys, list(sums))


def _error_quantiles(
    rows: DataFrame, keys: Sequence[str], error: str, wanted: Mapping[str, float]
) -> DataFrame:
    counted = rows.groupBy(*keys, error).agg(F.count(F.lit(1)).alias("_n"))
    return weighted_quantiles(counted, keys, error, "_n", wanted)


def time_diagnostics(df: DataFrame, limits: Sequence[int] = (5, 30, 60, 300)) -> DataFrame:
    """Cardinality and error of timestamp answers, for all, leaf and gold cardinality."""
    rows = (
        df.where(F.col("answer_format") == "time")
        .select(
            "dataset",
            "video",
            "correct",
            "capability_code",
            text.timestamps(F.col("answer")).alias("gold"),
            text.timestamps(F.col("prediction")).alias("pred"),
            text.timestamps(F.coalesce("raw_model_output", F.lit(""))).alias("raw"),
        )
        .select(
            "dataset",
            "video",
            "correct",
            "capability_code",
            F.size("gold").alias("ng"),
            F.size("pred").alias("np"),
            F.size("raw").alias("nr"),
            F.when(
                (F.size("gold") == 1) & (F.size("pred") == 1),
                F.abs(F.get("gold", F.lit(0)) - F.get("pred", F.lit(0))).cast("double"),
            ).alias("err"),
        )
    )
    scoped = _scoped(
        rows,
        {
            "dataset": F.lit("all_time"),
            "primary_capability": F.col("capability_code"),
            "gold_cardinality": F.when(F.col("ng") > 1, "multiple").otherwise("single"),
        },
    )
    keys = ["dataset", "scope", "name"]
    sums = {
        "gold_multi_timestamp_rows": F.count_if(F.col("ng") > 1),
        "raw_multi_timestamp_rows": F.count_if(F.col("nr") > 1),
        "normalized_multi_timestamp_rows": F.count_if(F.col("np") > 1),
        "_raw_match": F.count_if(F.col("nr") == F.col("ng")),
        "_norm_match": F.count_if(F.col("np") == F.col("ng")),
        "single_gold_rows": F.count_if(F.col("ng") == 1),
        "single_gold_with_parsed_prediction_rows": F.count("err"),
        **{f"_within_{s}": F.count_if(F.col("err") <= s) for s in limits},
    }
    out = _with_points(scoped, keys, sums)
    both = F.col("single_gold_with_parsed_prediction_rows")
    for s in limits:
        out = out.withColumn(
            f"single_gold_within_{s}_sec_rate", F.when(both > 0, F.col(f"_within_{s}") / both)
        ).drop(f"_within_{s}")
    out = (
        out.withColumn("raw_cardinality_match_rate", F.col("_raw_match") / F.col("rows"))
        .withColumn("normalized_cardinality_match_rate", F.col("_norm_match") / F.col("rows"))
        .drop("_raw_match", "_norm_match")
    )
    spread = _error_quantiles(
        scoped,
        keys,
        "err",
        {"single_gold_median_absolute_error_sec": 0.5, "single_gold_p90_absolute_error_sec": 0.9},
    )
    return out.join(spread, keys, "left")


def numeric_diagnostics(df: DataFrame) -> DataFrame:
    """Error of number and percentage answers, for all, leaf and gold bucket."""
    rows = (
        df.where(F.col("answer_format").isin("number", "percentage"))
        .select(
            "dataset",
            "answer_format",
            "video",
            "correct",
            "capability_code",
            text.first_number(F.col("answer")).alias("gold0"),
            text.first_number(F.col("prediction")).alias("pred0"),
        )
        .withColumn("both", F.col("gold0").isNotNull() & F.col("pred0").isNotNull())
        .withColumn("gold", F.when(F.col("both"), F.col("gold0")))
        .withColumn("pred", F.when(F.col("both"), F.col("pred0")))
        .withColumn("err", F.col("pred") - F.col("gold"))
        .withColumn("abs_err", F.abs("err"))
    )
    scoped = _scoped(
        rows,
        {
            "dataset": F.lit("all"),
            "primary_capability": F.col("capability_code"),
            "gold_value_bucket": F.when(
                F.col("answer_format") == "number", text.count_bucket(F.col("gold0"))
            ),
        },
    )
    keys = ["dataset", "answer_format", "scope", "name"]
    sums = {
        "parsed_rows": F.count("err"),
        "_gold": F.coalesce(F.sum("gold"), F.lit(0.0)),
        "_pred": F.coalesce(F.sum("pred"), F.lit(0.0)),
        "_abs": F.coalesce(F.sum("abs_err"), F.lit(0.0)),
        "_under": F.count_if(F.col("err") < 0),
        "_exact": F.count_if(F.col("err") == 0),
        "_over": F.count_if(F.col("err") > 0),
    }
    out = _with_points(scoped, keys, sums)
    n = F.col("parsed_rows")
    for name, source in (
        ("gold_mean", "_gold"),
        ("prediction_mean", "_pred"),
        ("mean_absolute_error", "_abs"),
        ("undercount_rate", "_under"),
        ("exact_numeric_rate", "_exact"),
        ("overcount_rate", "_over"),
    ):
        out = out.withColumn(name, F.when(n > 0, F.col(source) / n)).drop(source)
    spread = _error_quantiles(scoped, keys, "abs_err", {"median_absolute_error": 0.5})
    return out.join(spread, keys, "left")


def _set_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("answer_format") == "fo_class").select(
        "dataset",
        "video",
        "correct",
        text.answer_set(F.col("answer")).alias("gold"),
        text.answer_set(F.col("prediction")).alias("pred"),
    )


def set_diagnostics(df: DataFrame) -> DataFrame:
    """Cardinality match and mean set precision and recall, by gold cardinality."""
    rows = _set_rows(df).select(
        "dataset",
        "video",
        "correct",
        F.size("gold").alias("ng"),
        F.size("pred").alias("np"),
        text.set_precision(F.col("gold"), F.col("pred")).alias("precision"),
        text.set_recall(F.col("gold"), F.col("pred")).alias("recall"),
    )
    kind = F.when(F.col("ng") == 0, "none").when(F.col("ng") == 1, "single").otherwise("multiple")
    scoped = _scoped(rows, {"dataset": F.lit("all_fo_class"), "gold_cardinality": kind})
    keys = ["dataset", "scope", "name"]
    sums = {
        "_match": F.count_if(F.col("ng") == F.col("np")),
        "_precision": F.sum("precision"),
        "_recall": F.sum("recall"),
    }
    out = _with_points(scoped, keys, sums)
    for name, source in (
        ("cardinality_match_rate", "_match"),
        ("mean_set_precision", "_precision"),
        ("mean_set_recall", "_recall"),
    ):
        out = out.withColumn(name, F.col(source) / F.col("rows")).drop(source)
    return out


def label_diagnostics(df: DataFrame) -> DataFrame:
    """Support, hits, recall and precision per label over gold and predicted labels.

    Each row yields its own labels only, flagged by side, so one aggregation
    replaces the outer join of two exploded tables.
    """
    rows = _set_rows(df)
    labels = rows.select(
        "dataset",
        "correct",
        "gold",
        "pred",
        F.explode(F.array_union("gold", "pred")).alias("label"),
    ).select(
        "dataset",
        "label",
        "correct",
        F.array_contains("gold", F.col("label")).alias("g"),
        F.array_contains("pred", F.col("label")).alias("p"),
    )
    out = labels.groupBy("dataset", "label").agg(
        F.count_if("g").alias("gold_support_rows"),
        F.count_if("p").alias("predicted_positive_rows"),
        F.count_if(F.col("g") & F.col("p")).alias("true_positive_rows"),
        F.avg(F.when(F.col("g"), F.col("correct").cast("double"))).alias(
            "exact_row_accuracy_on_gold_positive_rows"
        ),
    )
    hits = F.col("true_positive_rows")
    return out.withColumn(
        "label_recall", F.when(F.col("gold_support_rows") > 0, hits / F.col("gold_support_rows"))
    ).withColumn(
        "label_precision",
        F.when(F.col("predicted_positive_rows") > 0, hits / F.col("predicted_positive_rows")),
    )


def categorical_diagnostics(df: DataFrame) -> DataFrame:
    """Yes/no answers by gold value, choices by single or multi select."""
    subtype = F.when(F.col("answer_format") == "binary", "gold_value").when(
        F.col("answer_format") == "multiple_choice", "selection_type"
    )
    value = F.when(
        F.col("answer_format") == "binary", F.lower(F.trim("answer"))
    ).otherwise(F.when(text.is_multi_select(F.col("question")), "multi_select").otherwise("single_select"))
    rows = df.where(F.col("answer_format").isin("binary", "multiple_choice")).withColumns(
        {"subtype": subtype, "value": value}
    )
    keys = ["dataset", "answer_format", "subtype", "value"]
    return metrics_of(video_cells(rows, keys), keys)


def cardinality_audit(df: DataFrame, names: Sequence[str] = CLASS_NAMES) -> DataFrame:
    """How many values gold, raw and normalised answers hold, and what normalising loses."""
    multi = (F.col("answer_format") == "multiple_choice") & text.is_multi_select(F.col("question"))
    rows = df.where(F.col("answer_format").isin("fo_class", "time") | multi)

    def held(column: str) -> Column:
        return F.size(
            text.recognised_values(
                F.col("answer_format"), F.coalesce(column, F.lit("")), F.col("question"), names
            )
        )

    sized = rows.select(
        "dataset",
        F.when(F.col("answer_format") == "multiple_choice", "multiple_choice_multi_select")
        .otherwise(F.col("answer_format"))
        .alias("answer_format"),
        F.col("correct").cast("int").alias("correct"),
        held("answer").alias("g"),
        held("raw_model_output").alias("r"),
        held("prediction").alias("p"),
    )
    same = F.count_if(F.col("p") == F.col("g"))
    return sized.groupBy("dataset", "answer_format").agg(
        F.count(F.lit(1)).alias("eligible_rows"),
        F.count_if(F.col("g") > 1).alias("gold_multi_rows"),
        F.count_if(F.col("r") > 1).alias("raw_multi_rows"),
        F.count_if(F.col("p") > 1).alias("normalized_multi_rows"),
        F.count_if((F.col("r") > 1) & (F.col("p") <= 1)).alias("raw_to_normalized_multi_rows_lost"),
        same.alias("normalized_cardinality_match_rows"),
        (same / F.count(F.lit(1))).alias("normalized_cardinality_match_rate"),
        F.sum("correct").alias("correct_rows"),
    )


def counting_by_truth(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, size and mean signed error by true count."""
    return (
        df.where(F.col("gold").isNotNull())
        .groupBy(*keys, "gold")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.col("correct").cast("double")).alias("accuracy"),
            F.avg(F.col("pred") - F.col("gold")).alias("mean_signed_error"),
        )
    )


def counting_summary(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    near = F.coalesce(F.abs(F.col("pred") - F.col("gold")) <= 1, F.lit(False))
    return (
        df.where(F.col("gold").isNotNull())
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.col("correct").cast("double")).alias("exact"),
            F.avg(near.cast("double")).alias("within_1"),
            F.max("pred").alias("max_pred"),
            F.max("gold").alias("max_gold"),
        )
    )


def prediction_histogram(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col("pred").isNotNull()).groupBy(*keys, "pred").agg(F.count(F.lit(1)).alias("n"))


def count_bias(df: DataFrame, runs: Mapping[str, str], keys: Sequence[str]) -> DataFrame:
    """Means, absolute error and under/over rates of several count columns."""
    aggs = [F.count(F.lit(1)).alias("count"), F.avg("gold").alias("gold_mean")]
    for run, column in runs.items():
        err = F.col(column) - F.col("gold")
        aggs += [
            F.avg(column).alias(f"{run}_prediction_mean"),
            F.avg(F.abs(err)).alias(f"{run}_mae"),
            F.avg((err < 0).cast("double")).alias(f"{run}_undercount_rate"),
            F.avg((err > 0).cast("double")).alias(f"{run}_overcount_rate"),
        ]
    return df.groupBy(*keys).agg(*aggs)


def status_rates(df: DataFrame, status: str = "status") -> DataFrame:
    """Structured-output statuses with their share of the dataset and accuracy."""
    out = df.groupBy("dataset", status).agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if("schema_valid").alias("schema_valid"),
        F.sum(F.col("correct").cast("int")).alias("correct"),
    )
    total = F.sum("count").over(Window.partitionBy("dataset"))
    return out.withColumn("rate", F.col("count") / total).withColumn(
        "micro_accuracy", F.col("correct") / F.col("count")
    )


def common_wrong(df: DataFrame, keys: Sequence[str], top: int = 5) -> DataFrame:
    """Most frequent wrong predictions per key; ties by text."""
    counts = (
        df.where(F.col("correct") == 0)
        .groupBy(*keys, "prediction")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # the row_number filter is pushed below the shuffle as a per-partition top k
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "prediction")
    return counts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top)


def readability(df: DataFrame, keys: Sequence[str], names: Sequence[str] = CLASS_NAMES) -> DataFrame:
    """Share of answers that do not parse, and how many of them did say something."""
    bad = ~F.coalesce(text.is_readable(F.col("answer_format"), F.col("prediction"), names), F.lit(False))
    said = F.length(F.coalesce("raw_model_output", F.lit(""))) > 0
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(bad.cast("double")).alias("invalid_rate"),
        F.count_if(bad & said).alias("normalization_failures"),
    )


def geometry_histogram(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row counts over image-geometry columns, NULL keys kept."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("question_count"))
