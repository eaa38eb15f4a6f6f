"""Table jobs that normalise and score predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import text
from tallyframe.functions.detections import derived_count, extract_detections
from tallyframe.functions.labels import counting_question
from tallyframe.taxonomy import CLASS_NAMES

SEGMENT_SECONDS = 305


def _raw_answer(variant: str, reasoning: bool | None) -> Column:
    raw = F.coalesce("raw_model_output", F.lit(""))
    return text.strip_reasoning(raw) if reasoning or (reasoning is None and variant != "v1") else raw


def normalize_predictions(
    df: DataFrame, variant: str = "v1", names: Sequence[str] = CLASS_NAMES, into: str = "prediction", reasoning: bool | None = None
) -> DataFrame:
    """Raw text of every row to the normalised answer of its format.

    ``reasoning`` strips thinking blocks first; only variants beside ``v1`` do
    so by default, as the shared normaliser reads the text as it is.
    """
    question = F.col("question") if "question" in df.columns else None
    staged = df.withColumn("_answer", _raw_answer(variant, reasoning))
    value = text.normalize_answer(F.col("answer_format"), F.col("_answer"), question, names, variant)
    return staged.withColumn(into, value).drop("_answer")


def normalize_as(
    df: DataFrame, formats: Sequence[str], variant: str = "v1", names: Sequence[str] = CLASS_NAMES, into: str = "prediction", reasoning: bool | None = None
) -> DataFrame:
    """Raw text of every row to its normalised answer under each of ``formats``, a row per text and format.

    The rows are those of ``normalize_predictions`` on texts repeated per format, but a
    text is cleaned once, and it is dropped before the rows multiply if nobody reads it later.
    """
    question = F.col("question") if "question" in df.columns else None
    staged = df.withColumn("_answer", text.clean(_raw_answer(variant, reasoning)))
    answers = [
        F.struct(
            F.lit(f).alias("answer_format"),
            text.normalize_answer(F.lit(f), F.col("_answer"), question, names, variant, cleaned=True).alias(into),
        )
        for f in formats
    ]
    return staged.select(*df.columns, F.inline(F.array(*answers)))


def requests(df: DataFrame) -> DataFrame:
    """Annotation rows as requests with times in seconds."""
    return df.select(
        F.col("id").cast("string").alias("qID"),
        F.col("video").alias("videoID"),
        text.stamp_seconds(F.col("timestamp_start")).alias("start_time"),
        text.stamp_seconds(F.col("timestamp_end")).alias("end_time"),
        "procedure_type",
        "question",
    )


def references(df: DataFrame) -> DataFrame:
    """Annotation rows as references, with the time tolerance of time answers."""
    length = text.stamp_seconds(F.col("timestamp_end")) - text.stamp_seconds(F.col("timestamp_start"))
    return df.select(
        F.col("id").cast("string").alias("qID"),
        F.lower("primary_capability").alias("capability_code"),
        F.substring("primary_capability", 1, 1).alias("group_code"),
        "answer_format",
        "answer",
        F.when(F.col("answer_format") == "time", text.time_threshold(length)).alias("threshold_seconds"),
        "secondary_capabilities",
        F.coalesce("ood", F.lit(False)).alias("ood"),
        F.coalesce("clinical_relevance", F.lit(False)).alias("clinical"),
    )


def route(start: Column, end: Column) -> Column:
    """Track of a request by the length of its window."""
    return F.when(end - start <= SEGMENT_SECONDS, "segment").otherwise("procedure")


def times_agree(gold: Column, pred: Column, threshold: Column) -> Column:
    """Same number of timestamps, each pair within the threshold."""
    close = F.forall(F.arrays_zip(gold.alias("g"), pred.alias("p")), lambda t: F.abs(t["g"] - t["p"]) <= threshold)
    return (F.size(gold) == F.size(pred)) & F.coalesce(close, F.lit(False))


def score(
    df: DataFrame,
    names: Sequence[str] = CLASS_NAMES,
    percentage_tolerance: float = 0.0,
    into: str = "correct",
) -> DataFrame:
    """Deterministic 0/1 score; judged formats read ``judged`` where the table has it.

    Unparseable and timed-out answers are wrong. The percentage tolerance is a
    parameter, as its published rule is not part of the answer format.
    """
    fmt, gold, pred = F.col("answer_format"), F.col("answer"), F.col("prediction")
    length = (
        F.col("duration") if "duration" in df.columns else F.lit(None).cast("double")
    )
    judged = F.col("judged") if "judged" in df.columns else F.lit(None).cast("int")
    late = F.col("timed_out") if "timed_out" in df.columns else F.lit(False)
    low = F.lower(F.trim(gold))
    threshold = F.coalesce(text.time_threshold(length), F.lit(5.0))
    gap = F.abs(pred.try_cast("double") - gold.try_cast("double"))
    right = (
        F.when(fmt == "binary", pred.isin("yes", "no") & (pred == low))
        .when(fmt == "number", pred.rlike(r"^\d+$") & (pred.try_cast("bigint") == gold.try_cast("bigint")))
        .when(fmt == "percentage", gap <= percentage_tolerance)
        .when(fmt == "fo_class", text.same_set(text.answer_set(gold), text.answer_set(pred)))
        .when(fmt == "time", times_agree(text.timestamps(gold), text.timestamps(pred), threshold))
        .otherwise(judged == 1)
    )
    return df.withColumn(into, (F.coalesce(right, F.lit(False)) & ~F.coalesce(late, F.lit(False))).cast("int"))


def format_confusion(df: DataFrame, rules: str = "window") -> DataFrame:
    """Annotated against inferred answer format."""
    return (
        df.select("answer_format", text.infer_format(F.col("question"), rules).alias("inferred"))
        .groupBy("answer_format", "inferred")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def parse_rates(df: DataFrame, keys: Sequence[str] = ("answer_format",), names: Sequence[str] = CLASS_NAMES) -> DataFrame:
    """Share of normalised answers that survive a strict read."""
    ok = F.coalesce(text.is_readable(F.col("answer_format"), F.col("prediction"), names), F.lit(False))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(ok).alias("parsed"),
        F.avg(ok.cast("double")).alias("parse_rate"),
    )


def structured_counts(df: DataFrame, names: Sequence[str] = CLASS_NAMES) -> DataFrame:
    """Boxes of each counting answer reduced to a count, never a bare number.

    Rows need ``mode, target`` or a question to read them from.
    """
    if "mode" not in df.columns:
        asked = counting_question(F.col("question"), F.col("answer_format"), names)
        df = df.withColumn("_asked", asked).where(F.col("_asked").isNotNull())
        df = df.withColumn("mode", F.col("_asked.mode")).withColumn("target", F.col("_asked.target")).drop("_asked")
    found = extract_detections(df, names=names)
    return found.withColumn(
        "derived_count", derived_count(F.col("detections"), F.col("mode"), F.col("target"), names)
    )


def namespaced(dataset: Column, qid: Column) -> Column:
    """``dataset:qid``; ids are unique within one dataset only."""
    return F.concat_ws(":", dataset, qid.cast("string"))
