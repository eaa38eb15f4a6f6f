"""Annotation pool: cases from questions, priority, diverse order, guide examples.

Questions stay flat rows. Everything a case needs is an aggregate of bounded
size (counts per kind, one flag per class), so a case with very many questions
never has to fit in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.labels import (
    classes_in_answer,
    counted_class,
    numeric_answer,
    question_kind,
)
from tallyframe.functions.numbers import case_id
from tallyframe.operators.scale import grouped_rank, grouped_running, value_bucket
from tallyframe.session import cut_lineage
from tallyframe.taxonomy import CLASS_NAMES

# --- fixed values: points of the priority score ---
RARE_CLASS_POINTS = {
    "Gallstone": 36,
    "Needle": 20,
    "External Drain": 9,
    "Silicone Loop": 8,
    "Specimen Bag": 7,
    "Specimen": 6,
    "Sponge": 4,
}
RARE_CLASS_CAP = 44
AWARDS = {
    "total_count": (28, "exact total-instance counting"),
    "clips": (28, "Clip counting (current major weakness)"),
    "class_count": (12, "per-class instance counting"),
    "distinct_count": (8, "distinct-class counting"),
    "inventory": (15, "complete class inventory"),
    "cross_check": (20, "inventory and count QA cross-check"),
    "very_crowded": (38, "very crowded frame (QA count %d)"),
    "crowded": (29, "crowded frame (QA count %d)"),
    "several": (17, "multiple instances (QA count %d)"),
    "pair": (7, "two visible instances"),
    "many_classes": (27, "%d known foreign-object classes"),
    "three_classes": (20, "three known foreign-object classes"),
    "two_classes": (11, "two known foreign-object classes"),
    "spatial": (8, "spatial grounding QA"),
    "attributes": (5, "object attribute QA"),
    "cooccurrence": (5, "object co-occurrence QA"),
    "ood": (9, "out-of-distribution question"),
    "clinical": (3, "clinically relevant question"),
    "dataset": (6, "LapChole domain coverage"),
}
RARE_REASON = "valuable class coverage: "
RECORDS_REASON = "%d QA records"
RECORDS_STEP, RECORDS_CAP = 2, 12
VERY_CROWDED, CROWDED, SEVERAL = 7, 5, 3
TIERS = (("critical", 105), ("high", 75), ("medium", 45), ("coverage", None))
KINDS = (
    "class_inventory",
    "total_instance_count",
    "distinct_class_count",
    "class_count",
    "single_object_identity",
    "closest_to_center",
    "spatial_location",
    "cooccurrence",
    "other",
)
# --- end of fixed values ---

CASE = ("dataset", "video", "timestamp")


def case_questions(df: DataFrame, names: Sequence[str] = CLASS_NAMES) -> DataFrame:
    """Questions with case id, kind, counted class, number and answer classes; a given case id is kept."""
    if "case_id" not in df.columns:
        named = case_id(F.col("dataset"), F.col("video").cast("string"), F.col("timestamp").cast("string"))
        df = df.select(named.alias("case_id"), "*")
    staged = df.select(
        "*",
        question_kind(F.col("question")).alias("kind"),
    )
    counts = F.col("kind").isin("total_instance_count", "distinct_class_count", "class_count")
    listed = F.col("kind").isin("class_inventory", "single_object_identity")
    return staged.select(
        "*",
        F.when(F.col("kind") == "class_count", counted_class(F.col("question"), names)).alias("target_class"),
        F.when(counts, numeric_answer(F.col("answer"))).alias("numeric_answer"),
        F.when(listed, classes_in_answer(F.col("answer"), names)).alias("answer_classes"),
    )


def ordered_questions(questions: DataFrame) -> DataFrame:
    """Position of each question in its case, by kind then id."""
    kinds = F.array_position(F.array(*[F.lit(k) for k in sorted(KINDS)]), F.col("kind"))
    bucket = F.struct(kinds.alias("kind"), value_bucket(F.col("qid").cast("double")).alias("id"))
    return grouped_rank(questions, ["case_id"], bucket, [F.col("kind"), F.col("qid")], "position")


def build_cases(questions: DataFrame, names: Sequence[str] = CLASS_NAMES) -> DataFrame:
    """One row per (dataset, video, timestamp) with everything the score reads."""
    counted = F.coalesce(F.col("numeric_answer"), F.lit(0)) > 0
    flags = []
    for n in names:
        shown = F.coalesce(F.array_contains("answer_classes", n), F.lit(False)) | (
            F.coalesce(F.col("target_class") == n, F.lit(False)) & counted
        )
        flags.append(F.max(F.when(shown, F.lit(n))).alias(f"has_{n}"))
    per_case = questions.groupBy("case_id", *CASE).agg(
        F.count(F.lit(1)).alias("n_questions"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS],
        F.max("numeric_answer").alias("max_number"),
        F.coalesce(F.bool_or(F.col("target_class") == "Clip"), F.lit(False)).alias("counts_clips"),
        F.bool_or(F.col("capability_code") == "1c").alias("attributes"),
        F.bool_or("ood").alias("any_ood"),
        F.bool_or("clinical").alias("any_clinical"),
        *flags,
    )
    evidence = F.array_compact(F.array(*[F.col(f"has_{n}") for n in names]))
    return per_case.withColumn("evidence", evidence).drop(*[f"has_{n}" for n in names])


def _rules(bonus_dataset: str) -> list[tuple[Column, Column, Column]]:
    """(condition, points, reason) of every additive rule."""
    def has(kind: str) -> Column:
        return F.col(f"n_{kind}") > 0

    top, classes, n = F.col("top"), F.size("evidence"), F.col("n_questions")
    any_count = has("total_instance_count") | has("distinct_class_count") | has("class_count")
    conditions = {
        "total_count": has("total_instance_count"),
        "clips": F.col("counts_clips"),
        "class_count": ~F.col("counts_clips") & has("class_count"),
        "distinct_count": has("distinct_class_count"),
        "inventory": has("class_inventory"),
        "cross_check": has("class_inventory") & any_count,
        "very_crowded": top >= VERY_CROWDED,
        "crowded": (top >= CROWDED) & (top < VERY_CROWDED),
        "several": (top >= SEVERAL) & (top < CROWDED),
        "pair": top == 2,
        "many_classes": classes >= 4,
        "three_classes": classes == 3,
        "two_classes": classes == 2,
        "spatial": has("closest_to_center") | has("spatial_location"),
        "attributes": F.col("attributes"),
        "cooccurrence": has("cooccurrence"),
        "ood": F.col("any_ood"),
        "clinical": F.col("any_clinical"),
        "dataset": F.col("dataset") == bonus_dataset,
    }
    shown = {"many_classes": classes, "very_crowded": top, "crowded": top, "several": top}
    rules = []
    for name, condition in conditions.items():
        points, words = AWARDS[name]
        reason = F.format_string(words, shown[name]) if name in shown else F.lit(words)
        rules.append((condition, F.lit(points), reason))

    weights = F.create_map(*[F.lit(v) for kv in RARE_CLASS_POINTS.items() for v in kv])
    rare = F.filter(
        F.transform(
            "evidence", lambda c: F.struct((-F.try_element_at(weights, c)).alias("w"), c.alias("c"))
        ),
        lambda s: s["w"].isNotNull(),
    )
    # heaviest first; equal weights do not occur in the table
    ranked = F.array_sort(rare)
    total = -F.aggregate(ranked, F.lit(0), lambda a, s: a + s["w"])
    names = F.array_join(F.transform(ranked, lambda s: s["c"]), ", ")
    rules.append((F.size(rare) > 0, F.least(F.lit(RARE_CLASS_CAP), total), F.concat(F.lit(RARE_REASON), names)))
    records = F.least(F.lit(RECORDS_CAP), RECORDS_STEP * (n - 1))
    rules.append((n > 1, records, F.format_string(RECORDS_REASON, n)))
    return rules


def prioritised(cases: DataFrame, bonus_dataset: str = "lapchole") -> DataFrame:
    """Additive score, tier and reasons, heaviest reason first."""
    staged = cases.withColumn("top", F.coalesce("max_number", F.lit(0)).cast("bigint"))
    awards = F.array_compact(
        F.array(
            *[
                F.when(
                    F.coalesce(cond, F.lit(False)),
                    F.struct((-points).cast("bigint").alias("p"), reason.alias("r")),
                )
                for cond, points, reason in _rules(bonus_dataset)
            ]
        )
    )
    staged = staged.withColumn("awards", F.array_sort(awards))
    staged = staged.withColumn(
        "score", -F.aggregate("awards", F.lit(0).cast("bigint"), lambda a, s: a + s["p"])
    )
    top, score = F.col("top"), F.col("score")
    (first, a), (second, b), (third, c), (rest, _) = TIERS
    tier = (
        F.when((top >= VERY_CROWDED) | F.array_contains("evidence", "Gallstone") | (score >= a), first)
        .when((top >= CROWDED) | (score >= b), second)
        .when(score >= c, third)
        .otherwise(rest)
    )
    return staged.withColumn("tier", tier).withColumn(
        "reasons", F.transform("awards", lambda s: s["r"])
    ).drop("awards", "top")


def _hex_step(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("bigint")


def diverse_positions(cases: DataFrame) -> DataFrame:
    """Place of a case among the cases of its video, best score first."""
    staged = cases.withColumn("_key", F.sha1("case_id"))
    bucket = -F.col("score") * 4096 + _hex_step(F.col("_key"))
    return grouped_rank(
        staged, ["dataset", "video"], bucket, [F.desc("score"), F.col("_key")], "video_position"
    ).drop("_key")


def diverse_rank(cases: DataFrame, keys: Sequence[str], name: str = "rank") -> DataFrame:
    """Order by score, then video position, then a hash that mixes the videos."""
    tie = F.sha1(F.concat(F.col("dataset"), F.lit("::"), F.col("video").cast("string"), F.lit("\u0000"), F.col("case_id")))
    staged = diverse_positions(cases).withColumn("_tie", tie)
    place, step = F.col("video_position"), _hex_step(F.col("_tie"))
    # all videos share the first places, so those are split by the tie hash as well
    coarse = 4096 + F.floor(F.log2(place.cast("double")) * 16).cast("bigint")
    bucket = F.struct(
        (-F.col("score")).alias("score"),
        F.when(place <= 4096, place.cast("bigint")).otherwise(coarse).alias("place"),
        F.when(place <= 16, step).when(place <= 4096, F.floor(step / 64)).otherwise(0).alias("step"),
    )
    order = [F.desc("score"), F.col("video_position"), F.col("_tie")]
    return grouped_rank(staged, keys, bucket, order, name).drop("_tie")


def select_pool(cases: DataFrame, quota: int, batch: int = 100) -> DataFrame:
    """Best cases per dataset up to the quota, ranked together and batched."""
    # ranks read their input several times, so scores and choices are kept as tables
    scored = cut_lineage(cases)
    first = diverse_rank(scored, ["dataset"], "_r").where(F.col("_r") <= quota)
    chosen = cut_lineage(first.drop("_r", "video_position"))
    ranked = diverse_rank(chosen, [], "rank")
    return cut_lineage(ranked.withColumn("batch", (F.floor((F.col("rank") - 1) / batch) + 1).cast("bigint")))


def short_datasets(cases: DataFrame, quota: int) -> DataFrame:
    """Datasets that cannot fill the quota."""
    return cases.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < quota)


def pool_summary(pool: DataFrame, batch: int = 100) -> DataFrame:
    """Size, batches, videos and score range; the median is the upper one."""
    sizes = pool.agg(
        F.count(F.lit(1)).alias("cases"),
        F.ceil(F.count(F.lit(1)) / F.lit(batch)).alias("batches"),
        F.count_distinct("dataset", "video").alias("videos"),
        F.max("score").alias("max_score"),
        F.min("score").alias("min_score"),
    )
    scores = pool.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    running = grouped_running(scores, [], "score", "n")
    half = F.floor(pool.agg(F.count(F.lit(1))).scalar() / 2)
    here = (F.col("before") <= half) & (half < F.col("before") + F.col("n"))
    median = running.where(here).agg(F.max("score"))
    return sizes.withColumn("median_score", median.scalar())


def example_strength(questions: DataFrame, names: Sequence[str] = CLASS_NAMES) -> DataFrame:
    """How well a case shows a class: best evidence over its questions."""
    classes = F.coalesce("answer_classes", F.array().cast("array<string>"))
    n = F.coalesce(F.size("answer_classes"), F.lit(0))
    alone = n == 1
    listed = questions.select(
        "case_id",
        *CASE,
        F.explode(classes).alias("class_name"),
        F.greatest(
            F.when(alone & (F.col("kind") == "single_object_identity"), 100),
            F.when(alone & (F.col("kind") == "class_inventory"), 90),
            60 - 5 * F.greatest(F.lit(0), n - 1),
        ).alias("strength"),
    )
    counted = questions.where(F.col("target_class").isNotNull() & (F.col("numeric_answer") > 0)).select(
        "case_id",
        *CASE,
        F.col("target_class").alias("class_name"),
        F.when((F.col("kind") == "class_count") & (F.col("numeric_answer") == 1), 80).otherwise(50).alias("strength"),
    )
    return (
        listed.unionByName(counted)
        .where(F.col("class_name").isin(*names))
        .groupBy("case_id", *CASE, "class_name")
        .agg(F.max("strength").alias("strength"))
        .where(F.col("strength") > 0)
    )


def guide_examples(strengths: DataFrame, pool: DataFrame, first_dataset: str) -> DataFrame:
    """Three cases per class: the best, the next from another video, the next after that.

    Each pick is a minimum over an ordered struct, so no class is ever sorted.
    """
    chosen = pool.select("case_id").distinct().withColumn("_in", F.lit(0))
    key = F.struct(
        (-F.col("strength")).alias("s"),
        F.coalesce("_in", F.lit(1)).alias("i"),
        F.when(F.col("dataset") == first_dataset, 0).otherwise(1).alias("d"),
        F.sha1("case_id").alias("h"),
        F.col("case_id").alias("case_id"),
        F.concat_ws("::", "dataset", F.col("video").cast("string")).alias("video_key"),
    )
    # three passes follow, so the ordered candidates are kept as a table
    ranked = cut_lineage(strengths.join(chosen, "case_id", "left").select("class_name", key.alias("k")))
    first = ranked.groupBy("class_name").agg(F.min("k").alias("k1"))
    rest = ranked.join(first, "class_name").where(
        (F.col("k") > F.col("k1")) & (F.col("k.video_key") != F.col("k1.video_key"))
    )
    second = rest.groupBy("class_name").agg(F.min("k").alias("k2"))
    after = ranked.join(second, "class_name").where(F.col("k") > F.col("k2"))
    third = after.groupBy("class_name").agg(F.min("k").alias("k3"))

    def picked(df: DataFrame, column: str, place: int) -> DataFrame:
        return df.select("class_name", F.lit(place).alias("place"), F.col(f"{column}.case_id").alias("case_id"))

    return picked(first, "k1", 1).unionByName(picked(second, "k2", 2)).unionByName(picked(third, "k3", 3))


STATUSES = ("complete", "needs_review", "in_progress", "skipped", "unstarted")


def progress(records: DataFrame) -> DataFrame:
    """Status counts over everything, per batch and per dataset."""
    sums: Mapping[str, Column] = {s: F.count_if(F.col("status") == s) for s in STATUSES}
    base = records.groupBy("batch", "dataset").agg(
        *[c.alias(s) for s, c in sums.items()],
        F.count(F.lit(1)).alias("size"),
        F.max("updated_at").alias("updated_at"),
    )
    tags = F.array(
        F.struct(F.lit("total").alias("level"), F.lit("all").alias("name")),
        F.struct(F.lit("batch").alias("level"), F.col("batch").cast("string").alias("name")),
        F.struct(F.lit("dataset").alias("level"), F.col("dataset").alias("name")),
    )
    out = base.select("*", F.inline(tags)).groupBy("level", "name").agg(
        F.sum("size").alias("size"),
        *[F.sum(s).alias(s) for s in STATUSES],
        F.max("updated_at").alias("updated_at"),
    )
    return out.withColumn("done", F.col("complete")).withColumn(
        "started", F.col("complete") + F.col("needs_review") + F.col("in_progress") + F.col("skipped")
    )
