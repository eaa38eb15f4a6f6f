"""Multi-view counting rules, their selection by video, and count recalibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import text
from tallyframe.functions.labels import clamp_count
from tallyframe.functions.numbers import hash_text
from tallyframe.operators.scale import grouped_rank, hash_bucket
from tallyframe.session import cut_lineage

# --- fixed values: views of one question, and the rules in order of preference ---
VOTING_VIEWS = ("whole", "hflip", "vflip", "zoom")
TILE_VIEWS = ("tile:top-left", "tile:top-right", "tile:bottom-left", "tile:bottom-right")
RULES = ("whole", "tiles", "vote", "max_whole_tiles", "tiles_if_high")
# --- end of fixed values ---


def pivot_views(
    views: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str] = (*VOTING_VIEWS, *TILE_VIEWS),
    value: str = "value",
) -> DataFrame:
    """One row per question, one column per view; repeated views take the minimum."""
    number = F.col(value).try_cast("int")
    return views.groupBy(*keys).pivot("view_id", list(columns)).agg(F.min(number))


def _vote(votes: Column) -> Column:
    """Most frequent value; ties go to the one nearest the median, then the smaller."""
    ordered = F.array_sort(votes)
    n = F.size(ordered)

    def choose(v: Column) -> Column:
        half = F.floor(n / 2).cast("int")
        upper = F.get(v, half).cast("double")
        lower = F.get(v, F.greatest(half - 1, F.lit(0))).cast("double")
        middle = F.when(n % 2 == 1, upper).otherwise((lower + upper) / 2)

        def rate(x: Column) -> Column:
            hits = F.size(F.filter(v, lambda y: y == x))
            return F.struct((-hits).alias("h"), F.abs(x - middle).alias("d"), x.alias("x"))

        return F.array_min(F.transform(v, rate))["x"]

    return F.get(F.transform(F.array(ordered), choose), F.lit(0))


def combine(wide: DataFrame, rules: Sequence[str] = RULES, high: int = 4) -> DataFrame:
    """Add one ``rule_*`` column per combination rule to pivoted views."""
    unknown = [r for r in rules if r not in RULES]
    if unknown:
        raise ValueError(f"unknown combine rule: {unknown[0]}")
    whole = F.coalesce(F.col("whole"), F.lit(0))
    votes = F.array_compact(F.array(*[F.col(v) for v in VOTING_VIEWS]))
    tiles = F.col(f"`{TILE_VIEWS[0]}`")
    for t in TILE_VIEWS[1:]:
        tiles = tiles + F.col(f"`{t}`")  # NULL as soon as one tile is missing
    staged = wide.withColumns({"_tiles": tiles, "_votes": votes}).withColumn(
        "_base", F.coalesce(_vote(F.col("_votes")), whole)
    )
    base, tile = F.col("_base"), F.col("_tiles")
    formula = {
        "whole": whole,
        "tiles": F.coalesce(tile, whole),
        "vote": base,
        "max_whole_tiles": F.greatest(base, tile),
        "tiles_if_high": F.when((tile >= high) & (tile > base), tile).otherwise(base),
    }
    return staged.withColumns({f"rule_{r}": formula[r] for r in rules}).drop("_tiles", "_votes", "_base")


def rule_rows(combined: DataFrame, keep: Sequence[str], rules: Sequence[str] = RULES) -> DataFrame:
    """Long form: one row per question and rule."""
    each = F.array(
        *[
            F.struct(F.lit(r).alias("rule"), F.lit(i).alias("rule_no"), F.col(f"rule_{r}").alias("pred"))
            for i, r in enumerate(rules)
        ]
    )
    return combined.select(*keep, F.inline(each))


def rule_sweep(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Exact, near and signed error per rule, also split at four."""
    ok = (F.col("pred") == F.col("gold")).cast("double")
    err = F.col("pred") - F.col("gold")
    return rows.groupBy(*keys, "rule").agg(
        F.avg(ok).alias("exact"),
        F.avg((F.abs(err) <= 1).cast("double")).alias("within_1"),
        F.avg(err).alias("mean_signed_err"),
        F.avg(F.when(F.col("gold") >= 4, ok)).alias("exact_gt_ge_4"),
        F.avg(F.when(F.col("gold") <= 3, ok)).alias("exact_gt_le_3"),
        F.count(F.lit(1)).alias("n"),
    )


def rule_cells(rows: DataFrame) -> DataFrame:
    """Hits per (dataset, video, rule); selection runs over these."""
    return rows.groupBy("dataset", "video", "rule", "rule_no").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("pred") == F.col("gold")).cast("int")).alias("k")
    )


def _best(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rule with the highest hit rate; ties go to the earlier rule."""
    rates = cells.groupBy(*keys, "rule", "rule_no").agg(
        (F.sum("k") / F.sum("n")).alias("rate"), F.sum("n").alias("n")
    )
    return rates.groupBy(*keys).agg(
        F.max_by("rule", F.struct("rate", -F.col("rule_no"))).alias("rule"), F.max("n").alias("fit_n")
    )


def _held_out(cells: DataFrame, keys: Sequence[str], best: DataFrame) -> DataFrame:
    scored = cells.groupBy(*keys, "rule").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    chosen = scored.join(best, [*keys, "rule"]).select(*keys, "rule", "fit_n", F.col("n").alias("held_n"), (F.col("k") / F.col("n")).alias("exact"))
    base = scored.where(F.col("rule") == "whole").select(*keys, (F.col("k") / F.col("n")).alias("whole_baseline"))
    return chosen.join(base, list(keys))


def group_aware_selection(
    cells: DataFrame, trials: int = 20, seed: int = 0, min_rows: int = 30
) -> DataFrame:
    """Fit the rule on half the videos, score it on the others; one row per trial.

    The halves come from the hash order of the videos, so whole videos move.
    """
    videos = cells.select("video").distinct().select(
        "video", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial")
    )
    digest = hash_text(seed, F.col("trial"), F.col("video"))
    ranked = grouped_rank(
        videos.withColumn("_d", digest), ["trial"], hash_bucket(F.col("_d")), [F.col("_d")], "_r", "_n"
    )
    halves = ranked.select("trial", "video", (F.col("_r") <= F.floor(F.col("_n") / 2)).alias("fit"))
    per_rule = cells.groupBy("video", "rule", "rule_no").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    # fitting and scoring both read the split, so it is kept as a table
    split = cut_lineage(per_rule.join(halves, "video"))
    best = _best(split.where("fit"), ["trial"])
    held = _held_out(split.where("NOT fit"), ["trial"], best)
    return held.where((F.col("fit_n") >= min_rows) & (F.col("held_n") >= min_rows)).withColumn(
        "delta", F.col("exact") - F.col("whole_baseline")
    )


def selection_summary(trials: DataFrame) -> DataFrame:
    """Most often picked rule and the mean held-out gain."""
    picks = trials.groupBy("rule").agg(F.count(F.lit(1)).alias("c"), F.min("trial").alias("first"))
    mode = picks.agg(F.max_by("rule", F.struct("c", -F.col("first"))))
    means = trials.agg(
        F.avg("exact").alias("held_out_exact"),
        F.avg("whole_baseline").alias("whole_baseline"),
        F.avg("delta").alias("delta"),
        F.count(F.lit(1)).alias("trials"),
    )
    return means.withColumn("selected_rule_mode", mode.scalar())


def transfer(cells: DataFrame) -> DataFrame:
    """Pick the rule on one dataset, apply it to all others."""
    totals = cells.groupBy("dataset", "rule", "rule_no").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    everything = totals.groupBy("rule").agg(F.sum("n").alias("all_n"), F.sum("k").alias("all_k"))
    others = totals.join(everything, "rule").select(
        "dataset", "rule", (F.col("all_n") - F.col("n")).alias("n"), (F.col("all_k") - F.col("k")).alias("k")
    ).where(F.col("n") > 0)
    best = _best(totals, ["dataset"])
    out = _held_out(others, ["dataset"], best)
    return out.select(
        F.col("dataset").alias("fit_on"),
        "rule",
        F.col("held_n").alias("n"),
        "exact",
        "whole_baseline",
        (F.col("exact") - F.col("whole_baseline")).alias("delta"),
    )


def class_set_counts(views: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct classes seen in the whole view and over all views of a question.

    Sets are counted as (question, class) rows, never collected.
    """
    named = views.select(*keys, "view_id", text.answer_set(F.col("value")).alias("found"))
    classes = named.select(*keys, F.explode_outer("found").alias("class"), (F.col("view_id") == "whole").alias("w"))
    seen = classes.groupBy(*keys, "class").agg(F.max("w").alias("w"))
    return seen.groupBy(*keys).agg(
        F.count_if(F.col("w") & F.col("class").isNotNull()).alias("whole_n"),
        F.count("class").alias("union_n"),
    )


# -- recalibration -------------------------------------------------------------------


def video_folds(df: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """Videos dealt into folds of equal size, in hash order."""
    digest = hash_text(seed, F.col("video"))
    videos = df.select("video").distinct().withColumn("_d", digest)
    ranked = grouped_rank(videos, [], hash_bucket(F.col("_d")), [F.col("_d")], "_r")
    return ranked.select("video", F.pmod(F.col("_r") - 1, F.lit(folds)).cast("int").alias("fold"))


def joint_counts(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows per (fold, template, prediction, truth); the fold joins after counting per video."""
    per_video = df.groupBy("video", "template_id", "pred", "target").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_video.join(folds, "video")
        .groupBy("fold", "template_id", "pred", "target")
        .agg(F.sum("n").alias("n"))
    )


def _modal(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Most frequent truth; ties go to the smaller one."""
    return counts.groupBy(*keys).agg(
        F.max_by("target", F.struct("n", -F.col("target"))).alias("maps_to"), F.sum("n").alias("seen")
    )


def fitted_maps(joint: DataFrame, folds: int) -> DataFrame:
    """Map per held-out fold, fitted on all other folds as total minus fold."""
    total = joint.groupBy("template_id", "pred", "target").agg(F.sum("n").alias("all_n"))
    spread = total.select("*", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    rest = (
        spread.join(joint, ["fold", "template_id", "pred", "target"], "left")
        .withColumn("n", F.col("all_n") - F.coalesce("n", F.lit(0)))
        .where(F.col("n") > 0)
    )
    return _modal(rest, ["fold", "template_id", "pred"]).drop("seen")


def recalibrated(joint: DataFrame, folds: int) -> DataFrame:
    """Each joint count with its clamped and cross-fitted prediction."""
    maps = fitted_maps(joint, folds)
    new = F.coalesce(F.col("maps_to"), F.col("pred"))
    return joint.join(maps, ["fold", "template_id", "pred"], "left").select(
        "fold",
        "template_id",
        "pred",
        "target",
        "n",
        clamp_count(F.col("pred"), F.col("template_id")).alias("clamped"),
        clamp_count(new, F.col("template_id")).alias("recal"),
    )


def calibration_gain(joint: DataFrame, folds: int, keys: Sequence[str] = ()) -> DataFrame:
    """Exact rates before and after recalibration, weighted over joint counts."""
    rows = recalibrated(joint, folds)

    def rate(hit: Column) -> Column:
        return F.sum(F.when(hit, F.col("n")).otherwise(0)) / F.sum("n")

    def mean(x: str) -> Column:
        return F.sum(F.col(x) * F.col("n")) / F.sum("n")

    out = rows.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        rate(F.col("pred") == F.col("target")).alias("exact_raw"),
        rate(F.col("clamped") == F.col("target")).alias("exact_clamped"),
        rate(F.col("recal") == F.col("target")).alias("exact_recalibrated"),
        rate(F.abs(F.col("clamped") - F.col("target")) <= 1).alias("within1_clamped"),
        mean("clamped").alias("mean_pred_clamped"),
        mean("recal").alias("mean_pred_recal"),
        mean("target").alias("mean_true"),
    )
    return out.withColumn("gain_vs_clamped", F.col("exact_recalibrated") - F.col("exact_clamped"))


def shift_table(df: DataFrame) -> DataFrame:
    """Where the map fitted on everything moves predictions."""
    counts = df.groupBy("template_id", "pred", "target").agg(F.count(F.lit(1)).alias("n"))
    return _modal(counts, ["template_id", "pred"]).where(F.col("pred") != F.col("maps_to"))
