"""Run against run: paired tables, tests, gaps and rankings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions.numbers import binomial_two_sided, normal_tail
from tallyframe.operators.scale import grouped_running
from tallyframe.session import cut_lineage

# -- pairing -------------------------------------------------------------------


def paired_cells(df: DataFrame, dims: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """Contingency counts of two correctness columns per (dims, video)."""
    x, y = F.col(a).cast("int"), F.col(b).cast("int")
    return df.groupBy(*dims, "video").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(x).alias("ka"),
        F.sum(y).alias("kb"),
        F.sum(x * y).alias("both"),
    )


def contingency(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both / only one / neither, with row and per-video accuracies of both runs."""
    per_video = cells.groupBy(*keys, "video").agg(
        *[F.sum(c).alias(c) for c in ("n", "ka", "kb", "both")]
    )
    out = per_video.groupBy(*keys).agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("videos"),
        F.sum("both").alias("both_correct"),
        (F.sum("ka") - F.sum("both")).alias("only_a_correct"),
        (F.sum("kb") - F.sum("both")).alias("only_b_correct"),
        (F.sum("n") - F.sum("ka") - F.sum("kb") + F.sum("both")).alias("both_wrong"),
        (F.sum("ka") / F.sum("n")).alias("micro_a"),
        (F.sum("kb") / F.sum("n")).alias("micro_b"),
        F.avg(F.col("ka") / F.col("n")).alias("macro_a"),
        F.avg(F.col("kb") / F.col("n")).alias("macro_b"),
    )
    return out.withColumn("micro_delta", F.col("micro_b") - F.col("micro_a")).withColumn(
        "macro_delta", F.col("macro_b") - F.col("macro_a")
    )


def scoped_contingency(cells: DataFrame, keys: Sequence[str], scopes: Mapping[str, Column]) -> DataFrame:
    """Contingency of several slices at once; the expansion runs over cells."""
    tags = F.array(
        *[F.struct(F.lit(s).alias("scope"), c.cast("string").alias("name")) for s, c in scopes.items()]
    )
    long = cells.select(*keys, "video", "n", "ka", "kb", "both", F.inline(tags))
    return contingency(long, [*keys, "scope", "name"])


def head_to_head(
    cells: DataFrame, keys: Sequence[str], scopes: Mapping[str, Column], min_n: int = 25
) -> DataFrame:
    """Bucket accuracies of both runs with the exact test on flips, worst first."""
    table = scoped_contingency(cells, keys, scopes).where(F.col("rows") >= min_n)
    p = binomial_two_sided(F.col("only_b_correct"), F.col("only_a_correct"))
    return table.withColumn("mcnemar_p", p).orderBy(*keys, "scope", "micro_delta", "name")


# -- tests ------------------------------------------------------------------------


def mcnemar(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact two-sided binomial test over flipped questions."""
    counts = cells.groupBy(*keys).agg(
        (F.sum("ka") - F.sum("both")).alias("only_a"), (F.sum("kb") - F.sum("both")).alias("only_b")
    )
    return counts.withColumn("mcnemar_p", binomial_two_sided(F.col("only_a"), F.col("only_b")))


def video_differences(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Difference ``b - a`` of per-video accuracies."""
    per_video = cells.groupBy(*keys, "video").agg(*[F.sum(c).alias(c) for c in ("n", "ka", "kb")])
    return per_video.select(
        *keys, "video", (F.col("kb") / F.col("n") - F.col("ka") / F.col("n")).alias("d")
    )


def wilcoxon(differences: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Signed-rank test over videos: zeros split, ties averaged, normal tail.

    Equal absolute differences are merged first; their shared rank follows from
    the running count, so no task sorts all videos of a slice.
    """
    sized = differences.withColumn("size", F.abs("d")).groupBy(*keys, "size").agg(
        F.count(F.lit(1)).alias("m"),
        F.count_if(F.col("d") > 0).alias("up"),
        F.count_if(F.col("d") < 0).alias("down"),
    )
    ranked = grouped_running(sized, keys, "size", "m")
    rank = F.col("before") + (F.col("m") + 1) / 2.0
    zero = F.sum(F.when(F.col("size") == 0, rank * F.col("m")).otherwise(0.0))
    m = F.col("m").cast("double")
    sums = ranked.groupBy(*keys).agg(
        F.sum("m").alias("videos"),
        (F.sum(rank * F.col("up")) + 0.5 * zero).alias("r_plus"),
        (F.sum(rank * F.col("down")) + 0.5 * zero).alias("r_minus"),
        F.sum(m * m * m - m).alias("_ties"),
        F.max("size").alias("_largest"),
    )
    n = F.col("videos").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_ties") / 48.0
    z = (F.least("r_plus", "r_minus") - n * (n + 1) / 4.0) / F.sqrt(variance)
    p = F.when((F.col("_largest") <= 1e-8) | (variance <= 0), 1.0).otherwise(
        F.least(F.lit(1.0), 2.0 * normal_tail(z))
    )
    return sums.withColumn("wilcoxon_p", p).drop("_ties", "_largest")


# -- dataset gaps ---------------------------------------------------------------------


def _sides(df: DataFrame, key: str, values: Mapping[str, str], first: str, second: str) -> DataFrame:
    """One row per ``key`` with columns of both datasets, from one aggregation."""
    aggs = [
        F.max(F.when(F.col("dataset") == side, F.col(column))).alias(f"{tag}_{name}")
        for tag, side in (("a", first), ("b", second))
        for name, column in values.items()
    ]
    return df.groupBy(key).agg(*aggs)


def gap_decomposition(groups: DataFrame, first: str, second: str, key: str = "group_code") -> DataFrame:
    """Composition and within-group parts of the accuracy gap, with a total row."""
    sides = _sides(
        groups, key, {"p": "row_share", "m": "micro_accuracy", "k": "correct", "n": "rows"}, first, second
    )
    rows = sides.select(
        key,
        F.col("a_p").alias("first_row_share"),
        F.col("b_p").alias("second_row_share"),
        F.col("a_m").alias("first_micro_accuracy"),
        F.col("b_m").alias("second_micro_accuracy"),
        ((F.col("b_p") - F.col("a_p")) * (F.col("b_m") + F.col("a_m")) / 2).alias("composition_contribution"),
        ((F.col("b_m") - F.col("a_m")) * (F.col("b_p") + F.col("a_p")) / 2).alias("within_contribution"),
        "a_k",
        "a_n",
        "b_k",
        "b_n",
    )
    total = rows.groupBy().agg(
        F.lit("TOTAL").alias(key),
        F.sum("first_row_share").alias("first_row_share"),
        F.sum("second_row_share").alias("second_row_share"),
        (F.sum("a_k") / F.sum("a_n")).alias("first_micro_accuracy"),
        (F.sum("b_k") / F.sum("b_n")).alias("second_micro_accuracy"),
        F.sum("composition_contribution").alias("composition_contribution"),
        F.sum("within_contribution").alias("within_contribution"),
    )
    return rows.drop("a_k", "a_n", "b_k", "b_n").unionByName(total)


def capability_gap(levels: DataFrame, first: str, second: str) -> DataFrame:
    """Second minus first accuracy per capability, NULL where a side is empty."""
    aggs = []
    for tag, side in (("first", first), ("second", second)):
        here = F.col("dataset") == side
        aggs += [
            F.coalesce(F.max(F.when(here, F.col("rows"))), F.lit(0)).alias(f"{tag}_rows"),
            F.max(F.when(here, F.col("video_macro_accuracy"))).alias(f"{tag}_accuracy"),
        ]
    out = levels.groupBy("level", "name").agg(*aggs)
    both = (F.col("first_rows") > 0) & (F.col("second_rows") > 0)
    return out.withColumn(
        "second_minus_first", F.when(both, F.col("second_accuracy") - F.col("first_accuracy"))
    )


def subset_against_full(subset: DataFrame, full: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer comparison of two metric tables."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(
            *keys,
            F.col("rows").alias(f"{tag}_rows"),
            F.col("video_macro_accuracy").alias(f"{tag}_accuracy"),
        )

    out = side(subset, "subset").join(side(full, "full"), list(keys), "full")
    return out.withColumn("full_minus_subset", F.col("full_accuracy") - F.col("subset_accuracy"))


def rescoring_effect(cells: DataFrame, keys: Sequence[str], scopes: Mapping[str, Column]) -> DataFrame:
    """Recorded against counterfactual correctness, with rows gained and lost."""
    out = scoped_contingency(cells, keys, scopes)
    return out.select(
        *keys,
        "scope",
        "name",
        "rows",
        (F.col("both_correct") + F.col("only_a_correct")).alias("recorded_correct"),
        (F.col("both_correct") + F.col("only_b_correct")).alias("counterfactual_correct"),
        F.col("micro_a").alias("recorded_micro_accuracy"),
        F.col("micro_b").alias("counterfactual_micro_accuracy"),
        "micro_delta",
        F.col("macro_a").alias("recorded_video_macro_accuracy"),
        F.col("macro_b").alias("counterfactual_video_macro_accuracy"),
        F.col("macro_delta").alias("video_macro_delta"),
        F.col("only_b_correct").alias("newly_correct_rows"),
        F.col("only_a_correct").alias("newly_incorrect_rows"),
    )


def detect_convention(leaf_metrics: DataFrame, stored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Which of row or per-video average reproduces stored leaf accuracies."""
    joined = leaf_metrics.join(stored, [*keys, "capability_code"])
    errors = joined.groupBy(*keys).agg(
        F.sum(F.abs(F.col("micro_accuracy") - F.col("accuracy"))).alias("micro_error"),
        F.sum(F.abs(F.col("video_macro_accuracy") - F.col("accuracy"))).alias("macro_video_error"),
    )
    better = F.when(F.col("micro_error") <= F.col("macro_video_error"), "micro").otherwise("macro_video")
    return errors.withColumn("convention", better)


# -- epochs and ranking ---------------------------------------------------------------------


def epoch_pivot(
    scores: DataFrame, baseline: DataFrame, epochs: Sequence[int], keys: Sequence[str] = ("track", "dataset")
) -> DataFrame:
    """Epochs as columns, the best of them and its distance to a baseline."""
    wide = scores.groupBy(*keys).pivot("epoch", list(epochs)).agg(F.max("accuracy"))
    named = wide.select(*keys, *[F.col(str(e)).alias(f"epoch_{e}") for e in epochs])
    cells = [F.col(f"epoch_{e}") for e in epochs]
    best = F.greatest(*cells) if len(cells) > 1 else cells[0]
    return (
        named.withColumn("best", best)
        .join(baseline.withColumnRenamed("accuracy", "baseline"), list(keys), "left")
        .withColumn("best_delta", F.col("best") - F.col("baseline"))
    )


def missing_cells(scores: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected (epoch, track, dataset) cells without a score."""
    on = [c for c in expected.columns]
    return expected.join(scores.select(*on).distinct(), on, "left_anti")


def best_epoch(scores: DataFrame, keys: Sequence[str], metric: str = "accuracy") -> DataFrame:
    """Highest metric per run; ties go to the later epoch; runs without epochs pass."""
    pick = F.max(F.struct(F.col(metric).alias("m"), "epoch"))
    top = scores.where(F.col("epoch").isNotNull()).groupBy(*keys).agg(pick.alias("top"))
    best = top.select(*keys, F.col("top.epoch").alias("epoch"), F.col("top.m").alias(metric))
    through = scores.where(F.col("epoch").isNull()).select(*keys, "epoch", metric)
    return best.unionByName(through)


def reranked_epochs(scores: DataFrame, keys: Sequence[str], first: str, second: str) -> DataFrame:
    """Runs whose best epoch changes when the metric changes."""
    def top(metric: str) -> Column:
        return F.max(F.struct(F.col(metric), F.col("epoch")))["epoch"].alias(f"epoch_by_{metric}")

    out = scores.groupBy(*keys).agg(top(first), top(second))
    changed = F.col(f"epoch_by_{first}") != F.col(f"epoch_by_{second}")
    return out.withColumn("changed", changed.cast("int"))


def checkpoint_history(
    scores: DataFrame, datasets: Sequence[str], keys: Sequence[str] = (), metric: str = "accuracy"
) -> DataFrame:
    """Epochs in which every dataset was scored, their mean, and the selected one."""
    per = [F.max(F.when(F.col("dataset") == d, F.col(metric))).alias(f"{d}_{metric}") for d in datasets]
    whole = (
        scores.where(F.col("dataset").isin(*datasets))
        .groupBy(*keys, "epoch")
        .agg(F.count_distinct("dataset").alias("_sets"), F.avg(metric).alias(f"mean_{metric}"), *per)
        .where(F.col("_sets") == len(datasets))
        .drop("_sets")
    )
    best = F.max(F.struct(F.col(f"mean_{metric}"), F.col("epoch")))["epoch"].alias("epoch")
    top = whole.groupBy(*keys).agg(best).withColumn("_top", F.lit(1))
    return whole.join(top, [*keys, "epoch"], "left").withColumn(
        "selected", F.coalesce("_top", F.lit(0))
    ).drop("_top")


def copeland(buckets: DataFrame) -> DataFrame:
    """Wins over other runs across buckets; overlapping intervals are a draw.

    Input is one row per (run, bucket) of a finished report, so the pairs are
    runs x runs, never questions.
    """
    left = buckets.select("bucket", F.col("run").alias("run"), F.col("ci_low"), F.col("ci_high"))
    right = buckets.select(
        "bucket", F.col("run").alias("other"), F.col("ci_low").alias("o_low"), F.col("ci_high").alias("o_high")
    )
    duel = left.join(right, "bucket").where(F.col("run") != F.col("other")).groupBy("run", "other").agg(
        F.sum(
            F.when(F.col("ci_low") > F.col("o_high"), 1).when(F.col("o_low") > F.col("ci_high"), -1).otherwise(0)
        ).alias("margin")
    )
    points = F.when(F.col("margin") > 0, 1.0).when(F.col("margin") == 0, 0.5).otherwise(0.0)
    return duel.groupBy("run").agg(
        F.sum(points).alias("copeland"),
        F.count_if(F.col("margin") > 0).alias("wins"),
        F.count_if(F.col("margin") < 0).alias("losses"),
    )


def win_rate(replicates: DataFrame) -> DataFrame:
    """Share of replicates in which a run scores highest; ties share the win."""
    best = replicates.groupBy("rep").agg(F.max("score").alias("top"))
    winners = replicates.join(best, "rep").where(F.col("score") == F.col("top"))
    shares = winners.groupBy("rep").agg(F.count(F.lit(1)).alias("tied"))
    reps = replicates.groupBy("run").agg(F.count(F.lit(1)).alias("reps"))
    won = winners.join(shares, "rep").groupBy("run").agg(F.sum(1.0 / F.col("tied")).alias("won"))
    return reps.join(won, "run", "left").select(
        "run", (F.coalesce("won", F.lit(0.0)) / F.col("reps")).alias("win_rate")
    )




def significant_duels(replicates: DataFrame, level: float = 0.95) -> DataFrame:
    """Margin of every pair of runs over the buckets, insignificant gaps counted as none.

    Input is one row per (run, bucket, rep) with ``accuracy``. A run wins a bucket if
    it scores higher in all but half of ``1 - level`` of the replicates. Scores that
    agree to nine digits are equal. The pairs are runs x runs of a report.
    """
    side = lambda name, score: replicates.select("bucket", "rep", F.col("run").alias(name), F.round("accuracy", 9).alias(score))
    both = side("run", "mine").join(side("other", "theirs"), ["bucket", "rep"]).where("run != other")
    need = 1 - (1 - level) / 2
    share = lambda hit: F.count_if(hit) / F.count(F.lit(1))
    buckets = both.groupBy("run", "other", "bucket").agg(
        share(F.col("mine") > F.col("theirs")).alias("above"), share(F.col("mine") < F.col("theirs")).alias("below")
    )
    verdict = F.when(F.col("above") >= need, 1).when(F.col("below") >= need, -1).otherwise(0)
    return buckets.groupBy("run", "other").agg(F.sum(verdict).alias("margin"))


def run_ranking(replicates: DataFrame, level: float = 0.95) -> DataFrame:
    """Place of every run: Copeland points over significant duels, then bootstrap win rate, then name.

    A duel won over the buckets gives a point, a drawn one half. The win rate is the
    share of replicates in which the mean over buckets is highest. Duels and win rate
    read the replicates several times, so they are written once.
    """
    replicates = cut_lineage(replicates)
    points = F.when(F.col("margin") > 0, 1.0).when(F.col("margin") == 0, 0.5).otherwise(0.0)
    duels = significant_duels(replicates, level).groupBy("run").agg(
        F.sum(points).alias("copeland"), F.count_if(F.col("margin") > 0).alias("wins"), F.count_if(F.col("margin") < 0).alias("losses")
    )
    scores = replicates.groupBy("run", "rep").agg(F.round(F.avg("accuracy"), 9).alias("score"))
    nothing = {"copeland": 0.0, "wins": 0, "losses": 0}  # a single run has no duel
    table = win_rate(scores).join(duels, "run", "left").fillna(nothing)
    order = Window.orderBy(F.col("copeland").desc(), F.round("win_rate", 9).desc(), "run")
    return table.select("run", "copeland", "wins", "losses", "win_rate", F.row_number().over(order).alias("place"))
