"""Queries: multi-view counting, recalibration and the count classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import counting as K
from tallyframe.operators import learn
from tallyframe.plans.registry import query
from tallyframe.plans.views import table, view

KEYS = ["sample_id", "dataset", "video", "gold"]

# wide views and every rule, written with list functions instead of columns
_WIDE = """
  w AS (SELECT sample_id, dataset, video, gold, """ + ", ".join(
    f"min(TRY_CAST(value AS INT)) FILTER (view_id = '{v}') AS {a}"
    for v, a in zip((*K.VOTING_VIEWS, *K.TILE_VIEWS), ("whole", "hflip", "vflip", "zoom", "t1", "t2", "t3", "t4"))
) + """ FROM views_long GROUP BY 1, 2, 3, 4),
  b AS (SELECT *, t1 + t2 + t3 + t4 AS tiles, list_filter([whole, hflip, vflip, zoom], lambda v: v IS NOT NULL) AS votes FROM w),
  u AS (SELECT sample_id, unnest(votes) AS v, list_median(votes) AS med FROM (SELECT *, list_aggregate(votes, 'median') AS lm FROM b) q),
  v AS (SELECT sample_id, arg_min(v, (-c, abs(v - med), v)) AS vote FROM (SELECT sample_id, v, med, count(*) AS c FROM u GROUP BY 1, 2, 3) GROUP BY 1),
  r AS (SELECT b.*, coalesce(vote, whole, 0) AS base FROM b LEFT JOIN v USING (sample_id)),
  rules AS (SELECT sample_id, dataset, video, gold, x.rule, x.rule_no, x.pred FROM r, LATERAL (VALUES ('whole', 0, coalesce(whole, 0)),
     ('tiles', 1, coalesce(tiles, whole, 0)), ('vote', 2, base), ('max_whole_tiles', 3, greatest(base, tiles)),
     ('tiles_if_high', 4, CASE WHEN tiles >= 4 AND tiles > base THEN tiles ELSE base END)) x(rule, rule_no, pred))"""
_WIDE = _WIDE.replace("list_median(votes)", "lm")


def rows(spark, sf):
    wide = K.pivot_views(view(spark, sf, "views_long"), KEYS)
    return K.rule_rows(K.combine(wide), KEYS)


@query(
    "view_pivot",
    "SELECT sample_id, dataset, video, gold, " + ", ".join(
        f"min(TRY_CAST(value AS INT)) FILTER (view_id = '{v}') AS \"{v}\"" for v in (*K.VOTING_VIEWS, *K.TILE_VIEWS)
    ) + " FROM views_long GROUP BY 1, 2, 3, 4",
    ["views_long"], covers="D-17",
)
def view_pivot(spark, sf):
    return K.pivot_views(view(spark, sf, "views_long"), KEYS)


@query(
    "combination_rules", f"WITH {_WIDE} SELECT sample_id, rule, pred FROM rules", ["views_long"], covers="I-14",
)
def combination_rules(spark, sf):
    return rows(spark, sf).select("sample_id", "rule", "pred")


@query(
    "rule_sweep",
    f"""WITH {_WIDE} SELECT dataset, rule, avg(CAST(pred = gold AS INT)) AS exact, avg(CAST(abs(pred - gold) <= 1 AS INT)) AS within_1,
          avg(pred - gold) AS mean_signed_err, avg(CAST(pred = gold AS INT)) FILTER (gold >= 4) AS exact_gt_ge_4,
          avg(CAST(pred = gold AS INT)) FILTER (gold <= 3) AS exact_gt_le_3, count(*) AS n FROM rules GROUP BY 1, 2""",
    ["views_long"], ("exact", "within_1", "mean_signed_err", "exact_gt_ge_4", "exact_gt_le_3"), "I-15",
)
def rule_sweep(spark, sf):
    return K.rule_sweep(rows(spark, sf), ["dataset"])


_TRIALS = f"""{_WIDE},
  c AS (SELECT video, rule, rule_no, count(*) AS n, sum(CAST(pred = gold AS INT)) AS k FROM rules GROUP BY 1, 2, 3),
  h AS (SELECT trial, video, row_number() OVER (PARTITION BY trial ORDER BY md5('0|' || trial || '|' || video))
          <= count(*) OVER (PARTITION BY trial) // 2 AS fit FROM (SELECT DISTINCT video FROM c), range(20) t(trial)),
  f AS (SELECT trial, rule, rule_no, sum(k) / sum(n) AS rate, sum(n) AS n FROM c JOIN h USING (video) WHERE fit GROUP BY 1, 2, 3),
  best AS (SELECT trial, arg_max(rule, (rate, -rule_no)) AS rule, max(n) AS fit_n FROM f GROUP BY 1),
  o AS (SELECT trial, rule, sum(k) / sum(n) AS exact, sum(n) AS held_n FROM c JOIN h USING (video) WHERE NOT fit GROUP BY 1, 2),
  res AS (SELECT trial, rule, CAST(fit_n AS BIGINT) AS fit_n, CAST(o.held_n AS BIGINT) AS held_n, o.exact, w.exact AS whole_baseline,
            o.exact - w.exact AS delta FROM best JOIN o USING (trial, rule) JOIN o w ON w.trial = best.trial AND w.rule = 'whole'
          WHERE fit_n >= 30 AND o.held_n >= 30)"""


@query(
    "group_aware_selection", f"WITH {_TRIALS} SELECT * FROM res", ["views_long"], ("exact", "whole_baseline", "delta"), "I-16",
)
def group_aware_selection(spark, sf):
    return K.group_aware_selection(K.rule_cells(rows(spark, sf)))


@query(
    "selection_summary",
    f"""WITH {_TRIALS} SELECT (SELECT arg_max(rule, (c, -f)) FROM (SELECT rule, count(*) AS c, min(trial) AS f FROM res GROUP BY 1)) AS selected_rule_mode,
          avg(exact) AS held_out_exact, avg(whole_baseline) AS whole_baseline, avg(delta) AS delta, count(*) AS trials FROM res""",
    ["views_long"], ("held_out_exact", "whole_baseline", "delta"), "I-16",
)
def selection_summary(spark, sf):
    return K.selection_summary(K.group_aware_selection(K.rule_cells(rows(spark, sf))))


@query(
    "rule_transfer",
    f"""WITH {_WIDE}, t AS (SELECT dataset, rule, rule_no, count(*) AS n, sum(CAST(pred = gold AS INT)) AS k FROM rules GROUP BY 1, 2, 3),
          best AS (SELECT dataset, arg_max(rule, (k / n, -rule_no)) AS rule FROM t GROUP BY 1),
          o AS (SELECT b.dataset, t.rule, sum(t.k) / sum(t.n) AS exact, sum(t.n) AS n FROM best b JOIN t ON t.dataset <> b.dataset GROUP BY 1, 2)
        SELECT best.dataset AS fit_on, best.rule, CAST(o.n AS BIGINT) AS n, o.exact, w.exact AS whole_baseline, o.exact - w.exact AS delta
        FROM best JOIN o USING (dataset, rule) JOIN o w ON w.dataset = best.dataset AND w.rule = 'whole'""",
    ["views_long"], ("exact", "whole_baseline", "delta"), "I-17",
)
def rule_transfer(spark, sf):
    return K.transfer(K.rule_cells(rows(spark, sf)))


@query(
    "class_set_counts",
    """WITH c AS (SELECT sample_id, dataset, gold, view_id, unnest(CASE WHEN lower(trim(value)) IN ('', 'none') THEN ['#'] ELSE
                    list_append(list_transform(string_split(value, ','), lambda p: lower(trim(p))), '#') END) AS cls FROM class_views)
       SELECT sample_id, dataset, gold, count(DISTINCT cls) FILTER (view_id = 'whole' AND cls <> '#') AS whole_n,
              count(DISTINCT cls) FILTER (cls <> '#') AS union_n FROM c GROUP BY 1, 2, 3""",
    ["class_views"], covers="I-18 F-05",
)
def class_set_counts(spark, sf):
    return K.class_set_counts(view(spark, sf, "class_views"), ["sample_id", "dataset", "gold"])


# recalibration straight from rows: one map per held-out fold
_FOLDS = """
  f AS (SELECT video, CAST((row_number() OVER (ORDER BY md5('42|' || video)) - 1) % 5 AS INT) AS fold FROM (SELECT DISTINCT video FROM counts)),
  d AS (SELECT counts.*, fold FROM counts JOIN f USING (video)),
  m AS (SELECT k.fold, template_id, pred, target, count(*) AS n FROM d, range(5) k(fold) WHERE d.fold <> k.fold GROUP BY ALL),
  map AS (SELECT fold, template_id, pred, arg_max(target, (n, -target)) AS maps_to FROM m GROUP BY 1, 2, 3),
  r AS (SELECT d.*, greatest(1, least(pred, CASE WHEN template_id = 1 THEN 4 ELSE 16 END)) AS clamped,
               greatest(1, least(coalesce(maps_to, pred), CASE WHEN template_id = 1 THEN 4 ELSE 16 END)) AS recal
        FROM d LEFT JOIN map USING (fold, template_id, pred))"""


def joint(spark, sf):
    df = view(spark, sf, "counts")
    return K.joint_counts(df, K.video_folds(df, 5))


@query(
    "calibration_gain",
    f"""WITH {_FOLDS} SELECT count(*) AS n, avg(CAST(pred = target AS INT)) AS exact_raw, avg(CAST(clamped = target AS INT)) AS exact_clamped,
          avg(CAST(recal = target AS INT)) AS exact_recalibrated, avg(CAST(abs(clamped - target) <= 1 AS INT)) AS within1_clamped,
          avg(clamped) AS mean_pred_clamped, avg(recal) AS mean_pred_recal, avg(target) AS mean_true,
          avg(CAST(recal = target AS INT)) - avg(CAST(clamped = target AS INT)) AS gain_vs_clamped FROM r""",
    ["counts"],
    ("exact_raw", "exact_clamped", "exact_recalibrated", "within1_clamped", "mean_pred_clamped", "mean_pred_recal", "mean_true", "gain_vs_clamped"),
    "I-19",
)
def calibration_gain(spark, sf):
    return K.calibration_gain(joint(spark, sf), 5)


@query(
    "calibration_by_template",
    f"""WITH {_FOLDS} SELECT template_id, count(*) AS n, avg(CAST(pred = target AS INT)) AS exact_raw, avg(CAST(clamped = target AS INT)) AS exact_clamped,
          avg(CAST(recal = target AS INT)) AS exact_recalibrated, avg(CAST(abs(clamped - target) <= 1 AS INT)) AS within1_clamped,
          avg(clamped) AS mean_pred_clamped, avg(recal) AS mean_pred_recal, avg(target) AS mean_true,
          avg(CAST(recal = target AS INT)) - avg(CAST(clamped = target AS INT)) AS gain_vs_clamped FROM r GROUP BY 1""",
    ["counts"],
    ("exact_raw", "exact_clamped", "exact_recalibrated", "within1_clamped", "mean_pred_clamped", "mean_pred_recal", "mean_true", "gain_vs_clamped"),
    "I-19",
)
def calibration_by_template(spark, sf):
    return K.calibration_gain(joint(spark, sf), 5, ["template_id"])


@query(
    "shift_table",
    """SELECT template_id, pred, arg_max(target, (n, -target)) AS maps_to, CAST(sum(n) AS BIGINT) AS seen
       FROM (SELECT template_id, pred, target, count(*) AS n FROM counts GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING pred <> maps_to""",
    ["counts"], covers="I-20",
)
def shift_table(spark, sf):
    return K.shift_table(view(spark, sf, "counts"))


@query(
    "soft_targets",
    """WITH e AS (SELECT vec_id, label + 1 AS y FROM embeddings),
            r AS (SELECT vec_id, y + o AS c, CASE WHEN o = 0 THEN 0.9 WHEN y IN (1, 10) THEN 0.1 ELSE 0.05 END AS weight
                  FROM e, (VALUES (-1), (0), (1)) t(o) WHERE y + o BETWEEN 1 AND 10)
       SELECT vec_id, CAST(c - 1 AS DOUBLE) AS label, weight FROM r""",
    floats=("label", "weight"), covers="I-21",
)
def soft_targets(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", (F.col("label") + 1).alias("target"))
    return learn.soft_target_rows(df, 1, 10, 0.1).select("vec_id", "label", "weight")


@query(
    "fold_baselines",
    f"""WITH {_FOLDS}, b AS (SELECT fold, template_id, target, CASE WHEN pred = 7 THEN NULL ELSE pred END AS p FROM d),
          c AS (SELECT *, CASE WHEN p IS NULL THEN 1 ELSE greatest(1, least(p, CASE WHEN template_id = 1 THEN 4 ELSE 16 END)) END AS q FROM b)
        SELECT fold, template_id, count(*) AS n, count(*) FILTER (p IS NULL) AS unreadable, max(target) AS max_true, avg(target) AS mean_true,
               avg(CAST(coalesce(p, 0) = target AS INT)) AS baseline_raw, avg(CAST(q = target AS INT)) AS baseline_clamped, avg(abs(q - target)) AS baseline_mae FROM c GROUP BY 1, 2""",
    ["counts"], ("mean_true", "baseline_raw", "baseline_clamped", "baseline_mae"), "I-21",
)
def fold_baselines(spark, sf):
    """What a trained head must beat: unreadable answers and the model's own clamped counts per fold and template."""
    df = view(spark, sf, "counts")
    rows = df.withColumn("baseline", F.when(F.col("pred") != 7, F.col("pred")))
    return learn.fold_baselines(rows, K.video_folds(df, 5))


@query("count_classifier", covers="I-21")
def count_classifier(spark, sf):
    """Trained models: no SQL form; the split and the report are tested apart."""
    df = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("qid"),
        F.concat(F.lit("v"), (F.col("vec_id") % 20).cast("string")).alias("video"),
        F.col("embedding").alias("X"),
        (F.col("label") + 1).alias("target"),
    )
    return learn.report(learn.cross_fit(df, 1, 10, folds=3, max_iter=10), "head")
