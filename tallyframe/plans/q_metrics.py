"""Queries: accuracy cubes and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.text import listed
from tallyframe.operators import diagnostics as D
from tallyframe.operators import metrics as M
from tallyframe.operators.scale import quantiles
from tallyframe.plans.registry import query
from tallyframe.plans.views import view
from tallyframe.taxonomy import CLASS_NAMES, GROUPS, LEAVES

DIMS = ["dataset", "group_code", "capability_code", "answer_format", "generation", "ood", "clinical"]
POINT = "micro_accuracy", "video_macro_accuracy"

# point metrics of any slice: two plain GROUP BYs
def _point(source: str, keys: str, where: str = "TRUE") -> str:
    return f"""
      SELECT {keys}, CAST(sum(n) AS BIGINT) AS rows, count(*) AS videos, CAST(sum(k) AS BIGINT) AS correct,
             sum(k) / sum(n) AS micro_accuracy, avg(k / n) AS video_macro_accuracy
      FROM (SELECT {keys}, video, count(*) AS n, sum(correct) AS k FROM {source} WHERE {where} GROUP BY ALL) c
      GROUP BY ALL"""


def cells(spark: SparkSession, sf: str, source: str = "eval_rows") -> DataFrame:
    return M.video_cells(view(spark, sf, source), DIMS)


@query("point_metrics_by_leaf", _point("eval_big", "dataset, capability_code"), ["eval_big"], POINT, "A-03 D-01")
def point_metrics_by_leaf(spark, sf):
    return M.point_metrics(view(spark, sf, "eval_big"), ["dataset", "capability_code"])


@query(
    "overall_with_flags",
    """SELECT p.*, clinical_rows, ood_rows, timed_out_rows, error_rows, empty_output_rows
       FROM (""" + _point("eval_big", "dataset") + """) p JOIN (
         SELECT dataset, count(*) FILTER (clinical) AS clinical_rows, count(*) FILTER (ood) AS ood_rows,
                count(*) FILTER (timed_out) AS timed_out_rows, count(*) FILTER (error <> '') AS error_rows,
                count(*) FILTER (trim(raw_model_output) = '') AS empty_output_rows
         FROM eval_big GROUP BY 1) f USING (dataset)""",
    ["eval_big"], POINT, "D-02",
)
def overall_with_flags(spark, sf):
    return M.overall(view(spark, sf, "eval_big"))


def _filled(column: str, entries: list[str]) -> str:
    values = ", ".join(f"('{e}')" for e in entries)
    return f"""
      SELECT s.dataset, s.{column}, coalesce(rows, 0) AS rows, coalesce(videos, 0) AS videos,
             coalesce(correct, 0) AS correct, micro_accuracy, video_macro_accuracy,
             coalesce(rows / total, 0) AS row_share
      FROM (SELECT DISTINCT dataset, v.{column} FROM eval_rows, (VALUES {values}) v({column})) s
      LEFT JOIN ({_point('eval_rows', f'dataset, {column}')}) m USING (dataset, {column})
      LEFT JOIN (SELECT dataset, count(*) AS total FROM eval_rows GROUP BY 1) t USING (dataset)"""


@query("by_capability_group", _filled("group_code", [c for c, _ in GROUPS]), ["eval_rows"], (*POINT, "row_share"), "D-03 C-06")
def by_capability_group(spark, sf):
    return M.by_group(cells(spark, sf))


@query("by_capability_leaf", _filled("capability_code", [c for c, _ in LEAVES]), ["eval_rows"], (*POINT, "row_share"), "D-04")
def by_capability_leaf(spark, sf):
    return M.by_leaf(cells(spark, sf))


@query(
    "by_answer_format",
    """SELECT m.*, rows / sum(rows) OVER (PARTITION BY dataset) AS row_share
       FROM (""" + _point("eval_rows", "dataset, answer_format") + ") m",
    ["eval_rows"], (*POINT, "row_share"), "D-05 E-07",
)
def by_answer_format(spark, sf):
    return M.by_format(cells(spark, sf))


@query("leaf_by_format", _point("eval_big", "dataset, capability_code, answer_format"), ["eval_big"], POINT, "D-06")
def leaf_by_format(spark, sf):
    return M.by_leaf_and_format(cells(spark, sf, "eval_big"))


@query(
    "by_secondary_capability",
    """WITH tags AS (SELECT dataset, video, correct, unnest(string_split(secondary_text, '|')) AS capability_code
                     FROM eval_rows),
            m AS (""" + _point("tags", "dataset, capability_code", "capability_code <> ''") + """)
       SELECT s.dataset, s.capability_code, coalesce(rows, 0) AS rows, coalesce(videos, 0) AS videos,
              coalesce(correct, 0) AS correct, micro_accuracy, video_macro_accuracy
       FROM (SELECT DISTINCT dataset, v.c AS capability_code FROM eval_rows,
             (VALUES """ + ", ".join(f"('{c}')" for c, _ in LEAVES) + """) v(c)) s
       LEFT JOIN m USING (dataset, capability_code)""",
    ["eval_rows"], POINT, "D-07 H-20",
)
def by_secondary_capability(spark, sf):
    df = view(spark, sf, "eval_rows")
    return M.by_secondary(df.withColumn("secondary_capabilities", listed(F.col("secondary_text"))))


@query(
    "by_flag_slices",
    " UNION ALL ".join(
        "SELECT dataset, level, name, rows, videos, correct, micro_accuracy, video_macro_accuracy FROM ("
        + _point(f"(SELECT *, '{lv}' AS level, CAST({c} AS VARCHAR) AS name FROM eval_big)", "dataset, level, name")
        + ")"
        for lv, c in (("generation", "generation"), ("clinical", "clinical"), ("ood", "ood"))
    ),
    ["eval_big"], POINT, "D-08",
)
def by_flag_slices(spark, sf):
    return M.by_flag(cells(spark, sf, "eval_big"))


@query("by_video", _point("(SELECT *, video AS v FROM eval_big)", "dataset, v").replace("SELECT dataset, v,", "SELECT dataset, v AS video,", 1), ["eval_big"], POINT, "D-09")
def by_video(spark, sf):
    return M.by_video(cells(spark, sf, "eval_big"))


@query(
    "rescore_summary",
    """WITH r AS (SELECT *, CASE WHEN answer_format = 'fo_class' THEN CAST(k % 2 = 0 AS INT) ELSE correct END AS correct_new
                  FROM eval_rows),
            s AS (SELECT dataset, 'overall' AS level, 'MEAN' AS name, correct, correct_new FROM r
              UNION ALL SELECT dataset, 'answer_format', answer_format, correct, correct_new FROM r
              UNION ALL SELECT dataset, 'primary', capability_code, correct, correct_new FROM r
              UNION ALL SELECT dataset, 'ood', CAST(ood AS VARCHAR), correct, correct_new FROM r
              UNION ALL SELECT dataset, 'clinical', CAST(clinical AS VARCHAR), correct, correct_new FROM r)
       SELECT dataset, level, name, count(*) AS count, avg(correct) AS acc_old, avg(correct_new) AS acc_new,
              avg(correct_new) - avg(correct) AS delta
       FROM s GROUP BY 1, 2, 3""",
    ["eval_rows"], ("acc_old", "acc_new", "delta"), "D-10 B-09",
)
def rescore_summary(spark, sf):
    df = view(spark, sf, "eval_rows")
    new = F.when(F.col("answer_format") == "fo_class", (F.col("k") % 2 == 0).cast("int")).otherwise(F.col("correct"))
    return M.rescore_summary(df.withColumn("correct_new", new))


_LATENCY = """
  WITH s AS (SELECT dataset, latency_sec, timed_out, u.scope, u.name FROM {source},
     LATERAL (VALUES ('dataset', 'all'), ('group', group_code), ('leaf', capability_code),
              ('answer_format', answer_format)) u(scope, name))
  SELECT dataset, scope, name, count(*) AS rows, avg(latency_sec) AS mean_latency_sec,
         quantile_cont(latency_sec, 0.5) AS median_latency_sec, quantile_cont(latency_sec, 0.95) AS p95_latency_sec,
         max(latency_sec) AS max_latency_sec, count(*) FILTER (latency_sec > 5) AS over_5_sec_rows,
         count(*) FILTER (latency_sec > 15) AS over_15_sec_rows, count(*) FILTER (latency_sec > 30) AS over_30_sec_rows,
         count(*) FILTER (timed_out) AS timed_out_rows
  FROM s GROUP BY 1, 2, 3"""
_LATENCY_COLS = ("mean_latency_sec", "median_latency_sec", "p95_latency_sec", "max_latency_sec")


@query("latency_profile", _LATENCY.format(source="eval_rows"), ["eval_rows"], _LATENCY_COLS, "D-11")
def latency_profile(spark, sf):
    return M.latency_profile(view(spark, sf, "eval_rows"))


@query(
    "accuracy_by_condition",
    """SELECT generation AS condition, dataset AS selection_group, CASE WHEN grouping(answer_format) = 1 THEN 'all' ELSE answer_format END AS answer_format,
              count(*) AS count, sum(correct) AS correct, avg(correct) AS accuracy
       FROM eval_rows GROUP BY GROUPING SETS ((generation, dataset, answer_format), (generation, dataset))""",
    ["eval_rows"], ("accuracy",), "I-22",
)
def accuracy_by_condition(spark, sf):
    df = view(spark, sf, "eval_rows").withColumnsRenamed({"generation": "condition", "dataset": "selection_group"})
    return M.accuracy_by_condition(df, "condition", "selection_group")


@query("latency_profile_big", _LATENCY.format(source="eval_big"), ["eval_big"], _LATENCY_COLS, "D-11")
def latency_profile_big(spark, sf):
    return M.latency_profile(view(spark, sf, "eval_big"))


@query(
    "price_quantiles",
    """SELECT l_suppkey, quantile_cont(l_extendedprice, 0.05) AS p05, quantile_cont(l_extendedprice, 0.5) AS p50,
              quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY 1""",
    floats=("p05", "p50", "p99"), covers="D-11",
)
def price_quantiles(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    return quantiles(df, ["l_suppkey"], "l_extendedprice", {"p05": 0.05, "p50": 0.5, "p99": 0.99})


@query(
    "bucket_cells",
    """SELECT group_code, dataset, count(*) AS n, avg(correct) AS accuracy,
         (avg(correct) + z*z/(2*count(*))) / (1 + z*z/count(*))
           - z * sqrt(avg(correct)*(1-avg(correct))/count(*) + z*z/(4*count(*)*count(*))) / (1 + z*z/count(*)) AS ci_low,
         (avg(correct) + z*z/(2*count(*))) / (1 + z*z/count(*))
           + z * sqrt(avg(correct)*(1-avg(correct))/count(*) + z*z/(4*count(*)*count(*))) / (1 + z*z/count(*)) AS ci_high
       FROM eval_big, (SELECT 1.959963984540054 AS z) GROUP BY group_code, dataset, z""",
    ["eval_big"], ("accuracy", "ci_low", "ci_high"), "D-19 I-23",
)
def bucket_cells(spark, sf):
    return M.bucket_cells(cells(spark, sf, "eval_big"))


@query(
    "bucket_macro_by_dataset_axis",
    """SELECT count(*) AS buckets, avg(a) AS bucket_macro
       FROM (SELECT group_code, dataset, avg(correct) AS a FROM eval_rows GROUP BY 1, 2)""",
    ["eval_rows"], ("bucket_macro",), "D-19",
)
def bucket_macro_by_dataset_axis(spark, sf):
    return M.bucket_macro(cells(spark, sf))


@query(
    "bucket_macro_by_ood_axis",
    """SELECT dataset, count(*) AS buckets, avg(a) AS bucket_macro
       FROM (SELECT dataset, group_code, ood, avg(correct) AS a FROM eval_rows GROUP BY 1, 2, 3) GROUP BY 1""",
    ["eval_rows"], ("bucket_macro",), "D-20",
)
def bucket_macro_by_ood_axis(spark, sf):
    return M.bucket_macro(cells(spark, sf), ["dataset"], "ood")


@query(
    "three_views_of_accuracy",
    """WITH b AS (SELECT generation, group_code, dataset, avg(correct) AS a FROM eval_big GROUP BY 1, 2, 3),
            v AS (SELECT generation, dataset, video, count(*) AS n, sum(correct) AS k FROM eval_big GROUP BY 1, 2, 3)
       SELECT generation, CAST(sum(n) AS BIGINT) AS rows, sum(k) / sum(n) AS micro_accuracy, avg(k / n) AS video_macro_accuracy,
              any_value(m) AS bucket_macro, any_value(wc) AS worst_cell, any_value(wa) AS worst_accuracy
       FROM v JOIN (SELECT generation, avg(a) AS m, arg_min(group_code || '/' || dataset, a) AS wc, min(a) AS wa
                    FROM b GROUP BY 1) USING (generation)
       GROUP BY 1""",
    ["eval_big"], ("micro_accuracy", "video_macro_accuracy", "bucket_macro", "worst_accuracy"), "D-21",
)
def three_views_of_accuracy(spark, sf):
    return M.three_views(cells(spark, sf, "eval_big"), ["generation"])


# timestamps of a text as sorted seconds, with the digit guards spelled out
_STAMPS = r"""list_sort(list_transform(
   regexp_extract_all(regexp_replace(regexp_replace(coalesce({x}, ''), '[0-9]{{3,}}:', '#', 'g'), ':[0-5]?[0-9][0-9]{{2,}}', '#', 'g'),
     '[0-9]{{1,2}}:[0-5]?[0-9]:[0-5]?[0-9]'),
   lambda t: CAST(split_part(t, ':', 1) AS INT) * 3600 + CAST(split_part(t, ':', 2) AS INT) * 60 + CAST(split_part(t, ':', 3) AS INT)))"""


@query(
    "time_diagnostics",
    f"""WITH t AS (SELECT dataset, video, correct, capability_code, {_STAMPS.format(x='answer')} AS g,
                          {_STAMPS.format(x='prediction')} AS p, {_STAMPS.format(x='raw_model_output')} AS r
                   FROM answer_rows WHERE answer_format = 'time'),
            e AS (SELECT *, CASE WHEN len(g) = 1 AND len(p) = 1 THEN abs(g[1] - p[1]) END AS err FROM t),
            s AS (SELECT e.*, u.scope, u.name FROM e, LATERAL (VALUES ('dataset', 'all_time'),
                    ('primary_capability', capability_code),
                    ('gold_cardinality', CASE WHEN len(g) > 1 THEN 'multiple' ELSE 'single' END)) u(scope, name))
        SELECT a.*, micro_accuracy, video_macro_accuracy, videos FROM (
          SELECT dataset, scope, name, count(*) AS rows, CAST(sum(correct) AS BIGINT) AS correct,
            count(*) FILTER (len(g) > 1) AS gold_multi_timestamp_rows,
            count(*) FILTER (len(r) > 1) AS raw_multi_timestamp_rows,
            count(*) FILTER (len(p) > 1) AS normalized_multi_timestamp_rows,
            avg(CAST(len(r) = len(g) AS INT)) AS raw_cardinality_match_rate,
            avg(CAST(len(p) = len(g) AS INT)) AS normalized_cardinality_match_rate,
            count(*) FILTER (len(g) = 1) AS single_gold_rows,
            count(err) AS single_gold_with_parsed_prediction_rows,
            quantile_cont(err, 0.5) AS single_gold_median_absolute_error_sec,
            quantile_cont(err, 0.9) AS single_gold_p90_absolute_error_sec,
            avg(CAST(err <= 5 AS INT)) AS single_gold_within_5_sec_rate,
            avg(CAST(err <= 30 AS INT)) AS single_gold_within_30_sec_rate,
            avg(CAST(err <= 60 AS INT)) AS single_gold_within_60_sec_rate,
            avg(CAST(err <= 300 AS INT)) AS single_gold_within_300_sec_rate
          FROM s GROUP BY 1, 2, 3) a
        JOIN (SELECT dataset, scope, name, sum(k) / sum(n) AS micro_accuracy, avg(k / n) AS video_macro_accuracy, count(*) AS videos
              FROM (SELECT dataset, scope, name, video, count(*) AS n, sum(correct) AS k FROM s GROUP BY ALL) GROUP BY ALL) b
        USING (dataset, scope, name)""",
    ["answer_rows"],
    (
        *POINT, "raw_cardinality_match_rate", "normalized_cardinality_match_rate",
        "single_gold_median_absolute_error_sec", "single_gold_p90_absolute_error_sec",
        "single_gold_within_5_sec_rate", "single_gold_within_30_sec_rate",
        "single_gold_within_60_sec_rate", "single_gold_within_300_sec_rate",
    ),
    "D-12 H-12",
)
def time_diagnostics(spark, sf):
    return D.time_diagnostics(view(spark, sf, "answer_rows"))


@query(
    "numeric_diagnostics",
    """WITH n AS (SELECT dataset, answer_format, video, correct, capability_code,
                    TRY_CAST(nullif(regexp_extract(answer, '[0-9]+([.][0-9]+)?'), '') AS DOUBLE) AS g0,
                    TRY_CAST(nullif(regexp_extract(prediction, '[0-9]+([.][0-9]+)?'), '') AS DOUBLE) AS p0
                  FROM answer_rows WHERE answer_format IN ('number', 'percentage')),
            e AS (SELECT *, CASE WHEN p0 IS NOT NULL THEN g0 END AS g, CASE WHEN g0 IS NOT NULL THEN p0 END AS p,
                         p0 - g0 AS err FROM n),
            s AS (SELECT e.*, u.scope, u.name FROM e, LATERAL (VALUES ('dataset', 'all'), ('primary_capability', capability_code),
                    ('gold_value_bucket', CASE WHEN answer_format = 'number' THEN
                      CASE WHEN g0 IS NULL THEN 'unparsed' WHEN floor(g0) <= 5 THEN CAST(CAST(floor(g0) AS INT) AS VARCHAR) ELSE '6+' END END)
                    ) u(scope, name) WHERE u.name IS NOT NULL)
       SELECT a.*, micro_accuracy, video_macro_accuracy, videos FROM (
         SELECT dataset, answer_format, scope, name, count(*) AS rows, CAST(sum(correct) AS BIGINT) AS correct,
           count(err) AS parsed_rows, avg(g) AS gold_mean, avg(p) AS prediction_mean, avg(abs(err)) AS mean_absolute_error,
           quantile_cont(abs(err), 0.5) AS median_absolute_error, avg(CAST(err < 0 AS INT)) AS undercount_rate,
           avg(CAST(err = 0 AS INT)) AS exact_numeric_rate, avg(CAST(err > 0 AS INT)) AS overcount_rate
         FROM s GROUP BY 1, 2, 3, 4) a
       JOIN (SELECT dataset, answer_format, scope, name, sum(k) / sum(n) AS micro_accuracy, avg(k / n) AS video_macro_accuracy, count(*) AS videos
             FROM (SELECT dataset, answer_format, scope, name, video, count(*) AS n, sum(correct) AS k FROM s GROUP BY ALL) GROUP BY ALL) b
       USING (dataset, answer_format, scope, name)""",
    ["answer_rows"],
    (*POINT, "gold_mean", "prediction_mean", "mean_absolute_error", "median_absolute_error",
     "undercount_rate", "exact_numeric_rate", "overcount_rate"),
    "D-13 H-14 H-15 B-04",
)
def numeric_diagnostics(spark, sf):
    return D.numeric_diagnostics(view(spark, sf, "answer_rows"))


def _set(x: str) -> str:
    parts = f"list_filter(list_transform(string_split({x}, ','), lambda p: lower(trim(p))), lambda p: p <> '')"
    return f"(CASE WHEN {parts} = ['none'] THEN [] ELSE list_distinct({parts}) END)"


@query(
    "set_diagnostics",
    f"""WITH r AS (SELECT dataset, video, correct, {_set('answer')} AS g, {_set('prediction')} AS p
                   FROM answer_rows WHERE answer_format = 'fo_class'),
            e AS (SELECT *, CASE WHEN len(p) = 0 THEN CAST(len(g) = 0 AS DOUBLE) ELSE len(list_intersect(g, p)) / len(p) END AS prec,
                         CASE WHEN len(g) = 0 THEN CAST(len(p) = 0 AS DOUBLE) ELSE len(list_intersect(g, p)) / len(g) END AS rec FROM r),
            s AS (SELECT e.*, u.scope, u.name FROM e, LATERAL (VALUES ('dataset', 'all_fo_class'), ('gold_cardinality',
                    CASE len(g) WHEN 0 THEN 'none' WHEN 1 THEN 'single' ELSE 'multiple' END)) u(scope, name))
        SELECT a.*, micro_accuracy, video_macro_accuracy, videos FROM (
          SELECT dataset, scope, name, count(*) AS rows, CAST(sum(correct) AS BIGINT) AS correct,
             avg(CAST(len(g) = len(p) AS INT)) AS cardinality_match_rate, avg(prec) AS mean_set_precision, avg(rec) AS mean_set_recall
          FROM s GROUP BY 1, 2, 3) a
        JOIN (SELECT dataset, scope, name, sum(k) / sum(n) AS micro_accuracy, avg(k / n) AS video_macro_accuracy, count(*) AS videos
              FROM (SELECT dataset, scope, name, video, count(*) AS n, sum(correct) AS k FROM s GROUP BY ALL) GROUP BY ALL) b
        USING (dataset, scope, name)""",
    ["answer_rows"], (*POINT, "cardinality_match_rate", "mean_set_precision", "mean_set_recall"), "D-14 H-18 H-19",
)
def set_diagnostics(spark, sf):
    return D.set_diagnostics(view(spark, sf, "answer_rows"))


@query(
    "label_diagnostics",
    f"""WITH r AS (SELECT qid, dataset, correct, {_set('answer')} AS g, {_set('prediction')} AS p
                   FROM answer_rows WHERE answer_format = 'fo_class'),
            gl AS (SELECT qid, dataset, correct, unnest(g) AS label FROM r), pl AS (SELECT qid, dataset, unnest(p) AS label FROM r)
        SELECT coalesce(gl.dataset, pl.dataset) AS dataset, label, count(gl.qid) AS gold_support_rows,
               count(pl.qid) AS predicted_positive_rows, count(CASE WHEN gl.qid = pl.qid THEN 1 END) AS true_positive_rows,
               avg(gl.correct) AS exact_row_accuracy_on_gold_positive_rows,
               CASE WHEN count(gl.qid) > 0 THEN count(CASE WHEN gl.qid = pl.qid THEN 1 END) / count(gl.qid) END AS label_recall,
               CASE WHEN count(pl.qid) > 0 THEN count(CASE WHEN gl.qid = pl.qid THEN 1 END) / count(pl.qid) END AS label_precision
        FROM gl FULL JOIN pl USING (qid, label) GROUP BY 1, 2""",
    ["answer_rows"], ("exact_row_accuracy_on_gold_positive_rows", "label_recall", "label_precision"), "D-15",
)
def label_diagnostics(spark, sf):
    return D.label_diagnostics(view(spark, sf, "answer_rows"))


@query(
    "categorical_diagnostics",
    "WITH c AS (SELECT *, CASE answer_format WHEN 'binary' THEN 'gold_value' ELSE 'selection_type' END AS subtype,"
    " CASE WHEN answer_format = 'binary' THEN lower(trim(answer)) WHEN question LIKE '%one or multiple answers%' THEN 'multi_select'"
    " ELSE 'single_select' END AS value FROM answer_rows WHERE answer_format IN ('binary', 'multiple_choice')) "
    + _point("c", "dataset, answer_format, subtype, value"),
    ["answer_rows"], POINT, "D-16 H-16",
)
def categorical_diagnostics(spark, sf):
    return D.categorical_diagnostics(view(spark, sf, "answer_rows"))


def _masked_hits(x: str, names: list[str]) -> tuple[str, list[str]]:
    """SQL that masks names longest first; flags per name."""
    text = f"lower({x})"
    flags = {}
    for name in sorted(names, key=len, reverse=True):
        pattern = f"(^|[^a-z0-9_])({name.lower()})([^a-z0-9_]|$)"
        flags[name] = f"regexp_matches({text}, '{pattern}')"
        text = f"regexp_replace({text}, '{pattern}', '\\1 \\3', 'g')"
    return text, [flags[n] for n in names]


def _class_count(x: str) -> str:
    clean = f"regexp_replace({x}, '\\s+', ' ', 'g')"
    return " + ".join(f"CAST({f} AS INT)" for f in _masked_hits(clean, list(CLASS_NAMES))[1])


def _option_count(x: str) -> str:
    low = f"lower({x})"
    first = f"CAST(contains({low}, 'top/left') AS INT)"
    left = f"replace({low}, 'top/left', ' ')"
    return f"({first} + CAST(contains({left}, 'bottom') AS INT) + CAST(contains(replace({left}, 'bottom', ' '), 'top') AS INT))"


def _held(x: str) -> str:
    return (
        f"CASE answer_format WHEN 'fo_class' THEN {_class_count(x)} "
        f"WHEN 'time' THEN len(list_distinct({_STAMPS.format(x=x)})) ELSE {_option_count(x)} END"
    )


@query(
    "cardinality_audit",
    f"""WITH h AS (SELECT dataset, correct, CASE WHEN answer_format = 'multiple_choice' THEN 'multiple_choice_multi_select'
                      ELSE answer_format END AS fmt, {_held('answer')} AS g, {_held('raw_model_output')} AS r, {_held('prediction')} AS p
                   FROM answer_rows WHERE answer_format IN ('fo_class', 'time')
                      OR (answer_format = 'multiple_choice' AND question LIKE '%one or multiple%'))
        SELECT dataset, fmt AS answer_format, count(*) AS eligible_rows, count(*) FILTER (g > 1) AS gold_multi_rows,
               count(*) FILTER (r > 1) AS raw_multi_rows, count(*) FILTER (p > 1) AS normalized_multi_rows,
               count(*) FILTER (r > 1 AND p <= 1) AS raw_to_normalized_multi_rows_lost,
               count(*) FILTER (p = g) AS normalized_cardinality_match_rows,
               avg(CAST(p = g AS INT)) AS normalized_cardinality_match_rate, CAST(sum(correct) AS BIGINT) AS correct_rows
        FROM h GROUP BY 1, 2""",
    ["answer_rows"], ("normalized_cardinality_match_rate",), "D-18 H-17",
)
def cardinality_audit(spark, sf):
    return D.cardinality_audit(view(spark, sf, "answer_rows"))


_COUNTED = """SELECT video, template_id, pred, target AS gold, CAST(pred = target AS INT) AS correct FROM counts"""


def counted(spark, sf):
    return view(spark, sf, "counts").select(
        "video", "template_id", "pred", F.col("target").alias("gold"), (F.col("pred") == F.col("target")).cast("int").alias("correct")
    )


@query(
    "counting_by_truth",
    f"""SELECT template_id, gold, count(*) AS n, avg(correct) AS accuracy, avg(pred - gold) AS mean_signed_error
        FROM ({_COUNTED}) GROUP BY 1, 2""",
    ["counts"], ("accuracy", "mean_signed_error"), "D-22",
)
def counting_by_truth(spark, sf):
    return D.counting_by_truth(counted(spark, sf), ["template_id"])


@query(
    "counting_summary",
    f"""SELECT template_id, count(*) AS n, avg(correct) AS exact, avg(CAST(abs(pred - gold) <= 1 AS INT)) AS within_1,
               max(pred) AS max_pred, max(gold) AS max_gold FROM ({_COUNTED}) GROUP BY 1""",
    ["counts"], ("exact", "within_1"), "D-22",
)
def counting_summary(spark, sf):
    return D.counting_summary(counted(spark, sf), ["template_id"])


@query("prediction_histogram", f"SELECT pred, count(*) AS n FROM ({_COUNTED}) GROUP BY 1", ["counts"], covers="D-22")
def prediction_histogram(spark, sf):
    return D.prediction_histogram(counted(spark, sf))


@query(
    "count_bias",
    """SELECT template_id, count(*) AS count, avg(target) AS gold_mean, avg(pred) AS direct_prediction_mean,
              avg(abs(pred - target)) AS direct_mae, avg(CAST(pred < target AS INT)) AS direct_undercount_rate,
              avg(CAST(pred > target AS INT)) AS direct_overcount_rate, avg(other) AS boxes_prediction_mean,
              avg(abs(other - target)) AS boxes_mae, avg(CAST(other < target AS INT)) AS boxes_undercount_rate,
              avg(CAST(other > target AS INT)) AS boxes_overcount_rate
       FROM (SELECT *, (pred * 3 + 1) % 7 AS other FROM counts) GROUP BY 1""",
    ["counts"],
    ("gold_mean", "direct_prediction_mean", "direct_mae", "direct_undercount_rate", "direct_overcount_rate",
     "boxes_prediction_mean", "boxes_mae", "boxes_undercount_rate", "boxes_overcount_rate"),
    "D-23",
)
def count_bias(spark, sf):
    df = view(spark, sf, "counts").withColumn("gold", F.col("target")).withColumn("other", (F.col("pred") * 3 + 1) % 7)
    return D.count_bias(df, {"direct": "pred", "boxes": "other"}, ["template_id"])


@query(
    "common_wrong_predictions",
    """SELECT dataset, answer_format, prediction, n, position FROM (
         SELECT *, row_number() OVER (PARTITION BY dataset, answer_format ORDER BY n DESC, prediction) AS position FROM (
           SELECT dataset, answer_format, prediction, count(*) AS n FROM answer_rows WHERE correct = 0 GROUP BY 1, 2, 3))
       WHERE position <= 5""",
    ["answer_rows"], covers="D-25",
)
def common_wrong_predictions(spark, sf):
    return D.common_wrong(view(spark, sf, "answer_rows"), ["dataset", "answer_format"])


@query(
    "geometry_histogram",
    """SELECT p_size % 4 AS source_width, CASE WHEN p_size % 5 > 0 THEN p_size % 3 END AS source_height, p_brand AS condition,
              count(*) AS question_count FROM part GROUP BY 1, 2, 3""",
    covers="D-26",
)
def geometry_histogram(spark, sf):
    df = spark.read.parquet(f"{sf}/part.parquet").select(
        (F.col("p_size") % 4).alias("source_width"),
        F.when(F.col("p_size") % 5 > 0, F.col("p_size") % 3).alias("source_height"),
        F.col("p_brand").alias("condition"),
    )
    return D.geometry_histogram(df, ["source_width", "source_height", "condition"])


@query(
    "majority_vote",
    """SELECT user_id, CAST(date_trunc('day', ts) AS VARCHAR) AS day, count(*) AS judges, CAST(sum(k % 2) AS BIGINT) AS votes,
              CAST(sum(k % 2) * 2 > count(*) AS INT) AS correct FROM eval_rows GROUP BY 1, 2""",
    ["eval_rows"], covers="D-30",
)
def majority_vote(spark, sf):
    df = view(spark, sf, "eval_rows").select(
        "user_id", F.date_trunc("day", "ts").cast("string").alias("day"), (F.col("k") % 2).alias("vote")
    )
    return M.majority_vote(df, ["user_id", "day"])
