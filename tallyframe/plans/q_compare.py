"""Queries: run against run, intervals, tests, gaps and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.numbers import wilson
from tallyframe.operators import compare as C
from tallyframe.operators import joins as J
from tallyframe.operators import metrics as M
from tallyframe.operators import runs as R
from tallyframe.plans.q_metrics import _point, cells
from tallyframe.plans.registry import query
from tallyframe.plans.views import table, view
from tallyframe.taxonomy import LEAVES

DIMS = ["dataset", "group_code", "answer_format"]


def _scopes():
    return {
        "dataset": F.lit("all"),
        "capability_group": F.col("group_code"),
        "answer_format": F.col("answer_format"),
    }


def pair_cells(spark, sf):
    return C.paired_cells(view(spark, sf, "pair_rows"), DIMS)


_SCOPED = """
  SELECT p.*, u.scope, u.name FROM pair_rows p,
    LATERAL (VALUES ('dataset', 'all'), ('capability_group', group_code), ('answer_format', answer_format)) u(scope, name)"""


def _contingency(source: str, keys: str) -> str:
    return f"""
      SELECT {keys}, CAST(sum(n) AS BIGINT) AS rows, count(*) AS videos, CAST(sum(kk) AS BIGINT) AS both_correct,
             CAST(sum(ka - kk) AS BIGINT) AS only_a_correct, CAST(sum(kb - kk) AS BIGINT) AS only_b_correct,
             CAST(sum(n - ka - kb + kk) AS BIGINT) AS both_wrong, sum(ka) / sum(n) AS micro_a, sum(kb) / sum(n) AS micro_b,
             avg(ka / n) AS macro_a, avg(kb / n) AS macro_b, sum(kb) / sum(n) - sum(ka) / sum(n) AS micro_delta,
             avg(kb / n) - avg(ka / n) AS macro_delta
      FROM (SELECT {keys}, video, count(*) AS n, sum(a) AS ka, sum(b) AS kb, sum(a * b) AS kk FROM ({source}) GROUP BY ALL)
      GROUP BY {keys}"""


_PAIR_FLOATS = ("micro_a", "micro_b", "macro_a", "macro_b", "micro_delta", "macro_delta")


def _binom(b: str, c: str) -> str:
    return (
        f"CASE WHEN {b} + {c} = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, CAST(least({b}, {c}) + 1 AS BIGINT)), "
        f"lambda i: exp(lgamma({b} + {c} + 1) - lgamma(i + 1) - lgamma({b} + {c} - i + 1) - ({b} + {c}) * ln(2.0))))) END"
    )


@query("paired_contingency", _contingency(_SCOPED, "dataset, scope, name"), ["pair_rows"], _PAIR_FLOATS, "C-04 I-04")
def paired_contingency(spark, sf):
    return C.scoped_contingency(pair_cells(spark, sf), ["dataset"], _scopes())


@query("paired_documents", _contingency("SELECT * FROM pair_docs", "dataset"), ["pair_docs"], _PAIR_FLOATS, "C-01 I-03")
def paired_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    labels = table(spark, sf, "labels")
    rows = J.one_to_one(labels, docs, ["doc_id"], check=False).select(
        F.col("source").alias("video"), F.col("lang").alias("dataset"), F.col("quality").alias("a"), F.col("toxic").alias("b")
    )
    return C.contingency(C.paired_cells(rows, ["dataset"]), ["dataset"])


@query(
    "head_to_head_buckets",
    f"""SELECT *, {_binom('only_a_correct', 'only_b_correct')} AS mcnemar_p
        FROM ({_contingency(_SCOPED, 'dataset, scope, name')}) WHERE rows >= 25""",
    ["pair_rows"], (*_PAIR_FLOATS, "mcnemar_p"), "I-05 I-07 E-14",
)
def head_to_head_buckets(spark, sf):
    return C.head_to_head(pair_cells(spark, sf), ["dataset"], _scopes())


@query(
    "mcnemar_test",
    f"""SELECT dataset, group_code, only_a, only_b, {_binom('only_a', 'only_b')} AS mcnemar_p FROM (
          SELECT dataset, group_code, count(*) FILTER (a > b) AS only_a, count(*) FILTER (b > a) AS only_b
          FROM pair_rows GROUP BY 1, 2)""",
    ["pair_rows"], ("mcnemar_p",), "I-05",
)
def mcnemar_test(spark, sf):
    return C.mcnemar(pair_cells(spark, sf), ["dataset", "group_code"])


_ERFC = """(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 200),
    lambda n: exp(-({x}) * ({x}) + n * ln(2.0) + (2 * n + 1) * ln(({x}) + 1e-300) - (lgamma(2 * n + 2) - n * ln(2.0) - lgamma(n + 1))))))"""


@query(
    "wilcoxon_test",
    f"""WITH v AS (SELECT dataset, group_code, sum(b) / count(*) - sum(a) / count(*) AS d FROM pair_rows GROUP BY dataset, group_code, video),
             r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY dataset, group_code, abs(d)) - 1) / 2.0 AS rk
                   FROM v WINDOW w AS (PARTITION BY dataset, group_code ORDER BY abs(d))),
             s AS (SELECT dataset, group_code, count(*) AS videos,
                     coalesce(sum(rk) FILTER (d > 0), 0) + 0.5 * coalesce(sum(rk) FILTER (d = 0), 0) AS r_plus,
                     coalesce(sum(rk) FILTER (d < 0), 0) + 0.5 * coalesce(sum(rk) FILTER (d = 0), 0) AS r_minus FROM r GROUP BY 1, 2),
             t AS (SELECT dataset, group_code, sum(CAST(m AS DOUBLE) ** 3 - m) AS ties FROM (
                     SELECT dataset, group_code, abs(d), count(*) AS m FROM v GROUP BY 1, 2, 3) GROUP BY 1, 2),
             z AS (SELECT s.*, abs((least(r_plus, r_minus) - videos * (videos + 1) / 4.0)
                     / sqrt(CAST(videos AS DOUBLE) * (videos + 1) * (2 * videos + 1) / 24.0 - ties / 48.0)) / sqrt(2.0) AS x
                   FROM s JOIN t USING (dataset, group_code))
        SELECT dataset, group_code, videos, r_plus, r_minus, least(1.0, CASE WHEN x > 5 THEN 0 ELSE {_ERFC.format(x='x')} END) AS wilcoxon_p FROM z""",
    ["pair_rows"], ("r_plus", "r_minus", "wilcoxon_p"), "I-06",
)
def wilcoxon_test(spark, sf):
    keys = ["dataset", "group_code"]
    return C.wilcoxon(C.video_differences(pair_cells(spark, sf), keys), keys)


@query(
    "dataset_gap_decomposition",
    """WITH g AS (SELECT group_code, count(*) FILTER (dataset = 'heico') AS na, count(*) FILTER (dataset = 'lapchole') AS nb,
                    sum(correct) FILTER (dataset = 'heico') AS ka, sum(correct) FILTER (dataset = 'lapchole') AS kb FROM (VALUES ('1'), ('2'), ('3'), ('4'), ('5')) t(group_code) LEFT JOIN eval_big USING (group_code) GROUP BY 1),
            s AS (SELECT *, na / (SELECT sum(na) FROM g) AS pa, nb / (SELECT sum(nb) FROM g) AS pb, ka / na AS ma, kb / nb AS mb FROM g)
       SELECT group_code, pa AS first_row_share, pb AS second_row_share, ma AS first_micro_accuracy, mb AS second_micro_accuracy,
              (pb - pa) * (mb + ma) / 2 AS composition_contribution, (mb - ma) * (pb + pa) / 2 AS within_contribution FROM s
       UNION ALL
       SELECT 'TOTAL', sum(pa), sum(pb), sum(ka) / sum(na), sum(kb) / sum(nb), sum((pb - pa) * (mb + ma) / 2), sum((mb - ma) * (pb + pa) / 2) FROM s""",
    ["eval_big"],
    ("first_row_share", "second_row_share", "first_micro_accuracy", "second_micro_accuracy", "composition_contribution", "within_contribution"),
    "I-10 F-01",
)
def dataset_gap_decomposition(spark, sf):
    groups = M.by_group(cells(spark, sf, "eval_big"))
    return C.gap_decomposition(groups, "heico", "lapchole")


_LEVELS = "SELECT *, 'group' AS level, group_code AS name FROM eval_rows UNION ALL SELECT *, 'leaf', capability_code FROM eval_rows"


@query(
    "capability_gap",
    f"""WITH m AS (SELECT dataset, level, name, count(*) AS videos, sum(n) AS rows, avg(k / n) AS acc FROM (
                     SELECT dataset, level, name, video, count(*) AS n, sum(correct) AS k FROM ({_LEVELS}) GROUP BY ALL) GROUP BY 1, 2, 3),
             s AS (SELECT level, name, CAST(coalesce(max(rows) FILTER (dataset = 'heico'), 0) AS BIGINT) AS first_rows,
                     CAST(coalesce(max(rows) FILTER (dataset = 'lapchole'), 0) AS BIGINT) AS second_rows,
                     max(acc) FILTER (dataset = 'heico') AS first_accuracy, max(acc) FILTER (dataset = 'lapchole') AS second_accuracy
                   FROM m GROUP BY 1, 2)
        SELECT *, second_accuracy - first_accuracy AS second_minus_first FROM s
        UNION ALL SELECT 'group', '5', 0, 0, NULL, NULL, NULL
        UNION ALL SELECT 'leaf', v.c, 0, 0, NULL, NULL, NULL FROM (VALUES {", ".join(f"('{c}')" for c, _ in LEAVES if c not in ("1a", "1c", "2a", "3a", "4c"))}) v(c)""",
    ["eval_rows"], ("first_accuracy", "second_accuracy", "second_minus_first"), "I-11",
)
def capability_gap(spark, sf):
    cube = cells(spark, sf)
    levels = M.by_group(cube).withColumn("level", F.lit("group")).withColumnRenamed("group_code", "name").unionByName(
        M.by_leaf(cube).withColumn("level", F.lit("leaf")).withColumnRenamed("capability_code", "name")
    )
    return C.capability_gap(levels, "heico", "lapchole")


_SIDE = "SELECT dataset, group_code, rows, video_macro_accuracy AS acc FROM ({})"


@query(
    "subset_against_full",
    "WITH f AS (" + _SIDE.format(_point("eval_big", "dataset, group_code")) + "), s AS ("
    + _SIDE.format(_point("eval_big", "dataset, group_code", "clinical AND group_code <> '2'"))
    + """) SELECT dataset, group_code, s.rows AS subset_rows, s.acc AS subset_accuracy, f.rows AS full_rows, f.acc AS full_accuracy,
           f.acc - s.acc AS full_minus_subset FROM s FULL JOIN f USING (dataset, group_code)""",
    ["eval_big"], ("subset_accuracy", "full_accuracy", "full_minus_subset"), "I-12 C-03",
)
def subset_against_full(spark, sf):
    df = view(spark, sf, "eval_big")
    keys = ["dataset", "group_code"]
    subset = df.where(F.col("clinical") & (F.col("group_code") != "2"))
    return C.subset_against_full(M.point_metrics(subset, keys), M.point_metrics(df, keys), keys)


@query(
    "detect_convention",
    "WITH m AS (" + _point("eval_big", "dataset, capability_code") + """),
       e AS (SELECT dataset, sum(abs(micro_accuracy - round(video_macro_accuracy, 4))) AS micro_error,
                    sum(abs(video_macro_accuracy - round(video_macro_accuracy, 4))) AS macro_video_error FROM m GROUP BY 1)
       SELECT *, CASE WHEN micro_error <= macro_video_error THEN 'micro' ELSE 'macro_video' END AS convention FROM e""",
    ["eval_big"], ("micro_error", "macro_video_error"), "I-08",
)
def detect_convention(spark, sf):
    leaf = M.point_metrics(view(spark, sf, "eval_big"), ["dataset", "capability_code"])
    stored = leaf.select("dataset", "capability_code", F.round("video_macro_accuracy", 4).alias("accuracy"))
    return C.detect_convention(leaf, stored, ["dataset"])


@query(
    "epoch_pivot",
    """WITH s AS (SELECT track, dataset, epoch, max(accuracy) AS a FROM epoch_scores GROUP BY 1, 2, 3),
            w AS (SELECT track, dataset, max(a) FILTER (epoch = 4) AS epoch_4, max(a) FILTER (epoch = 8) AS epoch_8,
                         max(a) FILTER (epoch = 12) AS epoch_12 FROM s GROUP BY 1, 2),
            b AS (SELECT track, dataset, min(accuracy) AS baseline FROM epoch_scores GROUP BY 1, 2)
       SELECT w.*, greatest(epoch_4, epoch_8, epoch_12) AS best, baseline, greatest(epoch_4, epoch_8, epoch_12) - baseline AS best_delta
       FROM w JOIN b USING (track, dataset)""",
    ["epoch_scores"], ("epoch_4", "epoch_8", "epoch_12", "best", "baseline", "best_delta"), "I-09",
)
def epoch_pivot(spark, sf):
    scores = view(spark, sf, "epoch_scores")
    baseline = scores.groupBy("track", "dataset").agg(F.min("accuracy").alias("accuracy"))
    return C.epoch_pivot(scores, baseline, [4, 8, 12])


@query(
    "missing_cells",
    """SELECT e.epoch, t.track, d.dataset FROM (SELECT DISTINCT epoch + 3 AS epoch FROM epoch_scores) e,
              (SELECT DISTINCT track FROM epoch_scores) t, (SELECT DISTINCT dataset FROM epoch_scores) d
       WHERE (e.epoch, t.track, d.dataset) NOT IN (SELECT (epoch, track, dataset) FROM epoch_scores)""",
    ["epoch_scores"], covers="I-09",
)
def missing_cells(spark, sf):
    scores = view(spark, sf, "epoch_scores")
    expected = scores.select((F.col("epoch") + 3).alias("epoch"), "track", "dataset").distinct()
    return C.missing_cells(scores, expected)


@query(
    "best_epoch",
    """SELECT run, dataset, epoch, accuracy FROM (SELECT *, row_number() OVER (PARTITION BY run, dataset ORDER BY accuracy DESC, epoch DESC) AS r
       FROM epoch_scores) WHERE r = 1""",
    ["epoch_scores"], ("accuracy",), "E-04",
)
def best_epoch(spark, sf):
    return C.best_epoch(view(spark, sf, "epoch_scores"), ["run", "dataset"])


@query(
    "reranked_epochs",
    """SELECT run, dataset, arg_max(epoch, (accuracy, epoch)) AS epoch_by_accuracy, arg_max(epoch, (bucket_macro, epoch)) AS epoch_by_bucket_macro,
              CAST(arg_max(epoch, (accuracy, epoch)) <> arg_max(epoch, (bucket_macro, epoch)) AS INT) AS changed
       FROM epoch_scores GROUP BY 1, 2""",
    ["epoch_scores"], covers="I-25",
)
def reranked_epochs(spark, sf):
    return C.reranked_epochs(view(spark, sf, "epoch_scores"), ["run", "dataset"], "accuracy", "bucket_macro")


@query(
    "checkpoint_history",
    """WITH w AS (SELECT run, epoch, avg(accuracy) AS mean_accuracy, max(accuracy) FILTER (dataset = 'heico') AS heico_accuracy,
                    max(accuracy) FILTER (dataset = 'lapchole') AS lapchole_accuracy
                  FROM epoch_scores GROUP BY 1, 2 HAVING count(DISTINCT dataset) = 2)
       SELECT *, CAST(row_number() OVER (PARTITION BY run ORDER BY mean_accuracy DESC, epoch DESC) = 1 AS INT) AS selected FROM w""",
    ["epoch_scores"], ("mean_accuracy", "heico_accuracy", "lapchole_accuracy"), "E-05",
)
def checkpoint_history(spark, sf):
    return C.checkpoint_history(view(spark, sf, "epoch_scores"), ["heico", "lapchole"], ["run"])


_RUN_BUCKETS = """SELECT concat('run', CAST(l_linenumber AS VARCHAR)) AS run, l_returnflag || l_linestatus AS bucket, count(*) AS n,
      sum(CAST(l_discount >= 0.05 AS INT)) AS k FROM lineitem GROUP BY 1, 2"""


def run_buckets(spark, sf):
    df = table(spark, sf, "lineitem")
    out = df.groupBy(
        F.concat(F.lit("run"), F.col("l_linenumber").cast("string")).alias("run"),
        F.concat("l_returnflag", "l_linestatus").alias("bucket"),
    ).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") >= 0.05).alias("k"))
    low, high = wilson(F.col("k"), F.col("n"), 0.3)
    return out.select("run", "bucket", low.alias("ci_low"), high.alias("ci_high"))


@query(
    "copeland_ranking",
    f"""WITH b AS (SELECT run, bucket, k / n AS p, n, 0.3 AS z FROM ({_RUN_BUCKETS})),
             c AS (SELECT run, bucket, (p + z*z/(2*n)) / (1 + z*z/n) AS mid, z * sqrt(p*(1-p)/n + z*z/(4.0*n*n)) / (1 + z*z/n) AS half FROM b),
             d AS (SELECT x.run, y.run AS other, sum(CASE WHEN x.mid - x.half > y.mid + y.half THEN 1 WHEN y.mid - y.half > x.mid + x.half THEN -1 ELSE 0 END) AS margin
                   FROM c x JOIN c y ON x.bucket = y.bucket AND x.run <> y.run GROUP BY 1, 2)
        SELECT run, sum(CASE WHEN margin > 0 THEN 1.0 WHEN margin = 0 THEN 0.5 ELSE 0 END) AS copeland,
               count(*) FILTER (margin > 0) AS wins, count(*) FILTER (margin < 0) AS losses FROM d GROUP BY 1""",
    floats=("copeland",), covers="I-24",
)
def copeland_ranking(spark, sf):
    return C.copeland(run_buckets(spark, sf))


@query(
    "replicate_win_rate",
    """WITH s AS (SELECT l_suppkey AS rep, concat('run', CAST(l_linenumber AS VARCHAR)) AS run, round(avg(CAST(l_discount >= 0.05 AS INT)), 2) AS score
                  FROM lineitem GROUP BY 1, 2),
            w AS (SELECT *, score = max(score) OVER (PARTITION BY rep) AS won FROM s),
            t AS (SELECT *, CASE WHEN won THEN 1.0 / count(*) FILTER (won) OVER (PARTITION BY rep) ELSE 0 END AS share FROM w)
       SELECT run, sum(share) / count(*) AS win_rate FROM t GROUP BY 1""",
    floats=("win_rate",), covers="I-24",
)
def replicate_win_rate(spark, sf):
    df = table(spark, sf, "lineitem")
    scores = df.groupBy(
        F.col("l_suppkey").alias("rep"), F.concat(F.lit("run"), F.col("l_linenumber").cast("string")).alias("run")
    ).agg(F.round(F.avg((F.col("l_discount") >= 0.05).cast("int")), 2).alias("score"))
    return C.win_rate(scores)


@query(
    "weakest_and_strongest",
    "WITH m AS (SELECT group_code, avg(video_macro_accuracy) AS s FROM (" + _point("eval_rows", "dataset, group_code") + """) GROUP BY 1)
       SELECT arg_min(group_code, (s, group_code)) AS weakest, min(s) AS weakest_score, arg_max(group_code, (s, group_code)) AS strongest, max(s) AS strongest_score FROM m""",
    ["eval_rows"], ("weakest_score", "strongest_score"), "E-15",
)
def weakest_and_strongest(spark, sf):
    return R.extremes(M.by_group(cells(spark, sf)), "group_code", "video_macro_accuracy")
