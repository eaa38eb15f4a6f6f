"""Queries: joins with contracts, run matrix, facets, integrity checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.prompts import instruction
from tallyframe.functions.text import listed
from tallyframe.operators import joins as J
from tallyframe.operators import quality as Q
from tallyframe.operators import runs as R
from tallyframe.plans.q_io import scratch
from tallyframe.plans.registry import query
from tallyframe.plans.views import table, view
from tallyframe.sources.files import put_file
from tallyframe.sources.readers import run_settings
from tallyframe.taxonomy import LEAVES

RUNS = ("base", "tuned", "merged")


# -- joins -----------------------------------------------------------------------------


def prediction_side(spark, sf):
    """Predictions of all evaluation rows; some carry an id that no row has."""
    return view(spark, sf, "eval_rows").select(
        "dataset", F.when(F.col("k").isin(7, 11), -F.col("qid")).otherwise(F.col("qid")).alias("qid"),
        F.col("capability_code").alias("seen_code"), (F.col("latency_sec") + F.when(F.col("k") == 3, 0.5).otherwise(0.0)).alias("seen_latency"),
    )


_PRED = """p AS (SELECT dataset, CASE WHEN k IN (7, 11) THEN -qid ELSE qid END AS qid, capability_code AS seen_code,
    latency_sec + CASE WHEN k = 3 THEN 0.5 ELSE 0.0 END AS seen_latency FROM eval_rows)"""


@query(
    "joined_evaluation",
    f"""WITH {_PRED} SELECT e.dataset, e.qid, e.capability_code, p.seen_latency FROM eval_rows e JOIN p USING (dataset, qid)""",
    ["eval_rows"], ("seen_latency",), "C-01 A-02",
)
def joined_evaluation(spark, sf):
    out = J.one_to_one(view(spark, sf, "eval_rows"), prediction_side(spark, sf), ["dataset", "qid"])
    return out.select("dataset", "qid", "capability_code", "seen_latency")


@query(
    "covered_lineitems",
    """SELECT l_returnflag, count(*) AS n, count(DISTINCT n_name) AS nations, sum(CAST(s_acctbal AS DECIMAL(18, 2))) AS balance FROM lineitem
       JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""",
    floats=("balance",), covers="C-02 C-06",
)
def covered_lineitems(spark, sf):
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    out = J.covered(lines, table(spark, sf, "supplier"), ["s_suppkey"], "line item")
    nations = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    return J.covered(out, nations, ["s_nationkey"], "supplier").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("n_name").alias("nations"), F.sum(F.col("s_acctbal").cast("decimal(18,2)")).alias("balance")
    )


@query(
    "suffixed_outer_join",
    """SELECT o_custkey, a.n AS n_first, a.total AS total_first, b.n AS n_second, b.total AS total_second FROM
         (SELECT o_custkey, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a
       FULL JOIN (SELECT o_custkey, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS total FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) b USING (o_custkey)""",
    floats=("total_first", "total_second"), covers="C-03",
)
def suffixed_outer_join(spark, sf):
    def side(here):
        rows = table(spark, sf, "orders").where(here)
        return rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))

    finished = F.col("o_orderstatus") == "F"
    return J.suffixed(side(finished), side(~finished), ["o_custkey"], ("first", "second"))


@query(
    "replaced_predictions",
    """WITH b AS (SELECT qid, dataset, 'base' AS model_name, prediction, latency FROM (SELECT qid, dataset, prediction, CAST(run_no AS DOUBLE) AS latency FROM run_rows WHERE run_no = 1)),
            r AS (SELECT qid, dataset, prediction, CAST(run_no AS DOUBLE) AS latency FROM run_rows WHERE run_no = 3 AND correct = 0)
       SELECT b.qid, b.dataset, 'hybrid' AS model_name, coalesce(r.prediction, b.prediction) AS prediction, coalesce(r.latency, b.latency) AS latency_sec,
              CASE WHEN r.qid IS NULL THEN 'direct' ELSE 'bbox-json' END AS prompt_strategy, b.model_name AS baseline_model_name,
              b.prediction AS baseline_prediction, b.latency AS baseline_latency_sec, r.qid IS NOT NULL AS changed_by_prompt
       FROM b LEFT JOIN r USING (dataset, qid)""",
    ["run_rows"], ("latency_sec", "baseline_latency_sec"), "C-05 B-08",
)
def replaced_predictions(spark, sf):
    rows = view(spark, sf, "run_rows").select("dataset", "qid", "prediction", F.col("run_no").cast("double").alias("latency_sec"), "run_no", "correct")
    base = rows.where(F.col("run_no") == 1).select("dataset", "qid", F.lit("base").alias("model_name"), "prediction", "latency_sec")
    new = rows.where((F.col("run_no") == 3) & (F.col("correct") == 0)).select(
        "dataset", "qid", "prediction", "latency_sec", F.lit("bbox-json").alias("prompt_strategy")
    )
    return J.replace_by_id(base, new, ["dataset", "qid"], "hybrid")


@query(
    "unknown_replacements",
    "SELECT dataset, qid FROM run_rows WHERE run_no = 1 AND (dataset, qid) NOT IN (SELECT (dataset, qid) FROM run_rows WHERE run_no = 2)",
    ["run_rows"], covers="C-05 C-07",
)
def unknown_replacements(spark, sf):
    rows = view(spark, sf, "run_rows")
    return J.unknown_replacements(rows.where(F.col("run_no") == 2), rows.where(F.col("run_no") == 1), ["dataset", "qid"])


@query(
    "coverage_gaps",
    f"""WITH {_PRED} SELECT dataset, qid, 'missing' AS side FROM eval_rows WHERE (dataset, qid) NOT IN (SELECT (dataset, qid) FROM p)
        UNION ALL SELECT dataset, qid, 'extra' FROM p WHERE (dataset, qid) NOT IN (SELECT (dataset, qid) FROM eval_rows)""",
    ["eval_rows"], covers="F-02 C-07 F-04",
)
def coverage_gaps(spark, sf):
    return J.coverage_gaps(view(spark, sf, "eval_rows"), prediction_side(spark, sf), ["dataset", "qid"])


@query(
    "best_overlap",
    """WITH u AS (SELECT DISTINCT dataset, qid, CASE WHEN hash_bit THEN 'train' ELSE 'test' END AS split FROM (SELECT dataset, qid, run_no, correct = 1 AS hash_bit FROM run_rows WHERE run_no = 1)),
            h AS (SELECT r.run, u.split, count(DISTINCT (r.dataset, r.qid)) AS overlap FROM (SELECT * FROM run_rows WHERE correct = 0) r JOIN u USING (dataset, qid) GROUP BY 1, 2)
       SELECT run, split, overlap FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY overlap DESC, split) AS n FROM h) WHERE n = 1""",
    ["run_rows"], covers="C-11",
)
def best_overlap(spark, sf):
    rows = view(spark, sf, "run_rows")
    universe = rows.where(F.col("run_no") == 1).select(
        "dataset", "qid", F.when(F.col("correct") == 1, "train").otherwise("test").alias("split")
    ).distinct()
    return J.best_overlap(rows.where(F.col("correct") == 0).select("run", "dataset", "qid"), universe)


@query(
    "salted_lookup",
    """SELECT l_linestatus, count(*) AS n, sum(p_size) AS size FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
    covers="C-06 C-09",
)
def salted_lookup(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_linestatus", "l_orderkey", "l_linenumber")
    out = J.salted_lookup(lines, table(spark, sf, "part").select("p_partkey", "p_size"), ["p_partkey"], hot_rows=20)
    return out.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("size"))


# -- runs ---------------------------------------------------------------------------------


@query(
    "run_matrix",
    """SELECT dataset, qid, arg_min(question, run_no) AS question, any_value(answer) AS answer, any_value(answer_format) AS answer_format, """
    + ", ".join(f"max(prediction) FILTER (run = '{r}') AS {r}_prediction, max(correct) FILTER (run = '{r}') AS {r}_correct" for r in RUNS)
    + " FROM run_rows GROUP BY 1, 2",
    ["run_rows"], covers="C-08",
)
def run_matrix(spark, sf):
    return R.question_matrix(view(spark, sf, "run_rows"), RUNS)


_AGREE = """SELECT dataset, qid, count(correct) AS judged_runs, CAST(sum(correct) AS BIGINT) AS correct_runs, count(DISTINCT prediction) AS distinct_predictions,
   max(CAST(run = 'tuned' AND coalesce(correct, 1) = 0 AS INT)) AS focus_wrong, CAST(count(correct) > 0 AND sum(correct) = count(correct) AS INT) AS all_correct,
   CAST(count(correct) > 0 AND coalesce(sum(correct), 0) = 0 AS INT) AS all_wrong, CAST(count(DISTINCT prediction) > 1 AS INT) AS disagree FROM run_rows GROUP BY 1, 2"""


@query("run_agreement", _AGREE, ["run_rows"], covers="B-06")
def run_agreement(spark, sf):
    return R.agreement(view(spark, sf, "run_rows"), focus="tuned")


@query(
    "questions_runs_disagree_on",
    f"SELECT dataset, qid FROM ({_AGREE}) WHERE disagree = 1 AND focus_wrong = 1", ["run_rows"], covers="B-06",
)
def questions_runs_disagree_on(spark, sf):
    out = R.agreement(view(spark, sf, "run_rows"), focus="tuned")
    return out.where((F.col("disagree") == 1) & (F.col("focus_wrong") == 1)).select("dataset", "qid")


@query(
    "facet_filter",
    """SELECT qid, video FROM answer_rows WHERE contains(lower(question), 'clip') AND answer_format = 'number' AND capability_code = '1a' AND NOT ood""",
    ["answer_rows"], covers="B-05 B-04",
)
def facet_filter(spark, sf):
    df = R.facet_filter(view(spark, sf, "answer_rows"), term="  CLIP ", answer_format="number", capability="1a", ood=False)
    return df.select("qid", "video")


@query(
    "capability_membership",
    """SELECT qid, capability_code LIKE '3%' OR contains(secondary_text, '3b') AS tagged_group_3, capability_code = '2a' OR contains(secondary_text, '2a') AS tagged_2a,
              capability_code LIKE '1%' AS primary_group_1 FROM eval_rows""",
    ["eval_rows"], covers="B-07",
)
def capability_membership(spark, sf):
    df = view(spark, sf, "eval_rows").withColumn("secondary_capabilities", listed(F.col("secondary_text")))
    return df.select(
        "qid",
        R.has_capability("3", "tagged").alias("tagged_group_3"),
        R.has_capability("2a", "tagged").alias("tagged_2a"),
        R.has_capability("1").alias("primary_group_1"),
    )


@query(
    "capability_scores",
    """WITH t AS (SELECT qid, dataset, CASE WHEN k <> 9 THEN correct END AS correct, unnest(list_distinct(list_filter(list_append(string_split(secondary_text, '|'), capability_code), lambda c: c <> ''))) AS c FROM eval_rows),
            r AS (SELECT DISTINCT qid, dataset, correct, x AS code FROM (SELECT *, c AS x FROM t UNION ALL SELECT *, substr(c, 1, 1) FROM t))
       SELECT dataset, code, count(*) AS assigned, count(correct) AS evaluated, count(*) FILTER (correct = 1) AS correct, count(*) FILTER (correct = 0) AS wrong,
              count(*) FILTER (correct = 1) / nullif(count(correct), 0) AS accuracy FROM r GROUP BY 1, 2""",
    ["eval_rows"], ("accuracy",), "D-28 B-07 H-20",
)
def capability_scores(spark, sf):
    df = view(spark, sf, "eval_rows").withColumns(
        {"secondary_capabilities": listed(F.col("secondary_text")), "correct": F.when(F.col("k") != 9, F.col("correct"))}
    )
    return R.capability_scores(df, ["dataset"])


@query(
    "run_order",
    """SELECT track, run AS label, 'test' AS split, dataset, max(accuracy) AS accuracy FROM epoch_scores GROUP BY 1, 2, 3, 4 ORDER BY track, split, dataset, accuracy DESC, label""",
    ["epoch_scores"], ("accuracy",), "E-06",
)
def run_order(spark, sf):
    runs = view(spark, sf, "epoch_scores").groupBy("track", F.col("run").alias("label"), F.lit("test").alias("split"), "dataset").agg(F.max("accuracy").alias("accuracy"))
    return R.run_order(runs)


@query(
    "discovered_runs",
    """WITH f AS (SELECT CASE c_nationkey % 3 WHEN 0 THEN 'segment' WHEN 1 THEN 'procedure' ELSE 'frame' END AS track, CASE WHEN c_custkey % 2 = 0 THEN 'heico' ELSE 'lapchole' END AS dataset,
                    c_custkey % 9 AS epoch, CASE WHEN c_custkey % 4 = 0 THEN 'legacy' ELSE 'rich' END AS kind, c_mktsegment AS m, c_custkey % 7 = 0 AS smoke FROM customer)
       SELECT '/runs/track-' || track || '/' || m || '/logs/eval_epoch_' || epoch || '/' || dataset AS run, track, dataset, CAST(NULL AS VARCHAR) AS split, m AS method, epoch, max(kind) AS kind
       FROM f WHERE NOT smoke GROUP BY ALL""",
    covers="L-11",
)
def discovered_runs(spark, sf):
    return R.describe_runs(run_paths(spark, sf)).withColumn("epoch", F.col("epoch").cast("bigint"))


def run_paths(spark, sf):
    c = F.col("c_custkey")
    track = F.when(F.col("c_nationkey") % 3 == 0, "segment").when(F.col("c_nationkey") % 3 == 1, "procedure").otherwise("frame")
    path = F.concat(
        F.lit("/runs/track-"), track, F.lit("/"), "c_mktsegment", F.when(c % 7 == 0, "/smoke").otherwise(""), F.lit("/logs/eval_epoch_"), (c % 9).cast("string"), F.lit("/"),
        F.when(c % 2 == 0, "heico").otherwise("lapchole"), F.when(c % 4 == 0, "/responses.json").otherwise("/predictions.parquet/part-0.parquet"),
    )
    return table(spark, sf, "customer").select(path.alias("path"))


# documents of whole tracks, of some methods' logs and of some epochs; the nearest counts
_META = """
  m AS (SELECT '/runs/track-' || t AS folder, t || '-model' AS model_name, NULL AS model, 'test' AS split, NULL AS dataset FROM (VALUES ('segment'), ('frame')) v(t)
        UNION ALL SELECT DISTINCT '/runs/track-' || t || '/' || c_mktsegment || '/logs', NULL, '/models/' || lower(c_mktsegment), NULL, NULL FROM customer, (VALUES ('segment'), ('procedure')) v(t) WHERE c_mktsegment < 'H'
        UNION ALL SELECT DISTINCT '/runs/track-frame/' || c_mktsegment || '/logs/eval_epoch_3', '', '', 'val', 'heico' FROM customer)"""


@query(
    "run_identities",
    f"""WITH f AS (SELECT DISTINCT CASE c_nationkey % 3 WHEN 0 THEN 'segment' WHEN 1 THEN 'procedure' ELSE 'frame' END AS track, CASE WHEN c_custkey % 2 = 0 THEN 'heico' ELSE 'lapchole' END AS dataset,
                    c_custkey % 9 AS epoch, c_mktsegment AS method FROM customer WHERE c_custkey % 7 > 0),
            r AS (SELECT *, '/runs/track-' || track || '/' || method || '/logs/eval_epoch_' || epoch || '/' || dataset AS run, '/runs/track-' || track || '/' || method || '/logs/' || dataset AS model_key FROM f), {_META},
            n AS (SELECT run, arg_max(m, length(m.folder)) AS meta FROM r JOIN m ON r.run = m.folder OR starts_with(r.run, m.folder || '/') GROUP BY 1),
            s AS (SELECT r.*, CASE WHEN epoch <> 5 THEN round((epoch * 37 % 10) / 10, 1) END AS accuracy FROM r),
            b AS (SELECT *, row_number() OVER (PARTITION BY model_key ORDER BY coalesce(accuracy, -1) DESC, epoch DESC) AS place FROM s)
       SELECT b.run, b.track, nullif(meta.split, '') AS split, coalesce(nullif(meta.dataset, ''), b.dataset) AS dataset, b.method, b.epoch, b.accuracy,
              coalesce(nullif(meta.model_name, ''), regexp_extract(nullif(meta.model, ''), '[^/]+$'), 'logs') || ' (ep' || b.epoch || ')' AS model_name,
              b.method || '/' || coalesce(nullif(meta.model_name, ''), regexp_extract(nullif(meta.model, ''), '[^/]+$'), 'logs') || ' (ep' || b.epoch || ')' AS label
       FROM b LEFT JOIN n USING (run) WHERE place = 1""",
    floats=("accuracy",), covers="L-11 E-04",
)
def run_identities(spark, sf):
    """Metadata documents written below a run root, read from their files and joined to the runs found there."""
    root = scratch(spark, "meta")
    segments = table(spark, sf, "customer").select("c_mktsegment").distinct()
    methods = segments.where("c_mktsegment < 'H'").select("c_mktsegment", F.explode(F.array(F.lit("segment"), F.lit("procedure"))).alias("t"))
    none = F.lit(None).cast("string")
    tracks = spark.createDataFrame([("segment",), ("frame",)], "t string")

    def docs(df, folder, model_name=none, model=none, split=none, dataset=none):
        return df.select(folder.alias("folder"), F.to_json(F.struct(model_name.alias("model_name"), model.alias("model"), split.alias("split"), dataset.alias("dataset"))).alias("settings"))

    all_docs = (
        docs(tracks, F.concat(F.lit("/runs/track-"), "t"), model_name=F.concat("t", F.lit("-model")), split=F.lit("test"))
        .unionByName(docs(methods, F.concat(F.lit("/runs/track-"), "t", F.lit("/"), "c_mktsegment", F.lit("/logs")), model=F.concat(F.lit("/models/"), F.lower("c_mktsegment"))))
        .unionByName(docs(segments, F.concat(F.lit("/runs/track-frame/"), "c_mktsegment", F.lit("/logs/eval_epoch_3")), F.lit(""), F.lit(""), F.lit("val"), F.lit("heico")))
    )
    put = lambda r: put_file(f"{root}{r.folder}/meta.json", r.settings.encode())
    all_docs.foreach(put)
    found = run_settings(spark, f"{root}/runs", "meta.json")
    metas = found.select(F.regexp_extract("run", r"(/runs(?:/.*)?)/meta\.json$", 1).alias("folder"), "settings")
    runs = R.with_meta(R.describe_runs(run_paths(spark, sf)), metas).drop("kind")
    epoch = F.col("epoch")
    scores = runs.select("run", F.when(epoch != 5, F.round(epoch * 37 % 10 / 10, 1)).alias("accuracy"))
    return R.best_epoch_runs(runs, scores).withColumn("epoch", epoch.cast("bigint"))


@query(
    "rebuilt_legacy_runs",
    """SELECT r.dataset, r.qid, coalesce(nullif(a.question, ''), q.question, '') AS question, coalesce(nullif(a.video, ''), q.video) AS video, coalesce(a.answer_format, 'open_ended') AS answer_format,
              a.capability_code AS primary_capability, a.answer, coalesce(a.ood, FALSE) AS ood, coalesce(a.clinical, FALSE) AS clinical, r.prediction, r.latency
       FROM (SELECT dataset, CASE WHEN k = 11 THEN -qid ELSE qid END AS qid, prediction, latency_sec AS latency FROM answer_rows) r
       LEFT JOIN (SELECT dataset, qid, CASE WHEN k = 4 THEN '' ELSE question END AS question, video, answer_format, capability_code, answer, ood, clinical FROM answer_rows WHERE k <> 7) a USING (dataset, qid)
       LEFT JOIN (SELECT dataset, qid, 'asked' AS question, 'w' || k AS video FROM answer_rows) q USING (dataset, qid)""",
    ["answer_rows"], ("latency",), "L-12",
)
def rebuilt_legacy_runs(spark, sf):
    df = view(spark, sf, "answer_rows")
    responses = df.select(
        "dataset", F.when(F.col("k") == 11, -F.col("qid")).otherwise(F.col("qid")).alias("qid"), F.col("prediction").alias("content"), F.col("latency_sec").alias("latency")
    )
    annotations = df.where(F.col("k") != 7).select(
        "dataset", "qid", F.when(F.col("k") == 4, "").otherwise(F.col("question")).alias("question"), "video", "answer_format",
        F.col("capability_code").alias("primary_capability"), "answer", "ood", "clinical",
    )
    asked = df.select("dataset", "qid", F.lit("asked").alias("question"), F.concat(F.lit("w"), F.col("k").cast("string")).alias("video"))
    return R.rebuild_legacy(responses, annotations, asked)


# -- integrity ----------------------------------------------------------------------------------


@query(
    "completeness",
    f"""WITH {_PRED}, h AS (SELECT dataset, qid, count(*) AS n FROM p GROUP BY 1, 2)
        SELECT dataset, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, count(n) AS distinct_ids, count(w) AS expected_ids, count(*) FILTER (n IS NULL) AS missing,
               count(*) FILTER (w IS NULL) AS extra, count(*) FILTER (n > 1) AS duplicated FROM h FULL JOIN (SELECT dataset, qid, 1 AS w FROM eval_rows) USING (dataset, qid) GROUP BY 1""",
    ["eval_rows"], covers="K-01",
)
def completeness(spark, sf):
    return Q.completeness(prediction_side(spark, sf), view(spark, sf, "eval_rows"), ["dataset", "qid"])


@query(
    "gap_examples",
    f"""WITH {_PRED} (SELECT dataset, qid, 'missing' AS side FROM eval_rows WHERE (dataset, qid) NOT IN (SELECT (dataset, qid) FROM p) ORDER BY 1, 2 LIMIT 5)
        UNION ALL (SELECT dataset, qid, 'extra' FROM p WHERE (dataset, qid) NOT IN (SELECT (dataset, qid) FROM eval_rows) ORDER BY 1, 2 LIMIT 5)""",
    ["eval_rows"], covers="K-01",
)
def gap_examples(spark, sf):
    return Q.gap_examples(prediction_side(spark, sf), view(spark, sf, "eval_rows"), ["dataset", "qid"])


@query(
    "duplicate_line_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1", covers="K-02",
)
def duplicate_line_keys(spark, sf):
    return J.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "column_pair_checks",
    f"""WITH {_PRED}, j AS (SELECT e.dataset, e.capability_code, e.latency_sec, seen_code, seen_latency, group_code, CASE WHEN k % 10 = 0 THEN NULL ELSE group_code END AS seen_group
          FROM eval_rows e JOIN p USING (dataset, qid))
        SELECT dataset, 'capability' AS "check", count(*) FILTER (capability_code IS DISTINCT FROM seen_code) AS offenders FROM j GROUP BY 1
        UNION ALL SELECT dataset, 'group', count(*) FILTER (group_code IS DISTINCT FROM seen_group) FROM j GROUP BY 1
        UNION ALL SELECT dataset, 'latency', count(*) FILTER (abs(latency_sec - seen_latency) > 1e-9) FROM j GROUP BY 1""",
    ["eval_rows"], covers="K-03",
)
def column_pair_checks(spark, sf):
    joined = view(spark, sf, "eval_rows").join(prediction_side(spark, sf), ["dataset", "qid"])
    joined = joined.withColumn("seen_group", F.when(F.col("k") % 10 != 0, F.col("group_code")))
    same = Q.column_pairs(joined, {"capability": ("capability_code", "seen_code"), "group": ("group_code", "seen_group")})
    return same.unionByName(Q.close_pairs(joined, "latency_sec", "seen_latency", "latency"))


@query(
    "run_health",
    """SELECT dataset, 'errors' AS "check", count(*) FILTER (error <> '') AS offenders FROM eval_big GROUP BY 1
       UNION ALL SELECT dataset, 'empty_outputs', count(*) FILTER (trim(raw_model_output) = '') FROM eval_big GROUP BY 1
       UNION ALL SELECT dataset, 'timeouts', count(*) FILTER (timed_out) FROM eval_big GROUP BY 1""",
    ["eval_big"], covers="K-04",
)
def run_health(spark, sf):
    return Q.run_health(view(spark, sf, "eval_big"))


@query(
    "unknown_capabilities",
    "SELECT event_type AS capability_code, count(*) AS n FROM events WHERE event_type NOT IN ("
    + ", ".join(f"'{c}'" for c, _ in LEAVES) + ") GROUP BY 1",
    covers="K-05 B-03",
)
def unknown_capabilities(spark, sf):
    return Q.unknown_capabilities(table(spark, sf, "events").withColumnRenamed("event_type", "capability_code"))


@query(
    "invalid_timestamps",
    """SELECT dataset, 'start' AS "check", count(*) FILTER (k % 7 = 0) AS offenders FROM eval_rows GROUP BY 1
       UNION ALL SELECT dataset, 'end', count(*) FILTER (k % 61 >= 60 OR k % 9 = 0) FROM eval_rows GROUP BY 1""",
    ["eval_rows"], covers="K-06",
)
def invalid_timestamps(spark, sf):
    k = F.col("k")
    df = view(spark, sf, "eval_rows").select(
        "dataset",
        F.when(k % 7 == 0, F.format_string("%d:%d", k, k)).otherwise(F.format_string("%d:%d:%d", k, k % 60, k % 60)).alias("start"),
        F.when(k % 9 == 0, F.lit("soon")).otherwise(F.format_string("0:%d:0.5", k % 61)).alias("end"),
    )
    return Q.invalid_timestamps(df, ["start", "end"])


@query(
    "unexpected_tracks",
    "SELECT track, count(*) AS n FROM windows WHERE track <> 'segment' GROUP BY 1", ["windows"], covers="K-06",
)
def unexpected_tracks(spark, sf):
    return Q.unexpected_tracks(view(spark, sf, "windows"), "segment")


@query(
    "answer_contract",
    """WITH a AS (SELECT CASE WHEN conv_id % 9 = 1 THEN -conv_id ELSE conv_id END AS qID, text AS content, turn - 1.0 AS latency FROM conversations),
            g AS (SELECT qID, count(*) AS n, max(length(trim(content))) AS m, min(latency) AS l, bool_or(trim(content) = '') AS e FROM a GROUP BY 1),
            q AS (SELECT DISTINCT conv_id AS qID FROM conversations)
       SELECT qID, 'missing_answer' AS rule FROM q ANTI JOIN g USING (qID) UNION ALL SELECT qID, 'unknown_id' FROM g ANTI JOIN q USING (qID)
       UNION ALL SELECT qID, 'repeated_id' FROM g WHERE n > 1 UNION ALL SELECT qID, 'content_too_long' FROM g WHERE m > 300
       UNION ALL SELECT qID, 'content_empty' FROM g WHERE e UNION ALL SELECT qID, 'invalid_latency' FROM g WHERE l < 0""",
    covers="K-07",
)
def answer_contract(spark, sf):
    talk = table(spark, sf, "conversations")
    answers = talk.select(
        F.when(F.col("conv_id") % 9 == 1, -F.col("conv_id")).otherwise(F.col("conv_id")).alias("qID"),
        F.col("text").alias("content"), (F.col("turn") - 1.0).cast("double").alias("latency"),
    )
    return Q.answer_contract(talk.select(F.col("conv_id").alias("qID")).distinct(), answers)


def settings(spark, sf):
    doc = F.to_json(F.struct(F.col("p_type").alias("model_name"), F.col("p_size").alias("stride"), (F.col("p_partkey") % 2).alias("limit")))
    return table(spark, sf, "part").select(F.col("p_brand").alias("family"), F.col("p_partkey").cast("string").alias("run"), doc.alias("settings"))


_SETTINGS = """s AS (SELECT p_brand AS family, CAST(p_partkey AS VARCHAR) AS run, u.key, u.value FROM part,
   LATERAL (VALUES ('model_name', p_type), ('stride', CAST(p_size AS VARCHAR)), ('limit', CAST(p_partkey % 2 AS VARCHAR))) u(key, value))"""


@query(
    "settings_conflicts",
    f"""WITH {_SETTINGS} SELECT family, key, count(DISTINCT value) AS values, min(value) AS lowest, max(value) AS highest FROM s
        WHERE key IN ('model_name', 'stride') GROUP BY 1, 2 HAVING count(DISTINCT value) > 1""",
    covers="K-08",
)
def settings_conflicts(spark, sf):
    return Q.settings_conflicts(settings(spark, sf), ["family"], ["model_name", "stride"])


@query(
    "unexpected_settings",
    f"""WITH {_SETTINGS} SELECT run, key, CASE key WHEN 'model_name' THEN 'PROMO' ELSE '1' END AS expected, value AS actual FROM s
        WHERE (key = 'model_name' AND value <> 'PROMO') OR (key = 'limit' AND value <> '1')
        UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'dtype', 'bf16', NULL FROM part""",
    covers="K-08",
)
def unexpected_settings(spark, sf):
    expected = spark.createDataFrame([("model_name", "PROMO"), ("limit", "1"), ("dtype", "bf16")], "key string, value string")
    return Q.unexpected_settings(settings(spark, sf), "run", expected)


@query(
    "rerun_audit",
    """SELECT dataset, count(*) AS unchanged_rows, count(*) FILTER (a <> b) AS judge_mismatches, count(*) FILTER (a > b) AS first_only_correct,
              count(*) FILTER (b > a) AS rerun_only_correct FROM pair_rows WHERE NOT changed GROUP BY 1""",
    ["pair_rows"], covers="K-09 B-08",
)
def rerun_audit(spark, sf):
    return Q.rerun_audit(view(spark, sf, "pair_rows").withColumnsRenamed({"a": "first_correct", "b": "second_correct"}))


@query(
    "isolated_substitution",
    """SELECT dataset, count(*) AS rows, CAST(sum(a) AS BIGINT) AS direct_correct, CAST(sum(b) AS BIGINT) AS rerun_correct,
              CAST(sum(CASE WHEN changed THEN b ELSE a END) AS BIGINT) AS isolated_correct FROM pair_rows GROUP BY 1""",
    ["pair_rows"], covers="B-08",
)
def isolated_substitution(spark, sf):
    rows = J.substitute(view(spark, sf, "pair_rows"), F.col("changed"), F.col("b"), F.col("a"), "isolated")
    return rows.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("a").alias("direct_correct"),
        F.sum("b").alias("rerun_correct"), F.sum("isolated").alias("isolated_correct"),
    )


@query(
    "prompt_contract",
    """SELECT dataset, answer_format, count(*) AS rows, count(*) FILTER (k % 20 = 0) AS offenders, CAST(count(*) FILTER (k % 20 = 0) = 0 AS INT) AS ok
       FROM answer_rows WHERE answer_format IN ('fo_class', 'time') GROUP BY 1, 2""",
    ["answer_rows"], covers="K-14",
)
def prompt_contract(spark, sf):
    df = view(spark, sf, "answer_rows")
    prompt = F.when(F.col("k") % 20 == 0, F.col("question")).otherwise(instruction(F.col("question"), F.col("answer_format")))
    return Q.prompt_contract(df.withColumn("prompt", prompt), {"fo_class": "one or more", "time": "one or more timestamps"})


@query(
    "replacement_violations",
    """SELECT qid AS sample_id, 'other_strategy' AS rule FROM case_rows WHERE ood UNION ALL SELECT qid, 'not_a_count' FROM case_rows WHERE count_value IS NULL""",
    ["case_rows"], covers="K-15",
)
def replacement_violations(spark, sf):
    df = view(spark, sf, "case_rows").select(
        F.col("qid").alias("sample_id"), "question", F.lit("number").alias("answer_format"),
        F.when(F.col("ood"), "direct").otherwise("bbox-json").alias("prompt_strategy"), F.lit("1").alias("prediction"),
    )
    return Q.replacement_violations(df)
