"""Many runs side by side: discovery, question matrix, facets and agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import text
from tallyframe.taxonomy import DATASETS, SPLITS, TRACKS


def describe_runs(files: DataFrame, path: str = "path") -> DataFrame:
    """Run attributes read off the path of a predictions or responses file.

    Smoke runs are left out. The deepest directory that names a dataset wins.
    """
    p = F.col(path)
    run_dir = F.regexp_replace(p, r"/(?:predictions\.parquet|responses\.json).*$", "")
    parts = F.split(run_dir, "/")
    rich = p.rlike(r"/predictions\.parquet")
    epoch = F.regexp_extract(p, r"/(?:eval_)?epoch_(\d+)(?:/|$)", 1)
    where_dataset = F.filter(F.reverse(parts), lambda x: x.isin(*DATASETS))
    where_split = F.filter(F.reverse(parts), lambda x: x.isin(*SPLITS))
    track = F.regexp_extract(p, rf"(?:^|/)track-({'|'.join(TRACKS)}|unified)(?:/|$)", 1)
    method = F.regexp_extract(p, r"(?:^|/)track-[^/]+/([^/]+)/", 1)
    return (
        files.where(p.rlike(r"/(?:predictions\.parquet|responses\.json)(?:/|$)") & ~p.contains("/smoke/"))
        .select(
            run_dir.alias("run"),
            F.when(rich, "rich").otherwise("legacy").alias("kind"),
            F.when(track != "", track).alias("track"),
            F.get(where_dataset, F.lit(0)).alias("dataset"),
            F.get(where_split, F.lit(0)).alias("split"),
            F.when(method != "", method).alias("method"),
            F.when(epoch != "", epoch.cast("int")).alias("epoch"),
        )
        .groupBy("run", "track", "dataset", "split", "method", "epoch")
        # a run that has both files counts as rich
        .agg(F.max("kind").alias("kind"))
    )


META_FIELDS = "model_name string, model string, track string, split string, dataset string"


def with_meta(runs: DataFrame, metas: DataFrame) -> DataFrame:
    """Runs with the metadata of their nearest folder that has a document; its fields override the path's.

    ``metas`` has ``folder`` and the document's text in ``settings``. Every run asks
    for its own folder and all folders above it, and the longest that has a document
    answers; a field that this document leaves out is read off the path. The model's
    name is the document's, else the last part of its model path, else the last part
    of the run's folder that names neither dataset nor epoch; a chosen epoch is added.
    """
    read = metas.select("folder", F.from_json("settings", META_FIELDS).alias("meta")).where("meta is not null")
    above = runs.withColumn("_parts", F.split("run", "/"))
    above = above.select("run", F.explode(F.sequence(F.lit(1), F.size("_parts"))).alias("_n"), "_parts").distinct()
    above = above.select("run", F.array_join(F.slice("_parts", F.lit(1), F.col("_n")), "/").alias("folder"), "_n")
    nearest = above.join(read, "folder").groupBy("run").agg(F.max_by("meta", "_n").alias("_meta"))
    joined = runs.join(nearest, "run", "left")
    given = lambda name: F.nullif(F.col(f"_meta.{name}"), F.lit(""))
    named = F.filter(F.split("run", "/"), lambda x: ~(x.isin(*DATASETS) | x.rlike(r"^(?:eval_)?epoch_\d+$")))
    model = F.coalesce(given("model_name"), F.element_at(F.split(given("model"), "/"), -1), F.element_at(named, -1))
    model = F.when(F.col("epoch").isNotNull(), F.concat(model, F.lit(" (ep"), F.col("epoch").cast("string"), F.lit(")"))).otherwise(model)
    out = joined.withColumns({n: F.coalesce(given(n), F.col(n)) for n in ("track", "split", "dataset")} | {"model_name": model}).drop("_meta")
    return out.withColumn("label", F.concat_ws("/", "method", "model_name"))


def best_epoch_runs(runs: DataFrame, scores: DataFrame) -> DataFrame:
    """Of the epochs of one model only the run with the best accuracy; a tie goes to the later epoch.

    ``scores`` has ``run, accuracy``; a run without a score ranks below all others.
    Runs that name no epoch stay.
    """
    scored = runs.join(scores.select("run", "accuracy"), "run", "left")
    model = F.regexp_replace("run", r"/(?:eval_)?epoch_\d+(?=/|$)", "")
    rest = scored.columns
    order = F.struct(F.coalesce("accuracy", F.lit(-1.0)), "epoch", "run")
    best = scored.where("epoch is not null").groupBy(model.alias("_model")).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return best.select("_r.*").unionByName(scored.where("epoch is null"))


def rebuild_legacy(responses: DataFrame, annotations: DataFrame, requests: DataFrame) -> DataFrame:
    """Response-only runs joined back to annotations and requests, with defaults."""
    ann = annotations.select(
        "dataset",
        "qid",
        F.col("question").alias("_q"),
        F.col("video").alias("_v"),
        "answer_format",
        "primary_capability",
        "answer",
        "ood",
        "clinical",
    )
    req = requests.select("dataset", "qid", F.col("question").alias("_rq"), F.col("video").alias("_rv"))
    joined = responses.join(ann, ["dataset", "qid"], "left").join(req, ["dataset", "qid"], "left")
    return joined.select(
        "dataset",
        "qid",
        F.coalesce(F.when(F.col("_q") != "", F.col("_q")), F.col("_rq"), F.lit("")).alias("question"),
        F.coalesce(F.when(F.col("_v") != "", F.col("_v")), F.col("_rv")).alias("video"),
        F.coalesce("answer_format", F.lit("open_ended")).alias("answer_format"),
        "primary_capability",
        "answer",
        F.coalesce("ood", F.lit(False)).alias("ood"),
        F.coalesce("clinical", F.lit(False)).alias("clinical"),
        F.col("content").alias("prediction"),
        "latency",
    )


def question_matrix(preds: DataFrame, runs: Sequence[str], keys: Sequence[str] = ("dataset", "qid")) -> DataFrame:
    """One row per question, prediction and correctness of every run as columns.

    Question text comes from the first run that has it. The run list is
    explicit, so the pivot needs no extra pass.
    """
    info = [F.min_by(c, "run_no").alias(c) for c in ("question", "answer", "answer_format") if c in preds.columns]
    cells = []
    for run in runs:
        here = F.col("run") == run
        cells += [
            F.max(F.when(here, F.col("prediction"))).alias(f"{run}_prediction"),
            F.max(F.when(here, F.col("correct"))).alias(f"{run}_correct"),
        ]
    return preds.groupBy(*keys).agg(*info, *cells)


def agreement(preds: DataFrame, keys: Sequence[str] = ("dataset", "qid"), focus: str | None = None) -> DataFrame:
    """Per question: do all runs agree, and how.

    A run without a verdict counts for the distinct predictions only.
    """
    known = F.col("correct").isNotNull()
    said = F.lower(text.clean(F.coalesce("prediction", F.lit(""))))
    out = preds.groupBy(*keys).agg(
        F.count_if(known).alias("judged_runs"),
        F.sum(F.when(known, F.col("correct"))).alias("correct_runs"),
        F.count_distinct(said).alias("distinct_predictions"),
        F.max(F.when((F.col("run") == focus) & (F.col("correct") == 0), 1).otherwise(0)).alias("focus_wrong")
        if focus
        else F.lit(0).alias("focus_wrong"),
    )
    some = F.col("judged_runs") > 0
    return out.withColumns(
        {
            "all_correct": (some & (F.col("correct_runs") == F.col("judged_runs"))).cast("int"),
            "all_wrong": (some & (F.col("correct_runs") == 0)).cast("int"),
            "disagree": (F.col("distinct_predictions") > 1).cast("int"),
        }
    )


def facet_filter(
    df: DataFrame,
    term: str | None = None,
    answer_format: str | None = None,
    capability: str | None = None,
    video: str | None = None,
    ood: bool | None = None,
    clinical: bool | None = None,
) -> DataFrame:
    """Rows that match every facet given."""
    out = df
    if term:
        out = out.where(F.lower("question").contains(" ".join(term.lower().split())))
    for column, value in (
        ("answer_format", answer_format),
        ("capability_code", capability),
        ("video", video),
        ("ood", ood),
        ("clinical", clinical),
    ):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out


def has_capability(code: str, scope: str = "primary") -> Column:
    """A one-digit code matches its group, any other code matches exactly."""
    codes = F.array(F.col("capability_code"))
    if scope == "tagged":
        codes = F.array_union(codes, F.coalesce("secondary_capabilities", F.array().cast("array<string>")))
    if len(code) == 1:
        return F.exists(codes, lambda c: c.startswith(code))
    return F.array_contains(codes, code)


def capability_scores(df: DataFrame, keys: Sequence[str], scope: str = "tagged") -> DataFrame:
    """Assigned, evaluated, correct and wrong per run and capability, groups included.

    A row counts once per distinct code and once per distinct group.
    """
    codes = F.array(F.col("capability_code"))
    if scope == "tagged":
        codes = F.array_union(codes, F.coalesce("secondary_capabilities", F.array().cast("array<string>")))
    groups = F.transform(codes, lambda c: F.substring(c, 1, 1))
    rows = df.select(*keys, "correct", F.explode(F.array_distinct(F.concat(codes, groups))).alias("code"))
    out = rows.groupBy(*keys, "code").agg(
        F.count(F.lit(1)).alias("assigned"),
        F.count("correct").alias("evaluated"),
        F.count_if(F.col("correct") == 1).alias("correct"),
        F.count_if(F.col("correct") == 0).alias("wrong"),
    )
    return out.withColumn("accuracy", F.when(F.col("evaluated") > 0, F.col("correct") / F.col("evaluated")))


def run_order(runs: DataFrame) -> DataFrame:
    """Track, split, dataset, best accuracy first, label."""
    return runs.orderBy("track", "split", "dataset", F.desc(F.coalesce("accuracy", F.lit(0.0))), "label")


def extremes(metrics: DataFrame, name: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Weakest and strongest entry by mean score; ties by name."""
    means = metrics.where(F.col(score).isNotNull()).groupBy(*keys, name).agg(F.avg(score).alias("_m"))
    out = means.groupBy(*keys).agg(
        F.min(F.struct("_m", name)).alias("_w"), F.max(F.struct("_m", name)).alias("_s")
    )
    return out.select(
        *keys,
        F.col(f"_w.{name}").alias("weakest"),
        F.col("_w._m").alias("weakest_score"),
        F.col(f"_s.{name}").alias("strongest"),
        F.col("_s._m").alias("strongest_score"),
    )
