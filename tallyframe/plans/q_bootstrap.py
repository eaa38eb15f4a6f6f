"""Queries: bootstrap intervals and the ranking of runs.

Draws are hashes, so the SQL repeats them. Chances of binomial counts come from
``lgamma`` there, term by term.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from tallyframe.operators import bootstrap as B
from tallyframe.operators import compare as C
from tallyframe.plans.q_compare import _PAIR_FLOATS, _contingency
from tallyframe.plans.q_metrics import cells
from tallyframe.plans.registry import query
from tallyframe.plans.views import table, view

_UNIT = "(('0x' || substr({h}, {at}, 13))::UBIGINT / 4503599627370496::DOUBLE)"
_CHANCE = "CASE WHEN {x} < 0 OR {x} > {n} THEN 0 ELSE exp(lgamma({n} + 1) - lgamma({x} + 1) - lgamma({n} - {x} + 1) + {x} * ln({p}) + ({n} - {x}) * ln(1 - {p})) END"


def _draws(keys: Sequence[str], reps: int, three: bool, shard: int, seed: int = 42) -> str:
    """CTEs after ``o`` (videos with slot and size): draws per shard, then each draw's slot and digest.

    ``three`` draws share half a digest, else each has its own.
    """
    step, pick = "j", f"('0x' || substr(h, 1, 13))::UBIGINT::BIGINT % m"
    if three:
        step, pick = "((j - 1) // 3 + 2) // 2", "(('0x' || substr(h, CASE WHEN (j - 1) // 3 % 2 = 0 THEN 1 ELSE 17 END, 15))::UBIGINT::BIGINT // (m ** ((j - 1) % 3))::BIGINT) % m"
    k = ", ".join(keys)
    head = f"'{seed}|' || " + " || '|' || ".join(keys)
    chance = lambda x: _CHANCE.format(x=f"({x})", n="draws", p="p")
    return f"""
  tree AS (
    SELECT DISTINCT {k}, rep, size, 0::BIGINT AS low, ceil(size / {shard})::BIGINT AS high, size AS draws FROM o, range({reps}) r(rep)
    UNION ALL
    SELECT {k}, rep, size, CASE side WHEN 0 THEN low ELSE mid END, CASE side WHEN 0 THEN mid ELSE high END, CASE side WHEN 0 THEN hit ELSE draws - hit END
    FROM (
      SELECT *, CASE WHEN draws = 0 THEN 0 ELSE coalesce(list_reduce(list_prepend({{'i': 0::BIGINT, 'rest': u - c, 'hit': CASE WHEN u < c THEN m END}},
          list_transform(range(1, w + 1), lambda i: {{'i': i, 'rest': 0::DOUBLE, 'hit': NULL::BIGINT}})),
          lambda a, b: {{'i': b.i, 'rest': a.rest - ({chance('m + b.i')}) - ({chance('m - b.i')}),
                         'hit': coalesce(a.hit, CASE WHEN a.rest < {chance('m + b.i')} THEN m + b.i WHEN a.rest - ({chance('m + b.i')}) < {chance('m - b.i')} THEN m - b.i END)}}).hit, m) END AS hit
      FROM (SELECT *, {chance('m')} AS c FROM (
        SELECT *, least(floor((draws + 1) * p)::BIGINT, draws) AS m, ceil(9 * sqrt(draws * p * (1 - p)))::BIGINT + 12 AS w FROM (
          SELECT {k}, rep, size, low, high, draws, (low + high) // 2 AS mid, {_UNIT.format(h=f"md5({head} || '|' || rep || '|split|' || low || '|' || high)", at=1)} AS u,
                 ((low + high) // 2 - low) * {shard} / (least(high * {shard}, size) - low * {shard}) AS p FROM tree WHERE high - low > 1)))),
      (VALUES (0), (1)) s(side)
  ),
  dealt AS (SELECT {k}, rep, size, low AS shard, unnest(range(1, draws + 1)) AS j FROM tree WHERE high - low <= 1 AND draws > 0),
  hashed AS (SELECT {k}, rep, size, shard, j, least({shard}, size - shard * {shard}) AS m, md5({head} || '|' || rep || '|' || shard || '|' || {step}) AS h FROM dealt),
  p AS (SELECT {k}, rep, size, h, shard * {shard} + {pick} AS slot FROM hashed)"""


def _numbered(keys: Sequence[str], source: str) -> str:
    k = ", ".join(keys)
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY md5('video|' || video)) - 1 AS slot, count(*) OVER (PARTITION BY {k}) AS size FROM {source})"""


def _paired_ci(reps: int, shard: int = B.SHARD) -> str:
    return f"""WITH RECURSIVE v AS (SELECT dataset, video, sum(CAST(k % 3 > 0 AS INT)) / count(*) - sum(correct) / count(*) AS d FROM eval_rows GROUP BY 1, 2),
  {_numbered(["dataset"], "v")}, {_draws(["dataset"], reps, three=True, shard=shard)},
  m AS (SELECT p.dataset, p.rep, sum(o.d) / any_value(p.size) AS mean FROM p JOIN o ON o.dataset = p.dataset AND o.slot = p.slot GROUP BY 1, 2)
  SELECT dataset, quantile_cont(mean, 0.025) AS ci_low, quantile_cont(mean, 0.975) AS ci_high FROM m GROUP BY 1"""


def _two_level(keys: Sequence[str], source: str, reps: int, shard: int = B.SHARD) -> str:
    """CTEs that end in ``m``: (keys, rep, accuracy) of the two-level bootstrap of ``source`` (keys, video, correct)."""
    k = ", ".join(keys)
    same = " AND ".join(f"{{0}}.{c} = {{1}}.{c}" for c in keys)
    return f"""v AS (SELECT {k}, video, count(*) AS n, sum(correct)::BIGINT AS k FROM {source} GROUP BY ALL),
  {_numbered(keys, "v")}, {_draws(keys, reps, three=False, shard=shard)},
  span AS (SELECT *, k / n AS q, CASE WHEN k IN (0, n) THEN k ELSE greatest(mode - wide, 0) END AS low, CASE WHEN k IN (0, n) THEN k ELSE least(mode + wide, n) END AS high
           FROM (SELECT *, least(floor((n + 1) * (k / n))::BIGINT, n) AS mode, ceil(9 * sqrt(n * (k / n) * (1 - k / n)))::BIGINT + 12 AS wide FROM o)),
  x AS (SELECT *, unnest(range(low, high + 1)) AS x FROM span),
  upto AS (SELECT *, sum(CASE WHEN k IN (0, n) THEN 1 ELSE {_CHANCE.format(x='x', n='n', p='q')} END) OVER (PARTITION BY {k}, slot ORDER BY x ROWS UNBOUNDED PRECEDING) AS c FROM x),
  ch AS (SELECT {k}, slot, any_value(n) AS n, any_value(low) AS low, list(c ORDER BY x) AS cs FROM upto GROUP BY {k}, slot),
  m AS (SELECT {", ".join(f"p.{c}" for c in keys)}, p.rep,
               sum((ch.low + least(len(list_filter(cs, lambda c: c <= {_UNIT.format(h='p.h', at=17)})), len(cs) - 1)) / ch.n) / any_value(p.size) AS accuracy
        FROM p JOIN ch ON {same.format('p', 'ch')} AND p.slot = ch.slot GROUP BY ALL)"""


def paired_events(spark, sf):
    """Two verdicts per event question: few videos, so full replicate counts stay cheap."""
    df = view(spark, sf, "eval_rows").withColumn("a", F.col("correct")).withColumn("b", (F.col("k") % 3 > 0).cast("int"))
    return C.paired_cells(df, ["dataset"])


@query("paired_video_interval", _paired_ci(10_000), ["eval_rows"], ("ci_low", "ci_high"), "I-02")
def paired_video_interval(spark, sf):
    keys = ["dataset"]
    return B.paired_interval(C.video_differences(paired_events(spark, sf), keys), keys, reps=10_000)


@query(
    "paired_slice_report",
    "WITH e AS (SELECT dataset, video, correct AS a, CAST(k % 3 > 0 AS INT) AS b FROM eval_rows), c AS ("
    + _contingency("SELECT * FROM e", "dataset")
    + f") SELECT c.*, ci_low, ci_high FROM c JOIN ({_paired_ci(2000, shard=20)}) i USING (dataset)",
    ["eval_rows"], (*_PAIR_FLOATS, "ci_low", "ci_high"), "I-03",
)
def paired_slice_report(spark, sf):
    return B.paired_slices(paired_events(spark, sf), ["dataset"], reps=2000, shard=20)


@query(
    "cluster_bootstrap_interval",
    f"""WITH RECURSIVE {_two_level(["dataset"], "eval_rows", 1000)}
    SELECT dataset, quantile_cont(accuracy, 0.025) AS ci_low, quantile_cont(accuracy, 0.975) AS ci_high FROM m GROUP BY 1""",
    ["eval_rows"], ("ci_low", "ci_high"), "I-01",
)
def cluster_bootstrap_interval(spark, sf):
    return B.bootstrap_interval(cells(spark, sf), ["dataset"], reps=1000)


_RUNS = "(SELECT concat('run', l_linenumber) AS run, l_returnflag || l_linestatus AS bucket, l_suppkey AS video, CAST(round(l_discount * 100) >= 4 + l_linenumber % 3 AS INT) AS correct FROM lineitem)"


@query(
    "run_ranking",
    f"""WITH RECURSIVE {_two_level(["run", "bucket"], _RUNS, 200)},
     r AS (SELECT run, bucket, rep, round(accuracy, 9) AS a FROM m),
     b AS (SELECT x.run, y.run AS other, bucket, CASE WHEN avg(CAST(x.a > y.a AS INT)) >= 0.975 THEN 1 WHEN avg(CAST(x.a < y.a AS INT)) >= 0.975 THEN -1 ELSE 0 END AS v
           FROM r x JOIN r y USING (bucket, rep) WHERE x.run <> y.run GROUP BY 1, 2, 3),
     d AS (SELECT run, other, sum(v) AS margin FROM b GROUP BY 1, 2),
     c AS (SELECT run, sum(CASE WHEN margin > 0 THEN 1.0 WHEN margin = 0 THEN 0.5 ELSE 0 END)::DOUBLE AS copeland, count(*) FILTER (margin > 0) AS wins, count(*) FILTER (margin < 0) AS losses FROM d GROUP BY 1),
     s AS (SELECT run, rep, round(avg(accuracy), 9) AS score FROM m GROUP BY 1, 2),
     t AS (SELECT *, score = max(score) OVER (PARTITION BY rep) AS top FROM s),
     u AS (SELECT run, avg(share) AS win_rate FROM (SELECT run, CASE WHEN top THEN 1 / count(*) FILTER (top) OVER (PARTITION BY rep) ELSE 0 END AS share FROM t) GROUP BY 1)
     SELECT run, copeland, wins, losses, win_rate, row_number() OVER (ORDER BY copeland DESC, round(win_rate, 9) DESC, run)::INT AS place FROM c JOIN u USING (run)""",
    floats=("copeland", "win_rate"), covers="I-24 I-01",
)
def run_ranking(spark, sf):
    line = table(spark, sf, "lineitem")
    right = F.round(F.col("l_discount") * 100) >= 4 + F.col("l_linenumber") % 3
    rows = line.select(
        F.concat(F.lit("run"), F.col("l_linenumber").cast("string")).alias("run"), F.concat("l_returnflag", "l_linestatus").alias("bucket"),
        F.col("l_suppkey").alias("video"), right.cast("bigint").alias("correct"),
    )
    counts = rows.groupBy("run", "bucket", "video").agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("k"))
    return C.run_ranking(B.bootstrap_replicates(counts, ["run", "bucket"], reps=200))
