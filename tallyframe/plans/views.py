"""Evaluation-shaped views over the test tables.

The text of a view is plain SQL that Spark and the SQL oracle both run, so
both sides of a check start from the same rows. Names in braces are tables or
other views, and ``<<each n: ..>>`` repeats a row per listed value.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _hms(x: str) -> str:
    """``HH:MM:SS`` text of a whole number of seconds."""
    def two(e: str) -> str:
        return f"lpad(CAST(CAST({e} AS BIGINT) AS STRING), 2, '0')"

    return f"concat({two(f'floor(({x}) / 3600)')}, ':', {two(f'floor((({x}) % 3600) / 60)')}, ':', {two(f'({x}) % 60')})"


VIEWS = {
    # scored questions of two datasets; one video per user
    "eval_rows": """
        SELECT event_id AS qid,
               CASE WHEN user_id % 2 = 0 THEN 'heico' ELSE 'lapchole' END AS dataset,
               concat('v', CAST(user_id AS STRING)) AS video,
               user_id, ts, k,
               CASE event_type WHEN 'click' THEN '1a' WHEN 'view' THEN '1c' WHEN 'purchase' THEN '2a'
                 WHEN 'signup' THEN '3a' ELSE '4c' END AS capability_code,
               CASE event_type WHEN 'click' THEN '1' WHEN 'view' THEN '1' WHEN 'purchase' THEN '2'
                 WHEN 'signup' THEN '3' ELSE '4' END AS group_code,
               CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN '2a|3b' WHEN 2 THEN '5c' ELSE '1b|2a|5a' END
                 AS secondary_text,
               CASE event_id % 6 WHEN 0 THEN 'number' WHEN 1 THEN 'time' WHEN 2 THEN 'fo_class'
                 WHEN 3 THEN 'binary' WHEN 4 THEN 'multiple_choice' ELSE 'percentage' END
                 AS answer_format,
               CASE WHEN k % 5 = 0 THEN 'manual' ELSE 'automatic' END AS generation,
               event_id % 7 = 0 AS ood,
               event_id % 11 = 0 AS clinical,
               value > 200 AS timed_out,
               value AS latency_sec,
               CASE WHEN k = 13 THEN 'decode error' ELSE '' END AS error,
               CASE WHEN (k * 7 + event_id) % 5 < 3 THEN 1 ELSE 0 END AS correct
        FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) e
    """,
    # the same questions with texts in every answer format
    "answer_rows": f"""
        SELECT qid, dataset, video, capability_code, group_code, answer_format, ood, clinical,
               generation, timed_out, latency_sec, error, k,
               CASE WHEN answer_format = 'multiple_choice' AND k % 3 = 0
                      THEN 'Where are they? Please select none, one or multiple answers: top/left; top; bottom.'
                    WHEN answer_format = 'multiple_choice'
                      THEN 'Where is it? Please select one answer: top/left; top; bottom.'
                    WHEN answer_format = 'number' THEN 'How many Clips appear in this frame? Please provide a number.'
                    WHEN answer_format = 'binary' THEN 'Is a clip present? Please answer with yes or no.'
                    WHEN answer_format = 'time' THEN 'When? Answer as hh:mm:ss.'
                    WHEN answer_format = 'percentage' THEN 'What share? Use the format xx%.'
                    ELSE 'Which objects? Please provide the class names or answer with none.' END AS question,
               CASE answer_format
                 WHEN 'number' THEN CAST(k % 9 AS STRING)
                 WHEN 'percentage' THEN concat(CAST(k AS STRING), '.5')
                 WHEN 'binary' THEN CASE WHEN k % 2 = 0 THEN 'yes' ELSE 'No ' END
                 WHEN 'time' THEN CASE WHEN k % 5 = 0
                   THEN concat({_hms('k * 37')}, ', ', {_hms('k * 37 + 90')}) ELSE {_hms('k * 37')} END
                 WHEN 'fo_class' THEN CASE k % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'Clip'
                   WHEN 2 THEN 'Specimen Bag, Clip' WHEN 3 THEN 'Specimen' ELSE 'Sponge, Needle' END
                 ELSE CASE k % 3 WHEN 0 THEN 'top/left, bottom' WHEN 1 THEN 'top' ELSE 'bottom' END END AS answer,
               CASE answer_format
                 WHEN 'number' THEN CASE WHEN k % 17 = 0 THEN 'cannot tell'
                   ELSE concat('There are ', CAST(greatest(k % 9 + qid % 3 - 1, 0) AS STRING), '   of 12') END
                 WHEN 'percentage' THEN CASE WHEN k % 13 = 0 THEN 'half of it'
                   ELSE concat('about ', CAST(k + qid % 2 AS STRING), '.5 %') END
                 WHEN 'binary' THEN CASE qid % 5 WHEN 0 THEN 'Yes.' WHEN 1 THEN 'no' WHEN 2 THEN 'It is not present'
                   WHEN 3 THEN 'None, I know' ELSE 'maybe' END
                 WHEN 'time' THEN CASE WHEN k % 11 = 0 THEN 'later'
                   WHEN k % 3 = 0 THEN concat('at ', {_hms('k * 37 + qid % 9')}, ' and 0:1:5')
                   ELSE concat('at ', {_hms('k * 37 + qid % 9')}, '!') END
                 WHEN 'fo_class' THEN CASE qid % 7 WHEN 0 THEN 'Nothing here' WHEN 1 THEN 'a clip.'
                   WHEN 2 THEN 'clip and specimen bag' WHEN 3 THEN 'Specimen  Bag and specimen'
                   WHEN 4 THEN 'sponge, NEEDLE' WHEN 5 THEN '' ELSE 'a grasper' END
                 ELSE CASE qid % 5 WHEN 0 THEN 'It is Top/Left and bottom' WHEN 1 THEN 'top' WHEN 2 THEN 'none of these'
                   WHEN 3 THEN 'the bottom' ELSE 'unsure' END END AS raw_model_output,
               CASE answer_format
                 WHEN 'number' THEN CASE WHEN k % 17 = 0 THEN 'cannot tell'
                   ELSE CAST(greatest(k % 9 + qid % 3 - 1, 0) AS STRING) END
                 WHEN 'percentage' THEN CASE WHEN k % 13 = 0 THEN 'half of it'
                   ELSE concat(CAST(k + qid % 2 AS STRING), '.5') END
                 WHEN 'binary' THEN CASE qid % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'yes'
                   WHEN 3 THEN 'no' ELSE 'maybe' END
                 WHEN 'time' THEN CASE WHEN k % 11 = 0 THEN 'later'
                   WHEN k % 3 = 0 THEN concat({_hms('k * 37 + qid % 9')}, ', 00:01:05')
                   ELSE {_hms('k * 37 + qid % 9')} END
                 WHEN 'fo_class' THEN CASE qid % 7 WHEN 0 THEN 'none' WHEN 1 THEN 'Clip'
                   WHEN 2 THEN 'Clip, Specimen Bag' WHEN 3 THEN 'Specimen Bag, Specimen'
                   WHEN 4 THEN 'Sponge, Needle' WHEN 5 THEN 'none' ELSE 'a grasper' END
                 ELSE CASE qid % 5 WHEN 0 THEN 'top/left' WHEN 1 THEN 'top' WHEN 2 THEN 'none of these'
                   WHEN 3 THEN 'bottom' ELSE 'unsure' END END AS prediction,
               CAST(k % 400 AS DOUBLE) AS duration,
               correct
        FROM {{eval_rows}}
    """,
    # a wide fact table of scored rows
    "eval_big": """
        SELECT CASE l_linestatus WHEN 'F' THEN 'heico' ELSE 'lapchole' END AS dataset,
               concat('v', CAST(l_suppkey AS STRING)) AS video,
               CASE l_returnflag WHEN 'A' THEN '1a' WHEN 'N' THEN '2b' ELSE '3a' END AS capability_code,
               CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN '2' ELSE '3' END AS group_code,
               CASE WHEN l_linenumber <= 2 THEN 'number' WHEN l_linenumber <= 4 THEN 'binary'
                 ELSE 'time' END AS answer_format,
               CASE WHEN l_linenumber % 2 = 0 THEN 'manual' ELSE 'automatic' END AS generation,
               l_tax >= 0.06 AS ood,
               l_quantity > 25 AS clinical,
               l_extendedprice > 80000 AS timed_out,
               l_quantity AS latency_sec,
               CASE WHEN l_tax = 0.08 THEN 'late' ELSE '' END AS error,
               CASE WHEN l_discount = 0.1 THEN '  ' ELSE 'x' END AS raw_model_output,
               CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS correct
        FROM {lineitem}
    """,
    # two runs over the same questions
    "pair_rows": """
        SELECT o_orderkey AS qid, concat('v', CAST(o_custkey AS STRING)) AS video,
               CASE o_orderstatus WHEN 'F' THEN 'heico' ELSE 'lapchole' END AS dataset,
               substr(o_orderpriority, 1, 1) AS group_code,
               CASE WHEN o_orderkey % 3 = 0 THEN 'number' WHEN o_orderkey % 3 = 1 THEN 'binary'
                 ELSE 'time' END AS answer_format,
               CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS a,
               CASE WHEN month(o_orderdate) % 2 = 0 OR o_totalprice > 400000 THEN 1 ELSE 0 END AS b,
               o_custkey % 3 = 0 AS changed
        FROM {orders}
    """,
    # two verdicts per document, grouped by source and language
    "pair_docs": """
        SELECT d.doc_id AS qid, d.source AS video, d.lang AS dataset, l.quality AS a, l.toxic AS b
        FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id
    """,
    # questions with a time window
    "windows": """
        SELECT o_orderkey AS qid, concat('v', CAST(o_custkey AS STRING), '.mp4') AS video,
               CASE o_orderstatus WHEN 'F' THEN 'heico' ELSE 'lapchole' END AS dataset,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'frame' WHEN '2' THEN 'segment'
                 WHEN '3' THEN 'segment' ELSE 'procedure' END AS track,
               CAST(o_orderkey % 5000 AS DOUBLE) / 2 AS start_s,
               CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN CAST(o_orderkey % 5000 AS DOUBLE) / 2
                 ELSE CAST(o_orderkey % 5000 AS DOUBLE) / 2 + (o_custkey % 400) END AS end_s
        FROM {orders}
    """,
    "sampling": """
        SELECT * FROM (VALUES
          ('frame', 'heico', 25, 25, 1, 602112), ('frame', 'lapchole', 30, 30, 1, 602112),
          ('segment', 'heico', 25, 25, 64, 262144), ('segment', 'lapchole', 30, 30, 64, 262144),
          ('procedure', 'heico', 25, 250, 96, 131072), ('procedure', 'lapchole', 30, 300, 96, 131072))
          AS s(track, dataset, fps, stride, max_frames, max_pixels)
    """,
    "frame_counts": """
        SELECT dataset, concat('v', CAST(c_custkey AS STRING), '.mp4') AS video,
               40000 + (c_custkey * 97) % 30000 AS frame_count
        FROM {customer} <<each dataset: 'heico', 'lapchole'>>
    """,
    # several views of one counting question
    "views_long": """
        SELECT concat('s', CAST(user_id AS STRING), '-', substr(CAST(date_trunc('week', ts) AS STRING), 1, 10))
                 AS sample_id,
               dataset, video, user_id % 6 AS gold,
               CASE qid % 8 WHEN 0 THEN 'whole' WHEN 1 THEN 'hflip' WHEN 2 THEN 'vflip' WHEN 3 THEN 'zoom'
                 WHEN 4 THEN 'tile:top-left' WHEN 5 THEN 'tile:top-right' WHEN 6 THEN 'tile:bottom-left'
                 ELSE 'tile:bottom-right' END AS view_id,
               CASE WHEN qid % 8 < 4 THEN CAST((user_id + k) % 6 AS STRING) ELSE CAST(k % 3 AS STRING) END AS value
        FROM {eval_rows}
    """,
    "class_views": """
        SELECT sample_id, dataset, gold,
               view_id,
               CASE value WHEN '0' THEN 'none' WHEN '1' THEN 'Clip' WHEN '2' THEN 'Clip, Sponge'
                 WHEN '3' THEN 'Needle' WHEN '4' THEN 'Sponge, Mesh, Clip' ELSE '' END AS value
        FROM {views_long}
    """,
    # predicted and true counts with a template
    "counts": """
        SELECT concat('v', CAST(l_suppkey AS STRING)) AS video, l_linenumber % 5 AS template_id,
               CAST(l_quantity AS INT) % 8 AS pred,
               (CAST(l_quantity AS INT) + CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE 1 END) % 8 AS target
        FROM {lineitem}
    """,
    # questions on single frames, several per (video, timestamp)
    "case_rows": """
        SELECT qid, dataset, concat('c', CAST(user_id % 40 AS STRING), '.mp4') AS video,
               CAST(date_trunc('day', ts) AS STRING) AS timestamp,
               capability_code, ood, clinical,
               CASE WHEN capability_code = '1a' AND k % 2 = 0 THEN 'How many Clips appear in this frame? Please count.'
                    WHEN capability_code = '1a' THEN 'How many specimen bags appear in this frame?'
                    WHEN capability_code = '1c' AND k % 2 = 0
                      THEN 'How many different foreign object instances appear in this frame?'
                    WHEN capability_code = '1c' THEN 'How many different foreign object classes appear in this frame?'
                    WHEN capability_code = '2a' AND k % 3 = 0 THEN 'There is one surgical foreign object visible. Which?'
                    WHEN capability_code = '2a' THEN 'Please list all foreign objects.'
                    WHEN capability_code = '3a' AND k % 2 = 0 THEN 'Which object is to the image centre closest?'
                    WHEN capability_code = '3a' THEN 'In which quadrant is the needle?'
                    WHEN k % 2 = 0 THEN 'Which objects co-occur?'
                    ELSE 'What happens next?' END AS question,
               CASE WHEN capability_code IN ('1a', '1c') THEN CAST(k % 9 AS STRING)
                    WHEN capability_code = '2a' AND k % 3 = 0
                      THEN CASE WHEN k % 2 = 0 THEN 'Gallstone' ELSE 'Needles' END
                    WHEN capability_code = '2a' THEN CASE k % 4 WHEN 0 THEN 'none'
                      WHEN 1 THEN 'Clip, sponges' ELSE 'Specimen Bag, Specimen, External Drain, mesh' END
                    WHEN k % 2 = 0 THEN 'Clip' ELSE 'the silicone loop' END AS answer,
               CASE WHEN capability_code IN ('1a', '1c') THEN k % 9 END AS count_value
        FROM {eval_rows}
    """,
    # cases, questions, annotations and boxes for box checks
    "box_cases": """
        SELECT concat('case-', CAST(o_orderkey AS STRING)) AS case_id, o_orderkey AS rank,
               CAST(floor((o_orderkey) / 100) AS BIGINT) + 1 AS batch,
               CASE o_orderstatus WHEN 'F' THEN 'heico' ELSE 'lapchole' END AS dataset,
               960 AS image_width, 540 AS image_height
        FROM {orders}
    """,
    "box_notes": """
        SELECT concat('case-', CAST(o_orderkey AS STRING)) AS case_id,
               CASE o_custkey % 6 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'skipped'
                 WHEN 3 THEN 'bogus' ELSE 'complete' END AS status,
               o_custkey % 9 = 0 AS no_foreign_objects,
               o_orderkey % 4 > 0 AS checked,
               CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE 'seen' END AS notes,
               o_custkey % 5 AS revision,
               substr(CAST(o_orderdate AS STRING), 1, 10) AS updated_at
        FROM {orders}
    """,
    "box_rows": """
        SELECT concat('case-', CAST(l_orderkey AS STRING)) AS case_id,
               (CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey) * 1000000 + l_suppkey AS box_no,
               CASE WHEN l_suppkey % 50 = 0 THEN concat('b ', CAST(l_partkey AS STRING))
                 ELSE concat('b', CAST(l_partkey % 60 AS STRING)) END AS box_id,
               CASE WHEN l_suppkey % 40 = 7 THEN 'Grasper' WHEN l_returnflag = 'A' THEN 'Clip'
                 WHEN l_returnflag = 'N' THEN 'sponges' ELSE 'Needle' END AS class_name,
               CAST(l_partkey % 950 AS DOUBLE) + CAST(0.0625 AS DOUBLE) AS x, CAST(l_suppkey % 500 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS y,
               l_quantity AS width, CAST(l_linenumber * 10 AS DOUBLE) AS height,
               l_tax = 0.0 AS difficult, l_discount = 0.0 AS uncertain
        FROM {lineitem}
    """,
    "box_questions": """
        SELECT concat('case-', CAST(o_orderkey AS STRING)) AS case_id, o_orderkey * 10 + n AS qid,
               CASE n WHEN 0 THEN 'How many different foreign object instances appear in this frame?'
                 WHEN 1 THEN 'How many different foreign object classes appear in this frame?'
                 WHEN 2 THEN 'How many Clips appear in this frame?'
                 WHEN 3 THEN 'Please list all foreign objects.'
                 WHEN 4 THEN 'There is one surgical foreign object visible. Which one?'
                 ELSE 'Which object is to the frame center closest?' END AS question,
               CASE n WHEN 0 THEN CAST(o_custkey % 6 AS STRING) WHEN 1 THEN CAST(o_custkey % 3 + 1 AS STRING)
                 WHEN 2 THEN CAST(o_custkey % 3 AS STRING)
                 WHEN 3 THEN CASE o_custkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'Clip, Needle'
                   WHEN 2 THEN 'clips, Sponge, needle' ELSE 'Sponge' END
                 WHEN 4 THEN 'Clip' ELSE CASE WHEN o_custkey % 2 = 0 THEN 'Clip' ELSE 'the needle' END END AS answer
        FROM {orders} <<each n: 0, 1, 2, 3, 4, 5>>
    """,
    # raw model texts with boxes in many dialects; the expected reading is known
    "detect_rows": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, shape, cls, mode, target, x, y, bad,
               CASE shape
                 WHEN 0 THEN concat('{{"objects":[{{"label":"', cls, '","bbox_2d":[', x, ',', y, ',', x2, ',', y2,
                   ']}},{{"label":"Mesh","bbox_2d":[1,2,3,4]}}]}}')
                 WHEN 1 THEN concat('Here: ```json ', '{{"detections":[{{"class":"', cls, '","box":[', x, ',', y, ',', x2, ',', y2,
                   ']}}]}}', ' ``` done')
                 WHEN 2 THEN concat('{{''objects'':[{{''label'':''', cls, 's'',''bbox'':[', x, ',', y, ',', x2, ',', y2, ']}}]}}')
                 WHEN 3 THEN concat('I see [{{"name":"', cls, '","bounding_box":{{"x1":', x, ',"y1":', y, ',"x2":', x2, ',"y2":', y2,
                   '}}}}] in view')
                 WHEN 4 THEN concat('{{label: ''', cls, ''', bbox_2d: [', x, ', ', y, ', ', x2, ', ', y2, ']}}')
                 WHEN 5 THEN 'There are 7 clips.'
                 WHEN 7 THEN concat('I see {{''objects'': [{{''label'': ''', cls, ''', ''bbox'': [', x, ', ', y, ', ', x2, ', ', y2, ']}}]}} here')
                 WHEN 8 THEN concat('{{"objects": [], "objects": [{{"label": "', cls, '", "bbox": [', x, ',', y, ',', x2, ',', y2, ']}}]}}')
                 WHEN 9 THEN concat('[{{''label'': "the patient''s ', cls, '", ''bbox'': (', x, ', ', y, ', ', x2, ', ', y2, ')}}]')
                 WHEN 10 THEN concat('note {{"x": [[[[[[[[[[1]]]]]]]]]], "items": [{{"label": "', cls, '", "bbox": [', x, ',', y, ',', x2, ',', y2, ']}}]}} end')
                 ELSE '{{"objects": 3}}' END AS raw_model_output
        FROM (SELECT *, CASE WHEN bad THEN CAST(CAST(x AS INT) - 1 AS STRING) ELSE CAST(CAST(x AS INT) + 40 AS STRING) END AS x2,
                     CAST(CAST(y AS INT) + 30 AS STRING) AS y2
              FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
                           l_partkey % 11 AS shape,
                           CASE l_returnflag WHEN 'A' THEN 'Clip' WHEN 'N' THEN 'Sponge' ELSE 'Specimen Bag' END AS cls,
                           CASE l_linenumber % 3 WHEN 0 THEN 'instances' WHEN 1 THEN 'classes' ELSE 'target' END AS mode,
                           CASE WHEN l_linenumber % 3 = 2 THEN 'clips' END AS target,
                           CAST(l_partkey % 900 AS STRING) AS x, CAST(l_suppkey % 900 AS STRING) AS y,
                           l_quantity > 40 AS bad
                    FROM {lineitem}) a) b
    """,
    # three runs over the same questions
    "run_rows": """
        SELECT o_orderkey AS qid, CASE o_orderstatus WHEN 'F' THEN 'heico' ELSE 'lapchole' END AS dataset,
               CASE run_no WHEN 1 THEN 'base' WHEN 2 THEN 'tuned' ELSE 'merged' END AS run, run_no,
               CASE WHEN run_no = 2 AND o_orderkey % 5 = 0 THEN '' ELSE concat('how many in ', o_orderpriority) END AS question,
               CAST(o_custkey % 4 AS STRING) AS answer, 'number' AS answer_format,
               CASE WHEN (o_orderkey + run_no) % 3 = 0 THEN CAST((o_custkey + run_no) % 4 AS STRING)
                    ELSE CAST(o_custkey % 4 AS STRING) END AS prediction,
               CASE WHEN run_no = 3 AND o_orderkey % 7 = 0 THEN NULL
                    WHEN (o_orderkey + run_no) % 3 = 0 AND run_no % 4 > 0 THEN 0 ELSE 1 END AS correct
        FROM {orders} <<each run_no: 1, 2, 3>>
        WHERE NOT (run_no = 2 AND month(o_orderdate) = 2)
    """,
    # raw answers taken from whole documents
    "doc_answers": """
        SELECT doc_id AS qid, lang AS dataset, source AS video, text AS raw_model_output, answer_format
        FROM {documents}
        <<each answer_format: 'binary', 'number', 'percentage', 'time', 'fo_class', 'open_ended'>>
    """,
    # scores per training epoch and run
    "epoch_scores": """
        SELECT concat('run', CAST(l_linenumber AS STRING)) AS run,
               CASE WHEN l_linenumber <= 3 THEN 'segment' ELSE 'procedure' END AS track,
               CASE l_linestatus WHEN 'F' THEN 'heico' ELSE 'lapchole' END AS dataset,
               CAST(l_quantity AS INT) % 12 + 1 AS epoch,
               avg(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END) AS accuracy,
               avg(CASE WHEN l_tax >= 0.04 THEN 1 ELSE 0 END) AS bucket_macro
        FROM {lineitem}
        GROUP BY 1, 2, 3, 4
    """,
    # revision log of annotation cases
    "revision_log": """
        SELECT ts AS timestamp, concat('case-', CAST(user_id AS STRING)) AS case_id,
               row_no AS revision,
               CASE k % 4 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'complete' WHEN 2 THEN 'needs_review'
                 ELSE 'skipped' END AS status,
               k % 12 AS box_count
        FROM (SELECT *, CASE WHEN k = 50 THEN 1 ELSE (qid % 40) + 1 END AS row_no FROM {eval_rows}) e
    """,
}


def references(text: str) -> list[str]:
    """Names in braces; doubled braces are plain text."""
    return re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text)


_EACH = re.compile(r"<<each (\w+): ([^>]*)>>")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(
    spark: SparkSession, sf_dir: str, name: str, sources: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """A view as a DataFrame; unused columns are pruned down to the scan.

    ``sources`` replaces tables, for instance by a stream of the same rows.
    """
    text = _EACH.sub(r"LATERAL VIEW explode(array(\2)) each_\1 AS \1", VIEWS[name])
    given = sources or {}
    needs = {
        n: given[n] if n in given else table(spark, sf_dir, n) if n in TABLES else view(spark, sf_dir, n, sources)
        for n in references(text)
    }
    return spark.sql(text, **needs) if needs else spark.sql(text)


def oracle_views(names: list[str]) -> dict[str, str]:
    """The CTEs a query needs, dependencies first, in the oracle's dialect."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        if name in out or name in TABLES:
            return
        text = VIEWS[name]
        for n in references(text):
            add(n)
        text = _EACH.sub(r"CROSS JOIN unnest([\2]) AS each_\1(\1)", text)
        body = re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", text).replace("{{", "{").replace("}}", "}")
        out[name] = body

    for name in names:
        add(name)
    return out
