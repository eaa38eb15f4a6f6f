"""Boxes out of free model text."""

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.brackets import first_wanted
from tallyframe.functions.detections import derived_count, extract_detections
from tallyframe.functions.labels import canonical_label

NEEDLE = '{"name": "needles", "box": [100, 200, 150.5, 260]}'
DEEP = "[" * 30 + "]" * 30
CASES = {
    "bare list": (f"[{NEEDLE}, {NEEDLE}]", "instances", None, 2, True, "json"),
    "single object": (NEEDLE, "target", "Needle", 1, True, "json"),
    "other class": (f"[{NEEDLE}]", "target", "Mesh", 0, True, "json"),
    "two classes": ('{"items": [%s, {"object": "gallstone", "bbox": [0, 0, 9, 9]}, %s]}' % (NEEDLE, NEEDLE), "classes", None, 2, True, "json"),
    "value in prose": (f"Found [{NEEDLE}] in the frame [1]", "instances", None, 1, True, "json"),
    "first value that is a payload": (f'{{"a": 1}} then [1, 2] then {{"detections": [{NEEDLE}]}}', "instances", None, 1, True, "json"),
    "deeper than any depth": ('note {"x": %s, "objects": [%s]} end' % (DEEP, NEEDLE), "instances", None, 1, True, "json"),
    "fenced literal": ("Result\n```python\n[{'name': 'mesh', 'box': (1, 1, 5, 5)},]\n```", "instances", None, 1, True, "python_literal"),
    "literal in prose is no payload": ("I see {'objects': [{'label': 'Mesh', 'bbox': [1, 2, 3, 4]}]} here", "instances", None, 1, False, "recovered_bbox_regex"),
    "repeated key, the last counts": ('{"objects": [], "objects": [%s]}' % NEEDLE, "instances", None, 1, True, "json"),
    "apostrophe in a literal": ("""[{'label': "Crohn's clip", 'bbox': [1, 2, 3, 4]}]""", "target", "Clip", 1, True, "python_literal"),
    "escaped quote in a literal": (r"[{'label': 'Crohn\'s clip', 'bbox': [1, 2, 3, 4]}]", "target", "Clip", 1, True, "python_literal"),
    "words inside strings stay": ("[{'label': 'None', 'bbox': [1, 2, 3, 4], 'sure': True}]", "instances", None, 1, True, "python_literal"),
    "no area": ('[{"name": "mesh", "box": [5, 5, 5, 9]}, %s]' % NEEDLE, "instances", None, 1, False, "json_partial_invalid_objects"),
    "corners by name": ('{"instances": [{"class_name": "Sponge", "bounding_box": {"xmin": 1, "ymin": 2, "xmax": 3, "ymax": 4}}]}', "instances", None, 1, True, "json"),
    "no list": ('{"detections": {"n": 2}}', "instances", None, 0, False, "missing_objects"),
    "no text": (None, "classes", None, 0, False, "invalid_json"),
    "brackets only": ("[[[{{{", "instances", None, 0, False, "invalid_json"),
}


@pytest.fixture(scope="module")
def read(spark):
    rows = [(name, *case[:3]) for name, case in CASES.items()]
    df = spark.createDataFrame(rows, "name string, raw_model_output string, mode string, target string")
    out = extract_detections(df).withColumn("n", derived_count(F.col("detections"), F.col("mode"), F.col("target")))
    return {r["name"]: r for r in out.collect()}


@pytest.mark.parametrize("name", CASES)
def test_case(read, name):
    row, (*_, n, valid, status) = read[name], CASES[name]
    assert (row["n"], row["schema_valid"], row["status"]) == (n, valid, status)


def brute_first(text, wanted):
    """Try every bracket with the standard decoder."""
    for start, c in enumerate(text):
        if c in "[{":
            try:
                value, size = json.JSONDecoder(parse_constant=float.fromhex).raw_decode(text[start:])
            except ValueError:
                continue
            if (all(isinstance(x, dict) for x in value) if isinstance(value, list) else any(k in value for k in wanted)):
                return text[start : start + size]
    return None


def test_first_wanted_value_against_every_bracket():
    draw, wanted = random.Random(2), {"objects", "box"}
    parts = ["[", "]", "{", "}", '"', "\\", ",", ":", "1", "-", '"a"', '"objects"', '"box"', '{"box":1}', "[{}]", " ", "x", "true", "[1,", '{"a":', '"[', '"{', '}"', '\\"', "1.5e3", "nul"]
    for _ in range(20_000):
        text = "".join(draw.choices(parts, k=draw.randint(1, 14)))
        assert first_wanted(text, wanted) == brute_first(text, wanted), text


@pytest.mark.parametrize("unit", ["[", "{", '["', "[1,", '{"a":', '"[",'])
def test_open_brackets_take_time_in_proportion(unit):
    def seconds(n):
        start = time.perf_counter()
        assert first_wanted(unit * n, {"box"}) is None
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(80_000) < 12 * seconds(20_000) + 0.5


def test_fragment_length_is_a_parameter(spark):
    df = spark.createDataFrame([("x {label: 'Mesh', note: '%s', bbox: [1, 2, 3, 4]}" % ("n" * 2000),)], "raw_model_output string")
    assert extract_detections(df).first()["status"] == "invalid_json"
    assert extract_detections(df, fragment_chars=5000).first()["status"] == "recovered_bbox_regex"


def test_labels_of_other_names(spark):
    df = spark.createDataFrame([("glass berries",), ("tall glass berry",), ("Classes",)], "x string")
    names = ["Glass Berries", "Berry", "Class"]
    assert [r[0] for r in df.select(canonical_label(F.col("x"), names)).collect()] == ["Glass Berries", "Glass Berries", "Class"]


def test_values_are_read_once(spark):
    """A reading repeated per accepted key grows the plan and the time of every row."""
    df = spark.createDataFrame([("[]",)], "raw_model_output string")
    plan = extract_detections(df).select("detections", "status")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get(") <= 50


def test_odd_values(spark):
    box = "[1,2,3,4]"
    cases = {
        '{"objects": null, "items": [{"label": "Clip", "bbox": %s}]}' % box: "recovered_bbox_regex",
        '[{"label": "Clip", "bbox": %s}] trailing' % box: "json",
        '{"label": null, "class": "Clip", "bbox": [1, 2, 3.5, "4"]}': "json",
        '{"label": "Clip", "bbox_2d": null, "bbox": %s}' % box: "json_partial_invalid_objects",
        '[{"label": "Clip", "bbox": [true, 2, 3, 4]}]': "json_partial_invalid_objects",
        "( )": "python_literal",
        "[null]": "invalid_json",
    }
    df = spark.createDataFrame([(t,) for t in cases], "raw_model_output string")
    assert {r["raw_model_output"]: r["status"] for r in extract_detections(df).collect()} == cases
