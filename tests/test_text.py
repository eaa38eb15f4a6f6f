"""Normalisers and parsers on small known texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import labels, prompts, text
from tallyframe.functions import numbers as N
from tallyframe.operators import scoring as S
from tallyframe.plans.catalog import QUERIES
from tallyframe.taxonomy import CLASS_NAMES


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(
    ("raw", "names", "want"),
    [
        ("The answer is Clip, Sponge.", CLASS_NAMES, {"Clip", "Sponge"}),
        ("Specimen Bag", CLASS_NAMES, {"Specimen Bag"}),
        ("Specimen Bag and Specimen", CLASS_NAMES, {"Specimen Bag", "Specimen"}),
        ("Clip, Clip and Sponge", CLASS_NAMES, {"Clip", "Sponge"}),
        ("Marker Band and Clip", ("Clip", "Marker Band"), {"Clip", "Marker Band"}),
        ("paperclip and Clipper", CLASS_NAMES, {"paperclip and Clipper"}),
        ("absent", CLASS_NAMES, {"none"}),
        ("N/A", CLASS_NAMES, {"none"}),
        ("", CLASS_NAMES, {"none"}),
        ("nonesuch", CLASS_NAMES, {"nonesuch"}),
    ],
)
def test_class_sets(spark, raw, names, want):
    got = one(spark, text.normalize_classes(lit(raw), names))
    assert set(got.split(", ")) == want


def test_names_that_interleave_are_masked_in_turn(spark):
    names = ("a b", "b c d")
    assert text._may_interleave(names) and not text._may_interleave(CLASS_NAMES)
    assert one(spark, text.found_names(lit("x a b c d"), names)) == ["b c d"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Events occur at 0:02:03 and 01:04:05.", "00:02:03, 01:04:05"),
        ("00:00:07, then 00:00:12", "00:00:07, 00:00:12"),
        (" at  noon ", "at noon"),
    ],
)
def test_times(spark, raw, want):
    assert one(spark, text.normalize_time(lit(raw))) == want


@pytest.mark.parametrize(
    ("raw", "v1", "v2"),
    [
        ("not present", "yes", "no"),
        ("Yes, certainly", "yes", "yes"),
        ("no", "no", "no"),
        ("nothing", "no", "nothing"),
        ("It is correct", "yes", "yes"),
        ("maybe", "maybe", "maybe"),
        ("anonymous", "anonymous", "anonymous"),
    ],
)
def test_binary(spark, raw, v1, v2):
    assert one(spark, text.normalize_binary(lit(raw))) == v1
    assert one(spark, text.normalize_binary(lit(raw), "v2")) == v2


def test_unknown_variant():
    with pytest.raises(ValueError):
        text.normalize_binary(F.col("x"), "v9")


def test_long_text_is_read_whole(spark):
    raw = "word " * 5000 + "Gallstone"
    assert one(spark, text.normalize_classes(lit(raw))) == "Gallstone"


def test_white_space_runs(spark):
    assert one(spark, text.clean(lit(" \t a    b\n\nc  "))) == "a b c"


def test_white_space_of_any_kind(spark):
    marks = [*text._EDGES, "x", "\u00e9", "\x1b", "\x7f", "\u200b", "\ufeff", "\u4e00", "\U0001f600"]
    raws = [f"{a}{b}q{a}{b}{a}" for a in marks for b in marks] + ["", " ", " " * 70_000, "a" + " \n" * 70_000 + "b"]
    rows = spark.createDataFrame([(r,) for r in raws], "raw string").select("raw", text.clean(F.col("raw")).alias("x")).collect()
    assert len(rows) == len(raws) and [r.raw for r in rows if r.x != " ".join(r.raw.split())] == []


ODD_ANSWERS = [
    None, "", " \t\n", "yes", "NO\u00a0", "not  present", "\u3000Yes", "none", "n/a", "12\n:5 and 0:1:5", "\u0663 clips", "1 . 5 %", "1.5\t%",
    "the\n the", "in\nthe", "Specimen\n Bag and specimen", "top/left\r\nor  bottom", "w" * 299 + "  \n tail", "w " * 149 + "x \n clip",
    "<think>yes</think>\n clip", "dangling</think> 3", "<think>never ends", "\U0001f600\x1c\x1dno",
]


@pytest.mark.parametrize("variant", ["v1", "v2", "frame"])
def test_texts_under_several_formats(spark, variant):
    formats = ("binary", "number", "percentage", "time", "fo_class", "multiple_choice", "open_ended")
    asked = "Which? Please select none, one or multiple answers: top/left; top; bottom."
    rows = [(i, r, asked) for i, r in enumerate(ODD_ANSWERS)]
    df = spark.createDataFrame(rows, "qid int, raw_model_output string, question string")
    single = S.normalize_predictions(df.crossJoin(spark.createDataFrame([(f,) for f in formats], "answer_format string")), variant)
    wanted = {(r.qid, r.answer_format): r.prediction for r in single.collect()}
    got = S.normalize_as(df, formats, variant).collect()
    assert len(got) == len(wanted) == len(rows) * len(formats)
    assert {(r.qid, r.answer_format): r.prediction for r in got} == wanted


def test_documents_are_cleaned_once(spark, sf):
    df = QUERIES["normalize_documents"].build(spark, sf)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("<think>a\nb</think>\nClip", "Clip"),
        ("<think></think> 3", "3"),
        ("<think>never ends", ""),
        ("  plain ", "plain"),
        ("dangling</think> yes", "yes"),
    ],
)
def test_reasoning(spark, raw, want):
    assert one(spark, text.strip_reasoning(lit(raw))) == want


def test_options(spark):
    many = "Which? Please select none, one or multiple answers: top/left; top; bottom."
    single = "Which? Please select one answer: top/left; top; bottom."
    assert one(spark, text.options(lit(single))) == ["top/left", "top", "bottom"]

    def pick(raw, question):
        q = lit(question)
        return one(spark, text.normalize_choice(lit(raw), text.options(q), text.is_multi_select(q)))

    assert pick("BOTTOM and top/left", many) == "top/left, bottom"
    assert pick("top/left or bottom", single) == "top/left"
    assert pick("none of them", many) == "none"
    assert pick("x" * 400, single) == "x" * 300


@pytest.mark.parametrize(
    ("stamp", "want"),
    [("00:01:02", 62.0), ("1:00:00.5", 3600.5), ("00:60:00", None), ("12:00", None), ("a:b:c", None), ("0:00:60", None)],
)
def test_stamps(spark, stamp, want):
    assert one(spark, text.stamp_seconds(lit(stamp))) == want


def test_guarded_timestamps(spark):
    assert one(spark, text.timestamps(lit("100:00:01 and 0:1:5, 00:00:02"))) == [2, 65]


def test_seconds_round_half_to_even(spark):
    assert one(spark, text.seconds_stamp(lit(2.5))) == "00:00:02"
    assert one(spark, text.seconds_stamp(lit(3.5))) == "00:00:04"


def test_answer_sets(spark):
    assert one(spark, text.answer_set(lit("None"))) == []
    assert one(spark, text.answer_set(lit("Clip, sponge ,Clip"))) == ["clip", "sponge"]
    empty, clip = F.array().cast("array<string>"), F.array(lit("clip"))
    assert one(spark, text.set_precision(empty, empty)) == 1.0
    assert one(spark, text.set_precision(clip, empty)) == 0.0
    assert one(spark, text.set_recall(empty, clip)) == 0.0


@pytest.mark.parametrize(
    ("question", "mode", "target"),
    [
        ("How many different foreign object instances appear in this frame? Now.", "instances", None),
        ("How many different foreign object classes appear in this frame?", "classes", None),
        ("How many Clips appear in this frame?", "target", "Clip"),
        ("how many Specimen bags appear in the frame?", "target", "Specimen Bag"),
        ("How many External drains appear in this frame?", "target", "External Drain"),
        ("How many graspers appear in this frame?", None, None),
        ("What is this?", None, None),
    ],
)
def test_counting_questions(spark, question, mode, target):
    got = one(spark, labels.counting_question(lit(question), lit("number").cast("string")))
    assert (got and got["mode"], got and got["target"]) == (mode, target)
    assert one(spark, labels.counting_question(lit(question), lit("open_ended"))) is None


@pytest.mark.parametrize(
    ("label", "want"),
    [("surgical clips", "Clip"), ("Specimen Bags", "Specimen Bag"), ("specimen_bag", "Specimen Bag"), ("grasper  tip", "grasper tip"), ("", "")],
)
def test_labels(spark, label, want):
    assert one(spark, labels.canonical_label(lit(label))) == want


def test_classes_in_answers(spark):
    assert one(spark, labels.classes_in_answer(lit("clips, Sponge, clip"))) == ["Clip", "Sponge"]
    # without a plain name in the list, contained names count, longest first
    assert one(spark, labels.classes_in_answer(lit("a specimen bag and a mesh"))) == ["Specimen Bag", "Specimen", "Mesh"]


@pytest.mark.parametrize("n,cap,want", [(10, 4, [0, 3, 6, 9]), (3, 8, [0, 1, 2]), (6, 3, [0, 2, 5]), (9, 1, [0])])
def test_even_positions(spark, n, cap, want):
    assert one(spark, N.even_positions(lit(n), lit(cap))) == want


def test_middle_position(spark):
    assert one(spark, N.even_positions(lit(9), lit(1), "middle")) == [4]


@pytest.mark.parametrize("w,h", [(1920, 1080), (854, 480), (640, 512)])
@pytest.mark.parametrize("budget", [602112, 262144, 131072])
def test_resize_is_stable(spark, w, h, budget):
    th, tw = N.resize_target(lit(h), lit(w), high=budget)
    height, width = one(spark, F.struct(th, tw))
    assert height % 32 == 0 and width % 32 == 0 and 65536 <= height * width <= budget
    th, tw = N.resize_target(lit(height), lit(width), high=budget)
    assert tuple(one(spark, F.struct(th, tw))) == (height, width)


def test_prompts(spark):
    q = "How many Clips appear in this frame?"
    direct = one(spark, prompts.instruction(lit(q), lit("number")))
    boxes = one(spark, prompts.instruction(lit(q), lit("number"), "bbox-json"))
    v2 = one(spark, prompts.instruction(lit("Please provide a class name."), lit("fo_class"), "v2"))
    assert direct.endswith("(digits only).") and '"bbox_2d"' in boxes and 'the class "Clip"' in boxes
    assert "exactly ONE" in v2
    with pytest.raises(ValueError):
        prompts.instruction(F.col("q"), F.col("f"), "other")


def test_infer_format(spark):
    assert one(spark, text.infer_format(lit("A? Answer with yes or no."))) == "binary"
    assert one(spark, text.infer_format(lit("Please provide a class name from the list"))) == "fo_class"
    assert one(spark, text.infer_format(lit("Please provide a number."), "frame")) == "number"
    assert one(spark, text.infer_format(lit("Describe it"))) == "open_ended"


def test_system_prompts(spark):
    def said(track, strategy="direct", procedure=None):
        return one(spark, prompts.system_prompt(lit(track), strategy, procedure))

    assert "single endoscopic frame from colorectal" in said("frame") and "valid JSON" in said("frame", "bbox-json")
    assert "The clip is shown" in said("segment") and "The video is shown" in said("procedure", "bbox-json")
    v2 = said("segment", "v2", lit(" Rectal Resection "))
    assert "an endoscopic clip from a Rectal Resection procedure." in v2 and "- Mesh: screen-like" in v2 and "anvils" in v2
    assert "minimally invasive" in said("frame", "v3") and "anvils" not in said("frame", "v2-noscope")
    with pytest.raises(ValueError):
        said("frame", "v9")


def test_preambles(spark):
    def said(track, start, end, frames, variant="shared"):
        return one(spark, prompts.window_preamble(lit(track), lit(start), lit(end), lit(frames), variant))

    assert said("segment", 10.0, 70.0, 5) == (
        "This clip covers video time 00:00:10 to 00:01:10 (60 s of surgery). It is shown as 5 frames in "
        "chronological order, about 15 s apart, each labelled with its absolute video timestamp."
    )
    assert said("procedure", 0.0, 70.0, 1).startswith("The surgical video from its start (00:00:00) up to 00:01:10 is shown as a single frame")
    assert said("any", 12.0, 70.0, 3, "container").startswith("This procedure clip covers absolute video time 00:00:12 to 00:01:10 and is shown as 3 frames")
    assert said("any", 0.5, 70.0, 1, "container").endswith("shown as a single frame labelled with its absolute video timestamp.")


def test_too_small_images_have_no_target(spark):
    h, w = N.resize_target(lit(20), lit(500))
    assert tuple(one(spark, F.struct(h, w))) == (None, None)
