"""Domain constants and their dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: they must equal the published taxonomy for right results ---
DATASETS = ("heico", "lapchole")
TRACKS = ("frame", "segment", "procedure")
SPLITS = ("train", "test")
BASE_FPS = {"heico": 25, "lapchole": 30}

GROUPS = (
    ("1", "object_recognition"),
    ("2", "temporal_grounding"),
    ("3", "aggregation"),
    ("4", "event_understanding"),
    ("5", "complex_reasoning"),
)

# code, name; the group is the first character of the code
LEAVES = (
    ("1a", "object_identification"),
    ("1b", "instance_matching"),
    ("1c", "object_attributes"),
    ("1d", "spatial_localization_camera"),
    ("1e", "spatial_localization_situs"),
    ("2a", "temporal_localization"),
    ("2b", "duration_estimation"),
    ("3a", "object_aggregation"),
    ("3b", "event_aggregation"),
    ("4a", "fo_interaction_recognition"),
    ("4b", "fo_usage_purpose"),
    ("4c", "temporal_ordering"),
    ("5a", "functional_reasoning"),
    ("5b", "causal_consequence_reasoning"),
    ("5c", "multi_step_reasoning"),
)

CLASS_NAMES = (
    "Sponge",
    "Clip",
    "Specimen Bag",
    "Silicone Loop",
    "External Drain",
    "Needle",
    "Gallstone",
    "Specimen",
    "Mesh",
    "Absorbable Hemostatic Agent",
)

ANSWER_FORMATS = (
    "binary",
    "number",
    "percentage",
    "time",
    "fo_class",
    "multiple_choice",
    "open_ended",
    "matching",
)

# track -> (stride per dataset, frame cap, pixel budget)
SAMPLING_PLAN = {
    "frame": ({"heico": 25, "lapchole": 30}, 1, 602112),
    "segment": ({"heico": 25, "lapchole": 30}, 64, 262144),
    "procedure": ({"heico": 250, "lapchole": 300}, 96, 131072),
}

# answer bounds of counting questions
MIN_COUNT = 1
MAX_COUNT = 16
MAX_DISTINCT_CLASSES = 4
# --- end of fixed values ---


def groups(spark: SparkSession) -> DataFrame:
    """``group_code, capability_group`` (5 rows)."""
    return spark.createDataFrame(list(GROUPS), "group_code string, capability_group string")


def leaves(spark: SparkSession) -> DataFrame:
    """``capability_code, primary_capability, group_code, capability_group`` (15 rows)."""
    names = dict(GROUPS)
    rows = [(code, name, code[0], names[code[0]]) for code, name in LEAVES]
    return spark.createDataFrame(
        rows,
        "capability_code string, primary_capability string, group_code string, capability_group string",
    )


def sampling_plan(spark: SparkSession) -> DataFrame:
    """``track, dataset, fps, stride, max_frames, max_pixels`` (6 rows)."""
    rows = [
        (track, dataset, BASE_FPS[dataset], stride, cap, pixels)
        for track, (strides, cap, pixels) in SAMPLING_PLAN.items()
        for dataset, stride in strides.items()
    ]
    return spark.createDataFrame(
        rows,
        "track string, dataset string, fps int, stride int, max_frames int, max_pixels int",
    )


def templates(spark: SparkSession, class_names: tuple[str, ...] = CLASS_NAMES) -> DataFrame:
    """Counting templates: 0 instances, 1 classes, 2.. one per class, with bounds."""
    names = ("instances", "classes", *class_names)
    rows = [
        (i, name, MIN_COUNT, MAX_DISTINCT_CLASSES if i == 1 else MAX_COUNT)
        for i, name in enumerate(names)
    ]
    return spark.createDataFrame(rows, "template_id int, template string, low int, high int")
