"""Checks of drawn boxes: shape rules, agreement with the answers, completion, export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.labels import class_alias, classes_in_answer
from tallyframe.functions.text import casefold
from tallyframe.operators.scale import dealt, grouped_rank, range_rank, value_bucket
from tallyframe.session import cut_lineage
from tallyframe.taxonomy import CLASS_NAMES

# --- fixed values: states, checklist and limits of an annotation ---
STATUSES = ("unstarted", "in_progress", "complete", "needs_review", "skipped")
CHECKS = ("full_frame_scanned", "every_instance_boxed", "classes_reviewed", "qa_compared")
BOX_ID = r"^[A-Za-z0-9_-]{1,80}$"
EDGE_TOLERANCE = 0.01
NOTE_LIMIT = 10_000
NO_OBJECT_ANSWERS = ("none", "no", "no foreign object", "no foreign objects")
# --- end of fixed values ---


def normalised_boxes(boxes: DataFrame, cases: DataFrame, names: Sequence[str] = CLASS_NAMES) -> DataFrame:
    """Canonical class, rounded corners, sizes trimmed to the image."""
    out = boxes.join(cases.select("case_id", "image_width", "image_height"), "case_id")
    for c in ("x", "y", "width", "height"):
        out = out.withColumn(c, F.bround(F.col(c), 3))
    return (
        out.withColumn("box_id", F.trim("box_id"))
        .withColumn("class_name", class_alias(F.col("class_name"), names))
        .withColumn("right", F.col("x") + F.col("width"))
        .withColumn("bottom", F.col("y") + F.col("height"))
        .withColumn("width", F.bround(F.least("width", F.col("image_width") - F.col("x")), 3))
        .withColumn("height", F.bround(F.least("height", F.col("image_height") - F.col("y")), 3))
    )


def box_violations(boxes: DataFrame, cases: DataFrame, names: Sequence[str] = CLASS_NAMES) -> DataFrame:
    """One row per broken rule of a box.

    ``boxes`` are raw; repeated ids are found by counting, not by a window. Breaches
    are counted per id, so boxes meet their cases once and shuffle once.
    """
    boxes, cases = dealt(["case_id"], boxes.count(), boxes, cases)
    sized = boxes.join(cases.select("case_id", "image_width", "image_height"), "case_id")
    x, y, w, h = (F.bround(F.col(c), 3) for c in ("x", "y", "width", "height"))
    finite = F.lit(True)
    for c in ("x", "y", "width", "height"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    box_id = F.trim("box_id")
    rules = {
        "invalid_id": ~box_id.rlike(BOX_ID),
        "unknown_class": class_alias(F.col("class_name"), names).isNull(),
        "not_finite": ~finite,
        "too_small_or_negative": finite & ((x < 0) | (y < 0) | (w <= 1) | (h <= 1)),
        "outside_image": finite
        & (
            (x + w > F.col("image_width") + EDGE_TOLERANCE)
            | (y + h > F.col("image_height") + EDGE_TOLERANCE)
        ),
    }
    breaches = [F.count_if(F.coalesce(c, F.lit(True))).alias(r) for r, c in rules.items()]
    per_id = sized.groupBy("case_id", box_id.alias("box_id")).agg(F.count(F.lit(1)).alias("duplicate_id"), *breaches)
    repeated = F.when(F.col("duplicate_id") > 1, F.array(F.lit("duplicate_id"))).otherwise(F.array().cast("array<string>"))
    broken = F.concat(repeated, *[F.array_repeat(F.lit(r), F.col(r).cast("int")) for r in rules])
    return per_id.select("case_id", "box_id", F.explode(broken).alias("rule"))


def annotation_violations(annotations: DataFrame, boxes: DataFrame) -> DataFrame:
    """One row per broken rule of an annotation record."""
    counts = boxes.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_boxes"))
    rows = annotations.join(counts, "case_id", "left")
    note = F.trim(F.coalesce("notes", F.lit("")))
    rules = {
        "unknown_status": ~F.col("status").isin(*STATUSES),
        "boxes_and_no_objects": F.col("no_foreign_objects") & (F.coalesce("n_boxes", F.lit(0)) > 0),
        "notes_too_long": F.length(note) > NOTE_LIMIT,
        "skipped_without_note": (F.col("status") == "skipped") & (note == ""),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items()]))
    return rows.select("case_id", F.explode(broken).alias("rule"))


def box_aggregates(boxes: DataFrame, cases: DataFrame, names: Sequence[str] = CLASS_NAMES) -> DataFrame:
    """Per case: boxes, count per class as a map, nearest class to the centre.

    A box of an unknown class counts as a box of no class.

    Counts go through one column per class of the small taxonomy. The nearest
    box is a minimum over (distance, box order).
    """
    near = boxes if "image_width" in boxes.columns else boxes.join(cases.select("case_id", "image_width", "image_height"), "case_id")
    dx = F.col("x") + F.col("width") / 2 - F.col("image_width") / 2
    dy = F.col("y") + F.col("height") / 2 - F.col("image_height") / 2
    agg = near.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_boxes"),
        F.count_if(F.coalesce("uncertain", F.lit(False))).alias("n_uncertain"),
        F.min(F.when(F.col("class_name").isNotNull(), F.struct((dx * dx + dy * dy).alias("d"), "box_no", "class_name")))["class_name"].alias("nearest"),
        *[F.count_if(F.col("class_name") == n).alias(f"c_{i}") for i, n in enumerate(names)],
    )
    entries = F.array(
        *[F.struct(F.lit(n).alias("key"), F.col(f"c_{i}").alias("value")) for i, n in enumerate(names)]
    )
    counts = F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))
    return agg.withColumn("counts", counts).drop(*[f"c_{i}" for i in range(len(names))])


def _text_set(values: Column) -> Column:
    return F.array_join(F.sort_array(values), ", ")


def answer_mismatches(
    questions: DataFrame, per_case: DataFrame, cases: DataFrame, names: Sequence[str] = CLASS_NAMES
) -> DataFrame:
    """Questions whose answer the boxes of ``box_aggregates`` contradict, expected next to observed.

    Texts are read on either side of the join, so that the filter behind it does not read them again.
    """
    known = cases.select("case_id").join(per_case, "case_id", "left")
    known = known.withColumn("_seen", F.coalesce(_text_set(F.map_keys("counts")), F.lit("")))
    centre = F.when(F.col("kind") == "closest_to_center", classes_in_answer(F.col("answer"), names))
    rows = questions.withColumn("_centre", centre).join(known, "case_id")
    kind, number = F.col("kind"), F.col("numeric_answer")
    n = F.coalesce("n_boxes", F.lit(0))
    counts = F.coalesce("counts", F.create_map().cast("map<string,bigint>"))
    of_class = F.coalesce(F.try_element_at(counts, F.col("target_class")), F.lit(0))
    blank = casefold(F.trim("answer")).isin(*NO_OBJECT_ANSWERS)
    empty = F.array().cast("array<string>")
    listed = F.coalesce("answer_classes", empty)
    expected_set = F.when((kind == "class_inventory") & blank, empty).otherwise(listed)
    by_centre = F.col("_centre")
    count_kinds = kind.isin("total_instance_count", "distinct_class_count", "class_count")
    observed_number = (
        F.when(kind == "total_instance_count", n)
        .when(kind == "distinct_class_count", F.size(counts))
        .when(kind == "class_count", of_class)
    )
    staged = rows.select(
        "case_id",
        "qid",
        "kind",
        F.when(count_kinds, number.cast("string"))
        .when(kind == "closest_to_center", _text_set(by_centre))
        .otherwise(_text_set(expected_set))
        .alias("expected"),
        F.when(count_kinds, observed_number.cast("string"))
        .when(kind == "closest_to_center", F.col("nearest"))
        .when(kind == "single_object_identity", F.concat(n.cast("string"), F.lit(": "), F.col("_seen")))
        .otherwise(F.col("_seen"))
        .alias("observed"),
        (
            F.when(
                count_kinds,
                number.isNotNull()
                & ((kind != "class_count") | F.col("target_class").isNotNull())
                & (observed_number != number),
            )
            .when(kind == "class_inventory", _text_set(expected_set) != F.col("_seen"))
            .when(
                kind == "single_object_identity", (n != 1) | (_text_set(listed) != F.col("_seen"))
            )
            .when(
                kind == "closest_to_center",
                (F.size(by_centre) > 0) & (n > 0) & ~F.array_contains(by_centre, F.col("nearest")),
            )
            .otherwise(False)
        ).alias("bad"),
    )
    return staged.where(F.coalesce("bad", F.lit(False))).drop("bad")


def completion_gate(
    annotations: DataFrame, questions: DataFrame, boxes: DataFrame, cases: DataFrame, names: Sequence[str] = CLASS_NAMES
) -> DataFrame:
    """Violations, structural errors, open checks, mismatches and uncertain boxes per case.

    ``boxes`` are raw. A record that breaks any rule is rejected as a whole and
    stays blocked, whatever its status.
    """
    per_case = box_aggregates(normalised_boxes(boxes, cases, names), cases, names)
    wrong = answer_mismatches(questions, per_case, cases, names).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("qa_mismatches")
    )
    broken = rejected_cases(annotations, boxes, cases, names)
    rows = annotations.join(per_case, "case_id", "left").join(wrong, "case_id", "left").join(broken, "case_id", "left")
    zero = F.lit(0)
    n = F.coalesce("n_boxes", zero)
    unchecked = sum(
        (F.when(F.coalesce(F.try_element_at("checks", F.lit(k)), F.lit(False)), 0).otherwise(1) for k in CHECKS),
        zero,
    )
    undecided = F.when(~F.col("no_foreign_objects") & (n == 0), 1).otherwise(0)
    out = rows.select(
        "case_id",
        "status",
        n.alias("box_count"),
        F.coalesce(F.size("counts"), zero).alias("class_count"),
        (unchecked + undecided).alias("structural_errors"),
        F.coalesce("qa_mismatches", zero).alias("qa_mismatches"),
        F.coalesce("n_uncertain", zero).alias("uncertain_boxes"),
        F.coalesce("violations", zero).alias("violations"),
    )
    rejected = F.col("violations") > 0
    clean = ~rejected & (F.col("structural_errors") == 0) & (F.col("qa_mismatches") == 0) & (F.col("uncertain_boxes") == 0)
    blocked = rejected | (F.col("status").isin("complete", "needs_review") & (F.col("structural_errors") > 0)) | (
        (F.col("status") == "complete") & ~clean
    )
    return out.withColumn("can_complete", clean.cast("int")).withColumn("blocked", blocked.cast("int"))


def rejected_cases(
    annotations: DataFrame, boxes: DataFrame, cases: DataFrame, names: Sequence[str] = CLASS_NAMES
) -> DataFrame:
    """Cases whose record breaks a rule of a box or of the annotation, with the number of breaches."""
    found = box_violations(boxes, cases, names).select("case_id").union(annotation_violations(annotations, boxes).select("case_id"))
    return found.groupBy("case_id").agg(F.count(F.lit(1)).alias("violations"))


def export_images(cases: DataFrame, annotations: DataFrame, rejected: DataFrame) -> DataFrame:
    """Completed cases that were not rejected, with image ids 1.. in rank order.

    They are written once, as the ids and every table of an export read them again.
    """
    done = cases.join(annotations.where(F.col("status") == "complete").select("case_id"), "case_id", "left_semi")
    done = cut_lineage(done.join(rejected.select("case_id"), "case_id", "left_anti"))
    return cut_lineage(grouped_rank(done, [], value_bucket(F.col("rank").cast("double")), [F.col("rank")], "image_id"))


def exported_boxes(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes of the images of an export, without ids."""
    return boxes.join(images.select("case_id", "image_id"), "case_id")


def export_boxes(images: DataFrame, boxes: DataFrame, names: Sequence[str] = CLASS_NAMES) -> DataFrame:
    """Boxes of completed cases with dense ids, image by image.

    Only these boxes are ranked, in ranges of (image, box), so no task holds more
    than a range and nothing is joined by case twice.
    """
    category = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("class_name"))
    kept = cut_lineage(
        exported_boxes(images, boxes).select(
            "image_id",
            "box_no",
            category.cast("int").alias("category_id"),
            "x",
            "y",
            "width",
            "height",
            F.bround(F.col("width") * F.col("height"), 3).alias("area"),
            F.lit(0).alias("iscrowd"),
            "difficult",
        )
    )
    return range_rank(kept, [], [F.col("image_id"), F.col("box_no")], "annotation_id").select(
        "annotation_id", "image_id", "category_id", "x", "y", "width", "height", "area", "iscrowd", "difficult"
    )


def export_progress(cases: DataFrame, gate: DataFrame, annotations: DataFrame) -> DataFrame:
    """Rank, status, boxes, revision and mismatches of every case."""
    state = annotations.select("case_id", "revision", "updated_at")
    return cases.select("rank", "batch", "case_id", "dataset").join(gate, "case_id", "left").join(
        state, "case_id", "left"
    ).select(
        "rank",
        "batch",
        "case_id",
        "dataset",
        F.coalesce("status", F.lit("unstarted")).alias("status"),
        F.coalesce("box_count", F.lit(0)).alias("box_count"),
        F.coalesce("revision", F.lit(0)).alias("revision"),
        F.coalesce(F.col("updated_at").cast("string"), F.lit("")).alias("updated_at"),
        F.coalesce("qa_mismatches", F.lit(0)).alias("qa_mismatch_count"),
    )


def export_manifest(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Totals of an export in one row; ``boxes`` are those of ``export_boxes`` or ``exported_boxes``."""
    total = boxes.agg(F.count(F.lit(1))).scalar()
    return images.agg(F.count(F.lit(1)).alias("complete_case_count")).withColumn("complete_box_count", total)
