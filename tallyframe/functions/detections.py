"""Labelled boxes from free model text, as staged projections over VARIANT values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.brackets import wanted_value
from tallyframe.functions.labels import canonical_label
from tallyframe.functions.text import let
from tallyframe.taxonomy import CLASS_NAMES

# --- fixed values: accepted keys, in order of preference ---
LIST_KEYS = ("objects", "detections", "instances", "items")
BOX_KEYS = ("bbox_2d", "bbox", "box", "bounding_box")
LABEL_KEYS = ("label", "class", "class_name", "name", "object")
CORNER_KEYS = (
    ("x_min", "y_min", "x_max", "y_max"),
    ("xmin", "ymin", "xmax", "ymax"),
    ("x1", "y1", "x2", "y2"),
)
FENCE = r"(?is)```(?:json|python)?\s*(.*?)```"
NUMBER = r"[-+]?\d+(?:\.\d+)?"
BOX_TEXT = rf"(?i)[\"']?(?:{'|'.join(BOX_KEYS)})[\"']?\s*:\s*\[(\s*" + r"\s*,\s*".join([NUMBER] * 4) + r"\s*)\]"
LABEL_TEXT = rf"(?i)[\"']?(?:{'|'.join(LABEL_KEYS)})[\"']?\s*:\s*[\"']([^\"']+)[\"']"
OPENING = r"^(?:\[[ \t\n\r]*\]|(?:\[[ \t\n\r]*)?\{[ \t\n\r]*[\"}])"  # of JSON that holds boxes
LITERAL_OPENING = r"^[\[{(]"
PYTHON_ONLY = r"True|False|None|\(|,\s*[\]}]"  # what a literal has and JSON has not, strings apart
FRAGMENT_CHARS = 1000  # longest object read where the text is no payload
# --- end of fixed values ---


def _fenced(text: Column) -> Column:
    blocks = F.transform(F.regexp_extract_all(text, F.lit(FENCE), F.lit(1)), _edges_off)
    return F.filter(F.array_distinct(blocks), lambda c: c != "")


def _edges_off(x: Column) -> Column:
    return F.btrim(x, F.lit(" \t\n\r"))


def _as_literal(text: Column) -> Column:
    """Rewrite a Python literal to JSON: strings to double quotes, words, tuples and spare commas between them."""

    def rewritten(token: Column) -> Column:
        body = F.replace(F.substring(token, F.lit(2), F.length(token) - 2), F.lit("\\'"), F.lit("'"))
        single = F.concat(F.lit('"'), F.replace(body, F.lit('"'), F.lit('\\"')), F.lit('"'))
        plain = token
        for word, to in (("True", "true"), ("False", "false"), ("None", "null")):
            plain = F.regexp_replace(plain, rf"\b{word}\b", to)
        plain = F.regexp_replace(plain, r"\(([-+0-9.,\s]*)\)", r"[$1]")
        plain = F.regexp_replace(plain, r",\s*([\]}])", "$1")
        quoted = token.startswith("'") & token.endswith("'") & (F.length(token) > 1)
        return F.when(token.startswith('"'), token).when(quoted, single).when(token.rlike(PYTHON_ONLY), plain).otherwise(token)

    tokens = F.regexp_extract_all(text, F.lit(r"""(?s)"(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+'|[^"']++|["']"""), F.lit(0))
    return F.array_join(F.transform(tokens, rewritten), "")


def _as_map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _as_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _may_open(text: Column) -> Column:
    """Whether JSON of an object or of a list of objects may begin like this; failed parses are dear."""
    return text.rlike(OPENING)


def _first_present(record: Column, keys: Sequence[str]) -> Column:
    """Value of the first key that is there; a JSON null is a value."""
    return F.coalesce(*[record[k] for k in keys])


# the read keys only: a record of typed fields is far cheaper than a map of all
RECORD = "struct<" + ",".join(f"`{k}` variant" for k in (*LIST_KEYS, *BOX_KEYS)) + ">"
ITEM = "struct<" + ",".join([f"`{k}` string" for k in LABEL_KEYS] + [f"`{k}` variant" for k in BOX_KEYS]) + ">"


def _items(v: Column) -> Column:
    """The listed objects of a value that looks like boxes as ``struct<items>``, else NULL; ``items`` is NULL without a list."""

    def item(e: Column) -> Column:
        return F.try_variant_get(e, "$", ITEM)

    def wrapped(items: Column) -> Column:
        return F.struct(items.alias("items"))

    def of_record(record: Column) -> Column:
        listed, boxed = _first_present(record, LIST_KEYS), _first_present(record, BOX_KEYS)
        found = let(listed, lambda x: F.when(x.isNotNull(), wrapped(F.transform(_as_list(x), item))))
        return F.coalesce(found, F.when(boxed.isNotNull(), wrapped(F.array(item(v)))))

    def of_list(items: Column) -> Column:
        return F.when(F.forall(items, lambda e: e.isNotNull()), wrapped(items))

    return F.coalesce(let(F.try_variant_get(v, "$", RECORD), of_record), let(F.transform(_as_list(v), item), of_list))


def _label(record: Column, names: Sequence[str]) -> Column:
    texts = F.coalesce(*[record[k] for k in LABEL_KEYS])
    return F.coalesce(let(texts, lambda t: canonical_label(t, names)), F.lit(""))


def _coordinates(v: Column) -> Column:
    """Four doubles of a box given as a list or as named corners."""

    def listed(corners: Column) -> Column:
        numbers = _as_list(v)
        for keys in reversed(CORNER_KEYS):
            every = F.size(F.array_intersect(F.map_keys(corners), F.array(*[F.lit(k) for k in keys]))) == len(keys)
            named = F.array(*[F.try_element_at(corners, F.lit(k)) for k in keys])
            numbers = F.when(corners.isNotNull() & every, named).otherwise(numbers)
        return numbers

    def each(numbers: Column) -> Column:
        return F.transform(numbers, lambda e: F.when(F.schema_of_variant(e) != "BOOLEAN", F.try_variant_get(e, "$", "double")))

    # most boxes are lists of numbers and nothing else, read at once
    plain = F.schema_of_variant(v).rlike(r"^ARRAY<(?:BIGINT|DOUBLE|DECIMAL\([0-9,]+\))>$")
    return F.when(plain, F.try_variant_get(v, "$", "array<double>")).otherwise(each(let(_as_map(v), listed)))


def valid_box(box: Column) -> Column:
    """Four finite corners inside 0..1000 with positive width and height."""
    x0, y0, x1, y1 = (F.get(box, F.lit(i)) for i in range(4))
    inside = (x0 >= 0) & (y0 >= 0) & (x1 <= 1000) & (y1 <= 1000) & (x1 > x0) & (y1 > y0)
    finite = F.forall(box, lambda n: n.isNotNull() & ~F.isnan(n))
    return F.coalesce((F.size(box) == 4) & finite & inside, F.lit(False))


def _recovered(raw: Column, names: Sequence[str], fragment_chars: int) -> Column:
    def read(fragment: Column) -> Column:
        box = F.transform(F.split(F.regexp_extract(fragment, BOX_TEXT, 1), ","), lambda n: n.try_cast("double"))
        label = let(F.regexp_extract(fragment, LABEL_TEXT, 1), lambda t: canonical_label(t, names))
        return F.struct(label.alias("label"), box.alias("bbox_2d"))

    boxes = F.transform(F.regexp_extract_all(raw, F.lit(rf"(?s)\{{[^{{}}]{{0,{fragment_chars}}}\}}"), F.lit(0)), read)
    return F.filter(boxes, lambda d: valid_box(d["bbox_2d"]) & (d["label"] != ""))


def extract_detections(
    df: DataFrame, raw: str = "raw_model_output", names: Sequence[str] = CLASS_NAMES, fragment_chars: int = FRAGMENT_CHARS
) -> DataFrame:
    """Add ``detections, schema_valid, status`` to every row of ``df``.

    The whole text and fenced blocks may be JSON or Python literals; a value
    inside other text must be JSON, at any depth, and is found by one pass over
    the brackets of such texts. Of repeated keys the last one
    counts: the session setting for VARIANT is changed for that. Objects of up
    to ``fragment_chars`` characters are looked for where nothing else is found.

    Each stage is its own projection, so a parsed value is computed once and
    read by name in the next stage.
    """

    def accepted(v: Column, how: str) -> Column:
        return let(_items(v), lambda f: F.when(f.isNotNull(), F.struct(f["items"].alias("items"), F.lit(how).alias("how"))))

    def parsed(text: Column) -> Column:
        return F.when(_may_open(text), F.try_parse_json(text))

    def judged(text: Column) -> Column:
        """First reading that looks like boxes; later readings are not tried."""
        literal = F.when(text.rlike(LITERAL_OPENING), _as_literal(text))
        return F.coalesce(
            let(parsed(text), lambda v: accepted(v, "json")),
            let(let(literal, parsed), lambda v: accepted(v, "python_literal")),
        )

    def read(item: Column) -> Column:
        box = let(_first_present(item, BOX_KEYS), _coordinates)
        return F.struct(_label(item, names).alias("label"), box.alias("bbox_2d"))

    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    text = F.coalesce(F.col(raw), F.lit(""))
    nothing = F.lit(None).cast(f"struct<items:array<{ITEM}>,how:string>")
    out = df.withColumn("_whole", judged(_edges_off(text)))
    fenced = F.aggregate(_fenced(_edges_off(text)), nothing, lambda got, c: F.coalesce(got, judged(c)))
    out = out.withColumn("_fenced", F.when(F.col("_whole").isNull() & text.contains("```"), fenced))
    # only texts without a payload so far are searched for a value inside them
    open_ = F.when(F.col("_whole").isNull() & F.col("_fenced").isNull() & text.rlike(r"[\[{]"), text)
    out = out.withColumn("_span", wanted_value(open_, (*LIST_KEYS, *BOX_KEYS)))
    out = out.withColumn("_inside", let(F.try_parse_json("_span"), lambda v: accepted(v, "json")))
    out = out.withColumn("_payload", F.coalesce("_whole", "_fenced", "_inside"))
    out = out.withColumn("_items", F.col("_payload")["items"])
    out = out.withColumn("_read", F.transform("_items", read))
    out = out.withColumn(
        "_valid", F.filter("_read", lambda d: valid_box(d["bbox_2d"]) & (d["label"] != ""))
    ).withColumn("_recovered", F.when(F.col("_items").isNull(), _recovered(text, names, fragment_chars)))
    how = F.col("_payload")["how"]
    partial = F.size("_valid") < F.size("_items")
    found = F.size("_recovered") > 0
    out = (
        out.withColumn("detections", F.when(F.col("_items").isNotNull(), F.col("_valid")).otherwise(F.col("_recovered")))
        .withColumn("schema_valid", F.col("_items").isNotNull() & ~partial)
        .withColumn(
            "status",
            F.when(F.col("_items").isNotNull(), F.when(partial, F.concat(how, F.lit("_partial_invalid_objects"))).otherwise(how))
            .when(found, "recovered_bbox_regex")
            .when(F.col("_payload").isNotNull(), "missing_objects")
            .otherwise("invalid_json"),
        )
    )
    return out.drop("_whole", "_fenced", "_span", "_inside", "_payload", "_items", "_read", "_valid", "_recovered")


def derived_count(detections: Column, mode: Column, target: Column, names: Sequence[str] = CLASS_NAMES) -> Column:
    """Boxes, distinct labels, or boxes of the target label."""
    labels = F.transform(detections, lambda d: d["label"])
    wanted = canonical_label(target, names)
    return (
        F.when(mode == "instances", F.size(labels))
        .when(mode == "classes", F.size(F.array_distinct(labels)))
        .when(mode == "target", F.size(F.filter(labels, lambda x: x == wanted)))
    )
