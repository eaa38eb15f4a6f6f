"""Prompt text per strategy and answer format, and the sentence on the window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.labels import counting_question
from tallyframe.functions.text import class_arity_is_multi, is_multi_select, seconds_stamp
from tallyframe.taxonomy import CLASS_NAMES

# --- fixed values: the wording that a model was prompted with ---
YES_NO = "Answer with exactly one word: yes or no."
DIGITS = "Answer with a single non-negative integer (digits only)."
DIGITS_V2 = "Count carefully, then answer with a single non-negative integer (digits only, no words)."
NAMES = (
    "Answer with one or more of these foreign-object names: {names}. Separate multiple names "
    "with a comma and a space. If none is visible, answer: none. Output only the name(s)."
)
NAMES_V2_MULTI = (
    "Name every class that is visible, using these names: {names}. Separate multiple names with "
    "a comma and a space, and name each class at most once. If none is visible, answer: none. "
    "Output only the name(s)."
)
NAMES_V2_SINGLE = (
    "Answer with exactly ONE of these names: {names}. If none is visible, answer: none. "
    "Output only the name."
)
OPTIONS_MULTI = (
    "Answer by copying the correct option(s) from the list, verbatim; separate multiple options "
    "with a comma and a space. If none apply, answer: none. Output nothing else."
)
OPTIONS_SINGLE = "Answer by copying EXACTLY ONE of the listed options, verbatim, and nothing else."
PERCENT = "Answer with a single number (a percentage)."
STAMPS = (
    "Answer with one or more timestamps as hh:mm:ss. Separate multiple timestamps with a comma "
    "and a space."
)
BRIEF = "Answer concisely, in a few words."
BRIEF_V2 = "Answer concisely, in a few words (under 300 characters)."
OWN_FORMAT = "Follow that format exactly, in under 300 characters."
OWN_FORMAT_CUES = "(?i)in the following format|please provide the answer in|for example:"
BOX_SCHEMA = (
    "Solve this by localizing objects before counting. Return exactly this JSON schema and "
    'nothing else:\n{"objects":[{"label":"<class>","bbox_2d":[x_min,y_min,x_max,y_max]}]}'
)
BOX_RULES = (
    "Coordinates must be integers normalized to 0-1000, ordered as [x_min,y_min,x_max,y_max]. "
    "Use only these canonical labels: {names}."
)
BOX_NONE = 'If no requested object is visible, return {"objects":[]}.'
BOX_EXAMPLE = (
    "One-shot format example:\nQuestion: How many Clips appear in this frame?\nAssistant: "
    '{"objects":[{"label":"Clip","bbox_2d":[88,140,166,230]},{"label":"Clip","bbox_2d":[612,355,701,438]}]}'
)
BOX_TARGET = 'Include only visible instances of the class "%s" and omit objects from every other class.'
BOX_REDUCE = {
    "instances": "The caller will count all valid boxes.",
    "classes": "The caller will count the distinct labels attached to valid boxes.",
}
BOX_REDUCE_TARGET = 'The caller will count valid boxes labeled "%s".'
BOX_END = "Do not include a count field or a final numeric answer."
BOX_SELECT = {
    "instances": "Include one object entry for every visible foreign-object instance, regardless of class.",
    "classes": (
        "Include one object entry for every visible foreign-object instance and label each one "
        "with its canonical class."
    ),
}
SYSTEM_FRAME = (
    "You are an expert surgical vision assistant analysing a single endoscopic frame from "
    "colorectal surgery. Look carefully at the image and answer the question. Respond with ONLY "
    "the answer in the exact requested format \u2014 no explanation, no extra words."
)
SYSTEM_BOXES = (
    "You are an expert surgical vision assistant analysing a single endoscopic frame from "
    "colorectal surgery. For a counting question, localize the requested visible foreign objects "
    "and respond with ONLY valid JSON matching the requested schema. Do not answer with a bare "
    "number or add an explanation; the caller will derive the count from your bounding boxes."
)
SYSTEM_WINDOW = (
    "You are an expert surgical vision assistant analysing a {shown}. The {what} is shown as a "
    "sequence of frames in chronological order, each labelled with its absolute video timestamp "
    "(hh:mm:ss from the start of the video). Timestamps mentioned in the question refer to that "
    "same absolute video time. Look carefully at the frames and answer the question. Respond with "
    "ONLY the answer in the exact requested format \u2014 no explanation, no extra words."
)
SHOWN = {
    "segment": ("clip from a colorectal surgery video", "clip"),
    "procedure": ("colorectal surgery video from its start up to the current moment", "video"),
}
SHOWN_V2 = {
    "frame": "a single endoscopic frame",
    "segment": "an endoscopic clip",
    "procedure": "an endoscopic video, from its start up to the current moment",
}
ORDER_V2 = (
    " The frames are in chronological order, each labelled with its absolute video timestamp "
    "(hh:mm:ss from the start of the video); timestamps in the question refer to that same "
    "absolute video time."
)
CLOSING_V2 = (
    "Look carefully, then answer in exactly the format the question asks for. Give the answer only "
    "\u2014 no explanation, no restating the question."
)
SCOPE_V2 = (
    "A foreign object is an object fully introduced into the body cavity that must be retrieved or "
    "accounted for. Instruments that stay connected to the outside (graspers, scissors, trocars, "
    "staplers, the camera) are not foreign objects, and neither are detachable stapler anvils."
)
SCOPE_V3 = (
    "A foreign object is an object introduced into the body cavity that must be retrieved or "
    "accounted for, such as a sponge, clip, needle or drain. Several may be present at once."
)
ANY_PROCEDURE = "minimally invasive"
# strategy -> (scope, whether classes are described)
V2_FAMILY = {
    "v2": (SCOPE_V2, True),
    "v2-noscope": (None, True),
    "v2-nodesc": (SCOPE_V2, False),
    "v3": (SCOPE_V3, False),
    "v3-desc": (SCOPE_V3, True),
}
DESCRIPTIONS = {
    "Sponge": "soft absorbent pad, white when fresh, reddish-brown when blood-soaked",
    "Clip": "small metal or polymer vessel/duct clip; counts only once placed, not while still in the applier",
    "Specimen Bag": "sterile retrieval pouch; the pouch only, not its string",
    "Silicone Loop": "soft flexible band, usually white, encircling a vessel for traction",
    "External Drain": "clear or fluid-filled tube evacuating fluid out of the body",
    "Needle": "sharp straight or curved suture needle; suture thread alone does not count",
    "Gallstone": "roundish white/yellow calcified concretion from the gallbladder",
    "Specimen": "excised tissue or organ, fully detached, awaiting retrieval; not fat or blood",
    "Mesh": "screen-like implantable patch reinforcing a muscle wall; more open weave than a sponge",
    "Absorbable Hemostatic Agent": "resorbable white or pale-yellow frizzy mesh applied to a bleeding surface",
}
# --- end of fixed values ---

STRATEGIES = ("direct", "bbox-json", *V2_FAMILY)


def instruction(
    question: Column,
    answer_format: Column,
    strategy: str = "direct",
    names: Sequence[str] = CLASS_NAMES,
) -> Column:
    """Question followed by the output rule of its answer format."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown prompt strategy: {strategy}")
    roster = ", ".join(names)
    chosen = F.when(is_multi_select(question), OPTIONS_MULTI).otherwise(OPTIONS_SINGLE)
    if strategy in V2_FAMILY:
        classes = F.when(class_arity_is_multi(question), NAMES_V2_MULTI.format(names=roster)).otherwise(
            NAMES_V2_SINGLE.format(names=roster)
        )
        digits, brief = F.lit(DIGITS_V2), F.when(question.rlike(OWN_FORMAT_CUES), OWN_FORMAT).otherwise(BRIEF_V2)
    else:
        classes, digits, brief = F.lit(NAMES.format(names=roster)), F.lit(DIGITS), F.lit(BRIEF)
    rule = (
        F.when(answer_format == "binary", YES_NO)
        .when(answer_format == "number", digits)
        .when(answer_format == "fo_class", classes)
        .when(answer_format == "multiple_choice", chosen)
        .when(answer_format == "percentage", PERCENT)
        .when(answer_format == "time", STAMPS)
        .otherwise(brief)
    )
    plain = F.concat(question, F.lit("\n\n"), rule)
    if strategy != "bbox-json":
        return plain
    asked = counting_question(question, answer_format, names)

    def by_mode(fixed: dict[str, str], target: str) -> Column:
        out = F.format_string(target, asked["target"])
        for mode, words in fixed.items():
            out = F.when(asked["mode"] == mode, words).otherwise(out)
        return out

    boxed = F.concat(
        question,
        F.lit(f"\n\n{BOX_SCHEMA}\n\n{BOX_RULES.format(names=roster)}\n"),
        by_mode(BOX_SELECT, BOX_TARGET),
        F.lit(f"\n{BOX_NONE}\n\n{BOX_EXAMPLE}\n\n"),
        by_mode(BOX_REDUCE, BOX_REDUCE_TARGET),
        F.lit(f" {BOX_END}"),
    )
    return F.when(asked.isNotNull(), boxed).otherwise(plain)


def system_prompt(track: Column, strategy: str = "direct", procedure: Column | None = None) -> Column:
    """System prompt of a track; the v2 family also names the procedure of the row."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown prompt strategy: {strategy}")
    if strategy not in V2_FAMILY:
        window = {t: SYSTEM_WINDOW.format(shown=shown, what=what) for t, (shown, what) in SHOWN.items()}
        return (
            F.when(track == "segment", window["segment"])
            .when(track == "procedure", window["procedure"])
            .otherwise(SYSTEM_BOXES if strategy == "bbox-json" else SYSTEM_FRAME)
        )
    scope, described = V2_FAMILY[strategy]
    if described:
        listed = "\n".join(f"- {name}: {words}" for name, words in DESCRIPTIONS.items())
        roster = f"The canonical classes are exactly these ten:\n{listed}"
    else:
        roster = "The canonical classes are: " + ", ".join(DESCRIPTIONS) + "."
    tail = "\n\n".join(part for part in (scope, roster, CLOSING_V2) if part)
    named = F.lit(None).cast("string") if procedure is None else F.nullif(F.trim(procedure), F.lit(""))
    shown = (
        F.when(track == "frame", SHOWN_V2["frame"])
        .when(track == "segment", SHOWN_V2["segment"])
        .otherwise(SHOWN_V2["procedure"])
    )
    return F.concat(
        F.lit("You are an expert surgical vision assistant analysing "),
        shown,
        F.lit(" from a "),
        F.coalesce(named, F.lit(ANY_PROCEDURE)),
        F.lit(" procedure."),
        F.when(track == "frame", "").otherwise(ORDER_V2),
        F.lit("\n\n" + tail),
    )


def window_preamble(
    track: Column, start: Column, end: Column, frames: Column, variant: str = "shared"
) -> Column:
    """What span the frames cover and how far apart they are.

    ``container`` decides by the start of the window and not by the track.
    """
    length = F.greatest(end - start, F.lit(0.0))
    gap = F.when(frames > 1, length / (frames - 1)).otherwise(0.0)
    from_start = F.format_string("The surgical video from its start (00:00:00) up to %s", seconds_stamp(end))
    a, b = seconds_stamp(start), seconds_stamp(end)
    if variant == "container":
        clip = F.format_string("This procedure clip covers absolute video time %s to %s", a, b)
        span = F.concat(F.when(start <= 0.5, from_start).otherwise(clip), F.lit(" and is shown"))
        alone = " as a single frame labelled with its absolute video timestamp."
    elif variant == "shared":
        clip = F.format_string(
            "This clip covers video time %s to %s (%d s of surgery). It is shown", a, b, F.rint(length).cast("bigint")
        )
        span = F.when(track == "procedure", F.concat(from_start, F.lit(" is shown"))).otherwise(clip)
        alone = " as a single frame, each labelled with its absolute video timestamp."
    else:
        raise ValueError(f"unknown variant: {variant}")
    many = F.format_string(
        " as %d frames in chronological order, about %d s apart, each labelled with its absolute video timestamp.",
        frames.cast("bigint"),
        F.rint(gap).cast("bigint"),
    )
    return F.concat(span, F.when(frames > 1, many).otherwise(alone))


def frame_labels(indices: Column, fps: Column) -> Column:
    """``Frame at HH:MM:SS:`` for every index."""
    return F.transform(indices, lambda i: F.concat(F.lit("Frame at "), seconds_stamp(i / fps), F.lit(":")))
