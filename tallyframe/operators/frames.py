"""Frame plans: which frame indices a time window samples, clipped and checked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numbers import even_positions, frame_folder, frame_index, frame_name
from tallyframe.functions.text import let, seconds_stamp


def window_indices(
    start: Column, end: Column, fps: Column, stride: Column, cap: Column | None = None
) -> Column:
    """Sampled indices of one window, in closed form.

    The grid is ``start, start + stride, ..`` up to the last frame. Its length
    follows by division, so only the kept positions are built, however long
    the window is. A window that ends at or before its start has one index.
    """
    first = frame_index(start, fps)
    last = F.greatest(frame_index(end, fps), first)
    step = F.greatest(stride.cast("bigint"), F.lit(1))

    def grid(w: Column) -> Column:
        n = F.floor((w["last"] - w["first"]) / w["step"]) + 1
        places = even_positions(n, n if cap is None else F.coalesce(cap.cast("bigint"), n))
        return F.transform(places, lambda p: w["first"] + p * w["step"])

    return let(F.struct(first.alias("first"), last.alias("last"), step.alias("step")), grid)


def sized_windows(df: DataFrame, cap: bool = True) -> DataFrame:
    """Each window as first frame, step, positions on its grid and kept positions with their gap.

    Needs ``start_s, end_s, fps, stride`` and, when capped, ``max_frames``. More
    frames than the cap are at least one step apart, so no position repeats.
    """
    return (
        df.withColumn("_first", frame_index(F.col("start_s"), F.col("fps")))
        .withColumn("_last", F.greatest(frame_index(F.col("end_s"), F.col("fps")), F.col("_first")))
        .withColumn("_step", F.greatest(F.col("stride").cast("bigint"), F.lit(1)))
        .withColumn("_n", F.floor((F.col("_last") - F.col("_first")) / F.col("_step")) + 1)
        .withColumn("_k", F.least(F.col("_n"), F.col("max_frames").cast("bigint")) if cap else F.col("_n"))
        .withColumn(
            "_gap",
            # never NULL to the planner, which else checks it by an expression of all the columns above
            F.coalesce(F.when((F.col("_k") < F.col("_n")) & (F.col("_k") > 1), (F.col("_n") - 1) / (F.col("_k") - 1)), F.lit(1.0)),
        )
    )


WINDOW = ("_first", "_step", "_k", "_gap")


def listed_frames(windows: DataFrame) -> DataFrame:
    """One row per kept position of a sized window, its index a plain column ``frame``."""
    rows = windows.withColumn("position", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_k") - 1)))
    place = F.rint(F.col("position") * F.col("_gap")).cast("bigint")
    return rows.withColumn("frame", F.col("_first") + place * F.col("_step"))


def question_frames(df: DataFrame, cap: bool = True) -> DataFrame:
    """One row per question and sampled frame: the grid of ``window_indices`` without building lists."""
    return listed_frames(sized_windows(df, cap)).select(*df.columns, "position", "frame")


def with_folder(df: DataFrame, folder: str = "frames") -> DataFrame:
    """Questions with the path of their video's frames in ``folder``, found once per question."""
    return df.withColumn("folder", frame_folder(F.lit(folder), F.col("video").cast("string")))


def frame_details(frames: DataFrame, folder: str = "frames") -> DataFrame:
    """Seconds, label and path of every sampled frame; frames of ``with_folder`` bring their folder."""
    seconds = F.col("frame") / F.col("fps")
    root = F.col("folder") if "folder" in frames.columns else frame_folder(F.lit(folder), F.col("video").cast("string"))
    return frames.select(
        "*",
        seconds.alias("seconds"),
        seconds_stamp(seconds).alias("stamp"),
        F.concat(root, frame_name(F.col("frame"))).alias("path"),
    )


# -- sets of frames as bits ----------------------------------------------------------
#
# A set of frames of a video is rows (video, word, bits) with 64 frames a word, which
# lie ``APART`` frames apart: sampling steps are multiples of 25 or 30 frames, so the
# frames of a window fill its words. Words of a video's windows merge by ``bit_or``
# inside every task, so a shuffle carries words and never frames; union, clip and
# difference are bit operations on long values, which stay inside generated code.

APART = 150


def _turn(frame: Column) -> Column:
    return F.call_function("div", frame - F.pmod(frame, F.lit(APART)), F.lit(APART))


def _word(frame: Column) -> Column:
    return F.shiftright(_turn(frame), 6) * APART + F.pmod(frame, F.lit(APART))


def _bit(frame: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), _turn(frame).bitwiseAND(63).cast("int"))


def _first_turn() -> tuple[Column, Column]:
    """First turn of a word's frames, and their offset inside a turn."""
    offset = F.pmod(F.col("word"), F.lit(APART))
    return F.call_function("div", F.col("word") - offset, F.lit(APART)) * 64, offset


def as_words(frames: DataFrame, keys: Sequence[str], **sets: Column) -> DataFrame:
    """``frame`` rows as ``(keys, word)`` with one bit column per named set of rows."""
    ours = [F.coalesce(F.bit_or(F.when(hit, _bit(F.col("frame")))), F.lit(0)).alias(n) for n, hit in sets.items()]
    return frames.groupBy(*keys, _word(F.col("frame")).alias("word")).agg(*ours)


def plan_words(df: DataFrame, keys: Sequence[str] = ("dataset", "video"), cap: bool = True) -> DataFrame:
    """Frames that any question of a video needs, as words in ``want``.

    Equal windows of a video are listed once, however many questions share them.
    """
    windows = sized_windows(df, cap).select(*keys, *WINDOW).distinct()
    return as_words(listed_frames(windows), keys, want=F.lit(True))


def inventory_words(files: DataFrame, keys: Sequence[str] = ("dataset", "video")) -> DataFrame:
    """Files ``(keys, frame, size)`` as words: ``have`` those with content, ``empty`` those without.

    A frame that several files claim is there if any of them has content.
    """
    words = as_words(files, keys, have=F.col("size") > 0, empty=F.col("size") == 0)
    return words.withColumn("empty", F.col("empty").bitwiseAND(F.bitwise_not("have")))


def listed_words(words: DataFrame, keys: Sequence[str], bits: str) -> DataFrame:
    """The frames of a set, one row each."""
    turn, offset = _first_turn()
    rows = words.where(F.col(bits) != 0).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return rows.where(F.getbit(bits, "_b") == 1).select(*keys, ((turn + F.col("_b")) * APART + offset).alias("frame"))


def build_plan(df: DataFrame, keys: Sequence[str] = ("dataset", "video")) -> DataFrame:
    """Distinct frame indices that any question of a video needs."""
    return listed_words(plan_words(df, keys), keys, "want")


def _inside(count: Column) -> Column:
    """Bits of a word's frames below ``count``; all where the count is NULL."""
    turn, offset = _first_turn()
    left = F.call_function("div", count - offset + (APART - 1), F.lit(APART)) - turn  # turns whose frame lies below the count
    whole = F.lit(-1).cast("bigint")
    part = F.call_function("shiftrightunsigned", whole, (64 - left).cast("int"))
    below = F.when((count <= offset) | (left <= 0), F.lit(0).cast("bigint")).when(left >= 64, whole).otherwise(part)
    return F.when(F.col("word") < 0, F.lit(0).cast("bigint")).otherwise(F.coalesce(below, whole))


def clip_words(
    words: DataFrame, frame_counts: DataFrame, keys: Sequence[str] = ("dataset", "video"), how: str = "inner"
) -> DataFrame:
    """Split ``want`` at the decoded length: ``want`` keeps what lies inside, ``clipped`` the rest.

    Joined rows are words; ``how='left'`` keeps videos of unknown length whole.
    """
    joined = words.join(frame_counts.select(*keys, "frame_count"), list(keys), how)
    inside = F.col("want").bitwiseAND(_inside(F.col("frame_count")))
    return joined.select(*keys, "word", inside.alias("want"), F.col("want").bitwiseXOR(inside).alias("clipped"))


def clip_summary(clipped: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    total = lambda c: F.sum(F.bit_count(c)).cast("bigint").alias
    return clipped.groupBy(*keys).agg(total("want")("kept"), total("clipped")("clipped"))


def _without(a: str, b: str) -> Column:
    return F.col(a).bitwiseAND(F.bitwise_not(b))


def compared_words(plan: DataFrame, inventory: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Words of a plan and of an inventory side by side, 0 where one has none."""
    names = ("want", "have", "empty")
    zero = F.lit(0).cast("bigint")
    sides = [
        words.select(*keys, "word", *[F.col(n) if n in words.columns else zero.alias(n) for n in names]) for words in (plan, inventory)
    ]
    both = sides[0].unionByName(sides[1])
    return both.groupBy(*keys, "word").agg(*[F.bit_or(n).alias(n) for n in names])


# Files meet questions as strips: the words of a block of ``SPAN`` frames whose frames
# agree modulo ``LANES``, a common divisor of the sampling steps. A window of such a step
# touches one strip per block, so the join carries one or two rows per question.

LANES = 5
SPAN = 64 * APART
STRIP = ("block", "lane")


def _floor_div(n: Column, by: int) -> Column:
    return F.call_function("div", n - F.pmod(n, F.lit(by)), F.lit(by))


def as_strips(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``frame`` rows as ``(keys, block, lane, bits)``, ``bits`` one word per offset of the lane.

    Repeated rows say nothing new.
    """
    frame = F.col("frame")
    slot = F.call_function("div", F.pmod(frame, F.lit(APART)), F.lit(LANES))
    strip = _floor_div(frame, SPAN).alias("block"), F.pmod(frame, F.lit(LANES)).alias("lane")
    rows = frames.select(*keys, *strip, slot.alias("_slot"), _bit(frame).alias("_bit"))
    zero = F.lit(0).cast("bigint")
    words = [F.bit_or(F.when(F.col("_slot") == i, F.col("_bit")).otherwise(zero)) for i in range(APART // LANES)]
    return rows.groupBy(*keys, *STRIP).agg(F.array(*words).alias("bits"))


def window_strips(windows: DataFrame) -> DataFrame:
    """Sized windows by the strips they touch, with the positions ``_from`` to ``_to`` that may lie in each.

    A window with no more frames than blocks has one row per frame instead, so its
    rows never outnumber its frames by more than the lanes.
    """
    first, step, k, gap = (F.col(c) for c in WINDOW)
    piece, few = F.col("_piece"), F.col("_few")
    place = lambda p: first + F.rint(p * gap).cast("bigint") * step
    sized = windows.withColumns({"_low": _floor_div(first, SPAN), "_high": _floor_div(place(k - 1), SPAN)})
    sized = sized.withColumns({
        "_few": F.col("_high") - F.col("_low") >= k - 1,
        "_every": F.when(step % LANES == 0, LANES).otherwise(1).cast("bigint"),
    })
    # pieces are positions, or strips counted through: block * LANES + lane
    start = F.col("_low") * LANES + F.pmod(first, F.col("_every"))
    pieces = F.when(~few, F.sequence(start, F.col("_high") * LANES + (LANES - 1), F.col("_every")))
    rows = sized.withColumn("_piece", F.explode(pieces.when(k > 0, F.sequence(F.lit(0).cast("bigint"), k - 1))))
    at = F.when(few, place(piece)).otherwise(_floor_div(piece, LANES) * SPAN + F.pmod(piece, F.lit(LANES)))
    rows = rows.withColumn("_at", at)  # a frame of the strip
    zero = F.lit(0).cast("bigint")  # for the planner: a piece has a strip
    rows = rows.withColumns({"block": F.coalesce(_floor_div(F.col("_at"), SPAN), zero), "lane": F.coalesce(F.pmod("_at", F.lit(LANES)), zero)})
    # one position more at either end, as division rounds; the reader checks the strip of each frame
    begin = (F.col("block") * SPAN - first) / step / gap
    low = F.greatest(F.floor(begin).cast("bigint") - 1, F.lit(0).cast("bigint"))
    high = F.least(F.ceil(begin + SPAN / step / gap).cast("bigint") + 1, k - 1)
    own = {"_from": F.when(few, piece).otherwise(low), "_to": F.when(few, piece).otherwise(high)}
    return rows.withColumns(own).drop("_piece", "_few", "_every", "_low", "_high", "_at")


def present_frames(windows: DataFrame, strips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``listed_frames`` of sized windows, only frames that the strips of their video have."""
    met = window_strips(windows).join(strips, [*keys, *STRIP])
    span = F.when(F.col("_from") <= F.col("_to"), F.sequence("_from", "_to"))
    rows = met.withColumn("position", F.explode(span))
    frame = F.col("_first") + F.rint(F.col("position") * F.col("_gap")).cast("bigint") * F.col("_step")
    spot = frame - F.col("block") * SPAN
    word = F.get("bits", F.call_function("div", F.pmod(spot, F.lit(APART)), F.lit(LANES)).cast("int"))
    there = F.getbit(word, F.call_function("div", spot, F.lit(APART)).bitwiseAND(63).cast("int")) == 1
    rows = rows.where((spot >= 0) & (spot < SPAN) & (F.pmod(spot, F.lit(LANES)) == F.col("lane")) & there)
    return rows.withColumn("frame", frame)


def sampled_frames(
    df: DataFrame,
    frame_counts: DataFrame | None = None,
    inventory: DataFrame | None = None,
    keys: Sequence[str] = ("dataset", "video"),
) -> DataFrame:
    """Frames of every question, clipped to the decoded length, without frames that have no file.

    A video without a frame count is not clipped; with ``inventory`` given, a frame
    without any file is dropped, one with an empty file stays. Windows meet the files
    as strips, so joined rows are stretches of a video and never frames.
    """
    own = sized_windows(df)
    if frame_counts is not None:
        own = own.join(frame_counts.select(*keys, F.col("frame_count").alias("_count")), list(keys), "left")
    rows = listed_frames(own) if inventory is None else present_frames(own, as_strips(inventory, keys), keys)
    if frame_counts is not None:
        rows = rows.where(F.col("_count").isNull() | ((F.col("frame") >= 0) & (F.col("frame") < F.col("_count"))))
    return rows.select(*df.columns, "position", "frame")


def with_sampling(df: DataFrame, plan: DataFrame) -> DataFrame:
    """Attach fps, stride, frame cap and pixel budget of the track and dataset.

    The sampling plan has one row per (track, dataset): six rows.
    """
    return df.join(F.broadcast(plan), ["track", "dataset"])


def coverage(
    df: DataFrame, inventory: DataFrame, keys: Sequence[str] = ("dataset", "video"), cap: bool = True
) -> DataFrame:
    """Questions, mean frames per question, unique and missing frames per dataset.

    ``df`` has one row per question; its number of frames follows by division.
    """
    questions = sized_windows(df, cap).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("questions"), F.avg("_k").alias("mean_frames_per_question")
    )
    files = inventory_words(inventory, keys).select(*keys, "word", "have")
    both = plan_words(df, keys, cap).join(files, [*keys, "word"], "left").fillna(0, ["have"])
    found = both.groupBy("dataset").agg(
        F.sum(F.bit_count("want")).cast("bigint").alias("unique_frames"),
        F.sum(F.bit_count(_without("want", "have"))).cast("bigint").alias("missing"),
    )
    return questions.join(found, "dataset")


def missing_examples(
    df: DataFrame, inventory: DataFrame, keys: Sequence[str] = ("dataset", "video"), show: int = 10
) -> DataFrame:
    """The first missing frames in key order; every task sends its first ones."""
    files = inventory_words(inventory, keys).select(*keys, "word", "have")
    both = plan_words(df, keys).join(files, [*keys, "word"], "left").fillna(0, ["have"])
    gone = both.withColumn("gone", _without("want", "have"))
    return listed_words(gone, keys, "gone").orderBy(*keys, "frame").limit(show)


def grid_words(
    plan: DataFrame, files: DataFrame, grids: Sequence[str], keys: Sequence[str] = ("dataset", "video")
) -> DataFrame:
    """Words of a plan split by the grid that serves them: one bit column per grid of ``grids`` and ``none``.

    ``files`` has ``(keys, frame, grid)``; a frame goes to the first grid in which it
    lies, as ``joins.first_available`` has it for rows. Joined rows are words.
    """
    there = as_words(files, keys, **{f"_{g}": F.col("grid") == g for g in grids})
    out = plan.join(there, [*keys, "word"], "left").fillna(0, [f"_{g}" for g in grids]).withColumn("none", F.col("want"))
    for g in grids:
        out = out.withColumn(g, F.col("none").bitwiseAND(F.col(f"_{g}"))).withColumn("none", _without("none", f"_{g}"))
    return out.select(*keys, "word", "want", *grids, "none")


def grid_frames(words: DataFrame, grids: Sequence[str], keys: Sequence[str] = ("dataset", "video")) -> DataFrame:
    """The frames of ``grid_words`` one row each, with their grid or ``none`` in ``source``."""
    turn, offset = _first_turn()
    rows = words.where(F.col("want") != 0).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(63))))
    source = F.lit("none")
    for g in reversed(grids):
        source = F.when(F.getbit(F.col(g), F.col("_b")) == 1, g).otherwise(source)
    return rows.where(F.getbit("want", "_b") == 1).select(*keys, ((turn + F.col("_b")) * APART + offset).alias("frame"), source.alias("source"))


def verify_plan(plan: DataFrame, inventory: DataFrame, keys: Sequence[str] = ("dataset", "video")) -> DataFrame:
    """Expected, missing, unexpected and empty files per video of the plan.

    ``plan`` has words (``plan_words`` or ``clip_words``), ``inventory`` one row per file.
    """
    both = compared_words(plan, inventory_words(inventory, keys), keys)
    total = lambda c: F.sum(F.bit_count(c)).cast("bigint")
    out = both.groupBy(*keys).agg(
        total("want").alias("expected"),
        total(_without("want", "have")).alias("missing"),
        total(_without("have", "want")).alias("unexpected"),
        total("empty").alias("empty"),
    )
    return out.where(F.col("expected") > 0)


def jittered_frames(df: DataFrame, cap: int, phase: Column) -> DataFrame:
    """One frame per second from the window start plus a phase, capped."""
    moved = F.least(F.col("start_s") + phase, F.col("end_s"))
    return question_frames(
        df.withColumns({"start_s": moved, "stride": F.col("fps"), "max_frames": F.lit(cap)})
    )


def copy_offset(copy_no: Column, fps: Column) -> Column:
    """Frames by which a copy of a question is shifted: 0 for the first, spread over a second for the rest.

    Multiples of a step near the golden section of a second, without common divisor
    with it: the offsets of ``fps`` copies are all different, and those of the first
    few lie far apart.
    """
    def divisor(a: Column, b: Column) -> Column:
        start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
        step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], s["b"]).alias("b")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(20)), start, step)["a"]

    near = F.greatest(F.rint(fps * 0.6180339887498949), F.lit(1)).cast("bigint")
    steps = F.filter(F.sequence(near, near + fps.cast("bigint")), lambda g: divisor(g, fps) == 1)
    return F.pmod((copy_no - 1).cast("bigint") * F.get(steps, F.lit(0)), fps.cast("bigint"))


def phased_frames(df: DataFrame, cap: int) -> DataFrame:
    """One frame per second from the window start plus the offset of ``copy_no``, capped.

    Copies of a question share no frame as long as its window has more than a
    second and it has no more copies than frames a second; a shorter window ends at
    its last frame for all of them.
    """
    sized = sized_windows(df.withColumns({"stride": F.col("fps"), "max_frames": F.lit(cap)}))
    first = F.least(F.col("_first") + copy_offset(F.col("copy_no"), F.col("fps")), F.col("_last"))
    moved = sized.withColumn("_first", first).withColumn("_n", F.floor((F.col("_last") - F.col("_first")) / F.col("_step")) + 1)
    moved = moved.withColumn("_k", F.least(F.col("_n"), F.lit(cap).cast("bigint")))
    gap = F.when((F.col("_k") < F.col("_n")) & (F.col("_k") > 1), (F.col("_n") - 1) / (F.col("_k") - 1)).otherwise(1.0)
    return listed_frames(moved.withColumn("_gap", gap)).select(*df.columns, "position", "frame")
