"""Numeric helpers: hash draws, frame indices, special functions, geometry."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


# -- reproducible draws --------------------------------------------------------


def hash_text(seed: int | Column | str, *key: Column) -> Column:
    """md5 of ``seed|key|...``; any SQL engine with md5 gives the same text."""
    head = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", head, *[k.cast("string") for k in key]))


def hash_int(digest: Column, digits: int = 8) -> Column:
    """The first hex digits of a digest as an integer."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def uniform_index(digest: Column, n: Column) -> Column:
    """An index in ``[0, n)`` picked by the digest (52 bits, so any real ``n`` is fair)."""
    return F.pmod(hash_int(digest, 13), n.cast("bigint"))


def uniform_unit(digest: Column, first: int = 1) -> Column:
    """A number in [0, 1) from 13 hex digits of a digest."""
    return F.conv(F.substring(digest, first, 13), 16, 10).cast("bigint") / float(1 << 52)


def case_id(dataset: Column, video: Column, timestamp: Column) -> Column:
    key = F.concat_ws("\u0000", dataset, video, timestamp)
    return F.concat(dataset, F.lit("-"), F.substring(F.sha1(key), 1, 16))


# -- frames ----------------------------------------------------------------------


def frame_index(seconds: Column, fps: Column) -> Column:
    return F.rint(seconds * fps).cast("bigint")


def zero_padded(n: Column, digits: int) -> Column:
    """A whole number as text of at least ``digits`` characters, sign included.

    A format call would parse its pattern for every row.
    """
    n = n.cast("bigint")
    text = lambda x, d: F.substring((x + 10**d).cast("string"), 2, d)
    short = F.when((n >= 0) & (n < 10**digits), text(n, digits))
    below = (n < 0) & (n > -(10 ** (digits - 1)))
    return short.when(below, F.concat(F.lit("-"), text(-n, digits - 1))).otherwise(n.cast("string"))


def frame_folder(folder: Column, video: Column) -> Column:
    """Path of a video's frames up to their names."""
    return F.concat(folder, F.lit("/"), F.regexp_replace(video, r"(.)\.[^./]+$", "$1"), F.lit("/"))


def frame_name(index: Column) -> Column:
    return F.concat(F.lit("frame"), zero_padded(index, 7), F.lit(".jpg"))


def frame_path(folder: Column, video: Column, index: Column) -> Column:
    return F.concat(frame_folder(folder, video), frame_name(index))


def even_positions(n: Column, cap: Column, single: str = "first") -> Column:
    """Positions of at most ``cap`` of ``n`` items, both ends kept.

    With a cap of one, ``single`` picks the ``first`` or the ``middle`` item.
    """
    n, cap = n.cast("bigint"), cap.cast("bigint")
    step = (n - 1) / F.greatest(cap - 1, F.lit(1))
    spread = F.array_distinct(
        F.transform(F.sequence(F.lit(0).cast("bigint"), cap - 1), lambda i: F.rint(i * step).cast("bigint"))
    )
    alone = F.lit(0).cast("bigint") if single == "first" else F.floor(n / 2)
    return (
        F.when(n <= cap, F.sequence(F.lit(0).cast("bigint"), n - 1))
        .when(cap <= 1, F.array(alone))
        .otherwise(spread)
    )


def resize_target(
    height: Column, width: Column, factor: int = 32, low: int = 65536, high: Column | int = 602112
) -> tuple[Column, Column]:
    """Height and width snapped to ``factor`` inside a pixel budget; NULL below one factor."""
    top = high if isinstance(high, Column) else F.lit(high)
    area = (height * width).cast("double")
    h0, w0 = F.rint(height / factor) * factor, F.rint(width / factor) * factor
    shrink, grow = F.sqrt(area / top), F.sqrt(F.lit(float(low)) / area)

    def pick(size: Column, snapped: Column) -> Column:
        return (
            F.when((height < factor) | (width < factor), F.lit(None))
            .when(h0 * w0 > top, F.floor(size / shrink / factor) * factor)
            .when(h0 * w0 < low, F.ceil(size * grow / factor) * factor)
            .otherwise(snapped)
            .cast("int")
        )

    return pick(height, h0), pick(width, w0)


# -- special functions Spark does not ship ------------------------------------------


def ln_gamma(z: Column) -> Column:
    """Stirling series, shifted up by eight where the argument is small."""
    z = z.cast("double")
    small = z < 16.0
    w = F.when(small, z + 8.0).otherwise(z)
    series = (
        (w - 0.5) * F.ln(w)
        - w
        + 0.5 * math.log(2 * math.pi)
        + 1 / (12 * w)
        - 1 / (360 * w * w * w)
        + 1 / (1260 * F.pow(w, F.lit(5.0)))
        - 1 / (1680 * F.pow(w, F.lit(7.0)))
    )
    product = z
    for k in range(1, 8):
        product = product * (z + k)
    return series - F.when(small, F.ln(product)).otherwise(0.0)


def erfc(x: Column) -> Column:
    """Complementary error function for ``x >= 0``.

    Power series below two, continued fraction above; both run as JVM folds.
    """
    x = x.cast("double")
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, n: F.struct(
            (a["t"] * 2 * x * x / (2 * n + 1)).alias("t"),
            (a["s"] + a["t"] * 2 * x * x / (2 * n + 1)).alias("s"),
        ),
    )["s"]
    near = 1 - 2 / math.sqrt(math.pi) * x * F.exp(-x * x) * series
    fraction = F.aggregate(
        F.sequence(F.lit(80), F.lit(1), F.lit(-1)),
        F.lit(0.0),
        lambda acc, k: (k / 2.0) / (x + acc),
    )
    far = F.exp(-x * x) / math.sqrt(math.pi) / (x + fraction)
    return F.when(x < 2.0, near).otherwise(far)


def normal_tail(z: Column) -> Column:
    return 0.5 * erfc(F.abs(z) / math.sqrt(2.0))


def binomial_two_sided(b: Column, c: Column) -> Column:
    """Exact two-sided test of ``b`` against ``c`` flips at one half.

    Starts at the largest term and walks down by ratios. Terms further than
    ``sqrt(800 n)`` from the start are below e^-800 of it, so the walk is
    complete in double precision and stays short for any ``n``.
    """
    n, k = (b + c).cast("double"), F.least(b, c).cast("double")
    steps = F.least(k, F.ceil(F.sqrt(800.0 * n)).cast("double")).cast("int")
    peak = ln_gamma(n + 1) - ln_gamma(k + 1) - ln_gamma(n - k + 1) - n * math.log(2.0)
    walk = F.aggregate(
        F.sequence(F.lit(0), F.greatest(steps - 1, F.lit(0))),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, j: F.struct(
            (a["t"] * (k - j) / (n - k + j + 1)).alias("t"),
            (a["s"] + a["t"] * (k - j) / (n - k + j + 1)).alias("s"),
        ),
    )["s"]
    tail = F.when(steps > 0, walk).otherwise(1.0)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2.0 * F.exp(peak) * tail))


def binomial_log(x: Column, n: Column, p: Column) -> Column:
    """Logarithm of the chance of ``x`` hits in ``n`` draws, for 0 < p < 1."""
    n, x = n.cast("double"), x.cast("double")
    ways = ln_gamma(n + 1) - ln_gamma(x + 1) - ln_gamma(n - x + 1)
    return ways + x * F.ln(p) + (n - x) * F.ln(1 - p)


def binomial_span(n: Column, p: Column) -> tuple[Column, Column, Column]:
    """Mode, and the first and last count between which all but 1e-16 of the chance lies."""
    mode = F.least(F.floor((n + 1) * p).cast("bigint"), n.cast("bigint"))
    wide = F.ceil(9 * F.sqrt(n * p * (1 - p))).cast("bigint") + 12
    return mode, F.greatest(mode - wide, F.lit(0)), F.least(mode + wide, n.cast("bigint"))


def binomial_draw(n: Column, p: Column, u: Column) -> Column:
    """The number of hits in ``n`` draws that a uniform ``u`` picks, for 0 < p < 1.

    Counts are taken from the mode outwards, the larger of two first, until their
    chances exceed ``u``; each chance follows from its inner neighbour by a ratio.
    """
    n = n.cast("bigint")
    mode, low, high = binomial_span(n, p)
    start = F.exp(binomial_log(mode, n, p))
    given = F.struct(n.alias("n"), mode.alias("mode"), (p / (1 - p)).alias("odds"), u.alias("u"), start.alias("start"), F.greatest(mode - low, high - mode, F.lit(1)).alias("steps"))

    def fold(g: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            up = F.when(g["mode"] + i <= g["n"], a["up"] * (g["n"] - g["mode"] - i + 1) / (g["mode"] + i) * g["odds"]).otherwise(0.0)
            down = F.when(g["mode"] - i >= 0, a["down"] * (g["mode"] - i + 1) / (g["n"] - g["mode"] + i) / g["odds"]).otherwise(0.0)

            def next_(c: Column) -> Column:
                rest = a["left"] - c["up"]
                hit = F.when(a["left"] < c["up"], g["mode"] + i).when(rest < c["down"], g["mode"] - i)
                return F.struct(c["up"].alias("up"), c["down"].alias("down"), (rest - c["down"]).alias("left"), hit.alias("hit"))

            both = F.transform(F.array(F.struct(up.alias("up"), down.alias("down"))), next_)
            return F.when(a["hit"].isNotNull(), a).otherwise(F.get(both, F.lit(0)))

        begin = F.struct(
            g["start"].alias("up"), g["start"].alias("down"), (g["u"] - g["start"]).alias("left"), F.when(g["u"] < g["start"], g["mode"]).alias("hit")
        )
        found = F.aggregate(F.sequence(F.lit(1).cast("bigint"), g["steps"]), begin, step)["hit"]
        return F.coalesce(found, g["mode"])

    picked = F.get(F.transform(F.array(given), fold), F.lit(0))
    return F.when(n <= 0, F.lit(0).cast("bigint")).otherwise(picked)


def _ln_gamma(z: np.ndarray) -> np.ndarray:
    """``ln_gamma`` on arrays."""
    w = np.where(z < 16.0, z + 8.0, z)
    series = (w - 0.5) * np.log(w) - w + 0.5 * math.log(2 * math.pi) + 1 / (12 * w) - 1 / (360 * w**3) + 1 / (1260 * w**5) - 1 / (1680 * w**7)
    product = np.prod([np.where(z < 16.0, z + k, 1.0) for k in range(8)], axis=0)
    return series - np.log(product)


def _binomial_chance(x: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    n, x = n.astype(np.float64), x.astype(np.float64)
    return np.exp(_ln_gamma(n + 1) - _ln_gamma(x + 1) - _ln_gamma(n - x + 1) + x * np.log(p) + (n - x) * np.log1p(-p))


def _binomial_span(n: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``binomial_span`` on arrays."""
    mode = np.minimum(np.floor((n + 1) * p).astype(np.int64), n)
    wide = np.ceil(9 * np.sqrt(n * p * (1 - p))).astype(np.int64) + 12
    return mode, np.maximum(mode - wide, 0), np.minimum(mode + wide, n)


def binomial_hits(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """``binomial_draw`` on arrays: those whose number is found leave the walk."""
    mode, low, high = _binomial_span(n, p)
    chance = _binomial_chance(mode, n, p)
    out = np.where(n > 0, mode, 0)
    at = np.flatnonzero((n > 0) & (u >= chance))
    up, down, left, odds = chance[at], chance[at], (u - chance)[at], (p / (1 - p))[at]
    n, mode, steps, i = n[at], mode[at], np.maximum(np.maximum(mode - low, high - mode), 1)[at], 0
    while len(at):
        i += 1
        up = np.where(mode + i <= n, up * (n - mode - i + 1) / (mode + i) * odds, 0.0)
        down = np.where(mode - i >= 0, down * (mode - i + 1) / (n - mode + i) / odds, 0.0)
        above = left < up
        left = left - up
        below = ~above & (left < down)
        out[at[above]], out[at[below]] = mode[above] + i, mode[below] - i
        left = left - down
        go = ~above & ~below & (steps > i)
        at, up, down, left, odds, n, mode, steps = (a[go] for a in (at, up, down, left, odds, n, mode, steps))
    return out


def binomial_sums(n: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running chances of Binomial(n, k/n) counts: first count, begin in the list, and the list.

    The list holds one distribution after the other, number ``i`` shifted by ``i``, so it
    ascends as a whole; about 18 standard deviations of counts are listed for each.
    """
    sure = (k <= 0) | (k >= n)
    p = np.where(sure, 0.5, k / n)
    _, low, high = _binomial_span(n, p)
    low, high = np.where(sure, k, low), np.where(sure, k, high)
    begin = np.r_[0, np.cumsum(high - low + 1)]
    own = np.repeat(np.arange(len(n)), high - low + 1)
    x = low[own] + np.arange(begin[-1]) - begin[own]
    upto = np.cumsum(np.where(sure[own], 1.0, _binomial_chance(x, n[own], p[own])))
    before = np.r_[0.0, upto][begin[own]]
    return low, begin, own + np.minimum(upto - before, 1.0)


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson 95 % interval of ``k`` hits in ``n``."""
    k, n = k.cast("double"), n.cast("double")
    p = k / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, middle - half), F.when(n > 0, middle + half)
