"""Answer-text functions, Column in and Column out, all evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.numbers import zero_padded
from tallyframe.taxonomy import CLASS_NAMES

MAX_TEXT = 300

# The white space that text splitting recognises, control separators included.
WHITESPACE = (
    r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# White space to collapse: any run but a single plain blank, so ordinary text
# passes with few replacements. Printable ASCII is ruled out by a range or two
# before the long list of white space is tried.
_OTHER_THAN_BLANK = rf"[[\t-\x1f\x85-\x{{3000}}]&&{WHITESPACE}]"
_RUN = f" (?![!-~]){WHITESPACE}+|{_OTHER_THAN_BLANK}{WHITESPACE}*"
DIGIT = r"\p{Nd}"  # decimal digits of any script
_EDGES = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

# --- fixed values: cue words that decide an answer ---
YES_WORDS = ("yes", "yeah", "yep", "true", "correct", "present", "affirmative")
NO_WORDS = ("no", "nope", "false", "incorrect", "absent", "negative")
NO_WORDS_STRICT = (*NO_WORDS, "not present")
YES_WORDS_FRAME = ("yes", "yeah", "yep", "true", "present", "affirmative")
NO_WORDS_FRAME = ("no", "nope", "false", "absent", "negative")
NONE_CUES = ("none", "no foreign object", "no object", "nothing", "absent", "not present", "n/a")
SINGLE_CLASS_CUES = ("provide a class name", "a single class", "one class name")
MULTI_CLASS_CUES = (
    "class names",
    "class name(s)",
    "classes are",
    "objects are",
    "all foreign",
    "which combination",
)
MULTI_SELECT = r"(?i)select (?:none, )?one or multiple answers?"
OPTION_TAIL = r"(?is)select (?:one answer|(?:none, )?one or multiple answers?)[:\s]*(.+)$"
TIME_LOOSE = r"\d{1,2}:[0-5]?\d:[0-5]?\d"
TIME_GUARDED = r"(?<!\d)\d{1,2}:[0-5]?\d:[0-5]?\d(?!\d)"
# answer format by question wording, in order of preference: a phrase anywhere, at the end, or a pattern
FORMAT_WORDING = {
    "frame": (
        ("multiple_choice", "has", "please select one answer:"),
        ("binary", "ends", "please answer with yes or no."),
        ("number", "ends", "please provide a number."),
        ("fo_class", "ends", "please provide a class name."),
        ("fo_class", "ends", "please provide the class names or answer with none."),
    ),
    "window": (
        ("multiple_choice", "like", r"\b(?:please )?select (?:one answer|(?:none, )?one or multiple answers?)\s*:"),
        ("binary", "like", r"(?:please )?answer with (?:exactly )?yes or no[.!]?$"),
        ("percentage", "has", "format xx%"),
        ("percentage", "has", "answer as a percentage"),
        ("time", "has", "hh:mm:ss"),
        ("number", "like", r"\bplease provide (?:a )?number\b"),
        ("fo_class", "has", "please provide a class name"),
        ("fo_class", "has", "please provide the class name"),
    ),
}
UNWORDED_FORMAT = "open_ended"
# --- end of fixed values ---


def quoted(word: str) -> str:
    """A regex that matches ``word`` literally."""
    return "".join("\\" + c if not (c.isalnum() or c in " _") else c for c in word)


def _starts(words: Sequence[str]) -> str:
    """Look-ahead on the first letters; it is far cheaper than a Unicode word boundary."""
    letters = sorted({w[0] for w in words})
    return "(?=[" + "".join("\\" + c if not c.isalnum() else c for c in letters) + "])"


def any_word(words: Sequence[str]) -> str:
    return r"(?U)" + _starts(words) + r"\b(?:" + "|".join(quoted(w) for w in words) + r")\b"


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``x`` once and hand its value to ``use``."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def casefold(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def clean(x: Column) -> Column:
    """Collapse white space and trim."""
    return F.trim(F.regexp_replace(x, _RUN, " "))


def clean_capped(x: Column, limit: int = MAX_TEXT) -> Column:
    return F.substring(clean(x), 1, limit)


def _tidy(x: Column, cleaned: bool) -> Column:
    """``clean`` unless the caller has done it for several readers of one text."""
    return x if cleaned else clean(x)


def is_blank(x: Column) -> Column:
    return F.coalesce(clean(x), F.lit("")) == ""


# -- yes / no ----------------------------------------------------------------


def normalize_binary(x: Column, variant: str = "v1", cleaned: bool = False) -> Column:
    """Yes/no answer.

    ``v1`` looks for yes-words first, so "not present" reads as yes. ``v2``
    takes a leading yes/no, then no-words first. ``frame`` has shorter word lists.
    """
    def v1(low: Column) -> Column:
        yes = low.startswith("yes") | low.rlike(any_word(YES_WORDS))
        no = low.startswith("no") | low.rlike(any_word(NO_WORDS))
        return F.when(low.isin("yes", "no"), low).when(yes, "yes").when(no, "no").otherwise(low)

    def v2(low: Column) -> Column:
        lead = F.regexp_extract(low, r"(?U)^(yes|no)\b", 1)
        return (
            F.when(low.isin("yes", "no"), low)
            .when(lead != "", lead)
            .when(low.rlike(any_word(NO_WORDS_STRICT)), "no")
            .when(low.rlike(any_word(YES_WORDS)), "yes")
            .otherwise(low)
        )

    def frame(low: Column) -> Column:
        return (
            F.when(low.isin("yes", "no"), low)
            .when(low.rlike(any_word(YES_WORDS_FRAME)), "yes")
            .when(low.rlike(any_word(NO_WORDS_FRAME)), "no")
            .otherwise(low)
        )

    rules = {"v1": v1, "v2": v2, "frame": frame}
    if variant not in rules:
        raise ValueError(f"unknown variant: {variant}")
    text = _tidy(x, cleaned)
    return let(F.lower(text if variant == "v1" else F.substring(text, 1, MAX_TEXT)), rules[variant])


# -- numbers -----------------------------------------------------------------


def _first_match(x: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(x, f"({pattern})", 1), F.lit(""))


def normalize_number(x: Column, cleaned: bool = False) -> Column:
    return F.coalesce(_first_match(x, rf"{DIGIT}+"), _tidy(x, cleaned))


def normalize_percentage(x: Column, cleaned: bool = False) -> Column:
    return F.coalesce(_first_match(x, rf"{DIGIT}+(?:\.{DIGIT}+)?"), _tidy(x, cleaned))


def first_number(x: Column) -> Column:
    """First unsigned number as a double, NULL where there is none."""
    return _first_match(x, r"\d+(?:\.\d+)?").try_cast("double")


def first_integer(x: Column) -> Column:
    """First signed integer, NULL where there is none."""
    return _first_match(x, r"-?\d+").try_cast("bigint")


def count_bucket(number: Column) -> Column:
    """``0``..``5``, ``6+``, ``unparsed``."""
    whole = number.cast("bigint")
    return (
        F.when(number.isNull(), "unparsed")
        .when(whole <= 5, whole.cast("string"))
        .otherwise("6+")
    )


# -- named classes -----------------------------------------------------------


def _may_interleave(names: Sequence[str]) -> bool:
    """Whether one name can begin inside another and run past its end.

    Only then can a left-to-right scan differ from masking the longest names
    first; the list of names is a small driver-side argument.
    """
    lows = [n.lower() for n in names]
    for a in lows:
        for b in lows:
            for k in range(1, min(len(a), len(b))):
                if a[-k:] == b[:k] and (a != b or k < len(a)):
                    before = a[-k - 1] if k < len(a) else " "
                    after = b[k] if k < len(b) else " "
                    if not (before.isalnum() or before == "_") and not (after.isalnum() or after == "_"):
                        return True
    return False


def found_names(x: Column, names: Sequence[str] = CLASS_NAMES) -> Column:
    """Lower-case names found in the text, longest names first and masked.

    One scan with the names as alternatives, longest first, is the same as
    masking unless two names can interleave; then the names are masked in turn.
    """
    return _names_in(F.lower(clean(x)), list(dict.fromkeys(names)))


def _names_in(low: Column, names: Sequence[str]) -> Column:
    ordered = sorted(names, key=len, reverse=True)
    listed = F.array(*[F.lit(n.lower()) for n in names])
    if not _may_interleave(names):
        lows = [n.lower() for n in ordered]
        pattern = r"(?U)" + _starts(lows) + r"(?<!\w)(?:" + "|".join(quoted(n) for n in lows) + r")(?!\w)"
        hits = F.regexp_extract_all(low, F.lit(pattern), F.lit(0))
        return F.array_intersect(listed, hits)
    masked, hit = low, {}
    for name in ordered:
        pattern = r"(?U)(?<!\w)" + quoted(name.lower()) + r"(?!\w)"
        hit[name] = masked.rlike(pattern)
        masked = F.regexp_replace(masked, pattern, " ")
    return F.array_compact(F.array(*[F.when(hit[n], F.lit(n.lower())) for n in names]))


def named(found: Column, names: Sequence[str] = CLASS_NAMES) -> Column:
    """Comma-joined canonical names of ``found``, in taxonomy order."""
    names = list(dict.fromkeys(names))
    return F.concat_ws(
        ", ", *[F.when(F.array_contains(found, n.lower()), F.lit(n)) for n in names]
    )


def _none_cue(low: Column) -> Column:
    cues = "|".join(quoted(c) for c in NONE_CUES)
    return low.rlike(r"(?U)" + _starts(NONE_CUES) + r"(?<!\w)(?:" + cues + r")(?!\w)")


def normalize_classes(
    x: Column, names: Sequence[str] = CLASS_NAMES, empty: str = "none", cleaned: bool = False
) -> Column:
    """Set answer: known names in taxonomy order, else ``none``, else the text."""
    names = list(dict.fromkeys(names))

    def settle(t: Column) -> Column:
        joined = let(_names_in(F.lower(t), names), lambda found: named(found, names))
        return F.when(t == "", F.lit(empty)).otherwise(
            F.coalesce(
                F.nullif(joined, F.lit("")), F.when(_none_cue(F.lower(t)), F.lit("none")), t
            )
        )

    return let(_tidy(x, cleaned), settle)


def answer_set(x: Column) -> Column:
    """Comma-separated answer as a lower-case set; a lone ``none`` is empty."""
    parts = F.filter(
        F.transform(F.split(x, ","), lambda p: F.lower(clean(p))), lambda p: p != ""
    )
    none = F.array(F.lit("none"))
    nothing = F.array().cast("array<string>")
    return let(parts, lambda p: F.when(p == none, nothing).otherwise(F.array_distinct(p)))


def set_precision(gold: Column, pred: Column) -> Column:
    shared = F.size(F.array_intersect(gold, pred))
    return F.when(F.size(pred) == 0, (F.size(gold) == 0).cast("double")).otherwise(
        shared / F.size(pred)
    )


def set_recall(gold: Column, pred: Column) -> Column:
    shared = F.size(F.array_intersect(gold, pred))
    return F.when(F.size(gold) == 0, (F.size(pred) == 0).cast("double")).otherwise(
        shared / F.size(gold)
    )


def same_set(gold: Column, pred: Column) -> Column:
    return F.array_sort(gold) == F.array_sort(pred)


# -- timestamps --------------------------------------------------------------


def _hms(stamp: Column) -> tuple[Column, Column, Column]:
    part = F.split(stamp, ":")
    return part[0].cast("int"), part[1].cast("int"), part[2].cast("int")


def normalize_time(x: Column, cleaned: bool = False) -> Column:
    """All ``h:m:s`` in the text, zero-padded and comma-joined."""

    def padded(stamp: Column) -> Column:
        return F.format_string("%02d:%02d:%02d", *_hms(stamp))

    found = F.regexp_extract_all(x, F.lit(f"({TIME_LOOSE})"), F.lit(1))
    joined = F.array_join(F.transform(found, padded), ", ")
    return F.coalesce(F.nullif(joined, F.lit("")), _tidy(x, cleaned))


def timestamps(x: Column) -> Column:
    """Digit-guarded timestamps of the text as sorted seconds."""

    def seconds(stamp: Column) -> Column:
        h, m, s = _hms(stamp)
        return h * 3600 + m * 60 + s

    found = F.regexp_extract_all(x, F.lit(f"({TIME_GUARDED})"), F.lit(1))
    return F.array_sort(F.transform(found, seconds))


def stamp_seconds(x: Column) -> Column:
    """``HH:MM:SS[.f]`` to seconds; NULL where it is not a valid timestamp."""
    shape = r"^\s*(\d+)\s*:\s*(\d+)\s*:\s*(\d+(?:\.\d*)?)\s*$"
    h, m, s = (F.regexp_extract(x, shape, i).try_cast("double") for i in (1, 2, 3))
    return F.when((m < 60) & (s < 60), h * 3600 + m * 60 + s)


def seconds_stamp(x: Column) -> Column:
    """Seconds to ``HH:MM:SS``, rounded half to even."""
    s = F.rint(x).cast("bigint")
    rest = F.pmod(s, F.lit(3600))
    hours = F.call_function("div", s - rest, F.lit(3600))
    digits = (F.call_function("div", rest, F.lit(60)) * 100 + F.pmod(rest, F.lit(60)) + 10000).cast("string")
    return F.concat(zero_padded(hours, 2), F.lit(":"), F.substring(digits, 2, 2), F.lit(":"), F.substring(digits, 4, 2))


def time_threshold(duration: Column) -> Column:
    """Accepted error in seconds: one, plus four per six minutes, at most five."""
    return F.least(F.lit(5.0), F.lit(1.0) + duration * F.lit(4 / 360))


# -- options -----------------------------------------------------------------


def is_multi_select(question: Column) -> Column:
    return question.rlike(MULTI_SELECT)


def options(question: Column) -> Column:
    """Choices listed at the end of the question, split at ``;`` or a new line."""
    tail = F.regexp_extract(question, OPTION_TAIL, 1)
    listed = F.split(F.when(tail != "", tail).otherwise(question), r"[;\n]")
    return F.filter(F.transform(listed, lambda o: F.btrim(o, F.lit(" ."))), lambda o: o != "")


def _longest_first(opts: Column) -> Column:
    tagged = F.transform(opts, lambda o, i: F.struct(-F.length(o), i, o.alias("o")))
    return F.transform(F.array_sort(tagged), lambda t: t["o"])


def matched_options(x: Column, opts: Column) -> Column:
    """Options contained in the text, longest first and masked, in list order."""
    start = F.struct(F.lower(clean(x)).alias("left"), F.array().cast("array<string>").alias("hit"))

    def step(acc: Column, opt: Column) -> Column:
        low = F.lower(opt)
        inside = F.contains(acc["left"], low)
        return F.struct(
            F.when(inside, F.replace(acc["left"], low, F.lit(" "))).otherwise(acc["left"]).alias("left"),
            F.when(inside, F.array_append(acc["hit"], opt)).otherwise(acc["hit"]).alias("hit"),
        )

    hits = F.aggregate(_longest_first(opts), start, step)["hit"]
    return F.filter(opts, lambda o: F.array_contains(hits, o))


def normalize_choice(x: Column, opts: Column, multi: Column, limit: int = MAX_TEXT) -> Column:
    """Snap the text to one listed option, or to every one where several may apply."""
    def settle(text: Column) -> Column:
        low, cut = F.lower(text), F.substring(text, 1, limit)
        many = F.nullif(F.array_join(matched_options(text, opts), ", "), F.lit(""))
        one = F.get(F.filter(_longest_first(opts), lambda o: F.contains(low, F.lower(o))), F.lit(0))
        none_said = low.rlike(r"(?U)(?<!\w)none(?!\w)")
        several = F.coalesce(F.substring(many, 1, limit), F.when(none_said, F.lit("none")), cut)
        return F.when(multi, several).otherwise(F.coalesce(F.substring(one, 1, limit), cut))

    return let(clean(x), settle)


# -- dispatch ----------------------------------------------------------------


def normalize_answer(
    answer_format: Column,
    x: Column,
    question: Column | None = None,
    names: Sequence[str] = CLASS_NAMES,
    variant: str = "v1",
    cleaned: bool = False,
) -> Column:
    """The normaliser of each answer format, as one expression; ``cleaned`` says that ``x`` comes from ``clean``."""
    text = F.substring(_tidy(x, cleaned), 1, MAX_TEXT)
    # the container variants read names from the answer they would submit, which may be cut at a blank
    shown = x if variant == "v1" else text
    choice = (
        text
        if question is None
        else normalize_choice(shown, options(question), is_multi_select(question))
    )
    empty = "" if variant == "frame" else "none"
    return (
        F.when(answer_format == "binary", normalize_binary(x, variant, cleaned))
        .when(answer_format == "number", normalize_number(x, cleaned))
        .when(answer_format == "fo_class", normalize_classes(shown, names, empty, cleaned and variant == "v1"))
        .when(answer_format == "percentage", normalize_percentage(x, cleaned))
        .when(answer_format == "time", normalize_time(x, cleaned))
        .when(answer_format == "multiple_choice", choice)
        .otherwise(text)
    )


def is_readable(answer_format: Column, content: Column, names: Sequence[str] = CLASS_NAMES) -> Column:
    """Whether normalised content has the strict shape its format is read with."""
    listed = F.array(F.lit("none"), *[F.lit(n.lower()) for n in dict.fromkeys(names)])
    parts = F.transform(F.split(content, ","), lambda p: F.lower(F.trim(p)))
    stamp = r"^\d{2}:[0-5]\d:[0-5]\d(?:, \d{2}:[0-5]\d:[0-5]\d)*$"
    return (
        F.when(answer_format == "binary", content.isin("yes", "no"))
        .when(answer_format == "number", content.rlike(r"^\d+$"))
        .when(answer_format == "percentage", content.rlike(r"^\d+(?:\.\d+)?$"))
        .when(answer_format == "time", content.rlike(stamp))
        .when(answer_format == "fo_class", F.forall(parts, lambda p: F.array_contains(listed, p)))
        .otherwise(F.length(content) <= MAX_TEXT)
    )


# -- wording of the question ---------------------------------------------------


def class_arity_is_multi(question: Column) -> Column:
    """Whether a class question admits several names; a single cue wins."""
    low = F.lower(question)
    single = "|".join(quoted(c) for c in SINGLE_CLASS_CUES)
    multi = "|".join(quoted(c) for c in MULTI_CLASS_CUES)
    return ~low.rlike(single) & low.rlike(multi)


def infer_format(question: Column, rules: str = "window") -> Column:
    """Answer format read off the question wording (``window`` or ``frame`` rules)."""
    if rules not in FORMAT_WORDING:
        raise ValueError(f"unknown rules: {rules}")

    def first_hit(low: Column) -> Column:
        test = {"has": low.contains, "ends": low.endswith, "like": low.rlike}
        out = F.lit(UNWORDED_FORMAT)
        for answer_format, how, wording in reversed(FORMAT_WORDING[rules]):
            out = F.when(test[how](wording), answer_format).otherwise(out)
        return out

    return let(F.lower(clean(question)), first_hit)


def strip_reasoning(x: Column) -> Column:
    """Drop a reasoning block; an unfinished one leaves no answer."""
    closed = F.regexp_replace(x, r"(?s)<think>.*?</think>", "")
    dangling = F.regexp_replace(closed, r"(?s)^.*?</think>", "")
    edges = F.lit(_EDGES)
    return (
        F.when(x.contains("</think>"), F.btrim(dangling, edges))
        .when(x.contains("<think>"), "")
        .otherwise(F.btrim(x, edges))
    )


# -- small parsers -------------------------------------------------------------


def truth(x: Column) -> Column:
    """Truthy text to 1 or 0; NULL marks a value that is neither."""
    low = F.lower(F.trim(x.cast("string")))
    return F.when(low.isin("true", "1", "1.0"), 1).when(low.isin("false", "0", "0.0"), 0)


def listed(x: Column, separators: str = "|", distinct: bool = False) -> Column:
    """Joined text to a clean array; NULL becomes the empty array."""
    split = F.split(F.coalesce(x, F.lit("")), "[" + "".join("\\" + c for c in separators) + "]")
    parts = F.filter(F.transform(split, lambda p: F.trim(p)), lambda p: p != "")
    return F.array_distinct(parts) if distinct else parts


def recognised_values(
    answer_format: Column, x: Column, question: Column, names: Sequence[str] = CLASS_NAMES
) -> Column:
    """The distinct values a text holds under its format."""
    stamps = F.array_distinct(timestamps(x)).cast("array<string>")
    chosen = F.array_distinct(F.transform(matched_options(x, options(question)), lambda o: F.lower(o)))
    return (
        F.when(answer_format == "fo_class", found_names(x, names))
        .when(answer_format == "time", stamps)
        .otherwise(chosen)
    )
