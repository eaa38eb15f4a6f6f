"""The first JSON value inside free text that looks wanted, found in one pass over its tokens."""

from __future__ import annotations

import json
import re
from collections.abc import Collection, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""[ \t\n\r]*(?:
        (?P<open>[\[{]) | (?P<close>[\]}]) | (?P<mark>[,:])
      | (?P<text>"[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*")
      | (?P<plain>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null)
    )""",
    re.VERBOSE,
)
_OPEN = re.compile(r"[\[{]")

# what an open list or object waits for next
_ITEM_OR_END, _ITEM, _COMMA, _KEY_OR_END, _KEY, _COLON, _VALUE = range(7)


def _scan(text: str, start: int, wanted: Collection[str], ends: dict[int, int], looked: set[int]) -> None:
    """Read the value at ``start``; every value it opens is looked at, and wanted ones get their end.

    When the grammar breaks, all values that are still open are broken with it, and
    none of them is read again; values closed before are whole.
    """
    stack: list[list] = []  # [start, waits for, looks wanted]
    at = start
    while True:
        found = _TOKEN.match(text, at)
        if found is None:
            return
        at, kind = found.end(), found.lastgroup
        token = found[kind]
        top = stack[-1] if stack else None
        waits = top[1] if top else _VALUE
        if kind == "close":
            if waits not in ((_ITEM_OR_END, _COMMA) if token == "]" else (_KEY_OR_END, _COMMA)) or (text[top[0]] == "[") != (token == "]"):
                return
            stack.pop()
            if top[2]:
                ends[top[0]] = at
            if not stack:
                return
        elif kind == "mark":
            if token == ":" and waits == _COLON:
                top[1] = _VALUE
            elif token == "," and waits == _COMMA:
                top[1] = _ITEM if text[top[0]] == "[" else _KEY
            else:
                return
        elif waits in (_KEY_OR_END, _KEY):
            if kind != "text":
                return
            key = json.loads(token) if "\\" in token else token[1:-1]
            top[1], top[2] = _COLON, top[2] or key in wanted
        elif waits in (_ITEM_OR_END, _ITEM, _VALUE):
            if top:
                if text[top[0]] == "[" and token != "{":
                    top[2] = False
                top[1] = _COMMA
            if kind == "open":
                looked.add(found.start(kind))
                stack.append([found.start(kind), _ITEM_OR_END, True] if token == "[" else [found.start(kind), _KEY_OR_END, False])
        else:
            return


def first_wanted(text: str, wanted: Collection[str]) -> str | None:
    """The first value, by its start, that is a list of objects only or an object with a wanted key.

    Every bracket may start a value, also one inside a string of another value. A
    bracket is read once as part of the value around it, so time grows with the text.
    """
    ends: dict[int, int] = {}
    looked: set[int] = set()
    for found in _OPEN.finditer(text):
        start = found.start()
        if start not in looked:
            _scan(text, start, wanted, ends, looked)
        if start in ends:
            return text[start : ends[start]]
    return None


def wanted_value(text: Column, wanted: Collection[str]) -> Column:
    """``first_wanted`` of a text column, batch by batch; NULL texts cost nothing."""
    keys = frozenset(wanted)

    @F.pandas_udf("string")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if x is None else first_wanted(x, keys) for x in batch], dtype=object)

    return search(text)
