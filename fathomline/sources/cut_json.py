"""Objects of texts that hold JSON, cut off or with prose around it (PRJ-16, PRJ-17)."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

_MARKS = re.compile(r'[{}\[\]"\\]')
_LITERAL, _COMMA = re.compile(r"\b(?:True|False|None)\b"), re.compile(r",(\s*[\]}])")
_CLOSES = {"{": "}", "[": "]"}


def brackets(text: str) -> tuple[str | None, str | None, list[str]]:
    """The outermost balanced value; a cut one up to its last whole object, closed; and every whole object, inner ones before those around them.

    A machine over brackets, quotes and escapes: nothing inside a string counts,
    and a bracket that closes none is skipped.  Only a value that is still open at
    the end of the text is closed.
    """
    open_: list[tuple[str, int]] = []
    objects: list[str] = []
    outer = closed = None
    last: tuple[int, str] | None = None
    quoted, skip = False, -1
    for m in _MARKS.finditer(text):
        mark, at = m.group(), m.start()
        if at == skip:
            continue
        if mark == "\\":
            skip = at + 1
        elif mark == '"':
            # prose around the value may hold quotes; they count inside it alone
            quoted = not quoted and bool(open_)
        elif quoted:
            continue
        elif mark in _CLOSES:
            open_.append((mark, at))
        elif open_ and _CLOSES[open_[-1][0]] == mark:
            start = open_.pop()[1]
            if mark == "}":
                objects.append(text[start : at + 1])
                last = (at + 1, "".join(_CLOSES[b] for b, _ in reversed(open_)))
            if not open_ and outer is None:
                outer = text[start : at + 1]
    if open_ and last and last[1] and last[0] > open_[0][1]:
        closed = text[open_[0][1] : last[0]] + last[1]
    return outer, closed, objects


def _value(text: str):
    """The value of JSON, its literals and commas mended where need be; None if it is none."""
    for variant in (text, _COMMA.sub(r"\1", _LITERAL.sub(lambda m: {"True": "true", "False": "false", "None": "null"}[m.group()], text))):
        try:
            return json.loads(variant)
        except (ValueError, RecursionError):
            continue
    return None


def finding_objects(objects: list[str]) -> list[str]:
    """Those with a type and a severity, the first of each type and location."""
    seen, out = set(), []
    for text in objects:
        value = _value(text)
        kind = (value.get("type") or value.get("vulnerability_type")) if isinstance(value, dict) else None
        if kind and "severity" in value:
            key = json.dumps([kind, value.get("location")], sort_keys=True)
            if key not in seen:
                seen.add(key)
                out.append(text)
    return out


_PARTS = StructType([StructField("outer", StringType()), StructField("closed", StringType()), StructField("objects", ArrayType(StringType()))])


@F.pandas_udf(_PARTS)
def json_parts(texts: pd.Series) -> pd.DataFrame:
    """The outermost value of each text, the closed one, and the objects that look like findings; of a null text nothing."""
    parts = [brackets(t or "") for t in texts]
    return pd.DataFrame([(outer, closed, finding_objects(objects)) for outer, closed, objects in parts], columns=["outer", "closed", "objects"])
