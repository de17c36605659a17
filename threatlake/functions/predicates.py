"""Hunt predicates over text columns: NULL counts as empty, comparisons ignore case."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def text(column: str) -> Column:
    return F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))


def matches(column: Column, pattern: str) -> Column:
    """Unicode-aware search; an empty text never matches."""
    return F.coalesce((F.length(column) > 0) & column.rlike("(?dU)" + pattern), F.lit(False))


#: Characters outside ASCII that a search without case takes for an ASCII letter.
_FOLDED = ("\u0130\u0131\u017f\u212a", "iisk")


def folded(column: Column) -> Column:
    """Lower case in which an ASCII literal occurs wherever a search without case would find it."""
    return F.lower(F.translate(F.coalesce(column, F.lit("")), *_FOLDED))


def literals(pattern: str) -> tuple[str, ...]:
    """Lower-case ASCII texts of which every match of a pattern holds at least one; () if unknown.

    Of a sequence the part whose shortest text is longest, of alternatives all parts, of
    a group or a repeat what it must hold once.
    """
    from re import _parser as parser

    def of(items) -> tuple[str, ...]:
        best: tuple[str, ...] = ()
        run = ""

        def better(found: tuple[str, ...]) -> None:
            nonlocal best
            if found and all(found) and min(map(len, found)) > min(map(len, best), default=0):
                best = found

        for op, value in items:
            name = str(op)
            if name == "LITERAL" and value < 128:
                run += chr(value).lower()
                continue
            better((run,))
            run = ""
            if name == "SUBPATTERN":
                better(of(value[3]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                better(of(value[2]))
            elif name == "BRANCH":
                parts = [of(b) for b in value[1]]
                better(tuple(x for p in parts for x in p) if all(parts) else ())
        better((run,))
        return best

    return of(parser.parse(pattern))


def number(column: str) -> Column:
    return F.when(F.col(column).cast("string").rlike(NUMBER), F.col(column).try_cast("double"))


OPS = {
    "eq": lambda c, v: text(c) == str(v).lower(),
    "ne": lambda c, v: text(c) != str(v).lower(),
    "contains": lambda c, v: text(c).contains(str(v).lower()),
    "regex": lambda c, v: matches(F.col(c).cast("string"), "(?i)" + v),
    "in": lambda c, v: text(c).isin([str(x).lower() for x in v]),
    "gte": lambda c, v: F.coalesce(number(c) >= float(v), F.lit(False)),
    "lte": lambda c, v: F.coalesce(number(c) <= float(v), F.lit(False)),
}


def step(spec: dict) -> Column:
    """A hunt step: predicates [{field, op, value}] joined by match 'all' or 'any'."""
    tests = [OPS[p["op"]](p["field"], p["value"]) for p in spec["predicates"]]
    return reduce(and_ if spec.get("match", "all") == "all" else or_, tests)


#: Fixed value: words that try to steer a model.
MARKERS = r"(?i)(ignore\s+(previous|all|above)|you\s+are\s+now|jailbreak|system\s*:|\[INST\]|<\|im_start\|>|</?input>|</?system>|assistant\s*:)"


def steers(value: Column, kind: T.DataType) -> Column:
    """Whether a value holds such words: in its text, or in any key or value nested in it, at any depth."""
    if isinstance(kind, T.ArrayType):
        found = F.exists(value, lambda v: steers(v, kind.elementType))
    elif isinstance(kind, T.MapType):
        found = steers(F.map_keys(value), T.ArrayType(kind.keyType)) | steers(F.map_values(value), T.ArrayType(kind.valueType))
    elif isinstance(kind, T.StructType):
        found = F.lit(any(re.search(MARKERS, f.name) for f in kind.fields)) & value.isNotNull()
        for f in kind.fields:
            found = found | steers(value[f.name], f.dataType)
    elif isinstance(kind, (T.StringType, T.VariantType)):
        return matches(value if isinstance(kind, T.StringType) else F.to_json(value), MARKERS)
    else:
        return F.lit(False)
    return F.coalesce(found, F.lit(False))


def steering(rows: DataFrame, *columns: str) -> DataFrame:
    """Adds `steers`: whether any of the columns (all, if none is named) holds such words."""
    found = F.lit(False)
    for c in columns or rows.columns:
        found = found | steers(F.col(f"`{c}`"), rows.schema[c].dataType)
    return rows.withColumn("steers", found)
