"""Declared forms of untrusted JSON, compiled to column expressions.

A form lists fields with a kind, bounds and a default. Compiled over a text column it gives
a struct of checked values and an array of what was wrong; nothing raises on bad input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .once import once

#: Fixed value: characters of an offending value that an error quotes.
QUOTED = 40


@dataclass(frozen=True)
class Field:
    """One field. kind: str, int, float, bool, enum, list (of str), dict or dicts (list of dict).

    most: items of a list that are looked at, longest: characters of a text; pattern: what
    an item must match whole; values: those of an enum; fields: those of a dict or of each dict
    of a list; drop: whether a dict with errors of its own is left out; null: what an explicit
    null becomes (the default, unless given), null_item: what it becomes in a list of texts;
    lower: an enum in lower case. A field without a default is required.
    """

    name: str
    kind: str = "str"
    default: object = ...
    low: float | None = None
    high: float | None = None
    longest: int = 4096
    most: int = 50
    values: tuple[str, ...] = ()
    pattern: str = ""
    fields: tuple["Field", ...] = ()
    drop: bool = False
    null: object = ...
    null_item: str = "None"
    lower: bool = False

    @property
    def type(self) -> str:
        plain = {"str": "string", "enum": "string", "int": "bigint", "float": "double", "bool": "boolean", "list": "array<string>"}
        if self.kind in plain:
            return plain[self.kind]
        inner = f"struct<{', '.join(f'{f.name}: {f.type}' for f in self.fields)}>"
        return inner if self.kind == "dict" else f"array<{inner}>"

    def fallback(self) -> Column:
        if self.default is ... or self.default is None:
            return F.lit(None).cast(self.type)
        if self.kind == "list":
            return F.array(*map(F.lit, self.default)).cast(self.type)
        if self.kind == "dicts":
            return F.array().cast(self.type)
        return defaults(self.fields) if self.kind == "dict" else F.lit(self.default).cast(self.type)


def defaults(fields: tuple[Field, ...]) -> Column:
    return F.struct(*(f.fallback().alias(f.name) for f in fields))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _part(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _fields(v: Column) -> Column:
    """The fields of an object by name, null if the value is none; far cheaper than its schema."""
    return _part(v, "$", "map<string, variant>")


def _text(v: Column, longest: int) -> Column:
    """A value as text: texts as they are, numbers as written, booleans as words, the rest as JSON."""
    plain = once(_kind(v), lambda kind: F.when(kind == "BOOLEAN", F.initcap(_part(v, "$", "string"))).when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.to_json(v)).otherwise(_part(v, "$", "string")))
    return F.substring(F.translate(plain, "\0", ""), 1, longest)


def _number(v: Column, whole: bool) -> Column:
    """A value as a number, null if it has none: texts must be numbers whole (of digits alone for a
    whole number), a fraction is cut, true is one."""
    pattern = r"^\s*[+-]?\d+\s*$" if whole else r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    kind, text, to = _kind(v), F.trim(_part(v, "$", "string")), "bigint" if whole else "double"
    number = _part(v, "$", "double")
    number = F.when(F.abs(number) < 2.0**63, F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))) if whole else number
    exact = F.coalesce(F.when(kind == "BIGINT", _part(v, "$", to)), number.cast(to))
    return F.when(kind == "STRING", F.when(text.rlike(pattern), text.try_cast(to))).when(kind == "BOOLEAN", _part(v, "$", "boolean").cast(to)).when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), exact)


def _bounded(x: Column, f: Field) -> Column:
    cast = int if f.kind == "int" else float
    x = F.greatest(x, F.lit(cast(f.low))) if f.low is not None else x
    return F.least(x, F.lit(cast(f.high))) if f.high is not None else x


def _say(*parts: Column | str) -> Column:
    return F.array(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))


def _pair(value: Column, errors: Column) -> Column:
    return F.struct(value.alias("value"), errors.alias("errors"))


def checked(f: Field, v: Column, path: Column) -> Column:
    """Struct (value, errors) of a field whose value is the variant v; v is not null. Whatever is
    named more than once is worked out once."""
    if f.kind == "str":
        if not f.pattern:
            return _pair(_text(v, f.longest), no_errors())
        return once(_text(v, f.longest), lambda text: _pair(F.when(fits(f, text), text).otherwise(f.fallback()), F.when(fits(f, text), no_errors()).otherwise(_say(path, ": failed pattern"))))
    if f.kind in ("int", "float"):
        wrong = _say(path, f": type coercion failed for '{f.kind}'")
        return once(_number(v, f.kind == "int"), lambda n: _pair(F.when(n.isNull(), f.fallback()).otherwise(_bounded(n, f).cast(f.type)), F.when(n.isNull(), wrong).otherwise(no_errors())))
    if f.kind == "bool":
        return _pair((_kind(v) == "BOOLEAN") & F.coalesce(_part(v, "$", "boolean"), F.lit(False)), no_errors())
    if f.kind == "enum":

        def chosen(text: Column) -> Column:
            good = text.isin(*f.values)
            return _pair(F.when(good, text).otherwise(f.fallback()), F.when(good, no_errors()).otherwise(_say(path, ": '", F.substring(text, 1, QUOTED), "' not in enum")))

        def lowered(text: Column) -> Column:
            return F.when(text.isin(*f.values), text).otherwise(F.lower(text))

        return once(once(_text(v, 128), lowered) if f.lower else _text(v, 128), chosen)
    if f.kind == "dict":
        wrong = _pair(f.fallback(), _say(path, ": expected object"))
        return once(_fields(v), lambda m: F.when(m.isNotNull(), _pair(compiled(f.fields, m, path)["value"], no_errors())).otherwise(wrong))
    wrong = _pair(f.fallback(), _say(path, ": expected list"))
    if f.kind == "list":

        def texts(all_: Column) -> Column:
            if not f.pattern:
                return _pair(all_, no_errors())
            bad = F.transform(F.filter(all_, lambda t: ~fits(f, t)), lambda t: F.concat(path, F.lit(": item failed pattern")))
            return _pair(F.filter(all_, lambda t: fits(f, t)), bad)

        def listed(items: Column) -> Column:
            found = F.transform(F.slice(items, 1, f.most), lambda x: F.coalesce(_text(x, f.longest), F.lit(f.null_item)))
            return F.when(items.isNotNull(), once(found, texts)).otherwise(wrong)

        return once(_part(v, "$", "array<variant>"), listed)

    def one(x: Column, i: Column) -> Column:
        where = F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))

        def judged(r: Column) -> Column:
            return F.struct(r["value"].alias("value"), (F.size(r["errors"]) == 0 if f.drop else F.lit(True)).alias("keep"), no_errors().alias("errors"))

        none = F.struct(defaults(f.fields).alias("value"), F.lit(False).alias("keep"), _say(where, ": expected object").alias("errors"))
        return once(_fields(x), lambda m: F.when(m.isNotNull(), once(compiled(f.fields, m, where), judged)).otherwise(none))

    def sorted_out(all_: Column) -> Column:
        return _pair(F.transform(F.filter(all_, lambda x: x["keep"]), lambda x: x["value"]), F.flatten(F.transform(all_, lambda x: x["errors"])))

    def each(items: Column) -> Column:
        return F.when(items.isNotNull(), once(F.transform(F.slice(items, 1, f.most), one), sorted_out)).otherwise(wrong)

    return once(_part(v, "$", "array<variant>"), each)


def fits(f: Field, text: Column) -> Column:
    """Whether a text matches a field's pattern whole."""
    return text.rlike(f"^(?:{f.pattern})$(?!\\n)") if f.pattern else F.lit(True)


def no_errors() -> Column:
    return F.array().cast("array<string>")


def compiled(fields: tuple[Field, ...], given: Column, path: Column | None = None) -> Column:
    """Struct (value: struct of the fields, errors) of an object given as a map of variants. A missing or
    null field takes its default; a required one is an error. Fields that are not declared are
    dropped."""

    def field(f: Field) -> Column:
        at = F.concat(path, F.lit(f".{f.name}")) if path is not None else F.lit(f.name)
        missing = _pair(f.fallback(), _say(at, ": missing required field") if f.default is ... else no_errors())

        def judged(part: Column) -> Column:
            null = _pair(F.lit(f.null).cast(f.type), missing["errors"]) if f.null is not ... else missing
            return F.when(part.isNull(), missing).when(F.is_variant_null(part), null).otherwise(checked(f, part, at))

        return once(given[f.name], judged)

    found = F.struct(*(field(f).alias(f.name) for f in fields))
    return once(found, lambda r: _pair(F.struct(*(r[f.name]["value"].alias(f.name) for f in fields)), F.concat(*(r[f.name]["errors"] for f in fields))))


def against(fields: tuple[Field, ...], text: Column) -> Column:
    """Struct (value, errors) of a JSON text. No JSON, or no object, gives the defaults and says so.

    The text is parsed once. One beyond what a variant holds (128 MB, or a single text of 20
    million characters) is no JSON here.
    """

    def parsed(v: Column) -> Column:
        said = F.when(v.isNull(), _say("root: invalid JSON")).otherwise(_say("root: not an object"))
        return once(_fields(v), lambda m: F.when(m.isNotNull(), compiled(fields, m)).otherwise(_pair(defaults(fields), said)))

    return once(F.try_parse_json(F.coalesce(text, F.lit(""))), parsed)
