"""Readers of log files; each gives raw MAP<STRING,STRING> rows with the file and an order."""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAP = "map<string,string>"


def _rows(lines: DataFrame, raw) -> DataFrame:
    return lines.select(F.col("_metadata.file_path").alias("_src"), F.monotonically_increasing_id().alias("seq"), raw.alias("raw"), F.col("value").alias("line"))


def _truthy(value):
    """Whether a variant counts as a value: not null, false, zero, an empty text, list or object."""
    kind, text = F.coalesce(F.schema_of_variant(value), F.lit("VOID")), F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    return (
        F.when(kind == "VOID", False).when(kind == "BOOLEAN", text == "true").when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), number != 0)
        .when(kind == "STRING", text != "").otherwise(~text.isin("[]", "{}"))
    )


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _large(lines: pd.Series) -> pd.Series:
    """Records that are too large for a variant, or name a field twice, by the plain parser."""
    return lines.map(lambda x: _texts(json.loads(x)) if x is not None else None)


def typed(line):
    """A JSON object's values as text; what is empty, zero or false by its JSON type is left out,
    so 0 is missing and "0" is not. Null for what is no object."""
    texts, kinds = F.from_json(line, MAP), F.try_parse_json(line)
    by_kind = F.try_variant_get(kinds, "$", "map<string,variant>")
    kept = F.map_filter(texts, lambda k, v: v.isNotNull() & F.coalesce(_truthy(F.element_at(by_kind, k)), F.lit(False)))
    rest = F.when(kinds.isNull() & texts.isNotNull(), line)
    return F.coalesce(F.when(by_kind.isNotNull(), kept), _large(rest))


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """One object per line; splittable. Values as in `typed`. Lines that do not parse are left out
    (see corrupt)."""
    return _rows(spark.read.text(path), typed(F.col("value"))).where("raw is not null")


def corrupt(spark: SparkSession, path: str) -> DataFrame:
    """The lines that read_ndjson leaves out."""
    return _rows(spark.read.text(path).where("trim(value) <> ''"), F.from_json("value", MAP)).where("raw is null").select("_src", "seq", "line")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are JSON objects, and all others as {"raw": line}."""
    parsed = F.coalesce(typed(F.col("value")), F.create_map(F.lit("raw"), F.col("value")))
    return _rows(spark.read.text(path).where("trim(value) <> ''"), parsed)


def _texts(record: dict) -> dict[str, str]:
    """A record's values as text. What is empty, zero or false counts as missing; lists and objects stay JSON."""
    return {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in record.items() if v}


def records(text: str) -> Iterator[dict]:
    """The objects of a JSON text: an array, an object or a wrapper with Events, events or records;
    else objects one after another, on one line each or not."""
    try:
        found = json.loads(text.removeprefix("\ufeff"))
    except ValueError:
        found = [json.loads(x) for x in objects(text)]
    if isinstance(found, dict):
        found = next((found[k] for k in ("Events", "events", "records") if k in found), [found])
    yield from (r for r in found if isinstance(r, dict)) if isinstance(found, list) else ()


_SCHEMA = pa.schema([("_src", pa.string()), ("seq", pa.int64()), ("raw", pa.map_(pa.string(), pa.string())), ("line", pa.string())])
_DDL = f"_src string, seq long, raw {MAP}, line string"


def _batch(rows: list[tuple[str, int, dict]]) -> pa.RecordBatch:
    columns = [r[0] for r in rows], [r[1] for r in rows], [list(_texts(r[2]).items()) for r in rows], [json.dumps(r[2], ensure_ascii=False) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _by_file(spark: SparkSession, paths: str | list[str], split) -> DataFrame:
    """(_src, seq, raw, line) from whole files; split gives the records of a text. One task per file."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("_src"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for src, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = enumerate(split(text))
                while some := list(islice(found, 1_000)):
                    yield _batch([(src, i, r) for i, r in some])

    return whole.mapInArrow(run, _DDL)


#: An object can only end here, so files are read as texts between these.
_END = "}"
_ESCAPED = re.compile(r"\\.", re.S)
_TOKEN = re.compile(r'\\.|["{}\[\]]', re.S)
_NO_BRACKET = re.compile(r"[^{}\[\]]+")
_WRAPPER = r'\ufeff?\s*\{\s*"(?:Events|events|records)"\s*:\s*\['
_ARRAY = r"\ufeff?\s*\["
#: Characters of a file that tell its form.
_HEAD = 4_096
_STEP = {"{": 1, "[": 1, "}": -1, "]": -1}


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(_src, block, at, value): texts between closing braces by file, byte range and order.
    Spark splits files into byte ranges, wherever their lines end."""
    lines = spark.read.option("lineSep", _END).text(path)
    place = {"_src": "file_path", "block": "file_block_start", "size": "file_size"}
    return lines.select(*(F.col(f"_metadata.{c}").alias(n) for n, c in place.items()), F.monotonically_increasing_id().alias("at"), "value")


def _parts(text: str) -> list[str]:
    """A text at its quotes: every second part lies inside a string if the first does not."""
    return (_ESCAPED.sub("", text) if "\\" in text else text).split('"')


def _depth(text: str) -> int:
    return text.count("{") + text.count("[") - text.count("}") - text.count("]")


def _effects(pieces: DataFrame) -> DataFrame:
    """Per byte range what it does to a reader: whether its quotes are odd in number, and, for
    a reader that is outside or inside a string at its start, the change of depth and the
    lowest depth on the way; and its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, odd, total, deep, least = None, False, 0, [0, 0], [0, 0]

        def row():
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, odd, total, *deep, *least)], names=names)

        names = ["_src", "block", "size", "odd", "bytes", "out_sum", "in_sum", "out_min", "in_min"]
        for batch in batches:
            for src, block, size, text in zip(*(batch.column(c).to_pylist() for c in ("_src", "block", "size", "value"))):
                if now != (src, block, size):
                    if now:
                        yield row()
                    now, odd, total, deep, least = (src, block, size), False, 0, [0, 0], [0, 0]
                total += len(text.encode()) + 1
                parts = _parts(text + _END)
                for inside in (0, 1):
                    for c in _NO_BRACKET.sub("", "".join(parts[inside ^ odd :: 2])):
                        deep[inside] += _STEP[c]
                        least[inside] = min(least[inside], deep[inside])
                odd ^= len(parts) % 2 == 0
        if now:
            yield row()

    return pieces.mapInArrow(run, "_src string, block long, size long, odd boolean, bytes long, out_sum long, in_sum long, out_min long, in_min long")


def _starts(effects: DataFrame, pieces: DataFrame) -> DataFrame:
    """Per byte range the state of a reader at its start, a prefix scan of the effects: quotes
    add up to a parity, by which the change of each range is known, and these add up in turn.

    base: depth of the file's records, 1 in an array, 2 in a wrapper, 0 one after another.
    over: whether the array of records has ended before. cut: whether the file ends without
    a brace. broken: the file ends inside a string or an object.
    """
    first = pieces.where("block = 0").groupBy("_src").agg(F.min_by(F.substring("value", 1, _HEAD), "at").alias("head"))
    base = first.select("_src", F.when(F.col("head").rlike(f"^{_ARRAY}"), 1).when(F.col("head").rlike(f"^{_WRAPPER}"), 2).otherwise(0).alias("base"))
    whole = W.partitionBy("_src")
    before = whole.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    out = effects.join(base, "_src").withColumn("inside", F.coalesce(F.sum(F.col("odd").cast("long")).over(before), F.lit(0)) % 2 == 1)
    out = out.withColumns({"change": F.when(F.col("inside"), F.col("in_sum")).otherwise(F.col("out_sum")), "lowest": F.when(F.col("inside"), F.col("in_min")).otherwise(F.col("out_min"))})
    out = out.withColumns({"depth": F.coalesce(F.sum("change").over(before), F.lit(0)), "cut": F.sum("bytes").over(whole) > F.col("size")})
    # the first range opens the records; its own lowest depth is that of its start
    low = F.when(F.col("block") > 0, F.col("depth") + F.col("lowest")).otherwise(F.col("depth") + F.col("change"))
    ends = F.sum("change").over(whole) + F.col("cut").cast("int")
    broken = (F.sum(F.col("odd").cast("long")).over(whole) % 2 == 1) | (ends != 0)
    last = F.col("block") == F.max("block").over(whole)
    out = out.withColumn("low", low).withColumns({"over": F.coalesce(F.min("low").over(before) < F.col("base"), F.lit(False)), "broken": broken, "cut": F.col("cut") & last})
    return out.select("_src", "block", "inside", F.col("depth").cast("long").alias("depth"), "base", "over", "cut", "broken")


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Objects, and parts of them, from the pieces of byte ranges in order: _src, block, n, whole,
    text. What goes on with an object of an earlier range has n = -1, other objects their
    number in the range; what a range leaves open is not whole."""
    key, state, held, out, pending = None, None, [], [], None

    def close(whole: bool) -> None:
        out.append((*key, state["n"], whole, "".join(held)))
        held.clear()
        state["n"] += 1

    def take(text: str) -> None:
        if state["over"]:
            return
        if not state["open"]:
            for m in _TOKEN.finditer(text):
                c = m[0]
                if c == '"':
                    state["inside"] = not state["inside"]
                elif c in _STEP and not state["inside"]:
                    if c == "{" and state["depth"] == state["base"]:
                        text, state["open"] = text[m.start() :], True
                        break
                    state["depth"] += _STEP[c]
                    if state["depth"] == state["base"]:
                        state["seen"] = True
                    if state["seen"] and state["depth"] < state["base"]:
                        state["over"] = True
                        return
            else:
                return
        held.append(text)
        parts = _parts(text)
        state["depth"] += _depth("".join(parts[state["inside"] :: 2]))
        state["inside"] ^= len(parts) % 2 == 0
        if not state["inside"] and state["depth"] <= state["base"]:
            state["open"] = False
            close(True)

    def finish() -> None:
        if pending is not None:
            take(pending if state["cut"] else pending + _END)
        if held:
            close(False)

    def drained() -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
        done = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), types)], names=["_src", "block", "n", "whole", "text"])
        out.clear()
        return done

    for batch in batches:
        for src, block, inside, depth, base, over, cut, text in zip(*(batch.column(c).to_pylist() for c in ("_src", "block", "inside", "depth", "base", "over", "cut", "value"))):
            if key != (src, block):
                if key is not None:
                    finish()
                goes_on = (inside or depth > base) and block > 0
                key, pending = (src, block), None
                state = {"inside": inside, "depth": depth, "base": base, "over": over, "cut": cut, "open": goes_on, "n": -1 if goes_on else 0, "seen": block > 0 or base == 0}
            if pending is not None:
                take(pending + _END)
            pending = text
            if len(out) >= 1_000:
                yield drained()
    if key is not None:
        finish()
    if out:
        yield drained()


def _split_json(spark: SparkSession, path: str, wrapped: bool) -> DataFrame:
    """(_src, seq, raw, line) of JSON files whose byte ranges are read by tasks of their own."""
    from ..operators.shared import Scratch

    scratch = Scratch(spark, "json")
    pieces = _pieces(spark, path)
    starts = scratch.keep(_starts(_effects(pieces), pieces), "starts")
    fine = starts.where("not broken").drop("broken")
    ordered = pieces.select("_src", "block", "at", "value").join(fine, ["_src", "block"]).sortWithinPartitions("_src", "block", "at")
    found = scratch.keep(ordered.mapInArrow(_assemble, "_src string, block long, n long, whole boolean, text string"), "found")
    parts = found.where("not whole or n < 0")
    group = F.sum((F.col("n") >= 0).cast("int")).over(W.partitionBy("_src").orderBy("block", "n"))
    joined = parts.withColumn("group", group).groupBy("_src", "group").agg(F.array_sort(F.collect_list(F.struct("block", "n", "text"))).alias("p"))
    joined = joined.select("_src", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["n"].alias("n"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    objects_ = found.where("whole and n >= 0").select("_src", "block", "n", "text").unionByName(joined)
    alone = found.where("whole or n >= 0").groupBy("_src").agg((F.count_if(F.expr("n >= 0")) == 1).alias("alone")).join(starts.select("_src", "base").distinct(), "_src")
    rows = objects_.join(alone.select("_src", (F.col("alone") & (F.col("base") == 0) & F.lit(wrapped)).alias("alone")), "_src", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = []
            for src, block, n, text, single in zip(*(batch.column(c).to_pylist() for c in ("_src", "block", "n", "text", "alone"))):
                for i, r in enumerate(records(text) if single else map(json.loads, objects(text))):
                    some.append((src, block + max(n, 0) + i, r))
                    if len(some) == 1_000:
                        yield _batch(some)
                        some = []
            if some:
                yield _batch(some)

    whole = rows.select("_src", "block", "n", "text", "alone").mapInArrow(run, _DDL)
    wrong = [r[0] for r in starts.where("broken").select("_src").distinct().collect()]
    if not wrong:
        return whole
    return whole.unionByName(_by_file(spark, wrong, records if wrapped else lambda text: (json.loads(x) for x in objects(text))))


def write_arrays(rows: DataFrame, path: str) -> None:
    """Rows as JSON, an array in each file; a partition is a file."""

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            lines = batch.column(0).to_pylist()
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([lead + lines[0], *("," + x for x in lines[1:])])], names=["value"])
                lead = ","
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if lead == "[" else "]"])], names=["value"])

    rows.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(bracketed, "value string").write.text(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array, one object, a wrapper, or objects one after another, whichever a file holds.

    Spark splits files into byte ranges; one pass finds what each range does to a reader
    (quotes, depth), a prefix scan gives the state at each start, a second pass cuts the
    objects, and those that lie across ranges are put together. seq grows along the file: the
    first byte of the range an object begins in, and its number there. Only files that end
    inside a string or an object are read whole, by one task each; their names pass the driver.
    """
    return _split_json(spark, path, True)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV; every value is text."""
    table = spark.read.csv(path, header=True, maxCharsPerColumn=10_485_760, escape='"')
    pairs = [x for c in table.columns for x in (F.lit(c.lstrip("\ufeff")), F.col(f"`{c}`"))]
    return table.select(F.lit(path).alias("_src"), F.monotonically_increasing_id().alias("seq"), F.create_map(*pairs).alias("raw"), F.lit(None).cast("string").alias("line"))


def realign(cells: list[str], header: list[str]) -> list[str]:
    """A row's cells under its header, repaired where a list in the middle was not quoted.

    Columns before the first of host.ip, host.mac and source.ip and from host.name on keep
    their places, counted from the row's start and end; what lies between is one value.
    """
    size = len(header)
    first = next((header.index(c) for c in ("host.ip", "host.mac", "source.ip") if c in header), None)
    if len(cells) != size and first is not None and first < len(cells):
        last = size - (header.index("host.name") if "host.name" in header else first + 2)
        end = len(cells) - last if 0 < last <= len(cells) else len(cells)
        cells = [*cells[:first], ", ".join(cells[first:end]), *cells[end:]]
    return [*cells, *[""] * (size - len(cells))][:size]


def read_csv_realigned(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV whose rows may have too many or too few cells (see realign); a row is one
    line, also where a quote is left open. The files share one header."""
    lines = spark.read.text(path).where("value <> ''")
    top = lines.first()
    header = next(csv.reader([top.value.removeprefix("\ufeff")])) if top else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        for batch in batches:
            rows = [list(zip(header, realign(next(csv.reader([line]), []), header))) for line in batch.column(2).to_pylist()]
            raw = pa.array(rows, type=pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), raw, batch.column(2)], names=["_src", "seq", "raw", "line"])

    rows = lines.where(F.col("value") != F.lit(top.value if top else "")).select(F.col("_metadata.file_path").alias("_src"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))
    return rows.mapInArrow(run, f"_src string, seq long, raw {MAP}, line string")


def read_xml(spark: SparkSession, path: str, row_tag: str = "Event") -> DataFrame:
    """<Event> rows: an element's text by its local name, an attribute by element_attribute."""
    table = spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", False).load(path)

    def leaves(name: str, column, kind) -> Iterator[tuple]:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                inner = name if f.name == "_VALUE" else f"{name}_{f.name[1:]}" if f.name.startswith("_") else f.name.rsplit(":", 1)[-1]
                yield from leaves(inner, column[f.name], f.dataType)
        else:
            yield name, column.cast("string") if isinstance(kind, T.StringType) else F.to_json(column)

    found = [x for f in table.schema.fields for x in leaves(f.name.rsplit(":", 1)[-1].removeprefix("_"), F.col(f"`{f.name}`"), f.dataType)]
    pairs = F.filter(F.array(*(F.struct(F.lit(n).alias("key"), c.alias("value")) for n, c in found)), lambda p: p["value"].isNotNull())
    return table.select(F.lit(path).alias("_src"), F.monotonically_increasing_id().alias("seq"), _last_wins(pairs).alias("raw"), F.lit(None).cast("string").alias("line"))


def _last_wins(pairs):
    """A map from (key, value) pairs; of equal keys the last counts."""
    return F.aggregate(pairs, F.create_map().cast(MAP), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["key"]), F.create_map(p["key"], p["value"])))


def objects(text: str) -> Iterator[str]:
    """The JSON objects of a text one after another; what does not parse is skipped up to the next brace."""
    read, opening, at = json.JSONDecoder().raw_decode, re.compile(r"\{"), 0
    while m := opening.search(text, at):
        try:
            _, at = read(text, m.start())
            yield text[m.start() : at]
        except (ValueError, RecursionError):
            at = m.end()


def read_concat_json(spark: SparkSession, path: str) -> DataFrame:
    """Objects one after another, also over several lines; what does not parse is skipped. Files
    are split as in read_json."""
    return _split_json(spark, path, False)


_DATA = "struct<Data: array<struct<_Name: string, _VALUE: string>>>"
_SYSTEM = ("EventID", "Version", "Level", "Task", "Opcode", "Keywords", "EventRecordID", "Channel", "Computer")
_EVENT = (
    f"System struct<Provider: struct<_Name: string, _Guid: string>, TimeCreated: struct<_SystemTime: string>, Execution: struct<_ProcessID: string, _ThreadID: string>, "
    f"Security: struct<_UserID: string>, {', '.join(f'{c}: string' for c in _SYSTEM)}>, EventData {_DATA}, UserData {_DATA}, DebugData {_DATA}"
)


def read_winevent_xml(spark: SparkSession, path: str) -> DataFrame:
    """Exported event-log XML: System values by name, named Data values, EventCode and ComputerName
    as copies. Of equal names the last counts; an element without a value is left out."""
    table = spark.read.format("xml").option("rowTag", "Event").schema(_EVENT).load(path)

    def pair(name: str, column: str):
        return F.struct(F.lit(name).alias("key"), F.col(column).alias("value"))

    system = [pair(c, f"System.{c}") for c in _SYSTEM] + [
        pair("Provider", "System.Provider._Name"), pair("ProviderGuid", "System.Provider._Guid"), pair("TimeCreated", "System.TimeCreated._SystemTime"), pair("ProcessID", "System.Execution._ProcessID"),
        pair("ThreadID", "System.Execution._ThreadID"), pair("UserID", "System.Security._UserID"), pair("EventCode", "System.EventID"), pair("ComputerName", "System.Computer"),
    ]
    data = [F.coalesce(F.transform(f"{c}.Data", lambda d: F.struct(d["_Name"].alias("key"), d["_VALUE"].alias("value"))), F.array().cast("array<struct<key: string, value: string>>")) for c in ("EventData", "UserData", "DebugData")]
    pairs = F.filter(F.concat(F.array(*system), *data), lambda p: p["key"].isNotNull() & p["value"].isNotNull())
    last = _last_wins(pairs)
    return table.select(F.lit(path).alias("_src"), F.monotonically_increasing_id().alias("seq"), last.alias("raw"), F.lit(None).cast("string").alias("line"))


READERS = {"json": read_json, "ndjson": read_ndjson, "jsonl": read_ndjson, "csv": read_csv, "csv_realign": read_csv_realigned, "xml": read_xml, "concat_json": read_concat_json, "winevent_xml": read_winevent_xml, "log": read_log, "txt": read_log}


def read_raw(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    return READERS[(fmt or path.rsplit(".", 1)[-1]).lower()](spark, path)
