"""Chat formatting by schema fingerprints, DataFrame operations only.

Records of several layouts (prompt and completion, instruction with input, message lists)
come as JSON text or as tables. The nested field paths of a record, or of a table's schema,
are hashed; the hash selects a declarative mapping to canonical turns. A record's paths are
read from a skeleton without texts, so no limit of JSON strings bounds a text. Turns are
written in one template, in which control strings inside texts are escaped reversibly, and
a mask marks what a model is trained on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BEGIN, STOP = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates, without their first character.
_CONTROL = r"\|[A-Za-z0-9_]+\||/?s>|/?INST\]|/?SYS>>|<SYS>>|</SYS>>"
_ESCAPE = rf"([<\[])(\\*)({_CONTROL})"
_UNESCAPE = rf"([<\[])\\(\\*)({_CONTROL})"
TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    """Puts a backslash after the first character of every control string; control strings
    that already carry backslashes get one more, so unescape() gives back any text."""
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def _role(role: Column) -> Column:
    """A role on one line: backslashes and line ends are written as two characters."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_back(role: Column) -> Column:
    role = F.replace(unescape(role), F.lit("\\\\"), F.lit("\\\x00"))
    return F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\\x00"), F.lit("\\"))


@dataclass(frozen=True)
class Layout:
    """paths: the nested field paths of a record, sorted; turns: their mapping, a SQL
    expression over `_r`, the record as a struct of `fields`, that gives TURNS. by_row: the
    record is a turn, and `_r` has the list of a key's turns."""

    name: str
    paths: tuple[str, ...]
    turns: str
    by_row: bool = False

    @property
    def fields(self) -> str:
        """The record's schema: lists of structs as the paths name them, all else text."""
        inner = {p: [q.removeprefix(f"{p}[].") for q in self.paths if q.startswith(f"{p}[].")] for p in self.paths if "[]." not in p}
        return ", ".join(f"{p} " + (f"array<struct<{', '.join(f'{q}: string' for q in qs)}>>" if qs else "string") for p, qs in inner.items())


def _get(field: str) -> str:
    return f"coalesce(_r.{field}, '')"


def _turn(role: str, text: str) -> str:
    return f"named_struct('role', {role}, 'text', {text})"


def _list(field: str, role: str, text: str) -> str:
    item = f"named_struct('role', coalesce(x.{role}, ''), 'text', coalesce(x.{text}, ''))"
    return f"transform(_r.{field}, x -> {item})"


LAYOUTS = (
    Layout("turns", ("turns", "turns[].role", "turns[].text"), _list("turns", "role", "text")),
    Layout("messages", ("messages", "messages[].content", "messages[].role"), _list("messages", "role", "content")),
    Layout("conversations", ("conversations", "conversations[].from", "conversations[].value"),
           "transform(" + _list("conversations", "from", "value") + ", x -> named_struct('role', "
           "case x.role when 'human' then 'user' when 'gpt' then 'assistant' else x.role end, 'text', x.text))"),
    Layout("prompt", ("completion", "prompt"), f"array({_turn("'user'", _get('prompt'))}, {_turn("'assistant'", _get('completion'))})"),
    Layout("response", ("prompt", "response"), f"array({_turn("'user'", _get('prompt'))}, {_turn("'assistant'", _get('response'))})"),
    Layout("qa", ("answer", "question"), f"array({_turn("'user'", _get('question'))}, {_turn("'assistant'", _get('answer'))})"),
    Layout("instruction", ("instruction", "output"), f"array({_turn("'user'", _get('instruction'))}, {_turn("'assistant'", _get('output'))})"),
    Layout("alpaca", ("input", "instruction", "output"),
           f"array({_turn("'user'", "concat_ws('\\n\\n', " + _get('instruction') + ", nullif(" + _get('input') + ", ''))")}, {_turn("'assistant'", _get('output'))})"),
)


#: A table with one turn a row.
ROWS = Layout("rows", ("role", "text", "turn"), _list("turns", "role", "text"), by_row=True)


def field_paths(skeleton: Column) -> Column:
    """The sorted field paths of a record: its keys, those of objects in them (a.b), and those of
    objects in lists (a[].b). Types do not count: a null and a text give one path, and other
    values beside the objects of a list add nothing. Null if the text is not a JSON object."""
    none = F.array().cast("array<string>")

    def keys(json: Column, prefix: Column) -> Column:
        return F.transform(F.coalesce(F.json_object_keys(json), none), lambda k: F.concat(prefix, k))

    def under(entry: Column) -> Column:
        items = F.from_json(entry["value"], "array<string>", _READ)
        in_list = F.flatten(F.transform(items, lambda x: F.when(x.startswith("{"), keys(x, F.concat(entry["key"], F.lit("[].")))).otherwise(none)))
        in_object = F.when(F.coalesce(entry["value"].startswith("{"), F.lit(False)), keys(entry["value"], F.concat(entry["key"], F.lit(".")))).otherwise(none)
        return F.when(F.coalesce(entry["value"].startswith("["), F.lit(False)), F.coalesce(in_list, none)).otherwise(in_object)

    record = F.from_json(skeleton, "map<string,string>", _READ)
    inner = F.flatten(F.transform(F.map_entries(record), under))
    return F.array_sort(F.array_distinct(F.concat(F.map_keys(record), inner)))


def schema_paths(schema: T.StructType) -> tuple[str, ...]:
    """The same paths of a table's columns."""
    out = []
    for f in schema.fields:
        kind, prefix = f.dataType, f"{f.name}."
        if isinstance(kind, T.ArrayType):
            kind, prefix = kind.elementType, f"{f.name}[]."
        out += [f.name, *(prefix + name for name in (kind.names if isinstance(kind, T.StructType) else ()))]
    return tuple(sorted(out))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


#: Strings that end in a colon are keys; groups are possessive, so long texts need no stack.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_VALUE = rf'(?s)\G([^"]*+(?:{_STRING}\s*+:[^"]*+)*+){_STRING}'
_REPEAT = r"(\{[^{}\[\]]*+\})(?:\s*+,\s*+\1)++"
_SCALARS = r'\[(?:\s*+(?:""|[-+.0-9eE]++|true|false|null)\s*+,?+)++\s*+\]'
_READ = {"maxStringLen": "2147483647"}
_OPTIONS = "map('maxStringLen', '2147483647', 'columnNameOfCorruptRecord', '_bad')"


def skeleton(json: Column) -> Column:
    """JSON with empty texts, lists of plain values emptied, and one of equal neighbours in a
    list; it has the same field paths."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(json, _VALUE, '$1""'), _SCALARS, "[]"), _REPEAT, "$1")


def _mapped(json_col: str, layout: Layout) -> Column:
    """The turns of a record by a layout; null if the record is not JSON after all."""
    record = f"from_json({json_col}, '{layout.fields}, _bad string', {_OPTIONS})"
    return F.expr(f"transform(array({record}), _r -> if(_r._bad is null, cast({layout.turns} as {TURNS}), null))[0]")


def _known(print_: Column, layouts: tuple[Layout, ...]) -> list[tuple[Layout, Column]]:
    return [(layout, print_ == fingerprint(F.array(*map(F.lit, layout.paths)))) for layout in layouts]


def _beside(df: DataFrame, *names: str) -> list[Column]:
    """The columns under `row`, but for those whose names the results take."""
    return [F.col("row")[c].alias(c) for c in df.columns if c not in names]


def to_turns(records: DataFrame, json_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds layout (null: unknown, or not JSON) and turns (null then) to records of JSON text.

    Other columns stay, whatever their names; columns named layout or turns are replaced.
    Repeated records give repeated rows, an empty table none.
    """
    rows = records.select(F.struct(*(F.col(f"`{c}`") for c in records.columns)).alias("row"))
    marked = rows.withColumn("mark", fingerprint(field_paths(skeleton(F.col("row")[json_col]))))
    known = _known(F.col("mark"), layouts)
    name = F.coalesce(*(F.when(hit, F.lit(layout.name)) for layout, hit in known))
    turns = F.coalesce(*(F.when(hit, _mapped(f"row.`{json_col}`", layout)) for layout, hit in known))
    made = marked.withColumn("turns", turns)
    return made.select(*_beside(records, "layout", "turns"), F.when(F.col("turns").isNotNull(), name).alias("layout"), "turns")


def table_turns(table: DataFrame, keys: tuple[str, ...], layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The key columns and turns of a table whose other columns have the paths of a layout.

    The paths of the schema are hashed as those of a record are, and the hash selects the
    layout, one of records or ROWS (a turn a row); an unknown one is an error.
    """
    paths = schema_paths(T.StructType([f for f in table.schema.fields if f.name not in keys]))
    every = (*layouts, ROWS)
    print_ = fingerprint(F.array(*map(F.lit, paths)))
    hits = table.sparkSession.range(1).select(*(hit.alias(f"h{i}") for i, (_, hit) in enumerate(_known(print_, every)))).first()
    layout = next((x for x, hit in zip(every, hits) if hit), None)
    if not layout:
        raise ValueError(f"no layout for columns {paths}")
    if layout.by_row:
        # turns go by (turn, role, text), null turns first, so ties have a defined order
        item = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        table = table.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("turns"))
        record = F.struct("turns").alias("_r")
    else:
        record = F.struct(*(F.col(f"`{c}`") for c in table.columns if c not in keys)).alias("_r")
    return table.select(*keys, record).select(*keys, F.expr(f"cast({layout.turns} as {TURNS})").alias("turns"))


def format_turns(records: DataFrame, turns_col: str = "turns") -> DataFrame:
    """Adds formatted (text) and loss_mask (array of start, end: code points of assistant texts).

    Null turns give nulls. Other columns stay, whatever their names; columns named formatted
    or loss_mask are replaced.
    """
    rows = records.select(F.struct(*(F.col(f"`{c}`") for c in records.columns)).alias("row"))
    pieces = F.transform(
        F.col("row")[turns_col],
        lambda t: F.struct(
            F.concat(F.lit(BEGIN), _role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")
        ),
    )
    marked = rows.withColumn("pieces", pieces)
    # the running end of each turn; a conversation's turns are folded once
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + F.lit(len(STOP) + 1)).alias("at"),
            F.when(
                p["loss"],
                F.concat(acc["spans"], F.array(F.struct(
                    (acc["at"] + F.length(p["head"])).alias("start"), (acc["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end"),
                ))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(STOP + "\n"))), "")
    return marked.select(*_beside(records, "formatted", "loss_mask"), text.alias("formatted"), spans.alias("loss_mask"))


def read_back(formatted: Column) -> Column:
    """TURNS from a formatted text."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")
    end = len(STOP) + 1

    def turn(p: Column) -> Column:
        body = F.regexp_extract(p, r"(?s)\A[^\n]*\n(.*)\z", 1)
        return F.struct(
            _role_back(F.regexp_extract(p, r"\A([^\n]*)\n", 1)).alias("role"),
            unescape(F.substring(body, F.lit(1), F.length(body) - end)).alias("text"),
        )

    return F.transform(parts, turn)


def masked_texts(formatted: Column, loss_mask: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(loss_mask, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))


def as_records(turns: DataFrame, key: str, number: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(key, json): conversations (key, turns) written as JSON records, each in the layout of its
    number modulo their count. Layouts of a question and an answer take conversations of a
    user's and an assistant's turn; others are written as a list of turns."""
    two = (F.size("turns") == 2) & (F.col("turns")[0]["role"] == "user") & (F.col("turns")[1]["role"] == "assistant")
    ask, answer, n = F.col("turns")[0]["text"], F.col("turns")[1]["text"], F.pmod(number, F.lit(len(layouts)))
    plain = F.to_json(F.struct("turns"))
    forms = {
        "messages": F.to_json(F.struct(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))),
        "prompt": F.when(two, F.to_json(F.struct(ask.alias("prompt"), answer.alias("completion")))),
        "response": F.when(two, F.to_json(F.struct(ask.alias("prompt"), answer.alias("response")))),
        "qa": F.when(two, F.to_json(F.struct(ask.alias("question"), answer.alias("answer")))),
        "instruction": F.when(two, F.to_json(F.struct(ask.alias("instruction"), answer.alias("output")))),
        "alpaca": F.when(two, F.to_json(F.struct(ask.alias("instruction"), F.lit("").alias("input"), answer.alias("output")))),
    }
    named = F.transform("turns", lambda t: F.struct(F.when(t["role"] == "user", "human").when(t["role"] == "assistant", "gpt").otherwise(t["role"]).alias("from"), t["text"].alias("value")))
    own = F.exists("turns", lambda t: t["role"].isin("human", "gpt"))
    forms["conversations"] = F.when(~own, F.to_json(F.struct(named.alias("conversations"))))
    return turns.select(key, F.coalesce(*(F.when(n == i, forms[x.name]) for i, x in enumerate(layouts) if x.name in forms), plain).alias("json"))


def digests(formatted: DataFrame, key: str) -> DataFrame:
    """What the formatted texts say when they are read back."""
    back = read_back(F.col("formatted"))
    loss = F.array_join(masked_texts(F.col("formatted"), F.col("loss_mask")), "")
    whole = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.select(F.col(key).alias("key"), "formatted", back.alias("back"), loss.alias("loss")).select(
        F.col("key").alias(key), F.size("back").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def format_conversations(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, formatted, loss_mask) per conversation of a table of turns.

    Null roles and texts are empty, a null key is a conversation of its own, repeated rows are
    repeated turns, equal turn numbers go by role and text, other columns are ignored, and an
    empty table gives no rows. The table's fingerprint selects the mapping, so texts go into
    the turns as they are, without JSON; a conversation is bounded only by Spark's size of a
    row (2 GB) and a task's memory, above which the job fails.
    """
    clean = rows.select(F.col(key), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return format_turns(table_turns(clean, (key,))).select(key, "formatted", "loss_mask")
