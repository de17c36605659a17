"""Encoded command lines: base64 arguments and blobs as text.

Column expressions decode them; Python is given only blobs of commands with a gzip layer.
"""

from __future__ import annotations

import base64
import binascii
import gzip
import string
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .once import once

#: The argument of an encoded command, a long blob, characters of a decoded text
#: at least, and its share of plain ones.
ARGUMENT = r"(?i)-(?:e|ec|enc|encodedcommand)\s+([A-Za-z0-9+/=]{16,})"
BLOB = r"[A-Za-z0-9+/]{24,}={0,2}"
LEAST, PLAIN = 3, 0.85


def _plain(text: str) -> float:
    return sum(" " <= c <= "~" or c in "\t\r\n" for c in text) / len(text)


def _unpacked(raw: bytes) -> tuple[bytes, str]:
    """Without a gzip layer, if there is a whole one."""
    if raw[:2] == b"\x1f\x8b":
        try:
            return gzip.decompress(raw), "+gzip"
        except (OSError, EOFError, zlib.error):
            pass
    return raw, ""


def decode_blob(blob: str) -> tuple[str, str] | None:
    """(text, layer) of a base64 blob in the encoding that gives more plain characters; None if
    it is not base64 or neither encoding gives a text."""
    try:
        raw, layer = _unpacked(base64.b64decode(blob, validate=True))
    except (binascii.Error, ValueError):
        return None
    found = []
    for kind in ("utf-16-le", "utf-8"):
        try:
            text = raw.decode(kind).replace("\0", "")
        except UnicodeDecodeError:
            continue
        if len(text) >= LEAST:
            found.append((_plain(text), text, kind + layer))
    best = max(found, key=lambda f: f[0], default=None)
    return (best[1], best[2]) if best and best[0] >= PLAIN else None


@F.pandas_udf(T.StructType([T.StructField("decoded", T.StringType()), T.StructField("layer", T.StringType())]))
def _decoded(blobs: pd.Series) -> pd.DataFrame:
    first = [next((d for d in map(decode_blob, found) if d), (None, None)) for found in blobs]
    return pd.DataFrame(first, columns=["decoded", "layer"])


def _class(characters: str) -> str:
    """A class of single characters, which Java looks up in one table; ranges it tries one after another."""
    return f"[{''.join(c if c.isalnum() else f'\\x{ord(c):02x}' for c in characters)}]"


#: The characters of base64 and of a plain text; ARGUMENT and BLOB with them, and with runs that Java reads in one loop.
_BASE64 = string.ascii_letters + string.digits + "+/"
_PLAIN = _class("".join(map(chr, range(32, 127))) + "\t\r\n")
_ARGUMENT = rf"-(?i:e|ec|enc|encodedcommand)\s+({_class(_BASE64 + '=')}{{16}}{_class(_BASE64 + '=')}*)"
_BLOB = f"{_class(_BASE64)}{{24}}{_class(_BASE64)}*={{0,2}}"


def candidates(command: Column, most: int | None = None) -> Column:
    """The argument of an encoded command first, then long blobs, each once; the first `most` if given."""
    text = F.coalesce(command, F.lit(""))
    argument = once(F.regexp_extract(text, _ARGUMENT, 1), lambda a: F.when(a != "", F.array(a)).otherwise(F.array().cast("array<string>")))
    both = F.array_distinct(F.concat(argument, F.regexp_extract_all(text, F.lit(_BLOB), 0)))
    return F.slice(both, 1, most) if most else both


#: A gzip header in base64; bytes of surrogates, and a lone one among UTF-16 units, low byte first, with a character a byte.
PACKED = "^H4[s-v]"
SURROGATE = r"[\xD8-\xDF]"
LONE = r"(?s)^(?:..)*?(?:.[\xD8-\xDB](?!.[\xDC-\xDF])|(?<![\xD8-\xDB]).[\xDC-\xDF])"


def _best(blob: Column) -> Column:
    """(decoded, layer) of a base64 blob without a gzip layer, by column expressions alone; null
    if it is no base64 or no encoding gives a text. Each step reads the one before once, so the
    work is a few passes over the blob."""

    def judged(text: Column, kind: str) -> Column:
        def of(t: Column) -> Column:
            share = (F.length(t) - F.length(F.regexp_replace(t, f"{_PLAIN}+", ""))) / F.length(t)
            return F.when(F.length(t) >= LEAST, F.struct(share.alias("share"), t.alias("decoded"), F.lit(kind).alias("layer")))

        return once(F.replace(text, F.lit("\0"), F.lit("")), of)

    def better(raw: Column) -> Column:
        # without a zero byte no unit is a plain character
        whole = (F.length(raw) % 2 == 0) & F.contains(raw.cast("string"), F.lit("\0"))
        wide = F.when(whole & once(F.decode(raw, "ISO-8859-1"), lambda c: ~(c.rlike(SURROGATE) & c.rlike(LONE))), F.decode(raw, "UTF-16LE"))
        narrow = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
        # of equal shares the first one counts, so nothing is better than a share of one
        return once(judged(wide, "utf-16-le"), lambda w: F.when(w["share"] == 1, w).otherwise(once(judged(narrow, "utf-8"), lambda n: F.when(F.coalesce(n["share"] > w["share"], w.isNull()), n).otherwise(w))))

    # a candidate has no other characters than those of base64 and =
    rest = F.length(blob) - F.locate("=", blob)
    ends = ~F.contains(blob, F.lit("=")) | (rest == 0) | ((rest == 1) & blob.endswith("=="))
    whole = F.when((F.length(blob) % 4 == 0) & ends, F.unbase64(blob))
    return once(once(whole, better), lambda b: F.when(b["share"] >= PLAIN, b))


def decoded(rows: DataFrame, column: str = "commandline", most: int | None = None) -> DataFrame:
    """Adds the first text hidden in a command, its layer, and the number of candidates. A row is
    worked on where it is, so commands that often repeat should be made distinct first."""
    found = rows.withColumn("_found", candidates(F.col(column), most))
    packed = F.exists("_found", lambda b: F.substring(b, 1, 4).rlike(PACKED))
    first = F.get(F.filter(F.transform("_found", _best), lambda d: d.isNotNull()), F.lit(0))
    unpacked = _decoded(F.when(packed, F.col("_found")).otherwise(F.array().cast("array<string>")))
    both = found.withColumns({"_packed": packed, "_native": F.when(~packed, first), "_python": unpacked})
    text = {c: F.when(F.col("_packed"), F.col(f"_python.{c}")).otherwise(F.col(f"_native.{c}")).alias(c) for c in ("decoded", "layer")}
    return both.select(*rows.columns, *text.values(), F.size("_found").alias("candidates"))


def decode_commands(events: DataFrame, column: str = "commandline", most: int | None = None) -> DataFrame:
    """Distinct commands with the first text hidden in them, its layer, and the number of candidates."""
    # no filter on candidates: it would move below the distinct and search every event's command
    return decoded(events.select(F.col(column).alias("commandline")).where("commandline is not null").distinct(), most=most)
