"""Hunts: steps of predicates, related by entity, order or distance in time."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.predicates import step
from .shared import Scratch

FIELDS = ("user_name", "hostname", "process_guid", "source_ip")


def same(select: DataFrame, partner: DataFrame, field: str) -> DataFrame:
    """Selected events whose field occurs among the partner's; case counts, empty never matches."""
    keys = partner.where(F.col(field) != "").select(field).distinct()
    return select.join(keys, field, "left_semi")


def after(select: DataFrame, partner: DataFrame, before: bool = False) -> DataFrame:
    """Selected events after the earliest partner (or before the latest). The partner is one row."""
    edge = partner.agg((F.max if before else F.min)("ts").alias("_edge"))
    test = F.col("ts") < F.col("_edge") if before else F.col("ts") > F.col("_edge")
    return select.join(F.broadcast(edge), test, "inner").drop("_edge")


def within(select: DataFrame, partner: DataFrame, seconds: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Selected events with a partner at most `seconds` away (with equal keys, if given).

    Times fall into buckets of that width. A bucket needs only its first and last partner:
    inside a bucket any partner is near, and of the neighbours only their nearest ends count.
    So the join has at most one row per bucket and key, however dense the partner is.
    """
    width = F.lit(seconds * 1_000_000)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = partner.where("ts is not null").groupBy(*keys, F.floor(micros / width).alias("_b")).agg(F.min(micros).alias("_lo"), F.max(micros).alias("_hi"))
    near = ends.select(*keys, F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)).alias("_b"), "_lo", "_hi")
    near = near.groupBy(*keys, "_b").agg(F.array_union(F.collect_set("_lo"), F.collect_set("_hi")).alias("_at"))
    asked = select.where("ts is not null").withColumn("_b", F.floor(micros / width))
    hit = asked.join(near, [*keys, "_b"]).where(F.exists("_at", lambda t: F.abs(t - F.unix_micros(F.col("ts").cast("timestamp"))) <= width))
    return hit.drop("_b", "_at")


def execute(events: DataFrame, ir: dict, previous: DataFrame | None = None, most: int | None = None) -> tuple[DataFrame, dict[str, int]]:
    """(results, events that match each step). ir: steps [{id, match, predicates}], relations
    [{type, ...}], select.

    One scan of the events sets a bit per step; what matches any step is written with its
    bits, counted on the way, and the relations, independent semi joins of the selected step,
    read that. Results by time, NULL last, the first `most` if given (None: all).
    """
    for r in ir.get("relations", ()):
        if r["type"] == "within" and not 1 <= int(r["seconds"]) <= WEEK:
            raise ValueError(f"within takes 1 to {WEEK} seconds, not {r['seconds']}")
    if ir.get("use_previous") and previous is not None:
        events = events.join(previous.select("seq").distinct(), "seq", "left_semi")
    steps = ir["steps"]
    bits = F.array_compact(F.array(*(F.when(step(s), F.lit(i)) for i, s in enumerate(steps))))
    seen = Observation()
    flagged = events.withColumn("_steps", bits).where(F.size("_steps") > 0)
    counts = (F.coalesce(F.sum(F.array_contains("_steps", i).cast("long")), F.lit(0)).alias(f"s{i}") for i in range(len(steps)))
    kept = Scratch(events.sparkSession, "hunt").keep(flagged.observe(seen, *counts), "flagged")
    of = {s["id"]: kept.where(F.array_contains("_steps", i)).drop("_steps") for i, s in enumerate(steps)}
    out = of[ir["select"]]
    for r in ir.get("relations", ()):
        partner = of[r["step"]]
        if r["type"] == "same":
            out = same(out, partner, r["field"])
        elif r["type"] == "within":
            out = within(out, partner, int(r["seconds"]), tuple(r.get("keys", ())))
        else:
            out = after(out, partner, before=r["type"] == "before")
    out = out.orderBy(F.asc_nulls_last("ts"), "seq")
    got = seen.get
    return out.limit(most) if most else out, {s["id"]: int(got[f"s{i}"]) for i, s in enumerate(steps)}


def run_hunt(events: DataFrame, ir: dict, previous: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """The results of a hunt (see execute); of a single step without relations they are not written."""
    if len(ir["steps"]) > 1 or ir.get("relations"):
        return execute(events, ir, previous, most)[0]
    if ir.get("use_previous") and previous is not None:
        events = events.join(previous.select("seq").distinct(), "seq", "left_semi")
    out = events.where(step(ir["steps"][0])).orderBy(F.asc_nulls_last("ts"), "seq")
    return out.limit(most) if most else out


#: Fields that a hunt may name, and its operators.
HUNT_FIELDS = (
    "process_name", "parent_process_name", "process_path", "commandline", "event_id", "user_name", "hostname", "source_ip", "destination_ip",
    "destination_port", "target_image", "target_object", "message", "properties", "process_guid", "event_outcome", "event_category", "action_type",
)
HUNT_OPS = ("eq", "ne", "contains", "regex", "in", "gte", "lte")
WEEK = 7 * 86_400
_NESTED = re.compile(r"\([^()]*[+*}][^()]*\)\s*[+*{]")


def _bad_pattern(pattern: str) -> str:
    try:
        re.compile(pattern)
    except re.error as wrong:
        return str(wrong)
    return "a repeat inside a repeat" if _NESTED.search(pattern) else ""


def _bad_predicate(p: dict) -> str:
    if p.get("field") not in HUNT_FIELDS:
        return f"unknown field {p.get('field')}"
    if p.get("op") not in HUNT_OPS:
        return f"unknown operator {p.get('op')}"
    if p["op"] == "in" and not isinstance(p.get("value"), list):
        return "in needs a list"
    if p["op"] == "regex" and (wrong := _bad_pattern(str(p.get("value", "")))):
        return f"pattern {p['value']}: {wrong}"
    if p["op"] in ("gte", "lte"):
        try:
            float(p.get("value"))
        except (TypeError, ValueError):
            return f"{p['op']} needs a number"
    return ""


def checked(ir: object) -> tuple[dict, list[str]]:
    """The runnable part of a hunt from elsewhere, and what is wrong with the rest.

    Steps get ids of their own where they have none or one twice. A relation names its partner
    as step, or both ends: left and right (right is after left), or steps. The selected step
    is the last one unless it names another. An empty hunt cannot run.
    """
    if not isinstance(ir, dict):
        return {}, ["a hunt is an object"]
    errors: list[str] = []
    steps: dict[str, dict] = {}
    for i, s in enumerate(ir.get("steps") or []):
        if not isinstance(s, dict):
            errors.append(f"step {i} is no object")
            continue
        name = str(s.get("id") or f"s{i}")
        name = f"{name}_{i}" if name in steps else name
        found = [(p, _bad_predicate(p)) for p in s.get("predicates") or [] if isinstance(p, dict)]
        errors += [f"step {i}: {wrong}" for _, wrong in found if wrong]
        good = [p for p, wrong in found if not wrong]
        if good:
            steps[name] = {"id": name, "match": "any" if s.get("match") == "any" else "all", "predicates": good}
        else:
            errors.append(f"step {i} has no usable predicate")
    if not steps:
        return {}, errors or ["no steps"]
    select = ir.get("select") if ir.get("select") in steps else list(steps)[-1]
    relations = []
    for r in ir.get("relations") or []:
        kind = r.get("type") if isinstance(r, dict) else None
        ends = [str(x) for x in (r.get("steps") or [r.get("left"), r.get("right")])] if kind and "step" not in r else [select, str(r.get("step"))] if kind else []
        if kind not in ("same", "after", "before", "within") or len(ends) != 2 or ends[0] == ends[1] or not set(ends) <= set(steps) or select not in ends:
            errors.append(f"bad relation {r}")
            continue
        out = {"type": kind, "step": next(x for x in ends if x != select)}
        if kind == "after" and "step" not in r and ends[0] == select:
            out["type"] = "before"
        if kind == "same":
            if r.get("field") not in FIELDS:
                errors.append(f"bad field {r.get('field')}")
                continue
            out["field"] = r["field"]
        if kind == "within":
            try:
                out["seconds"] = max(1, min(int(r.get("seconds")), WEEK))
            except (TypeError, ValueError):
                errors.append("within needs seconds")
                continue
            out["keys"] = [k for k in r.get("keys", ()) if k in FIELDS]
        relations.append(out)
    return {"use_previous": ir.get("use_previous") is True, "steps": list(steps.values()), "relations": relations, "select": select}, errors


def validate(ir: object) -> list[str]:
    """Errors of a hunt; an empty list if all of it can run."""
    return checked(ir)[1]


#: What words of a question ask for, as a predicate.
KEYWORDS = (
    (r"lsass|credential dump|憑證|dump.*cred", "commandline", "contains", "lsass"),
    (r"mimikatz|sekurlsa|logonpassword", "commandline", "contains", "mimikatz"),
    (r"dcsync|replication", "commandline", "regex", r"(?i)dcsync|replication"),
    (r"encoded|-enc\b|base64|混淆|obfuscat", "commandline", "regex", r"(?i)-e(nc)?\b"),
    (r"download|cradle|invoke-webrequest|下載", "commandline", "regex", r"(?i)(downloadstring|downloadfile|invoke-webrequest|iwr|net\.webclient)"),
    (r"powershell", "process_name", "eq", "powershell.exe"),
    (r"scheduled task|schtasks|排程", "commandline", "contains", "schtasks"),
    (r"registry run|reg add|persistence|持久", "commandline", "regex", r"(?i)reg.*add.*(run|runonce)"),
    (r"psexec|lateral|橫向", "commandline", "regex", r"(?i)(psexec|invoke-command)"),
    (r"external|outbound|c2|外網|連線", "destination_ip", "ne", ""),
)
#: Cues that ask for what came after, for the same host, and for the results before.
AFTER_CUE = r"(?i)\b(after|then|next|subsequen|之後|接著|然後|後續)\b"
HOST_CUE = r"(?i)(same host|same machine|same computer|同(一)?(主機|電腦))"
PREVIOUS_CUE = r"(?i)(of those|among them|其中|這些裡|前(一|面)(個)?結果)"
#: Predicates of a step from keywords at most, and characters of its description.
KEYWORD_PREDICATES, DESCRIPTION = 6, 200


def asked(question: str) -> dict:
    """A hunt for the words of a question, any of them; without known words all process activity.

    A word of order (after, then, next) asks for what the same user, or with such words the
    same host, did afterwards; words that point back narrow the hunt to the results before.
    """
    anything = {"field": "process_name", "op": "ne", "value": ""}
    found = [{"field": f, "op": o, "value": v} for words, f, o, v in KEYWORDS if re.search(words, question, re.IGNORECASE)]
    ir = {
        "description": question[:DESCRIPTION] or "hunt", "use_previous": bool(re.search(PREVIOUS_CUE, question)), "select": "a",
        "steps": [{"id": "a", "match": "any", "predicates": found[:KEYWORD_PREDICATES] or [anything]}], "relations": [],
    }
    if re.search(AFTER_CUE, question):
        ir["steps"].append({"id": "b", "match": "any", "predicates": [anything]})
        field = "hostname" if re.search(HOST_CUE, question) else "user_name"
        ir |= {"select": "b", "relations": [{"type": "after", "left": "a", "right": "b"}, {"type": "same", "field": field, "steps": ["a", "b"]}]}
    return checked(ir)[0] | {"description": ir["description"]}
