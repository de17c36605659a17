"""Streaming forms of the detection jobs; events need `ts` and a watermark bounds their state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import rules


def stream_rules(events: DataFrame) -> DataFrame:
    return rules.evaluate(events)


#: State with timers lives in this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _lowest(schema: T.StructType, keep_ms: int) -> StatefulProcessor:
    """Per key the row of least (seq, rule_ord) seen so far, given out when the key has been
    quiet for keep_ms of event time."""
    place = [schema.names.index(c) for c in ("seq", "rule_ord")]
    at = schema.names.index("ts")

    class Lowest(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.best = handle.getValueState("best", schema)
            self.until = handle.getValueState("until", "at long")

        def handleInputRows(self, key, rows, timerValues):
            best = self.best.get() if self.best.exists() else None
            until = old = self.until.get()[0] if self.until.exists() else 0
            for row in rows:
                row = tuple(row[c] for c in schema.names)
                until = max(until, int(row[at].timestamp() * 1000) + keep_ms)
                if best is None or [row[i] for i in place] < [best[i] for i in place]:
                    best = row
            self.best.update(tuple(best))
            if until != old:
                if old:
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(until)
                self.until.update((until,))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            yield Row(**dict(zip(schema.names, self.best.get())))
            self.best.clear()
            self.until.clear()

        def close(self) -> None:
            pass

    return Lowest()


def stream_dedup(findings: DataFrame, delay: str = "1 hour", keep: str = "1 hour") -> DataFrame:
    """The first finding by (seq, rule) per rule, process or command, source, user and host, as the
    batch form has it, in whatever order rows come: a key's finding is given out once the
    watermark (late by `delay`) is past its last row by `keep`, and its state then ends.

    Needs the state store STORE, which is set here for the session.
    """
    findings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in findings.schema.fields])
    actor = F.coalesce(F.nullif("process_guid", F.lit("")), F.col("commandline"), F.lit(""))
    keys = {"_rule": F.col("rule_id"), "_actor": actor, **{f"_{c}": F.coalesce(F.col(c), F.lit("")) for c in ("source_ip", "user_name", "hostname")}}
    number, unit = keep.split()
    millis = int(number) * {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]
    return findings.withColumns(keys).withWatermark("ts", delay).groupBy(*keys).transformWithState(_lowest(schema, millis), schema, "Append", "EventTime")


def stream_bruteforce(events: DataFrame, least: int = 5, delay: str = "1 hour", width: str = "1 hour", slide: str = "10 minutes") -> DataFrame:
    """The cases of rules.bruteforce per source and sliding window; a window is closed, and its
    state ends, once the watermark is past it."""
    auth = rules.logons(events).withWatermark("ts", delay)
    return rules.cases(rules.tries(auth, F.window("ts", width, slide), "source_ip"), least, "window", "source_ip")


def stream_incident_sessions(findings: DataFrame, delay: str = "1 hour", gap: str = "1 hour") -> DataFrame:
    """Findings of a host that follow each other within `gap`: session (the seq of the first by
    time), findings and times; rows in any order within the watermark join or merge sessions."""
    first = F.min(F.struct("ts", "seq")).alias("_first")
    out = findings.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "hostname").agg(F.count("*").alias("findings"), first, F.max("ts").alias("last_seen"))
    return out.select("session_window", "hostname", "findings", F.col("_first.seq").alias("session"), F.col("_first.ts").alias("first_seen"), "last_seen")


def stream_host_counts(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "hostname").agg(F.count("*").alias("events"))
