"""All results on one table of events, as lazy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import graph, heuristics, incidents, rules, summaries, verdicts
from .shared import Scratch


def analyze(events: DataFrame, playbook: tuple[rules.Rule, ...] = rules.RULES) -> dict[str, DataFrame]:
    """Findings, correlations, incidents, graph, facets, timeline, pre-scan and summary.

    Findings and judged events are written once to the shared folder; what builds on them reads
    those tables.
    """
    scratch = Scratch(events.sparkSession, "session")
    findings = scratch.keep(rules.dedup(rules.evaluate(events, playbook)), "findings")
    scored = scratch.keep(heuristics.with_replication(heuristics.event_semantics(events)), "scored")
    correlated = rules.bruteforce(events)
    edges = graph.edges(events)
    return {
        "findings": findings, "correlated": correlated, "severity_counts": rules.severity_counts(findings),
        "incidents": incidents.ranked(incidents.rollup(incidents.components(findings))), "nodes": graph.nodes(events, findings), "edges": edges,
        "facets": summaries.facets(events), "timeline": summaries.enrich_timeline(events, findings, correlated), "prescan": heuristics.prescan(events, scored=scored),
        "hypotheses": heuristics.with_evidence(heuristics.hypotheses(scored, findings), events), "summary": verdicts.session_summary(findings),
    }
