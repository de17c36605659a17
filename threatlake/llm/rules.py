"""Quality rules as a learned decision list.

Sequential covering over labelled text statistics: each rule is a conjunction of
thresholds, grown by information gain on one part of the sample and pruned on the
other; the list is applied as ordered Spark conditional expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Scratch, fresh, map_texts, same_ids

SYMBOLS = "#*$%&|<>"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper_words long, n_exclaim long, n_pipe long, n_unique long"
#: The learner's inputs, each an expression over the statistics.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_ratio": "n_symbols / greatest(word_chars, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "upper_ratio": "n_upper_words / greatest(n_words, 1)",
    "exclaim_ratio": "n_exclaim / greatest(n_words, 1)",
    "pipe_ratio": "n_pipe / greatest(n_words, 1)",
    "unique_ratio": "n_unique / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}
WINDOW = 5


def repeated_words(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per document, its words that lie in a WINDOW-word window found twice or more in it.

    ids: word numbers of all documents, one after another. Windows are compared as 64-bit mixes.
    """
    n = len(ids)
    if n < WINDOW:
        return np.zeros(len(starts), np.int64)
    key = np.repeat(np.arange(len(starts), dtype=np.uint64), counts)[: n - WINDOW + 1] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(WINDOW):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + ids[k : n - WINDOW + 1 + k]
    key ^= key >> np.uint64(32)
    whole = np.ones(n, bool)  # windows that do not run into the next document
    ends = starts + counts
    for k in range(1, WINDOW):
        whole[np.maximum(ends - k, starts)[counts > 0]] = False
    at = np.flatnonzero(whole[: n - WINDOW + 1])
    key = key[at]
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(starts), np.int64)
    hit = at[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(step[:n]) > 0)])
    return covered[ends] - covered[starts]


def statistics(texts: list[str]) -> dict[str, list]:
    got: dict[str, list] = {f.split()[0]: [] for f in STATS.split(", ")}
    numbers: dict[bytes, int] = {}
    ids: list[int] = []
    counts = []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").split()
        ids += [numbers.setdefault(w, len(numbers)) for w in words]
        counts.append(len(words))
        lines = [x for x in text.split("\n") if x.strip(SPACE)]
        got["n_words"].append(len(words))
        got["word_chars"].append(len(text) - sum(map(text.count, SPACE)))
        got["n_symbols"].append(sum(map(text.count, SYMBOLS)))
        got["n_dup_lines"].append(len(lines) - len(set(lines)))
        got["n_lines"].append(len(lines))
        got["n_upper_words"].append(sum(map(bytes.isupper, words)))
        got["n_exclaim"].append(text.count("!"))
        got["n_pipe"].append(text.count("|"))
        got["n_unique"].append(len(set(words)))
    size = np.array(counts, np.int64)
    got["n_repeat_words"] = repeated_words(np.array(ids, np.uint64), np.cumsum(size) - size, size).tolist()
    return got


@dataclass(frozen=True)
class Rule:
    """Rejects a text when all (feature, '<=' or '>', threshold) hold."""

    conditions: tuple[tuple[str, str, float], ...]

    def covers(self, x: np.ndarray) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for name, way, limit in self.conditions:
            column = x[:, list(FEATURES).index(name)]
            hit &= column <= limit if way == "<=" else column > limit
        return hit

    def column(self) -> Column:
        return F.expr(" and ".join(f"(({FEATURES[name]}) {way} {limit!r}D)" for name, way, limit in self.conditions))


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    hit = rule.covers(x)
    p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
    return (p - n) / max(p + n, 1)


def learn(x: np.ndarray, bad: np.ndarray, precision: float = 0.9, most_rules: int = 12, most_conditions: int = 4) -> list[Rule]:
    """Sequential covering. x: rows of FEATURES in their order; bad: the rows to reject."""
    names, rules = list(FEATURES), []
    prune = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    while len(rules) < most_rules:
        grow = left & ~prune
        gx, gy = x[grow], bad[grow]
        if gy.sum() < 3:
            break
        conditions: tuple[tuple[str, str, float], ...] = ()
        while len(conditions) < most_conditions and (~gy).any():
            best, base = None, np.log2(gy.mean())
            for f, name in enumerate(names):
                values = np.unique(gx[:, f])
                if len(values) < 2:
                    continue
                cut = np.unique(np.quantile(values, np.linspace(0, 1, 65)[1:-1], method="lower"))
                for limit in np.unique((cut + values[np.minimum(np.searchsorted(values, cut, "right"), len(values) - 1)]) / 2):
                    low = gx[:, f] <= limit
                    for way, hit in (("<=", low), (">", ~low)):
                        p, total = int((hit & gy).sum()), int(hit.sum())
                        if p >= 2 and (gain := p * (np.log2(p / total) - base)) > (best[0] if best else 1e-9):
                            best = (gain, (name, way, float(limit)), hit)
            if not best:
                break
            conditions += (best[1],)
            gx, gy = gx[best[2]], gy[best[2]]
        if not conditions:
            break
        px, py = x[left & prune], bad[left & prune]
        rule = max((Rule(conditions[:k]) for k in range(len(conditions), 0, -1)), key=lambda r: _worth(r, px, py)) if py.any() else Rule(conditions)
        hit = rule.covers(x) & left
        if hit.sum() < 3 or (hit & bad).sum() < precision * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True for a text to keep: the first rule that holds rejects it."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].column(), F.lit(False))
    for rule in rules[1:]:
        out = out.when(rule.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def quality_rules(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000) -> DataFrame:
    """Per document: statistics of the whole text, base_failed and kept.

    The list is fitted on at most `sample` labelled rows, those with the least hash of the
    id (label 0: to reject); statistics cover every row. A null or empty text has no words,
    so base_failed holds. Null ids and null labels take no part in fitting. Of repeated
    labels of one id the highest counts. With no labels, or of one class, the list is empty
    and only base_failed rejects. Repeated rows give equal rows; other columns are ignored.
    """
    scratch = Scratch(spark, "rules")
    stats = scratch.keep(map_texts(fresh(docs, id_col, text_col), statistics, STATS), "stats")
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).dropna().groupBy("_id").agg(F.max("_y").alias("_y"))
    left, marks = same_ids(stats, marks)
    rows = (
        left.join(marks, "_id")
        .select(F.xxhash64("_id").alias("_h"), "_id", "_y", *(F.expr(e).alias(n) for n, e in FEATURES.items()))
        .orderBy("_h", "_id", *FEATURES).limit(sample).collect()
    )
    x = np.array([[r[n] for n in FEATURES] for r in rows], float).reshape(-1, len(FEATURES))
    rules = learn(x, np.array([r["_y"] == 0 for r in rows], bool)) if rows else []
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"),
    )
