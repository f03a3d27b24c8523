"""Quality rules learned as a decision list (operator 3), in DataFrame operations only.

Labelled rows are counted by the bins of their text statistics; sequential covering then works on that table alone:
a rule for bad rows grows one threshold at a time by information gain, is cut back on rows held out for that, and the
rows that it covers leave before the next rule.  The rules become one ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loamframe.llm.common import WORD_SEPARATORS, durable, let, passed_on, word_list

SYMBOLS = "[^#*$%&|<>]+"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Shares come as whole parts of a thousand, so that rules show plain numbers.
FEATURES = {
    "n_words": "s.n_words",
    "chars_per_1000_words": "s.word_chars * 1000 div greatest(s.n_words, 1)",
    "symbols_per_1000_words": "s.n_symbols * 1000 div greatest(s.n_words, 1)",
    "n_dup_lines": "s.n_dup_lines",
    "repeated_per_1000_words": "s.n_repeat_words * 1000 div greatest(s.n_words, 1)",
}


def _repeated_words(words: Column) -> Column:
    """Words in three-word windows found twice or more: equal windows meet in order of their hash."""
    n = F.size(words)
    windows = F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("at")),
    )).otherwise(F.array().cast("array<struct<h:bigint,at:int>>"))

    def covered(ranked: Column) -> Column:
        again = F.filter(ranked, lambda w, k: ((k > 0) & (F.get(ranked, k - 1)["h"] == w["h"])) | F.coalesce(F.get(ranked, k + 1)["h"] == w["h"], F.lit(False)))
        return let(F.transform(again, lambda w: w["at"]), lambda at: F.size(F.array_union(
            F.array_union(at, F.transform(at, lambda i: i + 1)), F.transform(at, lambda i: i + 2))))

    return let(F.sort_array(windows), covered)


def text_statistics(text: Column) -> Column:
    """Struct of the statistics of one whole text; a null text has none of anything."""
    body = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda line: F.trim(line, F.lit(WORD_SEPARATORS)) != "")
    return let(word_list(body), lambda words: F.struct(
        F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(body, SYMBOLS, "")).cast("long").alias("n_symbols"),
        let(lines, lambda kept: F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("n_dup_lines"),
        _repeated_words(words).cast("long").alias("n_repeat_words")))


def base_failed(s: str) -> Column:
    """Fewer than 50 words, or over half of them repeated."""
    return (F.col(f"{s}.n_words") < 50) | (100 * F.col(f"{s}.n_repeat_words") > 50 * F.col(f"{s}.n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature > threshold, else feature <= threshold
    threshold: int

    def column(self, values: dict[str, Column]) -> Column:
        value = values[self.feature]
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def holds(rule: Rule, values: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, (c.column(values) for c in rule), F.lit(True))


def verdict(rules: list[Rule], values: dict[str, Column]) -> Column:
    """Number of the first rule that holds, 0 if none does."""
    out = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, start=1))):
        out = F.when(holds(rule, values), F.lit(number)).otherwise(out)
    return F.coalesce(out, F.lit(0))


def _cuts(rows: DataFrame, features: list[str], parts: int) -> dict[str, list[int]]:
    """Thresholds to try: quantiles of good and of bad rows, both ends included; 2 x features x (parts + 1) values at most."""
    shares = [k / parts for k in range(parts + 1)]
    found = rows.groupBy("bad").agg(*[F.percentile_approx(f, shares, 10_000).alias(f) for f in features]).collect()
    return {f: sorted({int(v) for row in found for v in row[f] or ()}) for f in features}


def _gain(p: float, n: float, before_p: float, before_n: float) -> float:
    if p <= 0 or before_p <= 0:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(before_p / (before_p + before_n)))


def learn_rules(
    rows: DataFrame, features: list[str], parts: int = 24, most_rules: int = 12, most_conditions: int = 4, precision: float = 0.9, least: int = 5,
) -> list[Rule]:
    """Ordered rules for the rows with ``bad`` true.

    ``rows`` has the long ``features``, ``bad`` and ``held`` (true: kept for pruning); rows with a null among them do not count.
    A rule stays if, on the held rows and on all, at least ``precision`` of what it covers is bad, and it covers ``least`` bad
    rows or more.  Equal gains go to the first feature, then "above", then the narrower
    condition.  A rule that fails is tried again without its first condition.  Without bad or good
    rows there are no rules.  Only counts for each feature and cut come to the driver.
    """
    rows = rows.select(*features, "bad", "held").dropna()
    cuts = _cuts(rows, features, parts)
    if not all(cuts.values()):
        return []
    # a cell: for each feature the number of cuts below the value
    cell = {f: reduce(lambda a, b: a + b, ((F.col(f) > F.lit(c)).cast("int") for c in cuts[f])) for f in features}
    cells = durable(rows.select(*[cell[f].alias(f) for f in features], "bad", "held").groupBy(*features, "held").agg(
        F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")))

    def in_cells(rule: Rule) -> Column:
        parts = [F.col(c.feature) > F.lit(cuts[c.feature].index(c.threshold)) for c in rule]
        return reduce(lambda a, b: a & b, (x if c.above else ~x for x, c in zip(parts, rule)), F.lit(True))

    def grow(rest: DataFrame, banned: set[Condition]) -> Rule:
        rule: Rule = ()
        while len(rule) < most_conditions:
            sums = (rest.where(in_cells(rule)).select("p", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(f).alias("b")) for k, f in enumerate(features)])).alias("at"))
                    .groupBy("at.f", "at.b").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect())
            best, found = 1e-9, None
            for k, f in enumerate(features):
                own = sorted((r["b"], r["p"], r["n"]) for r in sums if r["f"] == k)
                all_p, all_n = sum(r[1] for r in own), sum(r[2] for r in own)
                for above in (True, False):
                    for c in sorted(range(len(cuts[f])), reverse=above):
                        p = sum(r[1] for r in own if (r[0] > c) == above)
                        n = sum(r[2] for r in own if (r[0] > c) == above)
                        if not rule and Condition(f, above, cuts[f][c]) in banned:
                            continue
                        if p >= least and (gain := _gain(p, n, all_p, all_n)) > best + 1e-9:
                            best, found = gain, Condition(f, above, cuts[f][c])
                if not all_n:
                    return rule
            if found is None:
                break
            rule += (found,)
        return rule

    rules: list[Rule] = []
    banned: set[Condition] = set()
    while len(rules) < most_rules and len(banned) < most_rules:
        rest = cells
        for rule in rules:
            rest = rest.where(~in_cells(rule))
        rule = grow(rest.where(~F.col("held")), banned)
        if not rule:
            break
        counted = rest.agg(*[F.coalesce(F.sum(F.when(in_cells(rule[:k]) & held, F.col(c))), F.lit(0)).alias(f"{c}{k}{tag}")
                             for k in range(1, len(rule) + 1) for c in "pn" for tag, held in (("h", F.col("held")), ("a", F.lit(True)))]).first()
        worth = [((counted[f"p{k}h"] - counted[f"n{k}h"]) / max(1, counted[f"p{k}h"] + counted[f"n{k}h"]), -k) for k in range(1, len(rule) + 1)]
        k = -max(worth)[1]
        good = all(counted[f"p{k}{tag}"] >= precision * (counted[f"p{k}{tag}"] + counted[f"n{k}{tag}"]) for tag in "ha")
        if good and counted[f"p{k}a"] >= least:
            rules.append(rule[:k])
        else:
            banned.add(rule[0])
    return rules


def with_statistics(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) and the struct ``_statistics``.  Columns with names of results give way."""
    keep = passed_on(df.columns if keep is None else keep, {"_statistics", "base_failed", "rule", "kept"})
    return df.select(*[F.col(f"`{c}`") for c in keep], text_statistics(F.col(f"`{text}`")).alias("_statistics"))


def rules_from_labels(counted: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", **settings) -> list[Rule]:
    """Rules from all labelled rows of ``counted`` (a written table from ``with_statistics``) that pass the base checks.

    ``label`` 0 is bad; one row in three, by the hash of its id, is held out for pruning.  Null labels and ids do not
    count, repeated or contradicting labels count each.  Empty tables, or labels of one kind, give no rules.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("_labelled"), F.col(f"`{label}`").alias("_label")).dropna()
    rows = (counted.where(~base_failed("_statistics")).select(F.col(f"`{id_col}`").alias("_id"), *[v.cast("long").alias(n) for n, v in feature_columns().items()])
            .join(known, F.col("_id") == F.col("_labelled"))
            .select(*FEATURES, (F.col("_label") == 0).alias("bad"), (F.pmod(F.xxhash64("_id"), F.lit(3)) == 0).alias("held")))
    return learn_rules(rows, list(FEATURES), **settings)


def feature_columns() -> dict[str, Column]:
    return {name: F.expr(e.replace("s.", "_statistics.")) for name, e in FEATURES.items()}


def judge(counted: DataFrame, rules: list[Rule]) -> DataFrame:
    """``counted`` (from ``with_statistics``) with ``base_failed``, ``rule`` (number of the first that holds, or 0) and ``kept``.

    A row is kept if it passes the base checks and no rule holds.
    """
    return counted.withColumns({"base_failed": base_failed("_statistics"), "rule": verdict(rules, feature_columns())}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0))
