"""Matching a table of pattern rules over ordered sequences.

A rule names a set of target symbols, sets for the symbol before and after (a set may be
negated), boolean conditions over context columns, and a priority. Rules never change a
sequence, so they are independent: all of them are compiled into one array column over
the context columns, and matching costs a projection. Rule tables too large for that are
joined on the exploded target symbol (``match_join``).

A condition whose context value is null (not known at this position) passes, unless
``strict`` is set.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    target: tuple[str, ...]
    category: str = "general"
    priority: int = 0
    prev: tuple[str, ...] = ()
    next: tuple[str, ...] = ()
    not_prev: tuple[str, ...] = ()
    not_next: tuple[str, ...] = ()
    conditions: Mapping[str, bool] = field(default_factory=dict)


def by_priority(rules: Sequence[Rule]) -> list[Rule]:
    """Highest first; equal priorities keep their order."""
    return sorted(rules, key=lambda r: -r.priority)


def _all(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def predicates(rule: Rule, symbol: str, prev: str, next: str, strict: bool = False) -> dict[str, Column]:
    """Each test of a rule as a boolean column that is never null."""
    def within(column: str, values: Sequence[str]) -> Column:
        return F.coalesce(F.col(column).isin(*values), F.lit(False))

    parts = {"target": within(symbol, rule.target) if rule.target else F.lit(False)}
    if rule.prev:
        parts["prev"] = within(prev, rule.prev)
    if rule.next:
        parts["next"] = within(next, rule.next)
    if rule.not_prev:
        parts["not_prev"] = F.col(prev).isNotNull() & ~within(prev, rule.not_prev)
    if rule.not_next:
        parts["not_next"] = F.col(next).isNotNull() & ~within(next, rule.not_next)
    for name, wanted in rule.conditions.items():
        parts[name] = F.coalesce(F.col(name) == F.lit(wanted), F.lit(not strict))
    return parts


def known_conditions(rules: Sequence[Rule], columns: Sequence[str]) -> list[Rule]:
    """Rules without conditions on context that is known nowhere, as such a condition passes."""
    have = set(columns)
    return [replace(r, conditions={c: v for c, v in r.conditions.items() if c in have}) for r in rules]


def hits(rules: Sequence[Rule], symbol: str = "symbol", prev: str = "symbol_p1", next: str = "symbol_n1", strict: bool = False) -> Column:
    """Array of (rule, category, priority, rule_order) of the rules that match at a position, by priority."""
    found = [
        F.when(
            _all(list(predicates(r, symbol, prev, next, strict).values())),
            F.struct(F.lit(r.name).alias("rule"), F.lit(r.category).alias("category"), F.lit(r.priority).alias("priority"), F.lit(i).alias("rule_order")),
        )
        for i, r in enumerate(by_priority(rules))
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def match(
    positions: DataFrame, rules: Sequence[Rule], symbol: str = "symbol", prev: str = "symbol_p1", next: str = "symbol_n1", strict: bool = False
) -> DataFrame:
    """A row for each (position, rule) that matches: rule, category, priority, rule_order and all columns."""
    return positions.withColumn("_hit", F.explode(hits(rules, symbol, prev, next, strict))).select("*", "_hit.*").drop("_hit")


def rule_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """Rules as a table, one row each, sets as arrays and conditions as a map."""
    rows = [
        (i, r.name, r.category, r.priority, list(r.target), list(r.prev), list(r.next), list(r.not_prev), list(r.not_next), dict(r.conditions))
        for i, r in enumerate(by_priority(rules))
    ]
    return spark.createDataFrame(
        rows,
        "rule_order int, rule string, category string, priority int, target array<string>, prev array<string>, next array<string>, "
        "not_prev array<string>, not_next array<string>, conditions map<string,boolean>",
    )


def match_join(
    positions: DataFrame, rules: DataFrame, context: Sequence[str] = (), symbol: str = "symbol", prev: str = "symbol_p1",
    next: str = "symbol_n1", strict: bool = False,
) -> DataFrame:
    """The same with rules in a table of any size: an equi-join on the target symbol, then the other tests."""
    r = rules.select("*", F.explode("target").alias("_symbol")).drop("target")
    for name in ("prev", "next", "not_prev", "not_next", "conditions"):
        r = r.withColumnRenamed(name, f"_{name}")
    known = F.create_map(*[x for c in context for x in (F.lit(c), F.col(c))]) if context else F.create_map().cast("map<string,boolean>")
    j = positions.withColumn("_context", known).join(r, F.col(symbol) == F.col("_symbol"))

    def test(column: str, wanted: str, negated: str) -> Column:
        inside = (F.size(wanted) == 0) | F.coalesce(F.array_contains(wanted, F.col(column)), F.lit(False))
        outside = (F.size(negated) == 0) | (F.col(column).isNotNull() & ~F.coalesce(F.array_contains(negated, F.col(column)), F.lit(False)))
        return inside & outside

    holds = F.forall(F.map_entries("_conditions"), lambda e: F.coalesce(F.col("_context")[e["key"]] == e["value"], F.lit(not strict)))
    kept = j.where(test(prev, "_prev", "_not_prev") & test(next, "_next", "_not_next") & holds)
    return kept.drop("_symbol", "_prev", "_next", "_not_prev", "_not_next", "_conditions", "_context")


def suppress(apps: DataFrame, at: Sequence[str], general: str, specific: Sequence[str], name: str = "rule") -> DataFrame:
    """Drop the general rule where one of the specific rules applies at the same place."""
    winners = apps.where(F.col(name).isin(*specific)).select(*at).distinct()
    return apps.where(F.col(name) != general).unionByName(
        apps.where(F.col(name) == general).join(winners, list(at), "left_anti")
    )


def suppress_in_place(apps: DataFrame, at: Sequence[str], general: str, specific: Sequence[str], name: str = "rule") -> DataFrame:
    """The same by one window over the place: one exchange, no second read of the matches."""
    w = Window.partitionBy(*at)
    beaten = F.max(F.when(F.col(name).isin(*specific), 1).otherwise(0)).over(w) == 1
    return apps.withColumn("_beaten", beaten).where((F.col(name) != general) | ~F.col("_beaten")).drop("_beaten")


def inject(apps: DataFrame, specs: DataFrame, known: DataFrame, positions: DataFrame, at: Sequence[str]) -> DataFrame:
    """Add rule applications given as (place, rule): only known rules, existing places, and not yet there."""
    new = (
        specs.join(known.select("rule"), "rule", "left_semi")
        .join(positions.select(*at), list(at), "left_semi")
        .join(apps.select(*at, "rule"), [*at, "rule"], "left_anti")
        .select(*at, "rule").distinct()
    )
    return apps.select(*at, "rule").unionByName(new)


def rules_at(apps: DataFrame, at: Sequence[str], name: str = "rule") -> DataFrame:
    """One row a place: its distinct rules, sorted and joined."""
    return apps.groupBy(*at).agg(F.array_join(F.sort_array(F.collect_set(name)), ",").alias("rules"), F.countDistinct(name).alias("n_rules"))


def explain(positions: DataFrame, rule: Rule, keep: Sequence[str], symbol: str = "symbol", prev: str = "symbol_p1", next: str = "symbol_n1") -> DataFrame:
    """Why a rule did not match: each of its tests as a column."""
    return positions.select(*keep, *[c.alias(f"test_{k}") for k, c in predicates(rule, symbol, prev, next).items()])
