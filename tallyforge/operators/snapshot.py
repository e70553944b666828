"""Versions of rule tables, and what a change of rules would do."""

from __future__ import annotations

import json
from dataclasses import asdict, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def take(rules: dict[str, list]) -> str:
    """Rule lists as one JSON text."""
    return json.dumps({k: [asdict(r) for r in v] for k, v in rules.items()}, ensure_ascii=False, sort_keys=True)


def load(text: str, kinds: dict[str, type]) -> dict[str, list]:
    """Rule lists of a JSON text; a text that is no JSON object, or lacks a list, gives empty lists."""
    try:
        data = json.loads(text)
    except (TypeError, ValueError):
        data = {}
    data = data if isinstance(data, dict) else {}
    own = lambda kind, row: kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in row.items() if k in kind.__dataclass_fields__})
    return {k: [own(kind, r) for r in data.get(k, []) if isinstance(r, dict)] for k, kind in kinds.items()}


def next_id(rules: list) -> int:
    return max([getattr(r, "id", 0) for r in rules], default=0) + 1


def put(rules: list, rule) -> list:
    """rules with that rule in the place of the one of its id, or at the end."""
    return [rule if r.id == rule.id else r for r in rules] if any(r.id == rule.id for r in rules) else [*rules, rule]


def drop(rules: list, rule_id: int) -> list:
    return [r for r in rules if r.id != rule_id]


def toggle(rules: list, rule_id: int) -> list:
    return [replace(r, active=not r.active) if r.id == rule_id else r for r in rules]


def counts(rules: dict[str, list]) -> dict[str, int]:
    return {k: len(v) for k, v in rules.items()}


def diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, before, after) of every value that differs between two results."""
    b, a = before.select(key, *[F.col(c).cast("string").alias(f"b_{c}") for c in columns]), after.select(key, *[F.col(c).cast("string").alias(f"a_{c}") for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"b_{c}").alias("before"), F.col(f"a_{c}").alias("after")) for c in columns])
    return b.join(a, key).select(key, F.explode(F.filter(cells, lambda x: ~x["before"].eqNullSafe(x["after"]))).alias("x")).select(key, "x.*")
