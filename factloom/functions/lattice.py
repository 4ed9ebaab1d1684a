"""The uncertainty lattice. MUST is 1 and MAY is 2; weaker wins, in sequence along a path and among alternatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MUST, MAY, MUST_NOT, INFERRED, ASSUMED, UNKNOWN = 1, 2, 3, 4, 5, 6
NAMES = {0: "UNSPECIFIED", MUST: "MUST", MAY: "MAY", MUST_NOT: "MUST_NOT", INFERRED: "INFERRED", ASSUMED: "ASSUMED", UNKNOWN: "UNKNOWN"}
#: States of the typed relations, which count from 0: mapped by name, never by code.
TYPED = {"MUST": 0, "MAY": 1, "MUST_NOT": 2, "INFERRED": 3, "ASSUMED": 4, "UNKNOWN": 5}


def weaken(left: Column, right: Column) -> Column:
    return F.greatest(left, right)


def positive(state: Column) -> Column:
    return state.isin(MUST, MAY)


def merged(facts: DataFrame, keys: list[str], state: str = "epistemic") -> DataFrame:
    """One row for each key, with its weakest state."""
    return facts.groupBy(*keys).agg(F.max(state).alias(state))


def name_of(state: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), state)


def to_typed(state: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in TYPED.items() for x in kv]), name_of(state))


def alias_state(state: Column) -> Column:
    """0 must, 1 may, 2 no, 3 unknown."""
    return F.when(state == MUST, 0).when(state == MUST_NOT, 2).when(state == UNKNOWN, 3).otherwise(1)
