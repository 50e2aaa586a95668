"""Relations read off multi-way facts by a positional pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.analysis import ProgramError
from factloom.plans.clauses import Mapping, Var
from factloom.sources.facts import shape


def mapped(facts: DataFrame, mapping: Mapping, typed: bool = False) -> DataFrame:
    """Columns c0.. of the arguments: one row for each fact that has exactly the pattern's entities in its order.

    Ids stand without their type, or as ``type/id`` if ``typed``. A variable that repeats must stand for equal ids. The sequence of
    types is one text column of a stored fact, so matching it is pushed down to the scan.
    """
    where = F.col("shape") == F.lit(shape([t for t, _ in mapping.pattern]))
    first: dict[str, int] = {}
    for i, (_, value) in enumerate(mapping.pattern):
        own = F.col("entities")[i]["id"]
        if not isinstance(value, Var):
            where = where & (own == F.lit(value))
        elif value.name in first:
            where = where & (own == F.col("entities")[first[value.name]]["id"])
        else:
            first[value.name] = i
    if missing := [a for a in mapping.args if a not in first]:
        raise ProgramError(f"argument {missing[0]} of {mapping.name} is not in its pattern")
    values = [F.col("entities")[first[a]] for a in mapping.args]
    values = [F.concat_ws("/", v["type"], v["id"]) if typed else v["id"] for v in values]
    return facts.filter(where).select(*[v.alias(f"c{i}") for i, v in enumerate(values)])
