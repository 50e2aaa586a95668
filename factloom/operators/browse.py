"""Browsing of facts by entity: types, entities of a type, and what occurs together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entity_types(edges: DataFrame) -> DataFrame:
    """(type, entities): every type with the number of its distinct ids."""
    return edges.select("type", "id").distinct().groupBy("type").agg(F.count("*").alias("entities"))


def entities_of(edges: DataFrame, type: str) -> DataFrame:
    """(id): distinct ids of a type, sorted."""
    return edges.filter(F.col("type") == type).select("id").distinct().orderBy("id")


def _is(entity: tuple[str, str]):
    return (F.col("type") == entity[0]) & (F.col("id") == entity[1])


def matching_facts(edges: DataFrame, entities: list[tuple[str, str]]) -> DataFrame:
    """(fact_id) of the facts that have all of the entities: chained semi-joins of their lookups."""
    out = None
    for entity in dict.fromkeys(entities):
        own = edges.filter(_is(entity)).select("fact_id")
        out = own.distinct() if out is None else out.join(own, "fact_id", "left_semi")
    return out


def cooccurring(edges: DataFrame, entities: list[tuple[str, str]], project: str | None = None) -> DataFrame:
    """(type, id): distinct entities, other than the given ones, of the facts that have all of these."""
    wanted = edges if project is None else edges.filter(F.col("type") == project)
    for entity in dict.fromkeys(entities):
        wanted = wanted.filter(~_is(entity))
    return wanted.join(matching_facts(edges, entities), "fact_id", "left_semi").select("type", "id").distinct()


def read_path(path: str) -> tuple[list[tuple[str, str]], str | None]:
    """``T/I/T/I/P`` as its entities and the type projected to (last, if parts are odd in number)."""
    parts = [p for p in path.split("/") if p]
    pairs = list(zip(parts[::2], parts[1::2], strict=False))
    return pairs, parts[-1] if len(parts) % 2 else None


def get(edges: DataFrame, path: str = "") -> DataFrame:
    """What a path leads to: types, ids of a type, entities that occur with others, or those of one type."""
    entities, project = read_path(path)
    if not entities:
        return entities_of(edges, project) if project else entity_types(edges).orderBy("type")
    found = cooccurring(edges, entities, project)
    return found.select("id").orderBy("id") if project else found.orderBy("type", "id")
