"""Multi-way facts: reading JSON lines, and an append-only store of Parquet tables.

A fact is ``fact_id``, its ordered ``entities`` (type, id), a nullable ``source``, and ``shape``, the
sequence of its entity types.
"""

from __future__ import annotations

import contextlib
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.staging import table

ENTITIES = "array<struct<type:string,id:string>>"
FACTS = f"fact_id bigint, entities {ENTITIES}, source string, shape string"
EDGES = "fact_id bigint, pos int, type string, id string"

_MARK = "\u0001"


def shape(types: list[str]) -> str:
    return "".join(t + _MARK for t in types)


def with_shape(facts: DataFrame) -> DataFrame:
    return facts.withColumn("shape", F.array_join(F.transform("entities", lambda e: F.concat(e["type"], F.lit(_MARK))), ""))


def parse_lines(lines: DataFrame) -> DataFrame:
    """entities, source, shape and rejected of non-empty JSON lines (column ``value``).

    Each edge stands for itself: one that is no array of at least two texts is dropped, and a line
    without a valid edge has no entities. A source that is no text, or is empty, is null; rejected
    marks lines that are no JSON.
    """
    v = lines.filter("value <> ''").withColumn("v", F.try_parse_json("value"))
    is_text = lambda c, path: F.schema_of_variant(F.try_variant_get(c, path, "variant")) == "STRING"
    edges = F.try_variant_get("v", "$.edges", "array<variant>")
    good = F.filter(edges, lambda e: is_text(e, "$[0]") & is_text(e, "$[1]"))
    entities = F.transform(good, lambda e: F.struct(F.try_variant_get(e, "$[0]", "string").alias("type"), F.try_variant_get(e, "$[1]", "string").alias("id")))
    source = F.when(is_text(F.col("v"), "$.source"), F.nullif(F.try_variant_get("v", "$.source", "string"), F.lit("")))
    kept = [c for c in lines.columns if c != "value"]
    return with_shape(v.select(*kept, "value", entities.alias("entities"), source.alias("source"), F.col("v").isNull().alias("rejected")))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Facts of a JSON-lines file, without ids."""
    return parse_lines(spark.read.text(path)).filter(F.size("entities") > 0).select("entities", "source", "shape")


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of the lines of files that are no JSON, in order; line counts from 1, empty ones too.

    A block of a file is read by one task in order, so a line's number is its place in the block
    after the lines of the blocks before it.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    blocks = lines.groupBy("file", "start").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "start", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift"))
    bad = parse_lines(lines).filter("rejected").join(blocks, ["file", "start"])
    return bad.select("file", (F.col("row") + F.col("shift")).alias("line"), "value").orderBy("file", "line")


def numbered(facts: DataFrame, first: int = 1) -> DataFrame:
    """``facts`` with consecutive fact_ids in their order: offsets of partitions plus places within them."""
    rows = table(facts.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}  # one row a partition
    offset, pairs = first, []
    for part in sorted(sizes):
        pairs.append((part, offset - (part << 33)))
        offset += sizes[part]
    offsets = F.broadcast(facts.sparkSession.createDataFrame(pairs, "_part int, _offset bigint"))
    return rows.join(offsets, "_part").withColumn("fact_id", F.col("_row") + F.col("_offset")).select("fact_id", *facts.columns)


def edges_of(facts: DataFrame) -> DataFrame:
    """(fact_id, pos, type, id) of every entity of every fact."""
    return facts.select("fact_id", F.posexplode("entities").alias("pos", "e")).select("fact_id", "pos", "e.type", "e.id")


class FactStore:
    """Facts below a folder: ``facts`` by id, and ``edges`` sorted by entity so that lookups skip row groups.

    Each addition is a folder ``batch=...`` of both tables. Ids go on from the largest, so there is one
    writer at a time: a second one finds the file ``_writer`` and is refused.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        target, files = self._at(name)
        return files.exists(target)

    def _read(self, name: str, schema: str) -> DataFrame:
        # A store that nothing was added to is an empty table.
        if not self._exists(name):
            return self.spark.createDataFrame([], f"{schema}, batch string")
        return self.spark.read.schema(f"{schema}, batch string").parquet(f"{self.path}/{name}")

    @property
    def facts(self) -> DataFrame:
        return self._read("facts", FACTS).drop("batch")

    @property
    def edges(self) -> DataFrame:
        return self._read("edges", EDGES).drop("batch")

    @contextlib.contextmanager
    def _writing(self):
        target, files = self._at("_writer")
        try:
            files.createNewFile(target) or self._refuse()
        except Py4JJavaError as problem:
            raise OSError(f"cannot write to {self.path}") from problem
        try:
            yield
        finally:
            files.delete(target, False)

    def _refuse(self):
        raise RuntimeError(f"another writer adds to {self.path}; if it was cut off, call unlock()")

    def unlock(self) -> None:
        """Let go of what a writer that was cut off has left."""
        target, files = self._at("_writer")
        files.delete(target, False)

    def add_facts(self, facts: DataFrame, batch_id: int | str | None = None) -> int:
        """Append facts (entities, source); ids go on from the largest there is. Returns how many were added.

        What is added under a ``batch_id`` is stored once: if the batch is there already its facts
        stay as they are, and only edges that are missing are written.
        """
        name = f"batch={uuid.uuid4().hex if batch_id is None else f'id_{batch_id}'}"
        with self._writing():
            if not self._exists(f"facts/{name}/_SUCCESS"):
                others = self._read("facts", FACTS).filter(F.col("batch") != name.removeprefix("batch="))
                last = others.agg(F.max("fact_id")).head()[0] or 0
                clean = facts.select(F.col("entities").cast(ENTITIES).alias("entities"), F.nullif(F.col("source").cast("string"), F.lit("")).alias("source"))
                rows = numbered(with_shape(clean), last + 1).select("fact_id", "entities", "source", "shape")
                rows.sortWithinPartitions("shape").write.mode("overwrite").parquet(f"{self.path}/facts/{name}")
            rows = self.spark.read.schema(FACTS).parquet(f"{self.path}/facts/{name}")
            if not self._exists(f"edges/{name}/_SUCCESS"):
                edges_of(rows).repartitionByRange("type", "id").sortWithinPartitions("type", "id").write.mode("overwrite").parquet(f"{self.path}/edges/{name}")
            return rows.count()

    def add_fact(self, entities: list[tuple[str, str]], source: str | None = None) -> int:
        """Append one fact and return its id."""
        self.add_facts(self.spark.createDataFrame([(entities, source)], f"entities {ENTITIES}, source string"))
        return self.facts.agg(F.max("fact_id")).head()[0]

    def ingest(self, path: str) -> int:
        return self.add_facts(read_json_lines(self.spark, path))

    def fact(self, fact_id: int) -> DataFrame:
        return self.facts.filter(F.col("fact_id") == fact_id)

    def facts_of(self, type: str, id: str) -> DataFrame:
        """Sorted ids of the facts with an entity."""
        return self.edges.filter((F.col("type") == type) & (F.col("id") == id)).select("fact_id").distinct().orderBy("fact_id")
