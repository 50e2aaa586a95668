"""``python -m factloom.cli get|ingest|datalog``: browse and load the store in ./.factloom, run programs."""

from __future__ import annotations

import os
import sys
import time

from pyspark.sql import SparkSession

from factloom.engine import Engine
from factloom.operators.browse import get, matching_facts, read_path
from factloom.plans.analysis import ProgramError
from factloom.sources.facts import FactStore, rejected_lines
from factloom.sources.program import load_program

USAGE = "usage: get [path] | ingest <file.jsonl> | datalog [--profile] <file.dl>"
STORE = ".factloom"


def _store(spark: SparkSession) -> FactStore:
    return FactStore(spark, f"file://{os.path.abspath(STORE)}")


def _get(spark: SparkSession, path: str) -> int:
    store = _store(spark)
    entities, project = read_path(path)
    rows, none, last = get(store.edges, path).toLocalIterator(), True, None
    for r in rows:
        none = False
        if entities and project is None:
            if r.type != last:
                print(f"{r.type}/")
                last = r.type
            print(f"  {r.id}")
        else:
            print(f"{r.type}/ ({r.entities})" if "type" in r else r.id)
    if none:
        print("(no matching facts)" if entities else "(empty store)")
    if entities and project is None:
        print(f"{matching_facts(store.edges, entities).count()} facts")
    return 0


def _ingest(spark: SparkSession, path: str) -> int:
    for r in rejected_lines(spark, path).toLocalIterator():
        print(f"{os.path.basename(r.file)} line {r.line}: not JSON, skipped: {r.value[:80]}", file=sys.stderr)
    print(f"Ingested {_store(spark).ingest(path)} facts")
    return 0


def _datalog(spark: SparkSession, path: str, profile: bool) -> int:
    program = load_program(path)
    print(f"Parsed {len(program.rules)} rules, {len(program.mappings)} mappings, {len(program.queries)} queries")
    engine = Engine(spark, _store(spark).facts if program.mappings else None).load_file(path)
    if profile:
        print(f"{len(engine.relations())} relations")
    began = time.time()
    for query, found in engine.results():
        print(f"?- {', '.join(map(str, query))}.")
        count = 0
        for row in found.orderBy(*found.columns).toLocalIterator() if found.columns else found.collect():  # of the latter at most one
            print("  " + (", ".join(f"{c} = {v}" for c, v in zip(found.columns, row, strict=True)) or "true"))
            count += 1
        print(f"  ({count} results)" if count else "  (no results)")
    print(f"Evaluated in {(time.time() - began) * 1000:.0f} ms")
    return 0


def main(args: list[str], spark: SparkSession | None = None) -> int:
    flags, words = [a for a in args if a.startswith("--")], [a for a in args if not a.startswith("--")]
    known = words and words[0] in ("get", "ingest", "datalog") and len(words) <= 2 and (words[0] == "get" or len(words) == 2)
    if not known or set(flags) - {"--profile"} or flags and words[0] != "datalog":
        print(USAGE, file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("facts").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        if words[0] == "get":
            return _get(spark, words[1] if len(words) == 2 else "")
        return _ingest(spark, words[1]) if words[0] == "ingest" else _datalog(spark, words[1], bool(flags))
    except (ProgramError, OSError) as problem:
        print(problem, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
