"""Registered queries over the driver's tables, each a program with its DuckDB twin.

Values are bare texts, so keys of different tables carry a letter: C customer, N nation, R region,
S supplier, P part, O order, T turn, E event, D document.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.engine import Engine
from factloom.functions.compare import compare
from factloom.functions.entity_key import decode_key, encode_key, key_type, sort_part
from factloom.operators.browse import cooccurring, entities_of, entity_types, get, matching_facts
from factloom.sources.facts import FactStore, edges_of, parse_lines, rejected_lines, with_shape
from factloom.staging import shared_dir


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: predicate: (table, argument expressions, condition). The same text serves Spark and DuckDB.
RELATIONS: dict[str, tuple[str, tuple[str, ...], str]] = {
    "cust_nation": ("customer", ("concat('C', c_custkey)", "concat('N', c_nationkey)"), ""),
    "cust_segment": ("customer", ("concat('C', c_custkey)", "c_mktsegment"), ""),
    "supp_nation": ("supplier", ("concat('S', s_suppkey)", "concat('N', s_nationkey)"), ""),
    "nation_region": ("nation", ("concat('N', n_nationkey)", "concat('R', n_regionkey)"), ""),
    "nation_name": ("nation", ("concat('N', n_nationkey)", "n_name"), ""),
    "region_name": ("region", ("concat('R', r_regionkey)", "r_name"), ""),
    "placed": ("orders", ("concat('C', o_custkey)", "concat('O', o_orderkey)"), ""),
    "order_status": ("orders", ("concat('O', o_orderkey)", "o_orderstatus"), ""),
    "order_priority": ("orders", ("concat('O', o_orderkey)", "o_orderpriority"), ""),
    "order_part": ("lineitem", ("concat('O', l_orderkey)", "concat('P', l_partkey)"), ""),
    "supplied": ("lineitem", ("concat('S', l_suppkey)", "concat('P', l_partkey)"), ""),
    "returned": ("lineitem", ("concat('S', l_suppkey)", "concat('P', l_partkey)"), "l_returnflag = 'R'"),
    "part_size": ("part", ("concat('P', p_partkey)", "p_size"), ""),
    "part_brand": ("part", ("concat('P', p_partkey)", "p_brand"), ""),
    "same_key": ("customer", ("c_custkey", "c_nationkey"), ""),
    "next_turn": ("turns", ("concat('T', conv_id, '.', turn)", "concat('T', conv_id, '.', following)"), "following IS NOT NULL"),
    "first_turn": ("conversations", ("concat('T', conv_id, '.', turn)",), "turn = 0"),
    "turn_role": ("conversations", ("concat('T', conv_id, '.', turn)", "role"), ""),
}


#: Every turn number of a conversation with the next one there is.
TURNS = """(SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS following
  FROM (SELECT DISTINCT conv_id, turn FROM {conversations} WHERE conv_id IS NOT NULL AND turn IS NOT NULL) AS numbers)"""


def _engine(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    engine = Engine(spark)
    for name in names:
        source, columns, where = RELATIONS[name]
        rows = spark.sql(TURNS, conversations=_read(spark, sf_dir, "conversations")) if source == "turns" else _read(spark, sf_dir, source)
        rows = rows.filter(where) if where else rows
        engine.register(name, rows.select(*[F.expr(c).alias(f"a{i}") for i, c in enumerate(columns)]))
    return engine


def _program(names: str, source: str, query: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _engine(spark, sf_dir, *names.split()).load(source).query(query)


def _sql(names: str, body: str) -> str:
    views = []
    for name in names.split():
        source, columns, where = RELATIONS[name]
        listed = ", ".join(f"CAST({c} AS VARCHAR) AS {letter}" for c, letter in zip(columns, "abc", strict=False))
        source = f"{TURNS.format(conversations='conversations')} AS turns" if source == "turns" else source
        views.append(f"{name} AS (SELECT DISTINCT {listed} FROM {source}{f' WHERE {where}' if where else ''})")
    return f"WITH RECURSIVE {', '.join(views)} {body}"


#: Integer-or-text comparison for DuckDB; x and y are replaced.
def _compare_sql(x: str, op: str, y: str) -> str:
    n = lambda v: f"CASE WHEN regexp_full_match({v}, '[+-]?[0-9]([0-9_]*[0-9])?') THEN TRY_CAST(replace({v}, '_', '') AS BIGINT) END"
    return f"(CASE WHEN {n(x)} IS NOT NULL AND {n(y)} IS NOT NULL THEN {n(x)} {op} {n(y)} ELSE {x} {op} {y} END)"


_PROGRAMS: dict[str, tuple[str, str, str, str]] = {
    # name: (relations, rules, query, SQL after the relations)
    "copy_swap": ("nation_region", "has(R, N) :- nation_region(N, R).", "has(R, N)", "SELECT b AS R, a AS N FROM nation_region"),
    "project_distinct": ("placed", "active(C) :- placed(C, _).", "active(C)", "SELECT DISTINCT a AS C FROM placed"),
    "const_select": ("order_status", 'done(O) :- order_status(O, "F").', "done(O)", "SELECT DISTINCT a AS O FROM order_status WHERE b = 'F'"),
    "const_first": ("placed", 'mine(O) :- placed("C1", O).', "mine(O)", "SELECT DISTINCT b AS O FROM placed WHERE a = 'C1'"),
    "const_both": ("nation_region region_name", 'there(N) :- nation_region("N1", "R1"), region_name(_, N).', "there(N)", "SELECT DISTINCT b AS N FROM region_name WHERE EXISTS (SELECT 1 FROM nation_region WHERE a = 'N1' AND b = 'R1')"),
    "diagonal": ("same_key", "same(X) :- same_key(X, X).", "same(X)", "SELECT DISTINCT a AS X FROM same_key WHERE a = b"),
    "dup_head": ("region_name", "twice(X, X) :- region_name(_, X).", "twice(A, B)", "SELECT DISTINCT b AS A, b AS B FROM region_name"),
    "head_const": ("placed", 'tag(C, "buyer") :- placed(C, _).', "tag(C, T)", "SELECT DISTINCT a AS C, 'buyer' AS T FROM placed"),
    "unary_scan": ("first_turn", "opens(T) :- first_turn(T).", "opens(T)", "SELECT DISTINCT a AS T FROM first_turn"),
    "cmp_num": ("part_size", "large(P, Z) :- part_size(P, Z), Z >= 40.", "large(P, Z)", f"SELECT a AS P, b AS Z FROM part_size WHERE {_compare_sql('b', '>=', chr(39) + '40' + chr(39))}"),
    "cmp_range": ("part_size", "mid(P) :- part_size(P, Z), Z > 9, Z < 20.", "mid(P)", f"SELECT DISTINCT a AS P FROM part_size WHERE {_compare_sql('b', '>', chr(39) + '9' + chr(39))} AND {_compare_sql('b', '<', chr(39) + '20' + chr(39))}"),
    "cmp_str": ("nation_name", 'early(M) :- nation_name(_, M), M < "NATION_15".', "early(M)", "SELECT DISTINCT b AS M FROM nation_name WHERE b < 'NATION_15'"),
    "cmp_eq": ("cust_segment", 'auto(C) :- cust_segment(C, S), S = "AUTOMOBILE".', "auto(C)", "SELECT DISTINCT a AS C FROM cust_segment WHERE b = 'AUTOMOBILE'"),
    "cmp_neq": ("cust_segment", 'other(C, S) :- cust_segment(C, S), S != "BUILDING".', "other(C, S)", "SELECT a AS C, b AS S FROM cust_segment WHERE b <> 'BUILDING'"),
    "cmp_le_vars": ("same_key", "low(X, Y) :- same_key(X, Y), X <= Y.", "low(X, Y)", f"SELECT a AS X, b AS Y FROM same_key WHERE {_compare_sql('a', '<=', 'b')}"),
    "join2": ("cust_nation nation_region", "lives(C, R) :- cust_nation(C, N), nation_region(N, R).", "lives(C, R)", "SELECT DISTINCT c.a AS C, n.b AS R FROM cust_nation c JOIN nation_region n ON c.b = n.a"),
    "join_right": ("supp_nation nation_region", "meets(S, T) :- nation_region(S, R), nation_region(T, R).", "meets(S, T)", "SELECT DISTINCT x.a AS S, y.a AS T FROM nation_region x JOIN nation_region y ON x.b = y.b"),
    "self_join": ("supp_nation", "pair(A, B) :- supp_nation(A, N), supp_nation(B, N), A < B.", "pair(A, B)", f"SELECT DISTINCT x.a AS A, y.a AS B FROM supp_nation x JOIN supp_nation y ON x.b = y.b WHERE {_compare_sql('x.a', '<', 'y.a')}"),
    "join_const": ("cust_nation nation_region", 'asian(C) :- cust_nation(C, N), nation_region(N, "R2").', "asian(C)", "SELECT DISTINCT c.a AS C FROM cust_nation c JOIN nation_region n ON c.b = n.a WHERE n.b = 'R2'"),
    "join_multi": ("supplied returned", "sent_back(S, P) :- supplied(S, P), returned(S, P).", "sent_back(S, P)", "SELECT a AS S, b AS P FROM supplied INTERSECT SELECT a, b FROM returned"),
    "join_unary": ("first_turn turn_role", "opener(T, R) :- first_turn(T), turn_role(T, R).", "opener(T, R)", "SELECT DISTINCT t.a AS T, t.b AS R FROM first_turn f JOIN turn_role t ON f.a = t.a"),
    "join3": ("cust_segment placed order_part", 'bought(S, P) :- cust_segment(C, S), placed(C, O), order_part(O, P).', "bought(S, P)", "SELECT DISTINCT c.b AS S, l.b AS P FROM cust_segment c JOIN placed p ON c.a = p.a JOIN order_part l ON p.b = l.a"),
    "cross": ("region_name cust_segment", "segment(S) :- cust_segment(_, S). grid(R, S) :- region_name(_, R), segment(S).", "grid(R, S)", "SELECT DISTINCT r.b AS R, s.b AS S FROM region_name r, (SELECT DISTINCT b FROM cust_segment) s"),
    "union_rules": ("cust_nation supp_nation", 'in_one(X) :- cust_nation(X, "N1"). in_one(X) :- supp_nation(X, "N1").', "in_one(X)", "SELECT a AS X FROM cust_nation WHERE b = 'N1' UNION SELECT a FROM supp_nation WHERE b = 'N1'"),
    "neg_basic": ("cust_nation placed order_status", 'pending(C) :- placed(C, O), order_status(O, "P"). idle(C) :- cust_nation(C, _), not pending(C).', "idle(C)", "SELECT DISTINCT a AS C FROM cust_nation WHERE a NOT IN (SELECT p.a FROM placed p JOIN order_status s ON p.b = s.a WHERE s.b = 'P')"),
    "neg_binary": ("supplied returned", "clean(S, P) :- supplied(S, P), not returned(S, P).", "clean(S, P)", "SELECT a AS S, b AS P FROM supplied EXCEPT SELECT a, b FROM returned"),
    "neg_const": ("cust_segment cust_nation", 'foreign(C, S) :- cust_segment(C, S), not cust_nation(C, "N3").', "foreign(C, S)", "SELECT a AS C, b AS S FROM cust_segment WHERE a NOT IN (SELECT a FROM cust_nation WHERE b = 'N3')"),
    "neg_multi": ("placed order_status order_priority", 'calm(O) :- placed(_, O), not order_status(O, "F"), not order_priority(O, "1-URGENT").', "calm(O)", "SELECT DISTINCT b AS O FROM placed WHERE b NOT IN (SELECT a FROM order_status WHERE b = 'F') AND b NOT IN (SELECT a FROM order_priority WHERE b = '1-URGENT')"),
    "neg_unknown": ("region_name", "kept(X) :- region_name(_, X), not nothing(X).", "kept(X)", "SELECT DISTINCT b AS X FROM region_name"),
    "join_neg_cmp": ("cust_nation cust_segment placed order_status", 'b(C) :- placed(C, O), order_status(O, "P"). odd(C, N) :- cust_nation(C, N), cust_segment(C, S), S != "BUILDING", not b(C).', "odd(C, N)", "SELECT DISTINCT c.a AS C, c.b AS N FROM cust_nation c JOIN cust_segment s ON c.a = s.a WHERE s.b <> 'BUILDING' AND c.a NOT IN (SELECT p.a FROM placed p JOIN order_status o ON p.b = o.a WHERE o.b = 'P')"),
    "tc_geo": ("cust_nation nation_region", "in(X, Y) :- cust_nation(X, Y). in(X, Y) :- nation_region(X, Y). located_in(X, Y) :- in(X, Y). located_in(X, Z) :- in(X, Y), located_in(Y, Z).", "located_in(X, Y)", ", e AS (SELECT * FROM cust_nation UNION SELECT * FROM nation_region), t AS (SELECT a, b FROM e UNION SELECT e.a, t.b FROM e JOIN t ON e.b = t.a) SELECT a AS X, b AS Y FROM t"),
    "tc_conv": ("next_turn", "after(X, Y) :- next_turn(X, Y). after(X, Z) :- next_turn(X, Y), after(Y, Z).", "after(X, Y)", ", t AS (SELECT a, b FROM next_turn UNION SELECT e.a, t.b FROM next_turn e JOIN t ON e.b = t.a) SELECT a AS X, b AS Y FROM t"),
    "tc_bound": ("cust_nation nation_region", "in(X, Y) :- cust_nation(X, Y). in(X, Y) :- nation_region(X, Y). located_in(X, Y) :- in(X, Y). located_in(X, Z) :- in(X, Y), located_in(Y, Z).", 'located_in(X, "R1")', ", e AS (SELECT * FROM cust_nation UNION SELECT * FROM nation_region), t AS (SELECT a FROM e WHERE b = 'R1' UNION SELECT e.a FROM e JOIN t ON e.b = t.a) SELECT a AS X FROM t"),
    "nonlinear": ("next_turn", "after(X, Y) :- next_turn(X, Y). after(X, Z) :- after(X, Y), after(Y, Z).", "after(X, Y)", ", t AS (SELECT a, b FROM next_turn UNION SELECT t.a, e.b FROM t JOIN next_turn e ON t.b = e.a) SELECT a AS X, b AS Y FROM t"),
    "mutual_rec": ("first_turn next_turn", "even(T) :- first_turn(T). odd(U) :- even(T), next_turn(T, U). even(U) :- odd(T), next_turn(T, U).", "odd(T)", ", t AS (SELECT a, 0 AS k FROM first_turn UNION SELECT e.b, 1 - t.k FROM t JOIN next_turn e ON t.a = e.a) SELECT DISTINCT a AS T FROM t WHERE k = 1"),
    "strata3": ("next_turn first_turn turn_role", 'after(X, Y) :- next_turn(X, Y). after(X, Z) :- next_turn(X, Y), after(Y, Z). reached(Y) :- first_turn(X), after(X, Y). lone(T) :- turn_role(T, _), not reached(T). kept(T, R) :- turn_role(T, R), not lone(T).', "kept(T, R)", ", t AS (SELECT b FROM first_turn f JOIN next_turn e ON f.a = e.a UNION SELECT e.b FROM t JOIN next_turn e ON t.b = e.a) SELECT a AS T, turn_role.b AS R FROM turn_role WHERE a IN (SELECT b FROM t)"),
    "base_and_derived": ("first_turn next_turn", "first_turn(U) :- first_turn(T), next_turn(T, U).", "first_turn(T)", ", t AS (SELECT a FROM first_turn UNION SELECT e.b FROM t JOIN next_turn e ON t.a = e.a) SELECT a AS T FROM t"),
    "ground_facts": ("nation_name", 'tracked("N1"). tracked("N2"). known(M) :- tracked(N), nation_name(N, M).', "known(M)", "SELECT DISTINCT b AS M FROM nation_name WHERE a IN ('N1', 'N2')"),
    "query_bound": ("nation_region", "p(N, R) :- nation_region(N, R).", 'p(N, "R1")', "SELECT DISTINCT a AS N FROM nation_region WHERE b = 'R1'"),
    "query_conj": ("cust_nation nation_region region_name", "p(N, R) :- nation_region(N, R).", 'p(N, R), region_name(R, M), R != "R0"', "SELECT DISTINCT n.a AS N, n.b AS R, r.b AS M FROM nation_region n JOIN region_name r ON n.b = r.a WHERE n.b <> 'R0'"),
    "query_first": ("placed", "p(C, O) :- placed(C, O).", 'p("C1", O)', "SELECT DISTINCT b AS O FROM placed WHERE a = 'C1'"),
    "query_not": ("cust_nation nation_region", "p(N, R) :- nation_region(N, R).", 'p(N, R), not cust_nation("C1", N), R != "R2"', "SELECT a AS N, b AS R FROM nation_region WHERE b <> 'R2' AND a NOT IN (SELECT b FROM cust_nation WHERE a = 'C1')"),
    "query_unknown": ("nation_region", "p(N, R) :- nation_region(N, R).", 'p(N, "none such")', "SELECT a AS N FROM nation_region WHERE false"),
    "query_undefined": ("nation_region", "p(N, R) :- nation_region(N, R).", "nothing(X)", "SELECT a AS X FROM nation_region WHERE false"),
    "query_wildcard": ("placed", "p(C, O) :- placed(C, O).", "p(C, _)", "SELECT DISTINCT a AS C FROM placed"),
    "query_repeated": ("same_key", "p(X, Y) :- same_key(X, Y).", "p(X, X)", "SELECT DISTINCT a AS X FROM same_key WHERE a = b"),
}


def tc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closure of each user's chain of events in order of time."""
    steps = _read(spark, sf_dir, "events").selectExpr("concat('E', event_id) a", "concat('E', lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id)) b")
    engine = Engine(spark).register("step", steps).load("later(X, Y) :- step(X, Y). later(X, Z) :- step(X, Y), later(Y, Z).")
    return engine.query("later(X, Y)")


def tc_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation linked in a ring, and the closure of the rings."""
    same = Window.partitionBy("conv_id")
    turn = lambda c: F.concat(F.lit("T"), "conv_id", F.lit("."), c)
    following = F.coalesce(F.lead("turn").over(same.orderBy("turn")), F.min("turn").over(same))
    ring = _read(spark, sf_dir, "conversations").filter("turn IS NOT NULL").select(turn(F.col("turn")).alias("a"), turn(following).alias("b"))
    engine = Engine(spark).register("linked", ring).load("same(X, Y) :- linked(X, Y). same(X, Z) :- linked(X, Y), same(Y, Z).")
    return engine.query("same(X, Y)")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as multi-way facts: customer, order, status, priority; suppliers and customers as located in a nation."""
    entity = lambda kind, value: F.struct(F.lit(kind).alias("type"), F.expr(value).alias("id"))
    orders = _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("long").alias("fact_id"),
        F.array(entity("customer", "concat('C', o_custkey)"), entity("order", "concat('O', o_orderkey)"), entity("status", "o_orderstatus"), entity("priority", "o_orderpriority")).alias("entities"),
        F.lit("orders").alias("source"),
    )
    located = lambda name, key, nation, letter, kind, base: _read(spark, sf_dir, name).select(
        (F.col(key).cast("long") + base).alias("fact_id"),
        F.array(entity("rel", "'located'"), entity(kind, f"concat('{letter}', {key})"), entity("nation", f"concat('N', {nation})")).alias("entities"),
        F.lit(name).alias("source"),
    )
    suppliers = located("supplier", "s_suppkey", "s_nationkey", "S", "supplier", 1 << 40)
    customers = located("customer", "c_custkey", "c_nationkey", "C", "customer", 2 << 40)
    return with_shape(orders.unionByName(suppliers).unionByName(customers))


_EDGES_SQL = """e AS (
  SELECT o_orderkey AS f, unnest(['customer', 'order', 'status', 'priority']) AS type,
    unnest([concat('C', o_custkey), concat('O', o_orderkey), o_orderstatus, o_orderpriority]) AS id FROM orders
  UNION ALL SELECT s_suppkey + 1099511627776, unnest(['rel', 'supplier', 'nation']), unnest(['located', concat('S', s_suppkey), concat('N', s_nationkey)]) FROM supplier
  UNION ALL SELECT c_custkey + 2199023255552, unnest(['rel', 'customer', 'nation']), unnest(['located', concat('C', c_custkey), concat('N', c_nationkey)]) FROM customer)"""


def map_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = '@map urgent(C, O) = [customer:C, order:O, status:S, priority:"1-URGENT"].'
    return Engine(spark, facts(spark, sf_dir)).load(source).query("urgent(C, O)")


def map_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = '@map at(X, N) = [rel:"located", supplier:X, nation:N]. @map at(X, N) = [rel:"located", customer:X, nation:N].'
    return Engine(spark, facts(spark, sf_dir)).load(source).query("at(X, N)")


def map_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping joined with a registered relation below a recursion."""
    engine = _engine(spark, sf_dir, "nation_region")
    engine.facts = facts(spark, sf_dir)
    engine.load('@map at(X, N) = [rel:"located", supplier:X, nation:N]. in(X, Y) :- at(X, Y). in(X, Y) :- nation_region(X, Y). within(X, Y) :- in(X, Y). within(X, Z) :- in(X, Y), within(Y, Z).')
    return engine.query("within(X, Y)")


def ingest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as JSON lines and read back: numeric ids where shipped, no JSON where pending."""
    line = """CASE o_orderstatus WHEN 'P' THEN 'no json'
      WHEN 'F' THEN concat('{"edges":[["order","O', o_orderkey, '"],["customer",', o_custkey, '],["status"]],"source":""}')
      ELSE concat('{"edges":[["order","O', o_orderkey, '","more"],["customer","C', o_custkey, '"]],"source":"', o_orderpriority, '"}') END"""
    found = parse_lines(_read(spark, sf_dir, "orders").select("o_orderkey", F.expr(line).alias("value")))
    listed = F.array_join(F.transform("entities", lambda e: F.concat_ws("=", e["type"], e["id"])), ",")
    return found.select("o_orderkey", "rejected", listed.alias("entities"), "source", "shape")


def ingest_odd_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with another root than an object, no valid edge, or a source that is no text: what is left of them as facts."""
    line = """CASE p_partkey % 6 WHEN 0 THEN '[1,2]' WHEN 1 THEN 'null' WHEN 2 THEN '{"edges":[["a",5],["b"]]}' WHEN 3 THEN '{"edges":"no","source":"x"}'
      WHEN 4 THEN concat('{"source":7,"edges":[["part","P', p_partkey, '"]]}') ELSE concat('{"source":"s","edges":[["part","P', p_partkey, '"],[[]]]}') END"""
    found = parse_lines(_read(spark, sf_dir, "part").select("p_partkey", F.expr(line).alias("value"))).filter(F.size("entities") > 0)
    return found.select("p_partkey", F.col("entities")[0]["id"].alias("id"), F.size("entities").alias("n"), "source")


def ground_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many answers questions without variables have: one if they hold, else none."""
    engine = _engine(spark, sf_dir, "nation_region", "first_turn").load("p(N, R) :- nation_region(N, R).")
    asked = ['p("N1", "R1")', 'p("N1", "R3")', 'p("N1", "R1"), not p("N2", "R2")', 'first_turn("T1.0")', 'first_turn("T1.1")', 'nothing("x")']
    counts = [engine.query(q).agg(F.count("*").alias("answers")).select(F.lit(q).alias("asked"), "answers") for q in asked]
    return reduce(DataFrame.unionByName, counts)


def included_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program of two files, each of which includes the other."""
    with tempfile.TemporaryDirectory() as folder:
        with open(f"{folder}/top.dl", "w") as top, open(f"{folder}/part.dl", "w") as part:
            top.write('@include "part.dl". lives(C, R) :- cust_nation(C, N), lies(N, R).')
            part.write('@include "top.dl". lies(N, M) :- nation_region(N, R), region_name(R, M).')
        return _engine(spark, sf_dir, "cust_nation", "nation_region", "region_name").load_file(f"{folder}/top.dl").query("lives(C, R)")


def _store(spark: SparkSession, sf_dir: str) -> FactStore:
    """A new store with the orders read from JSON lines, the suppliers added as a DataFrame, and one fact."""
    folder = f"{shared_dir(spark)}/store_{uuid.uuid4().hex}"
    line = F.expr("""concat('{"edges":[["order","O', o_orderkey, '"],["customer","C', o_custkey, '"],["status","', o_orderstatus, '"]],"source":"orders"}')""")
    _read(spark, sf_dir, "orders").select(line.alias("value")).write.text(f"{folder}_lines")
    store = FactStore(spark, folder)
    store.ingest(f"{folder}_lines")
    store.add_facts(facts(spark, sf_dir).filter("source = 'supplier'").withColumn("source", F.lit("")))
    store.add_fact([("note", "last"), ("customer", "C1")], "by hand")
    return store


_listed = lambda: F.array_join(F.transform("entities", lambda e: F.concat_ws("=", e["type"], e["id"])), ",")


def store_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts of a store, and whether their ids are those from 1 on."""
    store = _store(spark, sf_dir)
    found = store.facts
    last = found.agg(F.max("fact_id").alias("last"), F.count_distinct("fact_id").alias("ids"), F.min("fact_id").alias("first"))
    return found.crossJoin(F.broadcast(last)).select(_listed().alias("entities"), "source", ((F.col("last") == F.col("ids")) & (F.col("first") == 1)).alias("consecutive"))


def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts with an entity, by the ids that a store's sorted edges have for it."""
    store = _store(spark, sf_dir)
    return store.facts.join(store.facts_of("customer", "C1"), "fact_id", "left_semi").select(_listed().alias("entities"), "source")


def store_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact of the largest id: what was added last."""
    store = _store(spark, sf_dir)
    return store.fact(store.facts.agg(F.max("fact_id")).head()[0]).select(_listed().alias("entities"), "source")


def store_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return get(_store(spark, sf_dir).edges, "customer/C1/status/O/order")


def store_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping whose shape reaches the scan of a store's facts."""
    source = '@map open(C, O) = [order:O, customer:C, status:"O"]. busy(C) :- open(C, O), open(C, P), O != P.'
    return Engine(spark, _store(spark, sf_dir).facts).load(source).query("busy(C)")


def rejected_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers of the lines of a file that are no JSON. (One small file, so that the numbers are known.)"""
    folder = f"{shared_dir(spark)}/lines_{uuid.uuid4().hex}"
    line = F.expr("CASE n_nationkey % 4 WHEN 0 THEN concat('broken ', n_name) WHEN 1 THEN '' ELSE '{}' END")
    _read(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey").select(line.alias("value")).write.text(folder)
    return rejected_lines(spark, folder).select("line", "value")


def browse_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_types(edges_of(facts(spark, sf_dir)))


def browse_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities_of(edges_of(facts(spark, sf_dir)), "nation")


def facts_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching_facts(edges_of(facts(spark, sf_dir)), [("status", "P")])


def cooccur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurring(edges_of(facts(spark, sf_dir)), [("nation", "N1")])


def cooccur_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurring(edges_of(facts(spark, sf_dir)), [("status", "O"), ("priority", "2-HIGH")])


def cooccur_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurring(edges_of(facts(spark, sf_dir)), [("status", "O"), ("priority", "2-HIGH")], "customer").select("id")


def typed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys and rounded balances through their typed keys and back, with the order of the keys' bytes."""
    rows = _read(spark, sf_dir, "supplier").select("s_suppkey", F.floor("s_acctbal").cast("long").alias("balance"), "s_name")
    key, name = encode_key(F.lit("balance"), F.col("balance"), "i64"), encode_key(F.lit("name"), F.col("s_name"), "string")
    rows = rows.withColumn("key", key).withColumn("name_key", name)
    return rows.select("s_suppkey", key_type(F.col("key")).alias("kind"), decode_key(F.col("key"), "i64").alias("balance"), decode_key(F.col("name_key"), "string").alias("name"), (sort_part(F.col("key")) < sort_part(encode_key(F.lit("x"), F.lit(0), "i64"))).alias("negative"))


def compare_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six comparisons between a part's size and its key as texts."""
    rows = _read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("x"), F.col("p_size").cast("string").alias("y"))
    names = {"=": "eq", "!=": "ne", "<": "lt", ">": "gt", "<=": "le", ">=": "ge"}
    return rows.select("x", "y", *[compare(F.col("x"), op, F.col("y")).alias(n) for op, n in names.items()])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _program(relations, rules, query) for name, (relations, rules, query, _) in _PROGRAMS.items()},
    "tc_events": tc_events,
    "tc_cycle": tc_cycle,
    "map_scan": map_scan,
    "map_union": map_union,
    "map_rules": map_rules,
    "ingest_lines": ingest_lines,
    "ingest_odd_lines": ingest_odd_lines,
    "rejected_numbered": rejected_numbered,
    "ground_answers": ground_answers,
    "included_rules": included_rules,
    "store_facts": store_facts,
    "store_lookup": store_lookup,
    "store_fact": store_fact,
    "store_path": store_path,
    "store_rules": store_rules,
    "browse_types": browse_types,
    "browse_list": browse_list,
    "facts_by_entity": facts_by_entity,
    "cooccur": cooccur,
    "cooccur_intersect": cooccur_intersect,
    "cooccur_project": cooccur_project,
    "typed_keys": typed_keys,
    "compare_pairs": compare_pairs,
}

_ORDER_SQL = "concat('order=O', o_orderkey, ',customer=C', o_custkey, ',status=', o_orderstatus)"

ORACLE_SQL: dict[str, str] = {
    **{name: _sql(relations, sql) for name, (relations, _, _, sql) in _PROGRAMS.items()},
    "tc_events": "WITH RECURSIVE s AS (SELECT event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), e AS (SELECT concat('E', a) AS a, concat('E', b) AS b FROM s WHERE b IS NOT NULL), t AS (SELECT a, b FROM e UNION SELECT e.a, t.b FROM e JOIN t ON e.b = t.a) SELECT a AS X, b AS Y FROM t",
    "tc_cycle": "SELECT concat('T', x.conv_id, '.', x.turn) AS X, concat('T', y.conv_id, '.', y.turn) AS Y FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id WHERE x.turn IS NOT NULL AND y.turn IS NOT NULL GROUP BY ALL",
    "map_scan": "SELECT concat('C', o_custkey) AS C, concat('O', o_orderkey) AS O FROM orders WHERE o_orderpriority = '1-URGENT'",
    "map_union": "SELECT concat('S', s_suppkey) AS X, concat('N', s_nationkey) AS N FROM supplier UNION SELECT concat('C', c_custkey), concat('N', c_nationkey) FROM customer",
    "map_rules": "WITH RECURSIVE e AS (SELECT concat('S', s_suppkey) AS a, concat('N', s_nationkey) AS b FROM supplier UNION SELECT concat('N', n_nationkey), concat('R', n_regionkey) FROM nation), t AS (SELECT a, b FROM e UNION SELECT e.a, t.b FROM e JOIN t ON e.b = t.a) SELECT a AS X, b AS Y FROM t",
    "ingest_lines": "SELECT o_orderkey, o_orderstatus = 'P' AS rejected, CASE o_orderstatus WHEN 'F' THEN concat('order=O', o_orderkey) WHEN 'O' THEN concat('order=O', o_orderkey, ',customer=C', o_custkey) END AS entities, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS source, CASE o_orderstatus WHEN 'F' THEN concat('order', chr(1)) WHEN 'O' THEN concat('order', chr(1), 'customer', chr(1)) END AS shape FROM orders",
    "ingest_odd_lines": "SELECT p_partkey, concat('P', p_partkey) AS id, 1 AS n, CASE WHEN p_partkey % 6 = 5 THEN 's' END AS source FROM part WHERE p_partkey % 6 IN (4, 5)",
    "rejected_numbered": "SELECT line, value FROM (SELECT row_number() OVER (ORDER BY n_nationkey) AS line, concat('broken ', n_name) AS value, n_nationkey % 4 = 0 AS bad FROM nation) WHERE bad",
    "ground_answers": """WITH p AS (SELECT concat('N', n_nationkey) AS n, concat('R', n_regionkey) AS r FROM nation), f AS (SELECT concat('T', conv_id, '.', turn) AS t FROM conversations WHERE turn = 0),
      q AS (SELECT 'p("N1", "R1")' AS asked, EXISTS (SELECT 1 FROM p WHERE n = 'N1' AND r = 'R1') AS holds
      UNION ALL SELECT 'p("N1", "R3")', EXISTS (SELECT 1 FROM p WHERE n = 'N1' AND r = 'R3')
      UNION ALL SELECT 'p("N1", "R1"), not p("N2", "R2")', EXISTS (SELECT 1 FROM p WHERE n = 'N1' AND r = 'R1') AND NOT EXISTS (SELECT 1 FROM p WHERE n = 'N2' AND r = 'R2')
      UNION ALL SELECT 'first_turn("T1.0")', EXISTS (SELECT 1 FROM f WHERE t = 'T1.0') UNION ALL SELECT 'first_turn("T1.1")', EXISTS (SELECT 1 FROM f WHERE t = 'T1.1') UNION ALL SELECT 'nothing("x")', false)
      SELECT asked, CAST(holds AS BIGINT) AS answers FROM q""",
    "included_rules": "SELECT DISTINCT concat('C', c_custkey) AS C, r_name AS R FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "store_facts": f"SELECT {_ORDER_SQL} AS entities, 'orders' AS source, true AS consecutive FROM orders UNION ALL SELECT concat('rel=located,supplier=S', s_suppkey, ',nation=N', s_nationkey), NULL, true FROM supplier UNION ALL SELECT 'note=last,customer=C1', 'by hand', true",
    "store_lookup": f"SELECT {_ORDER_SQL} AS entities, 'orders' AS source FROM orders WHERE o_custkey = 1 UNION ALL SELECT 'note=last,customer=C1', 'by hand'",
    "store_fact": "SELECT 'note=last,customer=C1' AS entities, 'by hand' AS source",
    "store_path": "SELECT DISTINCT concat('O', o_orderkey) AS id FROM orders WHERE o_custkey = 1 AND o_orderstatus = 'O'",
    "store_rules": "SELECT concat('C', o_custkey) AS C FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey HAVING count(DISTINCT o_orderkey) > 1",
    "browse_types": f"WITH {_EDGES_SQL} SELECT type, count(DISTINCT id) AS entities FROM e GROUP BY type",
    "browse_list": f"WITH {_EDGES_SQL} SELECT DISTINCT id FROM e WHERE type = 'nation'",
    "facts_by_entity": f"WITH {_EDGES_SQL} SELECT DISTINCT f AS fact_id FROM e WHERE type = 'status' AND id = 'P'",
    "cooccur": f"WITH {_EDGES_SQL} SELECT DISTINCT type, id FROM e WHERE f IN (SELECT f FROM e WHERE type = 'nation' AND id = 'N1') AND NOT (type = 'nation' AND id = 'N1')",
    "cooccur_intersect": f"WITH {_EDGES_SQL} SELECT DISTINCT type, id FROM e WHERE f IN (SELECT f FROM e WHERE type = 'status' AND id = 'O') AND f IN (SELECT f FROM e WHERE type = 'priority' AND id = '2-HIGH') AND type NOT IN ('status', 'priority')",
    "cooccur_project": f"WITH {_EDGES_SQL} SELECT DISTINCT id FROM e WHERE f IN (SELECT f FROM e WHERE type = 'status' AND id = 'O') AND f IN (SELECT f FROM e WHERE type = 'priority' AND id = '2-HIGH') AND type = 'customer'",
    "typed_keys": "SELECT s_suppkey, 'balance' AS kind, CAST(floor(s_acctbal) AS BIGINT) AS balance, s_name AS name, floor(s_acctbal) < 0 AS negative FROM supplier",
    "compare_pairs": "SELECT CAST(p_partkey AS VARCHAR) AS x, CAST(p_size AS VARCHAR) AS y, p_partkey = p_size AS eq, p_partkey <> p_size AS ne, p_partkey < p_size AS lt, p_partkey > p_size AS gt, p_partkey <= p_size AS le, p_partkey >= p_size AS ge FROM part",
}
