import random

import pytest
from pyspark.sql import functions as F

from factloom.engine import Engine
from factloom.functions.compare import compare
from factloom.functions.entity_key import decode_key, encode_key, key_type, sort_part, valid_key
from factloom.operators.fixpoint import NoFixpoint, closure, closure_of
from factloom.plans.analysis import ArityError
from factloom.sources.program import read_program

FOLDERS = """
inside("src", "root"). inside("doc", "root"). inside("core", "src"). inside("img", "doc"). inside("new", "img").
file("run.py", "core", 400). file("io.py", "core", 1200). file("logo", "img", 90). file("notes", "doc", 1200). file("key", "src", 8).
locked("img"). shared("notes"). shared("io.py").
level(A, B) :- inside(A, P), inside(B, P), A != B.
level(A, B) :- inside(A, P), level(P, Q), inside(B, Q).
outweighs(A, B) :- file(A, D, N), file(B, D, M), N > M.
private(F, D) :- file(F, D, _), not locked(D), not shared(F).
bare(D) :- inside(D, _), not holds(D).
holds(D) :- file(_, D, _).
twins(A, B) :- file(A, D, N), file(B, E, N), D != E, A < B.
"""
EDGES = 'edge("a", "b"). edge("b", "c"). edge("c", "d").'
CYCLE = 'e(a,b). e(b,c). e(c,a). t(X,Y) :- e(X,Y). t(X,Z) :- e(X,Y), t(Y,Z).'


def ask(spark, source, query):
    return sorted(tuple(r) for r in Engine(spark).load(source).query(query).collect())


@pytest.mark.parametrize(
    ("source", "query", "expected"),
    [
        (FOLDERS, 'level("core", X)', ["img"]),
        (FOLDERS, "level(X, doc)", ["src"]),
        (FOLDERS, "outweighs(F, _)", ["io.py"]),
        (FOLDERS, 'private(F, D), D != "core"', [("key", "src")]),
        (FOLDERS, "bare(D)", ["new"]),
        (FOLDERS, "twins(A, B)", [("io.py", "notes")]),
        (FOLDERS, 'file(F, D, N), N >= 90, N < "1200"', [("logo", "img", "90"), ("run.py", "core", "400")]),
        (FOLDERS, 'private(F, "core"), not locked("src")', ["run.py"]),
        (EDGES + "o(X) :- edge(X, _). i(X) :- edge(_, X).", "o(X)", ["a", "b", "c"]),
        (EDGES + "two(X, Z) :- edge(X, Y), edge(Y, Z).", "two(X, _)", ["a", "b"]),
        ('w(9). w("10"). w("10a"). w("07"). p(X) :- w(X), X < "10a".', "p(X)", ["07", "10"]),
        ('w("07"). q(X) :- w(X), X = 7. v(7). j(X) :- w(X), v(X).', "q(X)", ["07"]),
        ('w("07"). v(7). j(X) :- w(X), v(X).', "j(X)", []),
        ("c(red). c(blue).", 'c(X), X != "red"', ["blue"]),
        ("c(red).", "missing(X)", []),
        ("e(a,a). e(a,b).", "e(X, X)", ["a"]),
        ("e(a,b). e(b,a). e(a,c). m(A) :- e(A,B), e(B,A).", "m(A)", ["a", "b"]),
        ("q(a). q(b). p(X) :- q(X), not r(X).", "p(X)", ["a", "b"]),
        ('w(a,x). w(b,y). g(x,epic). n(A) :- w(A,B), not g(B,"epic").', "n(A)", ["b"]),
        ("a(1). b(2). p(X,Y) :- a(X), b(Y).", "p(_, Y)", ["2"]),
        ('p(X, "c") :- q(X). q(a).', "p(_, C)", ["c"]),
        ("e(a,b,c). p(X, Y, Z) :- e(X, Y, Z).", "p(X, b, c)", ["a"]),
    ],
)
def test_programs(spark, source, query, expected):
    assert ask(spark, source, query) == [x if isinstance(x, tuple) else (x,) for x in expected]


def test_cycle(spark):
    assert len(ask(spark, CYCLE, "t(X, Y)")) == 9


def test_closure_forms_agree(spark):
    chain = " ".join(f"e(n{i}, n{i + 1})." for i in range(9))
    forms = ["t(X,Y) :- e(X,Y). t(X,Z) :- e(X,Y), t(Y,Z).", "t(X,Y) :- e(X,Y). t(X,Z) :- t(X,Y), e(Y,Z).", "t(X,Y) :- e(X,Y). t(X,Z) :- t(X,Y), t(Y,Z).", "t(X,Y) :- e(X,Y), X != zzz. t(X,Z) :- e(X,Y), t(Y,Z)."]
    found = [ask(spark, chain + f, "t(X, Y)") for f in forms]
    assert len(found[0]) == 45 and all(f == found[0] for f in found)


def test_closure_is_recognised():
    found = lambda s, base=False: closure_of(read_program(s).rules, base)
    assert found("t(X,Y) :- e(X,Y). t(X,Z) :- e(X,Y), t(Y,Z).") == "e"
    assert found("t(X,Z) :- t(X,Y), e(Y,Z). t(X,Y) :- e(X,Y).") == "e"
    assert found("t(X,Y) :- e(X,Y). t(X,Z) :- t(Y,Z), t(X,Y).") == "e"
    for other in ("t(X,Y) :- e(Y,X). t(X,Z) :- e(X,Y), t(Y,Z).", "t(X,Y) :- e(X,Y). t(X,Z) :- e(Y,X), t(Y,Z).", 't(X,Y) :- e(X,Y). t(X,Z) :- e(X,Y), t(Y,Z), X != "a".', "t(X,Y) :- e(X,Y). t(X,Z) :- e(X,Y), e(Y,Z).", "t(X,Y) :- e(X,Y). t(X,Z) :- f(X,Y), t(Y,Z)."):
        assert found(other) is None, other
    assert found("t(X,Y) :- e(X,Y). t(X,Z) :- e(X,Y), t(Y,Z).", True) is None


@pytest.mark.parametrize("seed", range(3))
def test_closure_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = {(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(18)}
    expected = set(pairs)
    while more := {(a, d) for a, b in expected for c, d in pairs if b == c} - expected:
        expected |= more
    rows = closure(spark, spark.createDataFrame(sorted(pairs), "c0 string, c1 string")).collect()
    assert len(rows) == len(expected) and {tuple(r) for r in rows} == expected


def test_bound_closure_agrees(spark):
    source = "e(a,b). e(b,c). e(c,a). e(c,d). e(x,d). t(X,Y) :- e(X,Y). t(X,Z) :- e(X,Y), t(Y,Z)."
    whole = ask(spark, source, "t(X, Y)")
    assert ask(spark, source, "t(b, Y)") == [(y,) for x, y in whole if x == "b"]
    assert ask(spark, source, "t(X, d)") == [(x,) for x, y in whole if y == "d"]
    assert ask(spark, source, "t(d, Y)") == [] and Engine(spark).load(source).query("t(a, d)").count() == 1
    assert ask(spark, source, "t(a, Y), Y != a") == [("b",), ("c",), ("d",)]


def test_ground_query(spark):
    assert Engine(spark).load(EDGES).query('edge("a", "b")').count() == 1
    assert Engine(spark).load(EDGES).query('edge("a", "c")').count() == 0


def test_round_limit_and_arity(spark):
    with pytest.raises(NoFixpoint):
        Engine(spark, most_rounds=1).load(CYCLE).query("t(X, Y)").count()
    with pytest.raises(ArityError):
        Engine(spark).load("p(a).").query("p(X, Y)")


def test_register(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y")], "a int, b string")
    assert [tuple(r) for r in Engine(spark).register("p", rows).query("p(A, B)").collect()] == [("1", "x")]


def test_save_restore_and_views(spark, tmp_path):
    first = Engine(spark).load(CYCLE)
    first.save("t", str(tmp_path))
    second = Engine(spark).restore("t", str(tmp_path)).load("loop(X) :- t(X, X).")
    second.create_views("loop")
    assert sorted(r[0] for r in spark.sql("SELECT c0 FROM loop").collect()) == ["a", "b", "c"]


def test_typed_values(spark):
    entities = "fact_id bigint, entities array<struct<type:string,id:string>>, source string"
    facts = spark.createDataFrame([(1, [("author", "x"), ("book", "x")], None)], entities)
    source = "@map wrote(A, B) = [author:A, book:B]. same(A) :- wrote(A, A)."
    assert [tuple(r) for r in Engine(spark, facts, typed=True).load(source).query("wrote(A, B)").collect()] == [("author/x", "book/x")]
    assert Engine(spark, facts, typed=True).load(source).query("same(A)").count() == 0
    assert Engine(spark, facts).load(source).query("same(A)").count() == 1


def test_compare(spark):
    pairs = [("9", "10"), ("9", "10a"), ("07", "7"), ("3.14", "3"), ("+5", "5"), ("1_0", "10"), ("9223372036854775808", "9"), (" 7", "7"), ("-1", "1")]
    row = spark.createDataFrame(pairs, "x string, y string").select(compare(F.col("x"), "<", F.col("y")), compare(F.col("x"), "=", F.col("y"))).collect()
    assert [tuple(r) for r in row] == [(True, False), (False, False), (False, True), (False, False), (False, True), (False, True), (False, False), (True, False), (True, False)]


def test_entity_keys(spark):
    df = spark.range(1)
    for kind, values, sql in (("i64", [-(1 << 63), -5, 0, 7, (1 << 63) - 1], "bigint"), ("u16", [0, 255, 65535], "int"), ("u32", [0, 1 << 31, (1 << 32) - 1], "bigint"), ("u64", [0, 1 << 40, (1 << 64) - 1], "decimal(20,0)"), ("string", ["", "Zé", "a"], "string"), ("ipv4", [0, 167772161], "bigint")):
        keys = df.select(*[x for i, v in enumerate(values) for x in (encode_key(F.lit("t"), F.lit(str(v)).cast(sql), kind).alias(f"k{i}"),)])
        row = keys.select(*keys.columns, *[decode_key(F.col(c), kind).alias(f"d{c}") for c in keys.columns], *[key_type(F.col(c)).alias(f"t{c}") for c in keys.columns], *[sort_part(F.col(c)).alias(f"s{c}") for c in keys.columns]).head()
        assert [row[f"dk{i}"] for i in range(len(values))] == values
        assert {row[f"tk{i}"] for i in range(len(values))} == {"t"}
        parts = [bytes(row[f"sk{i}"]) for i in range(len(values))]
        assert parts == sorted(parts)
    assert not df.select(valid_key(F.lit(b"t\x00\x02\x01"))).head()[0]
    with pytest.raises(Exception, match="invalid"):
        df.select(encode_key(F.lit("a\0b"), F.lit("x"), "string")).collect()


@pytest.mark.parametrize(
    "body",
    ["r(A, N), r(B, N), A < B", "r(A, N), s(B, N)", "s(A, N), r(B, N), A != B", "w(A, N, X), w(B, N, Y), X > Y", "w(A, N, _), w(B, N, _), A <= B", "r(A, N), s(B, N), A != 7"],
)
def test_pairs_are_made_once(spark, monkeypatch, body):
    """Pairs of a group, large for its blocks, are neither lost nor repeated; none that one N makes is shuffled to be made distinct."""
    monkeypatch.setattr("factloom.operators.pairs.BLOCK", 3)
    rng = random.Random(body)
    r = {(str(a), f"n{a % 3}") for a in range(40)}
    s = r | {(str(rng.randrange(40)), f"n{rng.randrange(4)}") for _ in range(30)}
    w = {(a, n, str(rng.randrange(12))) for a, n in s for _ in range(2)}
    engine = Engine(spark)
    for name, rows in (("r", r), ("s", s), ("w", w)):
        engine.register(name, spark.createDataFrame(sorted(rows) * 2, ", ".join(f"c{i} string" for i in range(len(min(rows))))))
    found = engine.load(f"p(A, B) :- {body}.").query("p(A, B)")
    names = {"r": r, "s": s, "w": w}
    left, right = (names[part[0]] for part in (body, body[body.index("), ") + 3 :]))
    test = {"A < B": lambda x, y: int(x[0]) < int(y[0]), "A != B": lambda x, y: x[0] != y[0], "X > Y": lambda x, y: int(x[2]) > int(y[2]), "A <= B": lambda x, y: int(x[0]) <= int(y[0]), "A != 7": lambda x, y: x[0] != "7"}.get(body.rsplit("), ", 1)[1], lambda x, y: True)
    expected = {(x[0], y[0]) for x in left for y in right if x[1] == y[1] and test(x, y)}
    rows = [tuple(row) for row in found.collect()]
    assert len(rows) == len(expected) and set(rows) == expected
    if body.startswith("r"):
        assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_closure_of_paths_writes_no_pairs(spark, monkeypatch):
    """Rows that a closure of long paths writes are a few for each node, not one for each pair; its pairs are not made distinct."""
    import factloom.operators.fixpoint as module

    written, write, table = [], module.write, module.table

    def counted(kept):
        def run(rows):
            out = kept(rows)
            written.append((spark.read.parquet(out) if isinstance(out, str) else out).count())
            return out

        return run

    monkeypatch.setattr(module, "write", counted(write))
    monkeypatch.setattr(module, "table", counted(table))
    steps = spark.createDataFrame([(f"{c}.{i}", f"{c}.{i + 1}") for c in "ab" for i in range(150)], "a string, b string")
    found = Engine(spark).register("e", steps).load("t(X,Y) :- e(X,Y). t(X,Z) :- e(X,Y), t(Y,Z).").query("t(X, Y)")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {(f"{c}.{i}", f"{c}.{j}") for c in "ab" for j in range(151) for i in range(j)}
    assert found.count() == 2 * 150 * 151 // 2 > 2 * sum(written) and "Aggregate" not in plan


@pytest.mark.parametrize("block", [2_000, 3])
def test_closure_of_paths_rings_and_branches(spark, monkeypatch, block):
    monkeypatch.setattr("factloom.operators.pairs.BLOCK", block)
    chain = {(f"n{i}", f"n{i + 1}") for i in range(11)}
    rings = {(f"r{n}.{i}", f"r{n}.{(i + 1) % n}") for n in (1, 2, 5) for i in range(n)}
    ends = {("n11", "x"), ("n11", "y"), ("x", "z"), ("y", "z"), ("z", "n30"), ("n30", "n31"), ("q", "n5"), ("n31", "n6")}
    pairs = chain | rings | ends
    expected = set(pairs)
    while more := {(a, d) for a, b in expected for c, d in pairs if b == c} - expected:
        expected |= more
    rows = closure(spark, spark.createDataFrame(sorted(pairs), "c0 string, c1 string")).collect()
    assert len(rows) == len(expected) and {tuple(r) for r in rows} == expected
