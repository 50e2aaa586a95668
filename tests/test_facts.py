import os
import shutil

from factloom.cli import main
from factloom.engine import Engine
from factloom.operators.browse import get
from factloom.sources.facts import FactStore, read_json_lines, rejected_lines
from factloom.streaming.ingest import follow

LINES = [
    '{"edges":[["gauge","G1"],["river","Oder"],["level","-12"],["unit","cm"]],"source":"survey"}',
    '{"edges":[["gauge","G2"],["river","Oder"],["level","340"],["unit","cm"]],"source":""}',
    '{"edges":[["lock","Upper gate"],["river","Oder"],["river","Warta"]]}',
    '{"edges":[["gauge","G3"],["river","Warta"],["level","95"],["unit","inch"]],"source":"log 7"}',
    '{"edges":[["closed","2024"],["lock","Upper gate"]],"source":"log 7"}',
]
BAD = [
    "", "not json", "[1]", "null", '{"x":1}', '{"edges":"no"}', '{"edges":[]}', '{"edges":[["a",5]]}',
    '{"edges":[["a","b"],["c"],["d",5],["e","f","g"],"zz",[1,"x"]],"source":7}',
]
RULES = """
@map metric(G, L) = [gauge:G, river:R, level:L, unit:cm].
@map links(A, B) = [lock:K, river:A, river:B].
@map at(G, R) = [gauge:G, river:R, level:L, unit:U].
@map loop(A) = [lock:K, river:A, river:A].
@map pair(A, B) = [lock:A, gauge:B].
low(G) :- metric(G, L), L < 0.
next_to(G, H) :- at(G, A), links(A, B), at(H, B).
alone(G) :- at(G, R), not links(R, "Warta").
"""


def lines(folder, rows, name="f.jsonl"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(rows))
    return str(folder / name)


def test_malformed_lines(spark, tmp_path):
    path = lines(tmp_path, BAD)
    rows = read_json_lines(spark, path).collect()
    assert [([tuple(e) for e in r.entities], r.source) for r in rows] == [([("a", "b"), ("e", "f")], None)]
    assert [(r.line, r.value) for r in rejected_lines(spark, path).collect()] == [(2, "not json")]


def test_store(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "store"))
    assert store.facts.count() == 0 and get(store.edges).count() == 0
    assert store.ingest(lines(tmp_path, LINES)) == 5
    assert store.add_fact([("note", "dry summer"), ("river", "Oder")]) == 6
    assert [r.fact_id for r in store.facts_of("river", "Oder").collect()] == [1, 2, 3, 6]
    assert [r.source for r in store.facts.orderBy("fact_id").collect()] == ["survey", None, None, "log 7", "log 7", None]
    assert [tuple(e) for e in store.fact(5).head().entities] == [("closed", "2024"), ("lock", "Upper gate")] and store.fact(77).count() == 0
    rows = lambda path: [tuple(r) for r in get(store.edges, path).collect()]
    assert rows("") == [("closed", 1), ("gauge", 3), ("level", 3), ("lock", 1), ("note", 1), ("river", 2), ("unit", 2)]
    assert rows("gauge/") == rows("gauge") == [("G1",), ("G2",), ("G3",)]
    assert rows("lock/Upper gate") == [("closed", "2024"), ("river", "Oder"), ("river", "Warta")]
    assert rows("river/Oder/unit/cm") == [("gauge", "G1"), ("gauge", "G2"), ("level", "-12"), ("level", "340")]
    assert rows("river/Oder/note/") == [("dry summer",)] and rows("river/Nysa/unit/cm") == []

    engine = Engine(spark, store.facts).load(RULES)
    answer = lambda query: sorted(tuple(r) for r in engine.query(query).collect())
    assert answer("low(G)") == [("G1",)] and answer("alone(G)") == [("G3",)]
    assert answer("next_to(G, H)") == [("G1", "G3"), ("G2", "G3")]
    assert answer("loop(A)") == [] and answer("pair(A, B)") == []


def test_stream(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "store"))
    for k in range(2):
        lines(tmp_path / "in", LINES[2 * k : 2 * k + 2], f"{k}.jsonl")
        follow(spark, str(tmp_path / "in"), store, str(tmp_path / "check")).awaitTermination()
    assert sorted(r.fact_id for r in store.facts.collect()) == [1, 2, 3, 4]
    assert store.edges.filter("fact_id = 3").count() == 3


def test_batch_twice_is_stored_once(spark, tmp_path):
    """A batch that was cut off after its facts were written, or that comes again, ends up as one."""
    store = FactStore(spark, str(tmp_path / "store"))
    batch = read_json_lines(spark, lines(tmp_path, LINES))
    assert store.add_facts(batch, batch_id=0) == 5
    shutil.rmtree(tmp_path / "store/edges")
    for _ in range(2):
        assert store.add_facts(batch, batch_id=0) == 5
    assert store.add_facts(batch.limit(2), batch_id=1) == 2
    assert sorted(r.fact_id for r in store.facts.collect()) == [1, 2, 3, 4, 5, 6, 7]
    assert store.edges.count() == sum(len(r.entities) for r in store.facts.collect())


def test_rejected_lines_are_numbered(spark, tmp_path):
    path = lines(tmp_path, ['{"a":1}', "x y", "", '{"edges":[["t","i"]]}', "{"] + ["bad"] * 40)
    rows = rejected_lines(spark, path).collect()
    assert [(r.line, r.value) for r in rows] == [(2, "x y"), (5, "{"), *((k, "bad") for k in range(6, 46))]
    assert {os.path.basename(r.file) for r in rows} == {"f.jsonl"}


def test_cli(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    assert main(["ingest", lines(tmp_path, [*LINES, *["oops"] * 30])], spark) == 0
    assert main(["get", "lock/Upper gate"], spark) == 0
    (tmp_path / "p.dl").write_text(RULES + '?- next_to(G, "G3"), G != "G1". ?- links("x", "y"). ?- low("G1").')
    assert main(["datalog", "--profile", "p.dl"], spark) == 0
    text = capsys.readouterr()
    assert text.err.count("line ") == 30 and "line 35: not JSON" in text.err
    assert "Ingested 5 facts" in text.out and "  Warta\n2 facts" in text.out and "G = G2" in text.out and "(1 results)" in text.out and "(no results)" in text.out
    assert '?- next_to(G, "G3"), G != "G1".' in text.out and "8 relations" in text.out and "  true\n" in text.out
    (tmp_path / "bad.dl").write_text("p(X) :- q(X), not p(X).")
    assert main(["datalog", "bad.dl"], spark) == 1 and main(["datalog", "--profile"], spark) == 2
