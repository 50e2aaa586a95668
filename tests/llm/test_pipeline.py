import re
from collections import Counter

import corpus_pipeline
from factloom.llm import langid
from factloom.llm.queries import tokenizer_file


def test_pipeline(spark, tmp_path):
    """run() against a plain version: languages kept, largest copy, near copies by all pairs, words mixed, ids."""
    from tokenizers import Tokenizer

    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = spark.createDataFrame([(9000, "12 345 !!", None, None, None), (9001, None, "en", "src1", 0), (9002, "", "en", "src1", 0)], source.schema)
    source.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    docs = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()}
    scored = {r.doc_id: r for r in langid.predict_languages(source.unionByName(more)).collect()}
    kept = {i: r for i, r in docs.items() if scored[i].lang_pred != "und" and scored[i].score >= 0.5}
    assert len(kept) == 200
    largest = {r.text: i for i, r in sorted(kept.items())}
    kept = {i: r for i, r in kept.items() if largest[r.text] == i}

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets, root = {i: shingles(r.text) for i, r in kept.items()}, {i: i for i in kept}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    kept = {i: r for i, r in kept.items() if find(i) == i}

    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in found} <= kept.keys() and all(r.round_trip for r in found)
    tokenizer = Tokenizer.from_file(tokenizer_file())
    uses = Counter()
    for r in found:
        text = tokenizer.decode(r.ids, skip_special_tokens=False)
        assert len(text) == r.n_chars and tokenizer.encode(text, add_special_tokens=False).ids == r.ids
        own = kept[r.doc_id].text
        assert text == own or re.sub(r"\s+", " ", text).strip().split()[0] in own
        uses[r.doc_id] += len(text.split())
    size = {i: len(r.text.split()) for i, r in kept.items()}
    assert all(uses[i] <= 2 * n for i, n in size.items())
    assert abs(sum(uses.values()) - 1.5 * sum(size.values())) < 0.02 * sum(size.values())


def test_stages_on_edge_rows(spark):
    """Null ids and texts, repeats, ties, names that the operators use: defined results, other columns untouched."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, rep int, kept string"
    long = "Der Bach fließt ruhig durch das weite Tal und die alten Mühlen stehen still am Ufer. " * 3
    rows = [(1, long + "a", "de", "s"), (2, long + "b", "de", "s"), (2, long + "b", "de", "s"), (None, long + "c", "de", None), (None, long + "c", "de", None), (None, "solo", "de", "t"), (None, "solo", "de", "t"), (4, None, None, None), (5, "", None, None), (6, "123 !?", None, "s"), (None, None, None, None)]
    df = spark.createDataFrame([(*r, 7, "own", -7.0, 3, "k") for r in rows], schema)
    stages = dict(corpus_pipeline.STAGES)
    kept = lambda name, docs=df: sorted(((r.doc_id, r.text) for r in stages[name](spark, docs, "").collect()), key=repr)
    for name in ("language", "exact", "near"):
        out = stages[name](spark, df, "")
        assert out.columns == df.columns and out.dtypes == df.dtypes
        assert {tuple(r[4:]) for r in out.collect()} == {(7, "own", -7.0, 3, "k")}
    assert kept("near") == sorted([(1, long + "a"), (None, "solo"), (4, None), (5, ""), (6, "123 !?"), (None, None)], key=repr)
    assert kept("exact") == sorted([(1, long + "a"), (2, long + "b"), (None, long + "c"), (None, "solo"), (5, ""), (6, "123 !?")], key=repr)
    unlabelled = df.withColumn("lang", langid.F.lit(None).cast("string"))
    assert kept("language", unlabelled) == sorted([r[:2] for r in rows if r[1] and r[1] != "123 !?"], key=repr)
    mixed = stages["mix"](spark, df, "")
    assert mixed.columns == df.columns and {r.doc_id for r in mixed.collect()} <= {1, 2, 6, None}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), "").count() == 0
        assert name == "tokens" or stage(spark, df.limit(0), "").columns == df.columns
    assert sorted(r.n_tokens for r in stages["tokens"](spark, df, "").collect())[:3] == [0, 0, 0]
