"""Fingerprints, tokens, repeats, mixes, the language model and language ID against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from factloom.llm import bpe, fingerprint, katz, langid, mixing, repeats
from factloom.llm import text as T
from factloom.llm.queries import tokenizer_file

EDGE = [(None, "Hello wörld"), (1000001, None), (1000002, ""), (3, "x y z"), (3, "x y z"), (1000003, "  \n"), (1000004, "ab " * 60_000), (1000005, "!!!")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, size int").repartition(3)


def test_neighbours(spark):
    rng = random.Random(2)
    rows = [(i * 3 % 101, " ".join(rng.choice(["é", "bb", "ccc"]) for _ in range(rng.randint(0, 30)))) for i in range(100)] + [(500, None), (501, "x" * 70_000)]
    found = {r.doc_id: r for r in fingerprint.compare_neighbours(frame(spark, rows)).collect()}
    texts = {i: t or "" for i, t in rows}
    ids = sorted(texts, reverse=True)
    assert len(found) == len(rows)
    sketch = lambda t: fingerprint.sketch(fingerprint.pa.array([t]))[0]
    for k, i in enumerate(ids):
        following = texts[ids[(k + 1) % len(ids)]]
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + following[:half]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(texts[i]), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.packed(sketch(texts[i])), fingerprint.packed(sketch(edited)))
        assert (r.near_edited, r.near_next) == (fingerprint.likeness(sketch(texts[i]), sketch(edited)), fingerprint.likeness(sketch(texts[i]), sketch(following)))
    assert len(fingerprint.compare_neighbours(frame(spark, EDGE)).collect()) == len(EDGE)
    assert fingerprint.compare_neighbours(frame(spark, EDGE[:1])).head().near_next == 1.0
    assert fingerprint.compare_neighbours(frame(spark, EDGE).limit(0)).count() == 0


def test_sketch_estimates():
    words = [f"w{i}" for i in range(40_000)]
    whole, part = (fingerprint.sketch(fingerprint.pa.array([" ".join(w)]))[0] for w in (words, words[:4000]))
    assert fingerprint.containment(part, whole) == 1.0 and abs(fingerprint.likeness(part, whole) - 0.1) < 0.03
    parts = [fingerprint.sketch(fingerprint.pa.array([" ".join(w)]))[0] for w in (words[:20_004], words[20_000:])]
    assert (fingerprint.merge(*parts) == whole).all()
    assert (fingerprint.unpacked(fingerprint.packed(whole)) == whole).all()


def test_bpe(spark):
    from tokenizers import Tokenizer

    file = tokenizer_file()
    known, own = Tokenizer.from_file(file), bpe.Encoder(open(file, "rb").read())
    rng = random.Random(1)
    bits = ["a", "aa", " ", "  ", "\n", "\x1c", "\x85", " ", "é", "ß", "漢字", "😀", "'s", "'ll", "<|endoftext|>", "<|end", "1", "２", "_", "==", "Hello", "ing", "́", "\x00", "\r\n", "th"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        ids = known.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids, repr(text)
        assert own.decode(np.array(ids, dtype=int)) == known.decode(ids, skip_special_tokens=False)
    df = frame(spark, [*EDGE, (9, "a" * 30_000), (10, "<|endoftext|>x")])
    found = bpe.encode_documents(df, file)
    assert found.columns == [*df.columns, "ids", "decoded"]
    for r in found.collect():
        assert r.ids == known.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    packed = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.pack_ids(found).collect()}
    assert (10, 2, hashlib.sha256(np.array([50256, 87], "<u4").tobytes()).hexdigest()) in packed
    assert bpe.encode_documents(df.limit(0), file).count() == 0


@pytest.mark.parametrize(
    ("where", "name", "value"),
    [("pre_tokenizer", "add_prefix_space", True), ("pre_tokenizer", "type", "Whitespace"), ("model", "ignore_merges", True), ("model", "byte_fallback", True), (None, "normalizer", {"type": "NFC"}), ("added", "lstrip", True)],
)
def test_bpe_refuses_other_settings(where, name, value):
    import json

    definition = json.load(open(tokenizer_file()))
    (definition["added_tokens"][0] if where == "added" else definition[where] if where else definition)[name] = value
    with pytest.raises(ValueError, match=name):
        bpe.Encoder(json.dumps(definition).encode())
    definition = json.load(open(tokenizer_file()))
    del definition["model"]["vocab"][bpe.byte_letters()[200]]
    with pytest.raises(ValueError, match="200"):
        bpe.check_definition(definition)


def plain_repeats(rows, length):
    seen, out = Counter(), []
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raws:
        seen.update(b[s : s + length] for s in range(len(b) - length + 1))
    for i, b in raws:
        mark = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                mark[s : s + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        runs = sum(m and (k == 0 or not mark[k - 1]) for k, m in enumerate(mark))
        out.append((i, len(b), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [repeats.BLOCK, 3, 1])
def test_repeats(spark, block):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    base, rows = [noise(500) for _ in range(5)], []
    for k in range(50):
        own = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(500)] = rng.choice("xyz")
        a, z = sorted(rng.sample(range(500), 2))
        rows.append((k, noise(rng.randint(0, 80)) + "".join(own[a:z]) + noise(rng.randint(0, 80))))
    rows += [(100, None), (101, ""), (102, "a" * 700), (103, "ab" * 200), (104, base[0]), (105, base[0]), (105, base[0]), (106, base[1] * 2), (None, base[2]), (107, noise(199)), (108, rows[3][1])]
    assert sorted(map(tuple, repeats.remove_repeats(frame(spark, rows), block=block).collect()), key=repr) == plain_repeats(rows, 200)


def test_repeats_none(spark):
    assert repeats.remove_repeats(frame(spark, EDGE).limit(0)).count() == 0
    assert [r.n_removed for r in repeats.remove_repeats(frame(spark, [(1, "short")])).collect()] == [0]


def test_targets():
    assert mixing.targets([100, 100, 100]) == [200, 500 / 3, 250 / 3]
    assert mixing.targets([0, 10]) == [0, 15] and mixing.targets([]) == []


def test_permutation():
    for n in (1, 2, 3, 17, 1000):
        for key in (0, 7):
            out = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(out) == list(range(n))


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 400, 3000])), rng.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(300)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, block string")
    found = mixing.mix_sources(df, block=16, shards=9).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert found["size"].tolist() == [len((t or "").split()) for _, t, _ in rows] and (found.taken <= 2 * found["size"]).all()
    source = [s for _, _, s in rows]
    order = sorted({s for s in source if s is not None}) + [None]
    sizes = [int(found["size"][[x == s for x in source]].sum()) for s in order]
    for s, n, t in zip(order, sizes, mixing.targets(sizes), strict=True):
        mine = found[[x == s for x in source]]
        assert set(mine.source_size) == {n} and set(mine.target) == {t} and abs(mine.taken.sum() - t) <= 32
    again = mixing.mix_sources(df.repartition(5), block=16, shards=9).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert found.equals(again)
    mixed = mixing.mixed_documents(df, block=16, shards=9)
    assert mixed.columns == df.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
    assert all(words[i] == t for i, t in zip(found.doc_id, found.taken, strict=True))
    assert mixing.mix_sources(frame(spark, EDGE)).count() == len(EDGE)
    rows = [(i, "w " * (1 + 7 * i), f"s{i:02}") for i in range(40)]
    for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        assert abs(r.taken - r.target) <= 1 + r.size / 32 and r.taken <= 2 * r.size, "sources far below a block meet their targets"
    empty = frame(spark, EDGE).limit(0)
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def plain_discounts(counts):
    """Good-Turing shares d(1..5) of counts of counts, with half a count off where they are out of range."""
    n = Counter(counts)
    d = {}
    for r in range(1, 6):
        d[r] = (r - 0.5) / r
        if n[1] and n[r]:
            k = 6 * n[6] / n[1]
            if k < 1 and 0 < (x := ((r + 1) * n[r + 1] / n[r] / r - k) / (1 - k)) < 1:
                d[r] = x
    return lambda c: c * d.get(c, 1.0)


class PlainKatz:
    """Katz backoff over dictionaries, recursive per token."""

    def __init__(self, texts, order):
        self.seen, self.order = [defaultdict(Counter) for _ in range(order)], order
        for own in texts:
            for i, w in enumerate(own):
                for k in range(order):
                    if (h := self.context(own, i, k)) is not None:
                        self.seen[k][h][w] += 1
        self.take = [plain_discounts([c for after in s.values() for c in after.values()]) for s in self.seen]

    @staticmethod
    def context(own, i, k):
        """The k words before the i-th, the first of which follows an end; None where the text is too short for that."""
        if k == 0:
            return ()
        before = (None, *own[:i])
        return before[-k:] if len(before) >= k else None

    def p(self, w, h):
        k = len(h)
        if k and h not in self.seen[k]:
            return self.p(w, h[1:])
        after = self.seen[k].get(h, Counter())
        left = sum(c - self.take[k](c) for c in after.values())
        total = sum(after.values()) + (not any(c <= 5 for c in after.values()))
        if w in after:
            return self.take[k](after[w]) / total
        left += not any(c <= 5 for c in after.values())
        if not k:
            return left / total
        return left / total / (1 - sum(self.p(x, h[1:]) for x in after)) * self.p(w, h[1:])


def plain_katz(rows, order):
    tokens = lambda t: [*(re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")), None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    model = PlainKatz([tokens(t) for i, t in rows if not held(i)], order)
    one = model.seen[0][()]
    total, types = sum(one.values()), len(one)
    for k in range(order):  # every order sums to one over the words and the class of unseen ones
        for h in list(model.seen[k])[:12]:
            assert abs(sum(model.p(w, h) for w in [*one, "\0"]) - 1) < 1e-9
    out = []
    for i, t in rows:
        own = tokens(t)
        contexts = [next(h for k in range(order - 1, -1, -1) if (h := model.context(own, j, k)) is not None) for j in range(len(own))]
        base = sum(math.log10((one[w] + 1) / (total + types + 1)) for w in own)
        out.append((i, held(i), len(own), sum(one[w] > 0 for w in own), total, base, sum(math.log10(model.p(w, h)) for w, h in zip(own, contexts, strict=True))))
    return out


@pytest.mark.parametrize("options", [{}, {"order": 2}, {"block_bytes": 2500, "hot": 64, "bits": 2}, {"block_bytes": 9000, "bits": 2, "order": 4}])
def test_katz(spark, options):
    rng = random.Random(9)
    vocabulary = [f"w{int(rng.paretovariate(0.8))}" for _ in range(300)] + ["The", "É"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(300)] + [e for e in EDGE if e[0] != 1000004]
    rows += [(2000 + i, "one pair of words and then w%d more" % i) for i in range(60)]
    key = lambda r: (r[0] is None, r[0] or 0, *r[2:4], round(r[6], 6))
    found = sorted((tuple(r) for r in katz.score_documents(frame(spark, rows), **options).collect()), key=key)
    want = sorted(plain_katz(rows, options.get("order", katz.ORDER)), key=key)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in want], rtol=1e-9)


def test_word_hashes_have_no_structure():
    """Two words that every polynomial modulo a power of two maps to one value."""
    one, two = "a", "b"
    for _ in range(10):
        one, two = one + two, two + one
    column = katz.pa.array([one, two, "Ab\0", "ab", "abcdefgh", "abcdefgh\0"])
    hashes = np.concatenate([T.word_hashes(d, o)[0] for _, d, o in T.chunks(column)])
    assert len(np.unique(hashes)) == 6


def test_katz_without_rows(spark):
    assert katz.score_documents(frame(spark, EDGE).limit(0)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = katz.score_documents(frame(spark, [(held, "a b")])).head()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.score) == (True, 3, 0, 0, 0.0)


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = langid.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in held.doc_id]).all()
    assert (held.lang == held.lang_pred).mean() > 0.95 and found.score.between(0, 1).all()
    model = langid.train(docs)
    assert (model.weights == 0).mean() > 0.5
    edge = {r.doc_id: r for r in langid.identify(frame(spark, EDGE), model).collect()}
    assert {i for i, r in edge.items() if r.lang_pred == "und"} == {1000001, 1000002, 1000003, 1000005}
    assert edge[1000001].score == 0.0 and edge[3].lang_pred in model.languages
    nothing = langid.predict_languages(frame(spark, EDGE).withColumn("lang", langid.F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"} and langid.predict_languages(frame(spark, EDGE).limit(0)).count() == 0


def test_ftrl_and_temperature():
    rng = np.random.default_rng(0)
    rows = [(k % 2, np.array([k % 2, 5 + k % 3]), np.array([1.0, rng.normal()])) for k in range(400)]
    w = langid.fit_ftrl(rows, 2)
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0] and (w[100:] == 0).all()
    scores, labels = np.array([[4.0, 0.0]] * 10), np.array([0] * 7 + [1] * 3)
    t = langid.fit_temperature(scores, labels)
    assert abs(1 / (1 + math.exp(-4 / t)) - 0.7) < 0.03
