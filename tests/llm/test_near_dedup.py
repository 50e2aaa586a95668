import random
import re

import pytest

from factloom.llm import near_dedup


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    component = {i: i for i, _ in rows}

    def root(i):
        while component[i] != i:
            i = component[i]
        return i

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(i), root(j)))
                component[y] = x
    return sorted((i, len(s), root(i) if s else i, root(i) == i or not s) for (i, _), s in zip(rows, sets, strict=True))


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.choice([1, 2, 3, 8, 40, 120]))]
        for _ in range(rng.randint(1, 8)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = word()
            rows.append((n, rng.choice([" ", "\n", "  "]).join(own).upper() if rng.random() < 0.3 else " ".join(own)))
            n += 1
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "A b"), (n + 4, "a B")]


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 3, 85), (2, 5, 80)])
def test_against_all_pairs(spark, seed, width, percent):
    rows = made(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, rep string, token int")
    found = near_dedup.near_duplicates(df, width, percent)
    assert sorted(map(tuple, found.collect())) == brute(rows, width, percent)


@pytest.mark.parametrize("apart", [4, 60])
def test_small_blocks(spark, monkeypatch, apart):
    """Lists and groups that are dealt out in blocks give the same components, be they near one text or chains of several."""
    rng = random.Random(5)
    bases = [[f"w{k}" for k in range(150)]]
    for _ in range(5):  # each base shares about three quarters of its shingles with the one before
        bases.append([f"y{rng.randrange(10**6)}" if k % 25 == 0 else w for k, w in enumerate(bases[-1])])
    rows = []
    for i in range(120):
        own = list(bases[i % 6 if i < apart else 0])
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(150)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "SETS_BLOCK", 16)
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert sorted(map(tuple, found.collect())) == brute(rows, 3, 85)


def test_edge_rows(spark):
    schema = "doc_id long, text string"
    assert near_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    one, two = "a", "b"  # words that all polynomial hashes modulo a power of two take for equal
    for _ in range(10):
        one, two = one + two, two + one
    found = near_dedup.near_duplicates(spark.createDataFrame([(1, one), (2, two)], schema), 3, 85)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1, True), (2, 1, 2, True)]
    found = near_dedup.near_duplicates(spark.createDataFrame([(4, "a b c"), (4, "d e f"), (5, "d e f"), (6, "a b c")], schema), 3, 85)
    assert {r.component_id for r in found.collect()} == {4}
    rows = [(None, "a b c"), (7, "a b c"), (7, "a b c"), (3, "long " * 50_000)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, schema), 3, 85)
    assert sorted(map(tuple, found.collect()), key=repr) == [(3, 1, 3, True), (7, 1, 7, True), (7, 1, 7, True), (None, 1, 7, False)]
