"""Near duplicates against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import neardup
from plumbline.llm.links import components
from plumbline.llm.neardup import near_duplicates, one_of_each

SCHEMA = "doc_id bigint, text string, id string, root string, kept string"


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if len(words) >= width:
        return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
    return frozenset([tuple(words)] if words else [])


def brute(rows, width):
    """{id: (set sizes, component)} with rows of one id as one document."""
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            both = len(a & b)
            if both and 100 * both >= 80 * (len(a) + len(b) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in sets}


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for family in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(30, 120))]
        for _ in range(rng.randrange(1, 9)):
            out.append(" ".join(edited(base, rng.randrange(0, 5), rng)))
    # A chain: neighbours are similar, its ends are not.
    chain = [f"c{k}" for k in range(80)]
    for step in range(10):
        out.append(" ".join(chain))
        chain[step * 7 : step * 7 + 5] = [f"x{step}-{k}" for k in range(5)]
    # A large group of near copies, and one of exact ones.
    hot = [f"h{rng.randrange(300)}" for _ in range(100)]
    out += [" ".join(edited(hot, 1, rng)) for _ in range(60)] + [" ".join(hot)] * 50
    out += ["", None, " \t\n", "one", "ONE", "one two", "two one", "a\x0bb", "a b", "é È", "É è"]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("width", [1, 2, 5])
def test_components(spark, rows, width):
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA).repartition(4)
    found = near_duplicates(df, width=width).collect()
    expected = brute(rows, width)
    assert {r["doc_id"]: r["component_id"] for r in found} == expected
    assert {r["doc_id"]: r["n_shingles"] for r in found} == {i: len(shingles(t, width)) for i, t in rows}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_small_blocks_give_the_same(spark, rows, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 2)
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    found = near_duplicates(df, width=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute(rows, 2)


def test_repeated_and_missing_ids(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(7, text), (7, text), (3, text), (9, "other words here"), (9, text), (None, text), (5, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted(
        ((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()),
        key=str,
    )
    assert found == sorted(
        [(7, 3, False), (7, 3, False), (3, 3, True), (9, 3, False), (9, 3, False), (None, None, True), (5, 5, True)],
        key=str,
    )


def test_one_of_each_keeps_columns_and_clean_documents(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, "a"), (2, text + " more", "b"), (4, "its own", "c"), (4, "its own", "c"), (None, text, "d")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, id string")
    found = one_of_each(df)
    assert found.columns == df.columns
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [rows[0], rows[2]], key=str
    )


def test_one_of_each_tells_rows_of_one_id_apart(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [
        (1, "x y z", "a"), (1, text, "b"), (1, None, "c"), (1, None, "d"), (2, text + " more", "e"),
        (None, "of its own", "f"), (None, "of its own", "g"), (None, "", "h"), (5, "", "i"), (3, " ", "j"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, id string")
    found = sorted(map(tuple, one_of_each(df).drop("id").collect()), key=str)
    assert found == sorted(
        [(1, "x y z"), (1, text), (1, None), (None, "of its own"), (None, ""), (5, ""), (3, " ")], key=str
    )
    assert sorted(map(str, one_of_each(df.repartition(4)).collect())) == sorted(
        map(str, one_of_each(df.repartition(3, "id")).collect())
    )


def test_very_long_texts(spark):
    long = " ".join(f"word{k}" for k in range(1_000_000))
    rows = [(1, long), (2, long + " and more"), (3, "z" * 3_000_000), (4, "z" * 3_000_000 + " ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, width=2).collect()}
    assert found == {1: (999_999, 1), 2: (1_000_001, 1), 3: (1, 3), 4: (1, 3)}


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_duplicates(df).collect() == [] and one_of_each(df).collect() == []


def test_estimate_follows_similarity(spark):
    base = [f"w{k}" for k in range(2000)]
    rows = [(0, " ".join(base))] + [(k, " ".join(base[100 * k :])) for k in range(1, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    signed = neardup.signatures(df, "doc_id", "text", 1)
    first = signed.where("id = 0").select(F.col("low").alias("first"))
    pairs = signed.join(first).select(
        "id", neardup.estimate(neardup._unequal(F.col("low"), F.col("first"))).alias("e")
    )
    for r in pairs.collect():
        assert abs(r["e"] - (1 - r["id"] / 20)) < 0.15


def test_components_of_a_long_path(spark):
    ids = list(range(200))
    random.Random(1).shuffle(ids)
    edges = [*zip(ids, ids[1:]), (500, 501), (501, 500), (7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    found = {r["id"]: r["root"] for r in components(df).collect()}
    assert found == {**{i: 0 for i in range(200)}, 500: 500, 501: 500}


def test_large_classes_are_joined_by_broadcast(spark, rows, monkeypatch):
    monkeypatch.setattr(neardup, "LEAST_LARGE", 2)
    monkeypatch.setattr(neardup, "MOST_LARGE", 1_000_000)
    copies = rows + [(10_000 + k, rows[3][1]) for k in range(40)] + [(20_000, rows[3][1].upper())]
    df = spark.createDataFrame([(i, t) for i, t in copies], "doc_id bigint, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates(df, width=2).collect()}
    assert found == brute([(i, t) for i, t in copies], 2)
