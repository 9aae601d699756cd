"""Line quality, periodic runs and ranked search against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import crf
from plumbline.llm.queries import QUERIES
from plumbline.llm.ranking import ranked, term_counts
from plumbline.llm.runs import looped, periodic_runs, runs_of

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


# Periodic runs


def brute_runs(s, exponent=4, shortest=6):
    found = {}
    for q in range(1, len(s) // exponent + 1):
        x = 0
        while x + q < len(s):
            if s[x] != s[x + q]:
                x += 1
                continue
            start = x
            while x + q < len(s) and s[x] == s[x + q]:
                x += 1
            length = x - start + q
            if length >= max(shortest, exponent * q):
                found.setdefault((start, length), q)
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_and_looped_sequences():
    pick = random.Random(5)
    for _ in range(150):
        sequences = []
        for _ in range(pick.randint(0, 6)):
            n, kinds = pick.choice([0, 1, 5, 40, 150]), pick.choice([1, 2, 3, 9])
            s = [pick.randrange(kinds) for _ in range(n)]
            if n > 10 and pick.random() < 0.7:
                a = pick.randrange(n)
                p = 1 + (n - a) // pick.randint(2, 9)
                s = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)]
            sequences.append(np.array(s, np.int64))
        exponent, shortest = pick.choice([2, 3, 4]), pick.choice([1, 6])
        found = runs_of(sequences, exponent, shortest)
        assert [[tuple(r) for r in f.tolist()] for f in found] == [
            brute_runs(s.tolist(), exponent, shortest) for s in sequences
        ]


def test_runs_of_a_fibonacci_word():
    s, before = [0], [1]
    while len(s) < 800:
        s, before = s + before, s
    assert [tuple(r) for r in runs_of([np.array(s)], 2, 1)[0].tolist()] == brute_runs(s, 2, 1)


def brute_op13(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    listed = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        doc_id, len(runs), start, length, period,
        None if length is None else 1000 * length // period,
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest(),
    )


def test_op13_query(spark, docs):
    found = sorted(tuple(r) for r in QUERIES["op13_periodic_runs"](spark, FOLDER).collect())
    assert found == sorted(brute_op13(r["doc_id"], r["text"]) for r in docs.collect())
    assert any(r[1] for r in found)


def test_runs_of_odd_rows(spark):
    loop = "a b " * 6
    rows = [(1, None), (2, ""), (3, " \n"), (None, loop), (5, loop), (5, loop), (6, "x " * 9 + "y")]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumns(
        {c: F.lit("z") for c in ("id", "runs", "words", "n", "a", "g", "p", "collapsed")}
    )
    found = periodic_runs(df)
    assert dict(found.dtypes)["doc_id"] == "int"
    got = {(r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in found.collect()}
    twelve = (12, ((0, 12, 2),), "a b")
    assert got == {
        (1, 0, (), ""), (2, 0, (), ""), (3, 0, (), ""), (None, *twelve), (5, *twelve),
        (6, 10, ((0, 9, 1),), "x y"),
    }
    assert found.count() == 7 and periodic_runs(df.limit(0)).count() == 0
    assert looped(df).where("doc_id IS NULL").first()["text"] == loop
    assert looped(df.limit(0)).count() == 0


def test_runs_of_a_very_long_text(spark):
    n = 400_000
    text = " ".join(f"w{i % 90_000}" for i in range(n))
    df = spark.createDataFrame([(1, text), (2, "q " * 600_000)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in periodic_runs(df).collect()}
    assert [tuple(r) for r in rows[1]["runs"]] == [(0, n, 90_000)]
    assert rows[1]["collapsed"] == " ".join(f"w{i}" for i in range(90_000))
    assert [tuple(r) for r in rows[2]["runs"]] == [(0, 600_000, 1)] and rows[2]["collapsed"] == "q"


# Ranked search


def brute_ranked(docs, items, k=10):
    said = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in said)
    n_all = sum(c.total() for _, c in said)
    df = Counter(t for _, c in said for t in c)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for i, c in said:
            m = 25 + (75 * c.total() * n_docs) // n_all if n_all else 0
            score = sum(
                times
                * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t, times in asked.items()
                if c[t]
            )
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, i, -score))
    return sorted(out, key=str)


ODD_DOCS = [
    (1, None), (2, ""), (3, "..."), (None, "alpha beta"), (5, "Alpha alpha GAMMA"), (6, "alpha alpha gamma"),
    (6, "alpha alpha gamma"), (7, "éÉ beta, beta-gamma"), (8, "delta " * 3000 + "alpha"), (9, "unseen"),
]
ODD_ITEMS = [(1, "alpha"), (1, "alpha"), (2, None), (3, ""), (4, "beta Beta gamma É"), (None, "delta"), (6, "nowhere")]


@pytest.mark.parametrize("k", [1, 2, 10])
def test_ranked_odd_rows(spark, k):
    docs = spark.createDataFrame(ODD_DOCS, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(ODD_ITEMS, "item_id int, text string")
    more = {c: F.lit("z") for c in ("id", "n", "rank", "number", "score", "terms")}
    found = ranked(docs.withColumns(more), items.withColumns(more), k=k)
    assert found.dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_ranked(ODD_DOCS, ODD_ITEMS, k)
    assert ranked(docs.limit(0), items).count() == 0
    assert ranked(docs, items.limit(0)).count() == 0


def test_ranked_in_chunks_and_small_blocks(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    whole = sorted(map(tuple, ranked(docs, items).collect()))
    monkeypatch.setattr("plumbline.llm.ranking.CHUNK_TERMS", 100)
    assert sorted(map(tuple, ranked(docs.repartition(5), items).collect())) == whole


def test_terms_of_a_long_text(monkeypatch):
    text = (("word%d " % 7) * 999 + "é" * 3000 + " x,y").encode()
    whole = term_counts(text)
    monkeypatch.setattr("plumbline.llm.ranking.PIECE_BYTES", 64)
    assert term_counts(text) == whole and whole["é".encode() * 3000] == 1


# Line quality


def test_chain_against_all_labellings():
    texts = [b"Hello world foo.\nBAD!! LINE!!\n\nthe the the", b"", b"one | two | three\nx", b"solo"]
    lines = crf.lines_of(texts)
    assert lines.owner.tolist() == [0, 0, 0, 2, 2, 3]
    weights = np.random.default_rng(1).normal(size=crf.N_WEIGHTS) / 3
    chain = crf._chain(lines, weights)
    log_z = 0
    for text in set(lines.owner.tolist()):
        at = np.flatnonzero(lines.owner == text)
        total, good = 0, np.zeros(len(at))
        for labels in itertools.product((0, 1), repeat=len(at)):
            path = sum(
                chain.potentials[t, labels[k - 1] if k else 0, labels[k]]
                for k, t in enumerate(at)
            )
            total += math.exp(path)
            good += math.exp(path) * np.array(labels)
        assert np.allclose(good / total, chain.good[at])
        log_z += math.log(total)
    assert math.isclose(chain.log_z, log_z)
    labels = np.array([1, 0, 1, 0, 1, 1])
    _, slope = crf.loss(lines, labels, weights)
    for k in [*range(0, crf.N_WEIGHTS, 17), *range(crf.N_WEIGHTS - 4, crf.N_WEIGHTS), *lines.classes[1]]:
        step = np.zeros(crf.N_WEIGHTS)
        step[k] = 1e-5
        change = crf.loss(lines, labels, weights + step)[0] - crf.loss(lines, labels, weights - step)[0]
        assert abs(change / 2e-5 - slope[k]) < 1e-4


def test_long_chains_are_stable():
    lines = crf.lines_of([b"a b.\n" * 50_000, b"BAD!!"])
    good = crf._chain(lines, np.full(crf.N_WEIGHTS, 3.0)).good
    assert len(good) == 50_001 and np.isfinite(good).all() and (good > 0.99).all()


def test_op11_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in QUERIES["op11_line_quality"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert len(rows) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    unseen = [(r["quality"], rows[r["doc_id"]]) for r in labels if rows[r["doc_id"]]["held_out"]]
    right = sum(q == r["predicted"] for q, r in unseen)
    assert len(unseen) > 60 and right >= 0.95 * len(unseen)


def test_fit_does_not_hang_on_partitions_or_held_out_labels(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    one = crf.quality(docs, labels).select("doc_id", "score")
    turned = labels.withColumn(
        "quality",
        F.when(crf.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")),
    )
    two = crf.quality(docs.repartition(5), turned.repartition(3)).select("doc_id", "score")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_quality_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "\n \n"), (None, "x."), (5, "A\n" * 3), (5, "A\n" * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit("z") for c in ("id", "score", "good", "label", "part", "place")}
    )
    marks = spark.createDataFrame([(1, 1), (5, 1), (None, 0), (5, None)], "doc_id long, quality int")
    found = crf.quality(df, marks.withColumn("text", F.lit("z"))).collect()
    assert len(found) == 6 and all(0 <= r["score"] <= 1 for r in found)
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[1]["score"] == by_id[2]["score"] == by_id[3]["score"] and by_id[1]["good"] == []
    assert len(by_id[5]["good"]) == 3
    assert crf.quality(df.limit(0), marks).count() == 0
    none = crf.quality(df, marks.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
