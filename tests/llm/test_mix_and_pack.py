"""Sharding, mixing, packing, and the whole pipeline."""

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import mixing, packing, quality
from plumbline.llm.mixing import mixed
from plumbline.llm.packing import best_fit, packed
from plumbline.llm.queries import QUERIES
from plumbline.llm.ring import ring_nodes, sharded, walk
from tests.llm.test_neardup import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def brute_walk(sizes, n_shards, slack, places, virtual_nodes):
    """Clockwise, node by node."""
    nodes = ring_nodes(n_shards, virtual_nodes)
    loads = Counter()
    out = {}
    for place in sorted(sizes, key=lambda p: (-sizes[p], p)):
        at = place * ((1 << 60) // places)
        after = [s for p, s in nodes if p > at] + [s for p, s in nodes if p <= at]
        limit = (1 + slack) * sum(sizes.values()) / n_shards
        fits = [s for s in after if loads[s] + sizes[place] <= limit]
        out[place] = fits[0] if fits else min(range(n_shards), key=lambda s: (loads[s], s))
        loads[out[place]] += sizes[place]
    return out


def test_walk():
    sizes = {p: 1 + (p * 7919) % 97 for p in range(0, 512, 3)}
    for shards, slack in ((5, 0.0), (8, 0.05), (3, 2.0)):
        assert walk(sizes, shards, 16, slack, 512) == brute_walk(sizes, shards, slack, 512, 16)


def test_few_places_move_when_a_shard_is_added():
    sizes = {p: 100 for p in range(4096)}
    old, new = (walk(sizes, n, 256, 0.05, 4096) for n in (8, 9))
    moved = sum(old[p] != new[p] for p in sizes)
    assert moved < 0.3 * len(sizes)


def test_shards_of_documents(spark, docs):
    rows = docs.withColumn("shard", F.lit("x")).withColumn("n", F.lit(1))
    found = sharded(rows).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(found) == len(texts)
    slots, loads = defaultdict(list), Counter()
    for r in found:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "bytes")
        assert r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert set(loads) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads.values()) <= 1.03 * sum(loads.values()) / 8


def test_shards_of_odd_rows(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, None), (None, "x"), (2, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sharded(df, n_shards=3).collect()
    assert sorted(r["size"] for r in found) == [1, 1, 2, 2, 2, 2]
    assert len({r["shard"] for r in found if r["doc_id"] == 1}) == 1
    assert sharded(df.limit(0)).collect() == []


def test_poisson_inverse(spark):
    """Counts follow the distribution, also for means that are sums of draws."""
    for mean in (0.3, 2.0, 50.0):
        rows = [(i, "x", "a") for i in range(4000)] + [(i, "xxx" * 2000, "b") for i in range(4000, 4040)]
        df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
        total = 4000 * 2 + 40 * 6001
        found = mixed(df, weights={"a": 1.0}, epochs=mean * 8000 / total).groupBy("doc_id").count().collect()
        counts = [r["count"] for r in found] + [0] * (4000 - len(found))
        average = sum(counts) / 4000
        spread = sum((c - average) ** 2 for c in counts) / 4000
        assert abs(average - mean) < 5 * math.sqrt(mean / 4000)
        assert abs(spread / mean - 1) < 0.15
        assert all(r["doc_id"] < 4000 for r in found)


def test_shares_and_columns(spark, docs):
    rows = docs.withColumn("copy", F.lit("mine")).withColumn("rate", F.lit(1))
    found = mixed(rows, weights={"src0": 3.0, "src1": 1.0}, epochs=20.0)
    assert found.columns == rows.columns
    sizes = {
        r["source"]: r["s"]
        for r in found.groupBy("source").agg(F.sum(F.octet_length("text") + 1).alias("s")).collect()
    }
    assert set(sizes) == {"src0", "src1"} and 2.0 < sizes["src0"] / sizes["src1"] < 4.5


def test_mixing_odd_rows(spark):
    rows = [(1, "a", None)] * 2 + [(None, None, "s"), (2, "", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    first, second = (sorted(map(str, mixed(df, epochs=30.0).collect())) for _ in range(2))
    assert first == second and len({*first}) == 3
    assert mixed(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        mixed(df, weights={"other": 1.0})


def test_no_broadcast_gives_the_same(spark, docs, monkeypatch):
    held = sorted(map(str, mixed(docs, details=True).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixed(docs, details=True).collect())) == held


def brute_fit(lengths, bitmaps, capacity):
    bins, placed = [], []
    for length, own in zip(lengths, bitmaps):
        fits = [b for b in bins if capacity - b["used"] >= length and not b["held"] & own]
        best = min(fits, key=lambda b: (capacity - b["used"], b["seen"]), default=None)
        if best is None:
            best = {"used": 0, "held": 0, "no": len(bins)}
            bins.append(best)
        placed.append((best["no"], best["used"]))
        best["used"] += length
        best["held"] |= own
        best["seen"] = len(placed)
    return placed


def test_best_fit():
    import random

    rng = random.Random(3)
    for capacity in (10, 50, 200):
        lengths = sorted((rng.randrange(1, capacity + 1) for _ in range(300)), reverse=True)
        bitmaps = [rng.choice([0, 1, 1, 2, 4, 1 << rng.randrange(20)]) for _ in lengths]
        assert best_fit(lengths, bitmaps, capacity) == brute_fit(lengths, bitmaps, capacity)


def check_bins(rows, sources, texts, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r["bin_id"]].append(r)
    for held in bins.values():
        held.sort(key=lambda r: r["bin_offset"])
        at = 0
        for r in held:
            assert r["bin_offset"] == at
            at += r["n_tokens"]
        assert at == held[0]["bin_tokens"] <= capacity
        for values in ([sources[r["doc_id"]] for r in held], [texts[r["doc_id"]] for r in held]):
            known = [v for v in values if v]
            assert len(set(known)) == len(known)
    return bins


@pytest.mark.parametrize("options", [{}, {"capacity": 256, "group_rows": 50}])
def test_packing(spark, docs, options):
    capacity = options.get("capacity", 2048)
    found = packed(docs.withColumn("piece", F.lit("x")).withColumn("row", F.lit(1)), **options).collect()
    rows = docs.collect()
    check_bins(found, {r["doc_id"]: r["source"] for r in rows}, {r["doc_id"]: r["text"] for r in rows}, capacity)
    total = Counter()
    for r in found:
        total[r["doc_id"]] += r["n_tokens"]
    assert total == {r["doc_id"]: -(-len(r["text"].encode()) // 4) + 1 for r in rows}


def test_packing_odd_rows(spark):
    rows = [(1, "abcd", "s")] * 40 + [(2, None, None), (3, "", None), (None, "x", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = packed(df, capacity=16, group_rows=10).collect()
    assert len(found) == 43
    own = Counter(r["bin_id"] for r in found if r["doc_id"] == 1)
    assert max(own.values()) == 1
    assert packed(df.limit(0)).collect() == []


def test_packing_does_not_hang_on_partitions(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 4)
    rows = docs.unionByName(docs.limit(1).crossJoin(spark.range(11)).drop("id"))
    one, two = (packed(rows.repartition(n), group_rows=60).collect() for n in (2, 7))
    assert len(one) > 211 and sorted(map(tuple, one), key=str) == sorted(map(tuple, two), key=str)


def test_near_copies_do_not_share_a_bin(spark, tmp_path):
    words = [f"word{k}" for k in range(60)]
    rows = [(k, " ".join([*words[:59], f"last{k}"]) + " " * (k % 2), f"s{k}") for k in range(12)]
    rows += [(20 + k, f"other text {k}", f"t{k}") for k in range(12)]
    # Copies also stay apart where only one of them has an id.
    rows += [(None, rows[0][1], "u1"), (None, "!!!", "u2"), (40, "!!!", "u3")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op8_best_fit_packing"](spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    bins = {(r["doc_id"], r["source"]): r["bin_id"] for r in found}
    assert len({bins[k, f"s{k}"] for k in range(12)}) == 12
    assert bins[None, "u1"] != bins[0, "s0"] and bins[None, "u2"] != bins[40, "u3"]


def test_pipeline_against_brute_force(spark, docs):
    stages = corpus_pipeline.STAGES
    assert [name for name, _ in stages] == ["quality rules", "minhash near-dedup", "source mixing", "best-fit packing"]
    rows = [r.asDict() for r in docs.collect()]

    good = []
    for r in rows:
        counts = quality.counts_of(pa.array([r["text"]])).to_pylist()[0]
        failed = counts["n_words"] < 20 or counts["n_repeat_words"] * 100 > counts["n_words"] * 30
        if not failed and counts["lost_chars"] * 100 <= counts["line_chars"] * 50:
            text = r["text"] if counts["cleaned"] is None else counts["cleaned"]
            good.append(r | {"text": text, "n_chars": len(text)})
    step = stages[0][1](spark, docs, FOLDER)
    assert step.columns == docs.columns
    assert sorted(map(str, (r.asDict() for r in step.collect()))) == sorted(map(str, good))

    roots = brute([(r["doc_id"], r["text"]) for r in good], 5)
    unique = [r for r in good if roots[r["doc_id"]] == r["doc_id"]]
    step = stages[1][1](spark, step, FOLDER)
    assert step.columns == docs.columns
    assert sorted(map(str, (r.asDict() for r in step.collect()))) == sorted(map(str, unique))

    con = duckdb.connect()
    documents = step.toPandas()
    con.register("documents", documents)
    from plumbline.llm.oracles import ORACLES

    wanted = Counter(r[0] for r in con.execute(ORACLES["op6_poisson_mixing"]).fetchall())
    step = stages[2][1](spark, step, FOLDER)
    assert step.columns == docs.columns
    assert Counter(r["doc_id"] for r in step.collect()) == wanted

    found = QUERIES["pipeline"](spark, FOLDER).collect()
    texts = {r["doc_id"]: r["text"] for r in good}
    check_bins(found, {r["doc_id"]: r["source"] for r in good}, texts, packing.CAPACITY)
    size = Counter()
    for r in found:
        size[r["doc_id"]] += r["n_tokens"]
    assert size == {i: n * (-(-len(texts[i].encode()) // 4) + 1) for i, n in wanted.items()}
