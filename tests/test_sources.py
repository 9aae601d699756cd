"""Scans, contracts, baselines, profiles and fingerprints."""

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.operators import split, summary
from plumbline.operators.fingerprint import file_fingerprints, table_fingerprint
from plumbline.operators.quantiles import fit_baseline
from plumbline.sources import files
from plumbline.sources.baselines import fit_or_load_baseline, load_baseline, save_baseline
from plumbline.sources.files import chained_hashes, streamed_hashes
from plumbline.sources.shared import new_folder, shared_folder, written
from plumbline.sources.tables import (
    clean_markers,
    drop_incomplete,
    file_frame,
    read_csv,
    read_csv_checked,
    require_columns,
    select_features,
    write_windows,
)
from plumbline.spec import CARD_FRAUD, CENSUS, FeatureSpec, Pair


def census_rows(n, label=True):
    head = ["age", "workclass", "fnlwgt", "education", "education.num", "marital.status",
            "occupation", "relationship", "race", "sex", "capital.gain", "capital.loss",
            "hours.per.week", "native.country"]
    lines = []
    for i in range(n):
        numbers = {"age": 18 + 3 * i, "fnlwgt": 7 * i * i, "education.num": 1 + i % 16,
                   "capital.gain": 50 * (i % 4), "capital.loss": i % 2, "hours.per.week": 60 - i}
        row = [str(numbers.get(c, f"{c} {i % 3}")) for c in head]
        lines.append(row + (["<=50K" if i % 2 else ">50K"] if label else []))
    return head + (["income"] if label else []), lines


def write_csv(path, head, lines):
    path.write_text("\n".join(",".join(f'"{v}"' for v in row) for row in [head, *lines]))
    return str(path)


def test_csv_scan_drops_marked_rows(spark, tmp_path):
    head, lines = census_rows(6)
    lines[0][1] = "?"
    lines[1][6] = " ?"
    lines[2][14] = ""
    lines[3][1] = "?x"
    path = write_csv(tmp_path / "census.csv", head, lines)
    kept = read_csv(spark, path)
    assert kept.count() == 3
    assert read_csv(spark, path, keep_incomplete=True).count() == 6
    assert dict(kept.dtypes)["age"] == "int"
    assert select_features(kept, CENSUS).columns == list(CENSUS.features)


def test_contract_names_missing_columns_in_order(spark, tmp_path):
    path = write_csv(tmp_path / "card.csv", ["Time", "V1"], [["1", "2"]])
    with pytest.raises(ValueError, match="Amount, Class, V10"):
        read_csv(spark, path, required=[*CARD_FRAUD.features, "Class", "Time"])
    with pytest.raises(ValueError, match="b, z"):
        require_columns(spark.range(1), ["z", "id", "b"])


def test_incoming_batch_without_labels(spark, tmp_path):
    full = read_csv(spark, write_csv(tmp_path / "a.csv", *census_rows(30)))
    batch = read_csv(spark, write_csv(tmp_path / "b.csv", *census_rows(5, label=False)))
    pair = split.incoming_pair(full, batch, "fnlwgt")
    assert pair.current.count() == 5 and "income" not in pair.frame.columns
    labeled = split.incoming_pair(full, full, "fnlwgt")
    ref, cur = split.labeled_sides(labeled, "income")
    assert cur.count() == 30 and 0 < ref.count() < 30
    assert split.labeled_sides(pair, "income") == (None, None)


def test_shifted_scenario_overlaps(spark):
    df = spark.range(200).withColumn("age", F.col("id") % 60)
    pair = split.shifted_pair(df, "id", F.col("age") >= 40)
    both = pair.frame.where(F.col(Pair.IN_REF) & F.col(Pair.IN_CUR)).count()
    assert both > 0 and pair.current.where("age < 40").isEmpty()


def test_windows_written_and_read(spark):
    df = spark.range(9).select("id", (F.col("id") * 1.5).alias("Time"))
    path = new_folder(spark, "test-windows")
    write_windows(split.temporal_windows(df, "Time", "id"), path)
    back = read_csv(spark, path, "id bigint, Time double, window string")
    assert {r["window"]: r["count"] for r in back.groupBy("window").count().collect()} == {
        "D1": 3, "D2": 3, "D3": 3,
    }
    assert back.where("window = 'D2'").count() == 3


def test_markers_touch_text_only(spark):
    df = spark.createDataFrame([("?", 1), ("x", 2), (None, 3)], "`a.b` string, n int")
    assert drop_incomplete(clean_markers(df)).collect() == [("x", 2)]


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_baseline_roundtrip(spark, fmt):
    df = spark.range(100).select(F.col("id").cast("double").alias("a.b"), F.lit("x").alias("c"))
    base = fit_baseline(df, ("a.b",), ("c",), 4, {"source": "test"})
    path = new_folder(spark, "test-baseline")
    save_baseline(spark, base, path, fmt)
    assert load_baseline(spark, path, fmt) == base


def test_baseline_stays_frozen_until_features_change(spark):
    path = new_folder(spark, "test-frozen")
    spec = FeatureSpec(("a",))
    first = spark.range(10).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"))
    moved = first.withColumn("a", F.col("a") + 100)
    base = fit_or_load_baseline(first, path, spec)
    assert fit_or_load_baseline(moved, path, spec) == base
    assert fit_or_load_baseline(moved, path, FeatureSpec(("a",)), psi_bins=3).edges["a"][0] == 100.0
    rebuilt = fit_or_load_baseline(moved, path, FeatureSpec(("a", "b")))
    assert rebuilt.metadata["rebuilt"] == "true" and set(rebuilt.edges) == {"a", "b"}


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_folder(spark) == named.rstrip("/")
    assert written(spark.range(3)).count() == 3


def test_fingerprint_ignores_row_and_column_order(spark):
    one = spark.createDataFrame([(2, 3), (1, 4)], "b int, a int")
    two = spark.createDataFrame([(4, 1), (3, 2)], "a int, b int").repartition(3)
    other = spark.createDataFrame([(4, 2), (3, 1)], "a int, b int")

    def h(df):
        return table_fingerprint(df).first()["content_hash"]

    assert h(one) == h(two) != h(other)
    assert h(one) != h(one.union(one)) != h(one.union(one).union(one))
    assert h(one) != h(one.withColumnRenamed("a", "c"))


def test_fingerprint_tells_null_from_text_and_borders(spark):
    def h(*rows):
        return table_fingerprint(spark.createDataFrame(rows, "x string, y string")).first()["content_hash"]

    assert len({h((None, "a")), h(("", "a")), h(("a", "")), h(("a", None)), h(("~", "a"))}) == 5
    assert table_fingerprint(spark.createDataFrame([], "x string")).first()["row_count"] == 0


def test_file_fingerprints(spark, tmp_path):
    for name, size in (("a.bin", 10), ("b.bin", 100_000)):
        (tmp_path / name).write_bytes(bytes(i % 251 for i in range(size)))
    expected = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.iterdir()}
    rows = file_fingerprints(spark, str(tmp_path), "*.bin").collect()
    assert {r["path"].rsplit("/", 1)[1]: r["content_hash"] for r in rows} == expected


def test_numeric_profile(spark):
    values = np.random.default_rng(1).normal(size=301)
    df = spark.createDataFrame([(float(v), None, True) for v in values], "a double, e double, b boolean")
    rows = {r["feature"]: r for r in summary.numeric_profile(df, ["a", "e", "b"]).collect()}
    assert rows["a"]["std"] == pytest.approx(values.std(ddof=1))
    assert rows["a"]["q05"] == pytest.approx(np.quantile(values, 0.05))
    assert rows["e"]["empty"] and rows["e"]["mean"] is None
    assert rows["b"]["mean"] == 1.0 and not rows["b"]["empty"]
    one = summary.numeric_profile(df.limit(1), ["a"]).first()
    assert one["std"] == 0.0


def test_top_values_break_ties_by_value(spark):
    words = ["b"] * 3 + ["a"] * 3 + ["z"] * 9 + [None] * 20 + [f"w{i:02d}" for i in range(30)]
    df = spark.createDataFrame([(w,) for w in words], "c string").repartition(4)
    rows = summary.categorical_profile(df, ["c"]).orderBy("position").collect()
    assert [r["value"] for r in rows][:4] == ["z", "a", "b", "w00"]
    assert len(rows) == 15 and rows[0]["n_unique"] == 33
    near = summary.categorical_profile(df, ["c"], approximate=True).first()
    assert abs(near["n_unique"] - 33) <= 3


def test_snapshot_is_one_row_per_column(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "x", None)], "n int, t string, e string")
    rows = {r["feature"]: r for r in summary.table_snapshot(df).collect()}
    assert json.loads(rows["t"]["profile"]) == {"n_unique": 1, "top_values": {"x": 2}}
    assert json.loads(rows["e"]["profile"])["n_unique"] == 0
    assert json.loads(rows["n"]["profile"])["q50"] == 1.5
    assert {r["n_rows"] for r in rows.values()} == {2}


def test_unique_folders(spark):
    assert new_folder(spark, "x") != new_folder(spark, "x")
    assert uuid.UUID(new_folder(spark, "x").rsplit("-", 1)[1])


def test_large_files_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    """A sparse file of 3 GB, beyond what a row of the binary reader holds."""
    path = tmp_path / "large.bin"
    with path.open("wb") as out:
        out.truncate(3_000_000_000)
        out.seek(2_500_000_000)
        out.write(b"somewhere in it")
    small = tmp_path / "small.bin"
    small.write_bytes(b"abc")
    expected = {}
    for file in (path, small):
        digest = hashlib.sha256()
        with file.open("rb") as held:
            while piece := held.read(1 << 22):
                digest.update(piece)
        expected[file.name] = (file.stat().st_size, digest.hexdigest())
    rows = file_fingerprints(spark, str(tmp_path), "*.bin").collect()
    assert {r["path"].rsplit("/", 1)[1]: (r["length"], r["content_hash"]) for r in rows} == expected
    none = file_fingerprints(spark, str(tmp_path), "*.txt")
    assert none.count() == 0


def test_small_files_share_tasks_when_hashed_in_pieces(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"{k}.bin").write_bytes(b"x" * (k + 1))
    expected = {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.iterdir()}
    found = streamed_hashes(spark, file_frame(spark, str(tmp_path), "*.bin"))
    assert found.rdd.getNumPartitions() <= 60
    assert {r["path"].rsplit("/", 1)[1]: (r["length"], r["content_hash"]) for r in found.collect()} == expected
    few = spark.createDataFrame([(f"file:{tmp_path}/7.bin",)] * 2, "path string")
    assert [r["length"] for r in streamed_hashes(spark, few).collect()] == [8, 8]


def test_no_task_reads_more_than_a_part_of_a_large_file(spark, tmp_path):
    for k, size in enumerate((1, 999, 1000, 1001, 2000, 2777)):
        (tmp_path / f"a b%20{k}.bin").write_bytes(bytes(i * i % 251 for i in range(size)))
    expected = {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.iterdir()}

    def found(rows):
        return {r["path"].rsplit("/", 1)[1]: (r["length"], r["content_hash"]) for r in rows.collect()}

    hashed = chained_hashes(spark, file_frame(spark, str(tmp_path), "*.bin"), 1000)
    assert found(hashed) == expected
    steps = spark.read.parquet(hashed.inputFiles()[0].split("/step=")[0]).orderBy("step").collect()
    done = dict.fromkeys((r["path"] for r in steps), 0)
    for row in steps:
        assert 0 <= row["done"] - done[row["path"]] <= 1000
        done[row["path"]] = row["done"]
    assert {p.rsplit("/", 1)[1]: d for p, d in done.items()} == {p: size for p, (size, _) in expected.items()}
    assert max(r["step"] for r in steps) == 2
    assert found(file_fingerprints(spark, str(tmp_path), "*.bin", part_bytes=1000)) == expected
    assert found(file_fingerprints(spark, str(tmp_path), "*.bin", whole_below=1, part_bytes=1500)) == expected
    assert chained_hashes(spark, file_frame(spark, str(tmp_path), "*.txt")).count() == 0


def test_a_file_is_hashed_whole_without_a_hash_to_stop_at(tmp_path, monkeypatch):
    path = tmp_path / "x.bin"
    path.write_bytes(b"abc" * 1000)

    def step(length, **held):
        row = {"path": f"file:{path}", "length": length, "content_hash": None, "done": 0, "state": None}
        batch = pa.RecordBatch.from_pylist([row | held], files.STEP_ARROW)
        return next(files._next_part(1000)(iter([batch]))).to_pylist()[0]

    begun = step(3000)
    assert begun["content_hash"] is None and begun["done"] == 1000
    with pytest.raises(OSError, match="3000 bytes, 4000"):
        step(4000)
    monkeypatch.setattr(files, "_library", lambda: None)
    whole = hashlib.sha256(path.read_bytes()).hexdigest()
    for row in (step(3000), step(3000, done=1000, state=begun["state"])):
        assert row["content_hash"] == whole and row["done"] == 3000


def test_malformed_records_are_returned(spark, tmp_path):
    lines = ["a,b,_line", "1,x,2.5", "2,y", "3,z,1.0,extra", "four,w,1.0", '5,"u, v",0.5', "6,?,", ",,"]
    (tmp_path / "rows.csv").write_text("\n".join(lines) + "\n")
    good, malformed = read_csv_checked(spark, str(tmp_path / "rows.csv"), "a int, b string, _line double")
    assert sorted(r["line"] for r in malformed.collect()) == ["2,y", "3,z,1.0,extra", "four,w,1.0"]
    assert sorted(map(tuple, good.collect()), key=str) == sorted(
        [(1, "x", 2.5), (5, "u, v", 0.5), (6, None, None), (None, None, None)], key=str
    )
