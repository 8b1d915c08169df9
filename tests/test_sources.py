"""Single files by many tasks, libraries read in ranges with pushed filters, and quoted records that span lines and splits."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from symbridge.sources import address_library, listings, ordered_files


@pytest.fixture
def eight(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_large_version_is_written_and_read_by_many_tasks(eight, tmp_path, monkeypatch):
    n, folder = 10_000_000, f"file://{tmp_path}/large"
    told = []
    commit = ordered_files.OrderedWriter.commit
    monkeypatch.setattr(ordered_files.OrderedWriter, "commit", lambda self, messages: told.append(messages) or commit(self, messages))
    lib = eight.range(0, n, 1, 8).select(F.lit("2-0-0-0").alias("version"), (n - F.col("id")).alias("id"), (F.col("id") * 3).alias("rva"))
    assert address_library.write(lib.unionAll(lib.limit(3).withColumn("version", F.lit("2-0-1-0"))), folder) == n + 3
    assert sorted(os.listdir(tmp_path / "large")) == ["version-2-0-0-0.bin", "version-2-0-1-0.bin"]
    assert (tmp_path / "large" / "version-2-0-0-0.bin").stat().st_size == 8 + 16 * n
    read = address_library.read(eight, folder)
    assert read.rdd.getNumPartitions() >= 8
    large = read.where("version = '2-0-0-0'")
    assert large.agg(F.count("*"), F.sum("id"), F.sum("rva"), F.count_if(F.col("pos") + 1 != F.col("id"))).first() == (n, n * (n + 1) // 2, 3 * n * (n - 1) // 2, 0)
    some = large.where("id BETWEEN 5000000 AND 5000009")
    assert "PushedFilters: [" in some._jdf.queryExecution().explainString(some._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")) and some.rdd.getNumPartitions() == 1
    assert [(r["id"], r["rva"]) for r in some.collect()] == [(i, (n - i) * 3) for i in range(5_000_000, 5_000_010)]


def test_parts_come_from_many_tasks(eight, tmp_path):
    """The parts of a library before they are joined: eight ranges, eight writers, in order."""
    folder = f"file://{tmp_path}"
    writer = address_library.LibraryWriter(folder)
    rows = eight.range(8000).select(F.lit("1").alias("version"), "id", "id").repartitionByRange(8, "id").sortWithinPartitions("id")
    run = lambda batches: [__import__("pyarrow").RecordBatch.from_pylist([{"task": t.task, "parts": len(t.parts), "entries": sum(p[2] for p in t.parts)} for t in [writer.write(batches)]])]
    told = rows.mapInArrow(run, "task long, parts long, entries long").collect()
    assert len(told) == 8 and all(r["parts"] == 1 for r in told) and sum(r["entries"] for r in told) == 8000
    writer.abort([])
    assert os.listdir(tmp_path) == []


@pytest.mark.parametrize("at", [0, 4999])
def test_a_failed_write_leaves_nothing(eight, tmp_path, at):
    folder = tmp_path / "out"
    lib = eight.range(5000).select(F.lit("1-0-0-0").alias("version"), F.when(F.col("id") == at, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"), F.col("id").alias("rva"))
    with pytest.raises(Exception, match="lost"):
        address_library.write(lib, f"file://{folder}")
    rows = eight.range(5000).withColumn("x", F.when(F.col("id") == at, F.raise_error(F.lit("lost"))).otherwise("y"))
    with pytest.raises(Exception, match="lost"):
        listings.write_report(rows, ["id", "x"], f"file://{folder}/report.csv")
    assert not folder.exists() or os.listdir(folder) == []


def test_filters_of_a_library(spark, tmp_path):
    rng = random.Random(1)
    data = [(f"1-0-{v}-0", rng.randrange(200), rng.randrange(10**6)) for v in range(3) for _ in range(500)]
    folder = f"file://{tmp_path}"
    address_library.write(spark.createDataFrame(data, "version string, id long, rva long"), folder)
    for where in ("id = 7", "id IN (3, 50, 199, 5000)", "id > 20 AND id <= 25", "id < 2", "id >= 190 AND version IN ('1-0-0-0', '1-0-2-0')", "version = '1-0-1-0' AND id <> 3", "id > 9223372036854775806", "id = 1 OR rva < 1000", "id IS NULL", "id = 7 AND rva > 500000"):
        got = sorted(map(tuple, address_library.read(spark, folder).where(where).select("version", "id", "rva").collect()))
        want = sorted(map(tuple, spark.createDataFrame(data, "version string, id long, rva long").where(where).collect()))
        assert got == want, where
    pairs = [5, 1, 3, 2, 9, 4]
    (tmp_path / "version-9.bin").write_bytes(len(pairs).to_bytes(8, "little") + b"".join(i.to_bytes(8, "little") * 2 for i in pairs))
    mixed = address_library.read(spark, f"{folder}/version-9.bin", sorted_ids=False)
    assert [r["id"] for r in mixed.collect()] == pairs and [r["pos"] for r in mixed.where("id = 2").collect()] == [3]
    with pytest.raises(Exception, match="not sorted"):
        address_library.read(spark, f"{folder}/version-9.bin").where("id >= 1").collect()


def test_reports_have_one_mark_and_header(eight, tmp_path):
    rows = eight.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 'a "b"; c,\nd').when(F.col("id") % 3 == 1, None).otherwise("ü").alias("x, y"), F.lit(1).alias("other"))
    for sep, mark in ((";", True), (",", False)):
        path = tmp_path / f"{len(sep)}{mark}.csv"
        listings.write_report(rows, ["id", "x, y"], f"file://{path}", ["id"], sep, mark)
        out = io.StringIO()
        w = csv.writer(out, delimiter=sep)
        w.writerow(["id", "x, y"])
        w.writerows([i, ['a "b"; c,\nd', None, "ü"][i % 3]] for i in range(3000))
        assert path.read_bytes() == (b"\xef\xbb\xbf" if mark else b"") + out.getvalue().encode()
        back = listings.read_report(eight, f"file://{path}", ["id", "x, y", "absent"], sep).collect()
        assert sorted((int(r["id"]), r["x, y"], r["absent"]) for r in back) == [(i, ['a "b"; c,\nd', None, "ü"][i % 3], None) for i in range(3000)]
    listings.write_report(rows.limit(0), ["id"], f"file://{tmp_path}/none.csv")
    assert (tmp_path / "none.csv").read_bytes() == b"\xef\xbb\xbfid\r\n"
    listings.write_report(eight.createDataFrame([("",), ("b",)], "a string"), ["a"], f"file://{tmp_path}/one.csv", ["a"])
    assert (tmp_path / "one.csv").read_bytes() == b'\xef\xbb\xbfa\r\n""\r\nb\r\n'
    assert sorted(os.listdir(tmp_path)) == sorted(["1True.csv", "1False.csv", "none.csv", "one.csv"])


@pytest.mark.parametrize("split", ["61", "1000", "128m"])
def test_quoted_records_across_splits(spark, tmp_path, split):
    rng, want = random.Random(7), []
    for name in ("a.csv", "b.csv", "c.csv"):
        out = io.StringIO()
        w = csv.writer(out, delimiter=";", lineterminator=rng.choice(["\n", "\r\n"]))
        w.writerow(["k", "text"])
        for i in range(60 if name != "b.csv" else 0):
            text = "".join(rng.choices(['"', ";", "\n", "a", "bc", " ", "\n\n", "ü"], k=rng.randrange(12)))
            w.writerow([i, text])
            want.append((len(want), str(i), text or None))
            if rng.random() < 0.2:
                out.write(w.dialect.lineterminator)
        (tmp_path / name).write_bytes((b"\xef\xbb\xbf" if name == "a.csv" else b"") + out.getvalue().encode())
    (tmp_path / "d.csv").write_bytes(b"")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        table = listings.quoted_table(spark, f"file://{tmp_path}")
        assert sorted(tuple(r) for r in table.select("number", "k", "text").collect()) == want
        if split == "61":
            assert spark.read.text(f"file://{tmp_path}").rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("split", ["61", "128m"])
def test_match_files_across_splits(spark, tmp_path, split):
    at = lambda v: f"{listings.IMAGE_BASE + v:X}"
    want = []
    for n in range(3):
        lines = [f"{at(99)}\t{at(98)}"] * listings.HEADER_LINES + [f"{at(n * 100 + i)}\t{at(i * 7)}" for i in range(40)]
        want += [(n, n * 100 + i, i * 7) for i in range(40)]
        (tmp_path / f"1.{n}.0_1.{n + 1}.0.txt").write_bytes((["\n", "\r\n"][n % 2].join(lines) + "\n" * (n % 2)).encode())
    (tmp_path / "other.txt").write_text("x\n" * 60)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = sorted((r["lver"]["minor"], r["lrva"], r["rrva"]) for r in listings.match_files(spark, f"file://{tmp_path}").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted(want)


def test_no_quoted_records(spark, tmp_path):
    (tmp_path / "x.csv").write_text("\n\n")
    assert listings.quoted_table(spark, f"file://{tmp_path}").count() == 0
    assert listings.pair_table(spark, f"file://{tmp_path}").count() == 0


def test_what_tasks_tell_does_not_grow_with_their_files(tmp_path, monkeypatch):
    """A task of thousands of small files tells the driver two parts and a list's place; the files are all there, in order, large ones too."""
    import pickle
    from types import SimpleNamespace

    import pyarrow as pa

    monkeypatch.setattr(ordered_files, "CHUNK", 1000)
    writer = ordered_files.TextWriter(f"file://{tmp_path}/out", None, "<", ">", "\n")
    lines = sorted((f"f{k % 2000:04}", k) for k in range(4000)) + [("g", k) for k in range(5000)] + [("h", k) for k in range(9000, 9500)]
    told = []
    for task, (a, b) in enumerate([(0, 3001), (3001, 9100), (9100, 9500)]):  # the second begins within f1500, the third within h
        monkeypatch.setattr(ordered_files, "TaskContext", SimpleNamespace(get=lambda task=task: SimpleNamespace(partitionId=lambda: task)))
        batches = [pa.RecordBatch.from_pylist([{"file": f, "value": str(v)} for f, v in lines[i : min(i + 700, b)]]) for i in range(a, b, 700)]
        told.append(writer.write(iter(batches)))
    assert all(len(pickle.dumps(m)) < 2000 for m in told)
    writer.commit(told[::-1])
    want = {}
    for f, v in lines:
        want[f] = want.get(f, "<") + f"{v}\n"
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {f: t + ">" for f, t in want.items()}


def test_a_tree_is_listed_by_tasks(eight, tmp_path):
    """The files, hidden ones aside, are those of Spark's own reader, and no file of the tree is in the driver's index."""
    from symbridge.sources import rewrites

    for at in ("Lib/src/a.cpp", "Lib/src/deep/er/b c%20é.cpp", "Lib/include/x=1/c.h", "Lib/other/d.h", "Lib/src/_e.cpp", "Lib/src/.f.cpp", "Lib/src/_x=y.cpp", "Lib/.git/src/g.cpp", "Lib/src/_tmp/h.cpp", "more/Lib/src/i.cpp", "empty.txt"):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text(f"text of {at}", newline="")
    got = rewrites.read_sources(eight, f"file://{tmp_path}", "Lib")
    assert "binaryFile" not in got._jdf.queryExecution().toString()
    files = eight.read.option("recursiveFileLookup", "true").format("binaryFile").load(f"file://{tmp_path}")
    want = files.select(F.regexp_replace("path", "^file:/+", "file:///"), F.regexp_extract("path", "/(Lib/(?:include|src)/.+)$", 1).alias("file"), F.decode("content", "UTF-8"), F.sha2("content", 256)).where("file <> ''")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 5
