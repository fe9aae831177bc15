import pytest
from pyspark.sql import functions as F

from hazeloom.sources import files as fl


def test_stamps_refuse(spark):
    definition, path = {"a": "1"}, fl.scratch(spark, "t")
    fl.write_stamped(spark.range(3), path, definition, "me")
    assert fl.read_stamped(spark, path, definition, "me").count() == 3
    for d, p in (({"a": "2"}, "me"), (definition, "you")):
        with pytest.raises(ValueError):
            fl.read_stamped(spark, path, d, p)


def test_typed_csv_keeps_zeros_and_bad_lines(spark):
    path = fl.scratch(spark, "csv")
    spark.createDataFrame([("fips,x",), ("00123,1.5",), ("00124,oops",)], "v string").coalesce(1).write.text(path)
    rows = fl.typed_csv(spark, path, "fips string, x double", bad_column="bad").collect()
    assert [(r.fips, r.x, r.bad) for r in rows] == [("00123", 1.5, None), ("00124", None, "00124,oops")]


def test_gate(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 9.0)], "yr long, v double")
    assert fl.gated(df, "v", "yr", 1, 10).count() == 2
    with pytest.raises(ValueError):
        fl.gated(df, "v", "yr", 1, 5)


def test_versions_swap_and_two_writers(spark):
    definition, path = {"a": "1"}, fl.scratch(spark, "v")
    assert fl.current_version(spark, path) is None
    with pytest.raises(ValueError):
        fl.read_version(spark, path, definition, "me")
    assert fl.commit_version(spark.range(3), path, definition, "me", ["later"]) == 0
    with pytest.raises(ValueError):
        fl.read_version(spark, path, definition, "me")
    number, old = fl.current_version(spark, path)
    before = spark.read.parquet(f"{old}/data")
    assert fl.commit_version(spark.range(5), path, definition, "me", after=number) == 1
    for late in (spark.range(7), spark.range(8)):
        with pytest.raises(fl.Conflict):
            fl.commit_version(late, path, definition, "me", after=number)
    with pytest.raises(fl.Conflict):
        fl.commit_version(spark.range(9), path, definition, "me")
    assert [(n, t.count()) for n, t in [fl.read_version(spark, path, definition, "me")]] == [(1, 5)]
    assert before.count() == 3  # a reader of the old version is not disturbed


def test_writers_at_once(spark):
    from concurrent.futures import ThreadPoolExecutor

    definition, path = {"a": "1"}, fl.scratch(spark, "race")
    fl.commit_version(spark.range(1), path, definition, "me")

    def write(n):
        try:
            return n, fl.commit_version(spark.range(n), path, definition, "me", after=0)
        except fl.Conflict:
            return n, None

    with ThreadPoolExecutor(4) as pool:
        won = [n for n, number in pool.map(write, range(10, 16)) if number == 1]
    assert len(won) == 1 and fl.read_version(spark, path, definition, "me")[1].count() == won[0]


def test_headers_over_splits(spark):
    lines, want, header = [], [], None
    for i in range(4000):
        if i % 397 == 5:
            header = f"H,{i}"
            lines.append(header)
        else:
            lines.append(f"{i} detail")
            want.append((header, f"{i} detail"))
    path = fl.scratch(spark, "split")
    spark.createDataFrame([("\n".join(lines),)], "v string").coalesce(1).write.text(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        split = fl.split_lines(spark, path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert split.select("block").distinct().count() > 8
    got = sorted((int(r.line.split()[0]), r.header, r.line) for r in fl.carried_header(split, F.col("line").startswith("H,")).collect())
    assert [g[1:] for g in got] == want


def test_only_settled_files_are_taken(spark, tmp_path):
    import os

    folder, landing = str(tmp_path / "drop"), str(tmp_path / "landing")
    assert fl.settled(spark, folder, {}) == ([], {})
    os.makedirs(folder)

    def write(name, text, age):
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
        os.utime(f"{folder}/{name}", (1000 - age, 1000 - age))

    names = lambda paths: [p.rsplit("/", 1)[-1] for p in paths]
    for name, age in (("old", 60), ("fresh", 5), ("grows", 60), ("_hidden", 60), (".hidden", 60)):
        write(name, "x", age)
    ready, sizes = fl.settled(spark, folder, {}, now=1000)
    assert not ready and len(sizes) == 3
    write("grows", "xx", 30)
    ready, sizes = fl.settled(spark, folder, sizes, now=1000)
    assert names(ready) == ["old"]
    fl.hand_over(spark, ready, landing)
    ready, sizes = fl.settled(spark, folder, sizes, now=1021)
    assert names(ready) == ["fresh", "grows"]
    fl.hand_over(spark, ready, landing)
    assert sorted(x for x in os.listdir(landing) if x[0] != ".") == ["fresh", "grows", "old"]
    with pytest.raises(OSError):
        fl.hand_over(spark, [f"{folder}/nothing"], landing)
