"""The repository data source: kinds, partitions, pushed filters, streams."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from stratigraph.sources import readers, repository

PUSH = "spark.sql.python.filterPushdown.enabled"


@pytest.fixture(scope="module")
def source(spark):
    before = spark.conf.get(PUSH)
    spark.conf.set(PUSH, "true")
    spark.dataSource.register(repository.RepositorySource)
    yield lambda kind, path, **more: spark.read.format("repository").options(kind=kind, path=str(path), **more).load()
    spark.conf.set(PUSH, before)


@pytest.fixture
def tree(tmp_path):
    for k in range(40):
        f = tmp_path / "src" / f"d{k % 4}" / f"f{k}.{'cs' if k % 2 else 'py'}"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x" * 1000 + str(k).encode())
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "config").write_text("no source")
    (tmp_path / "Makefile").write_text("all:\n")
    return tmp_path


def test_inventory(spark, source, tree):
    got = {r.file: (r.language, r.bytes, r.hash) for r in source("inventory", tree).collect()}
    assert len(got) == 41 and got["Makefile"][0] == "other"
    assert got["src/d1/f5.cs"] == ("csharp", 1001, hashlib.sha256(b"x" * 1000 + b"5").hexdigest().upper())
    assert {(r.path, r.language) for r in readers.source_inventory(spark, str(tree / "src")).collect()} == {(f.removeprefix("src/"), v[0]) for f, v in got.items() if f.startswith("src/")}


def test_many_files_go_to_one_task(source, tree):
    few = source("inventory", tree, partition_bytes=10_100)
    assert few.rdd.getNumPartitions() == 4
    per_task = [r["count"] for r in few.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 41 and min(per_task) > 1
    assert source("inventory", tree, partition_bytes=1).rdd.getNumPartitions() == 41


def test_filters_are_pushed(source, tree, monkeypatch):
    df = source("inventory", tree, partition_bytes=1)
    for where, n in (("file = 'src/d1/f5.cs'", 1), ("language = 'csharp'", 20), ("file LIKE 'src/d1/%'", 10), ("file LIKE '%.py' AND language IN ('python', 'go')", 20), ("file LIKE '%/d2/%' AND bytes > 1001", 8)):
        some = df.where(where)
        assert some.count() == n, where
        assert some.rdd.getNumPartitions() <= n + 2, where  # only the files that are left are dealt out
    reader = repository.RepositoryReader({"path": str(tree), "kind": "log"})
    asked = [repository.EqualTo(("commit_id",), "a"), repository.EqualTo(("file",), "Makefile"), repository.EqualTo(("language",), "python")]
    assert list(reader.pushFilters(asked)) == [asked[0], asked[2]]
    assert [p.names for p in reader.partitions()] == [[("Makefile", 5)]]


def test_log_as_the_text_reader_has_it(spark, source, tmp_path):
    logs = {"a.log": "commit abc1\nAuthor: x\nDate: y\n\n    message\n\na.cs\nb.cs\na.cs\n\ncommit def2\nAuthor: x\n\na.cs\n", "b.log": "commit 0ff3\r\nMerge: 1 2\r\n\r\né.cs\r\n", "empty.log": ""}
    for n, t in logs.items():
        (tmp_path / n).write_bytes(t.encode())
    got = {(r.file, r.commit_id, r.path) for r in source("log", tmp_path).collect()}
    assert got == {("a.log", "abc1", "a.cs"), ("a.log", "abc1", "b.cs"), ("a.log", "def2", "a.cs"), ("b.log", "0ff3", "é.cs")}
    assert {tuple(r) for r in readers.git_log(spark, str(tmp_path / "a.log")).collect()} == {g[1:] for g in got if g[0] == "a.log"}


def test_long_lines_over_blocks(source, tmp_path):
    name = "n" * 3_000_000
    (tmp_path / "x").write_text(f"commit abc\n{name}\nshort\n")
    assert {len(r.path) for r in source("log", tmp_path).collect()} == {3_000_000, 5}


def test_clones_and_projects(source, tmp_path):
    (tmp_path / "r.json").write_text('{"duplicates": [{"format": "cs", "lines": 5, "tokens": 60, "firstFile": {"name": "b", "start": 1, "end": 6}, "secondFile": {"name": "a", "start": 3, "end": 8}}]}')
    r = source("clones", tmp_path).first()
    assert (r.first_path, r.first_start, r.second_path, r.second_end, r.tokens, r.lines) == ("a", 3, "b", 6, 60, 5)
    (tmp_path / "x.csproj").write_text('<Project xmlns="urn:x"><ItemGroup><ProjectReference Include="..\\y\\y.csproj" /></ItemGroup></Project>')
    (tmp_path / "all.sln").write_text('Project("{FAE0}") = "x", "x\\x.csproj", "{1}"\nEndProject\nProject("{FAE0}") = "y", "y\\y.csproj", "{2}"\nEndProject\n')
    (tmp_path / "all.slnx").write_text('<Solution><Folder Name="/s/"><Project Path="x/x.csproj" /></Folder></Solution>')
    got = {tuple(r) for r in source("projects", tmp_path).collect()}
    assert got == {("x.csproj", "csproj", "../y/y.csproj"), ("all.sln", "sln", "x/x.csproj"), ("all.sln", "sln", "y/y.csproj"), ("all.slnx", "slnx", "x/x.csproj")}
    with pytest.raises(Exception, match="kind is one of"):
        source("guess", tmp_path).count()


def test_stream_brings_each_file_once(spark, source, tmp_path):
    logs, state, out = tmp_path / "logs", str(tmp_path / "state"), str(tmp_path / "out")
    logs.mkdir()

    def step(*names):
        for k, n in enumerate(names):
            (logs / n).write_text(f"commit {n.encode().hex()}\n{n}.cs\n")
            os.utime(logs / n, ns=(step.time + k, step.time + k))
        step.time += 1000
        stream = spark.readStream.format("repository").options(kind="log", path=str(logs)).load()
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(once=True).start()
        query.awaitTermination()
        return sorted(r.path for r in spark.read.schema(stream.schema).parquet(out).collect())

    step.time = 1_700_000_000_000_000_000
    assert step("a", "b") == ["a.cs", "b.cs"]
    assert step("c") == ["a.cs", "b.cs", "c.cs"]
    assert step() == ["a.cs", "b.cs", "c.cs"]
