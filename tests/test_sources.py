from stratigraph.sources import readers


def test_inventory(spark, tmp_path):
    for name in ("src/a.cs", "src/b.py", "bin/c.cs", "docs/d.md", "tmp/e.cs"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    got = {r.path: r.language for r in readers.source_inventory(spark, str(tmp_path), exclude=["docs/**"], ignore=["tmp/**", "!tmp/keep"]).collect()}
    assert got == {"src/a.cs": "csharp", "src/b.py": "python"}


def test_text_readers(spark, tmp_path):
    (tmp_path / "log").write_text("commit abc1\nAuthor: x\nDate: y\n\n    message\n\na.cs\nb.cs\n\ncommit def2\nAuthor: x\n\na.cs\n")
    assert {tuple(r) for r in readers.git_log(spark, str(tmp_path / "log")).collect()} == {("abc1", "a.cs"), ("abc1", "b.cs"), ("def2", "a.cs")}
    (tmp_path / "status").write_text(" M a.cs\0R  new.cs\0old.cs\0?? c.cs\0")
    assert [tuple(r) for r in readers.git_status(spark, str(tmp_path / "status")).collect()] == [("a.cs", None, "M"), ("new.cs", "old.cs", "R"), ("c.cs", None, "??")]
    (tmp_path / "clones.json").write_text('{"duplicates": [{"format": "cs", "lines": 5, "tokens": 60, "firstFile": {"name": "b", "start": 1, "end": 6}, "secondFile": {"name": "a", "start": 3, "end": 8}}]}')
    r = readers.clone_report(spark, str(tmp_path / "clones.json")).first()
    assert (r.first.path, r.second.path, r.tokens) == ("a", "b", 60)
    (tmp_path / "settings.json").write_text('{"A": {"B": 1, "B": 2, "C": [true, null]}}')
    assert {(x.key, x.value, x.duplicate) for x in readers.json_configuration(spark, str(tmp_path / "settings.json")).collect()} == {("A:B", "2", True), ("A:C:0", "True", False), ("A:C:1", None, False)}
    (tmp_path / "x.csproj").write_text('<Project><ProjectReference Include="../y/y.csproj" /></Project>')
    assert readers.projects(spark, str(tmp_path / "x.csproj")).first().reference == "../y/y.csproj"


def test_layered_configuration(tmp_path):
    (tmp_path / "a.toml").write_text("[x]\na = 1\nb = 2\n")
    (tmp_path / "b.toml").write_text("[x]\nb = 3\n")
    assert readers.layered_configuration(str(tmp_path / "a.toml"), str(tmp_path / "b.toml"), str(tmp_path / "none"), override={"y": 1}) == {"x": {"a": 1, "b": 3}, "y": 1}
