"""Readers of what the graph engine ingests: file inventories, logs, clone reports, configuration, projects."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import scope_filter

LANGUAGES = {"cs": "csharp", "py": "python", "ts": "typescript", "js": "javascript", "go": "go", "rs": "rust", "java": "java", "json": "json", "xml": "xml", "md": "markdown", "toml": "toml"}


def language(path: Column) -> Column:
    ending, out = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)), F.lit("other")
    for e, name in LANGUAGES.items():
        out = F.when(ending == e, name).otherwise(out)
    return out


def source_inventory(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), ignore: list[str] = ()) -> DataFrame:
    """(path, language, bytes, hash) of the files in scope; contents are hashed where they are read."""
    base = "file:" + root.removeprefix("file:").rstrip("/").replace("//", "/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = files.select(F.regexp_replace(F.col("path"), f"^{base}/", "").alias("path"), F.col("length").alias("bytes"), F.upper(F.sha2("content", 256)).alias("hash"))
    kept = scope_filter(rows.select("path"), list(include), list(exclude), list(ignore)).where("reason = 'included'").select("path")
    return rows.join(kept, "path", "left_semi").select("path", language(F.col("path")).alias("language"), "bytes", "hash")


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """(commit_id, path) from log --name-only text whose commits start with 'commit <id>'."""
    text = spark.read.text(path, wholetext=True)
    blocks = text.select(F.explode(F.slice(F.split("value", r"(?m)^commit "), 2, 1 << 30)).alias("b")).select(F.regexp_extract("b", r"^([0-9a-f]+)", 1).alias("commit_id"), F.split("b", "\n").alias("lines"))
    names = F.filter("lines", lambda x, k: (k > 0) & (x != "") & ~x.rlike(r"^(Author|Date|Merge): |^\s"))
    return blocks.select("commit_id", F.explode(names).alias("path")).distinct()


def git_status(spark: SparkSession, path: str) -> DataFrame:
    """(path, former_path, state) from porcelain -z text; a rename takes two names."""
    text = spark.read.text(path, wholetext=True)
    return text.mapInPandas(_status, "path string, former_path string, state string")


def _status(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for value in frame["value"]:
            names = iter(value.split("\0"))
            for n in names:
                if n:
                    out.append((n[3:], next(names, None) if n[0] in "RC" else None, n[:2].strip()))
        yield pd.DataFrame(out, columns=["path", "former_path", "state"], dtype=object)


CLONE_REPORT = "duplicates array<struct<format:string, lines:int, tokens:int, firstFile:struct<name:string, start:int, end:int>, secondFile:struct<name:string, start:int, end:int>>>"


def clone_report(spark: SparkSession, path: str) -> DataFrame:
    """(clone_id, first, second, tokens, lines) from a clone detector's JSON; a malformed report fails."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", CLONE_REPORT, {"mode": "FAILFAST"})["duplicates"]).alias("d"))
    side = lambda c: F.struct(F.col(f"d.{c}.name").alias("path"), F.col(f"d.{c}.start").alias("start_line"), F.col(f"d.{c}.end").alias("end_line"))
    both = F.sort_array(F.array(side("firstFile"), side("secondFile")))
    return rows.select(both[0].alias("first"), both[1].alias("second"), F.col("d.tokens").alias("tokens"), F.col("d.lines").alias("lines")).withColumn("clone_id", F.sha2(F.to_json(F.struct("first", "second")), 256))


class _Pairs(list):
    """A JSON object with its keys as they stand, repeats included."""


def _flatten(value, prefix: str) -> Iterator[tuple[str, str | None]]:
    if isinstance(value, _Pairs):
        for k, v in value:
            yield from _flatten(v, f"{prefix}:{k}" if prefix else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _flatten(v, f"{prefix}:{i}")
    else:
        yield prefix, None if value is None else str(value)


def json_configuration(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value, duplicate): every leaf of JSON settings under its a:b:c key; keys given twice are marked."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(f, k, v) for f, t in zip(frame["file"], frame["value"], strict=True) for k, v in _flatten(json.loads(t, object_pairs_hook=_Pairs), "")]
            yield pd.DataFrame(out, columns=["file", "key", "value"], dtype=object)

    rows = text.mapInPandas(run, "file string, key string, value string")
    return rows.groupBy("file", "key").agg(F.last("value").alias("value"), (F.count("*") > 1).alias("duplicate"))


def projects(spark: SparkSession, path: str) -> DataFrame:
    """(file, reference): project references of .csproj files."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return text.select("file", F.explode(F.regexp_extract_all("value", F.lit(r'<ProjectReference\s+Include="([^"]+)"'), F.lit(1))).alias("reference"))


def layered_configuration(*paths: str, override: dict | None = None) -> dict:
    """TOML files from weakest to strongest, then override; tables merge, other values replace. Read on the driver."""
    out: dict = {}
    for part in [*(tomllib.loads(Path(p).read_text()) for p in paths if Path(p).exists()), override or {}]:
        _merge(out, part)
    return out


def _merge(into: dict, part: dict) -> None:
    for k, v in part.items():
        if isinstance(v, dict) and isinstance(into.get(k), dict):
            _merge(into[k], v)
        else:
            into[k] = v
