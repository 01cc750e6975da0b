"""A versioned fact store: nodes, edges, symbols and fingerprints committed together, revision by revision.

Each table is a set of version rows (keys, attributes, run_id, valid_from, valid_to) in hash buckets of its keys. A
commit takes a full snapshot of every table. Each bucket's open rows are known by a digest in the manifest
of the last revision, so a commit reads and writes only the buckets whose facts differ: it joins
their open versions with the facts, closes what changed or vanished at the revision before, opens what is new, and writes the
buckets' rows to a folder of its own. Files that a manifest names are never written again.

A manifest names the files of a revision. It gets its own name in one rename that fails if the name
is there, so readers see whole revisions only, and of two commits on the same base one fails. What a crash
or a refused commit leaves is named by no manifest.

Facts are validated first; an edge that changes its ends, kind or join key, or a symbol that changes its
node, is a conflict also with versions long closed, and nothing is committed then.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import fact_problems
from .storage import checkpointed, hadoop_path


class Conflict(ValueError):
    """The commit contradicts what is stored, or another commit came first."""


class FactTable(NamedTuple):
    keys: list[str]
    fixed: list[str]  # attributes that an id keeps for ever
    said: str


TABLES = {
    "nodes": FactTable(["stable_id"], [], "node"),
    "edges": FactTable(["edge_id"], ["source", "target", "edge_kind", "join_key"], "edge {} changed its source, target, kind or join key"),
    "symbols": FactTable(["symbol_id"], ["node_id"], "symbol {} changed the node that owns it"),
    "fingerprints": FactTable(["symbol_id", "fingerprint_kind"], [], "fingerprint"),
}
VERSION = "run_id string, valid_from long, valid_to long"


class VersionStore:
    """Versions under a folder; buckets is fixed by the first commit and should keep a bucket within what one task writes."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # manifests

    def revisions(self) -> list[int]:
        fs, folder = hadoop_path(self.spark, f"{self.path}/manifests")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.split("-")[1]) for n in names if n.startswith("revision-"))

    def active_revision(self) -> int:
        """The last revision, 0 before the first commit."""
        return max(self.revisions(), default=0)

    def manifest(self, revision: int | None = None) -> dict:
        r = self.active_revision() if revision is None else revision
        if not r:
            return {"revision": 0, "run_id": None, "buckets": self.buckets, "tables": {}}
        text = self.spark.read.text(f"{self.path}/manifests/revision-{r:012d}", wholetext=True).first()
        if text is None:
            raise ValueError(f"no revision {r}")
        return json.loads(text[0])

    def _publish(self, manifest: dict) -> None:
        fs, folder = hadoop_path(self.spark, f"{self.path}/manifests")
        fs.mkdirs(folder)
        jvm = self.spark._jvm
        part = jvm.org.apache.hadoop.fs.Path(folder, f"_{uuid.uuid4().hex}")
        out = fs.create(part)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        name = jvm.org.apache.hadoop.fs.Path(folder, f"revision-{manifest['revision']:012d}")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(part, name, options)  # without OVERWRITE: fails if the name is there
        except Exception as e:
            fs.delete(part, False)
            raise Conflict(f"another commit has made revision {manifest['revision']}") from e

    # reading

    def _bucket(self, table: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*TABLES[table].keys), F.lit(buckets)).cast("int")

    def _files(self, manifest: dict, table: str, buckets: list[int] | None = None) -> list[str]:
        there = manifest["tables"].get(table, {}).get("buckets", {})
        return [f"{self.path}/data/{x['commit']}/{table}/bucket={b}" for b, x in there.items() if buckets is None or int(b) in buckets]

    def _rows(self, manifest: dict, table: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        files = self._files(manifest, table, buckets)
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def versions(self, table: str, revision: int | None = None) -> DataFrame:
        """All version rows, as the manifest of a revision (the active one) has them."""
        m = self.manifest(revision)
        if table not in m["tables"]:
            raise ValueError(f"no facts of {table}")
        return self._rows(m, table, m["tables"][table]["schema"])

    def history_of(self, table: str, *key: str) -> DataFrame:
        """The versions of one id, from its bucket alone."""
        m = self.manifest()
        hashed = self.spark.range(1).select(*[F.lit(v).alias(k) for k, v in zip(TABLES[table].keys, key, strict=True)])
        bucket = hashed.select(self._bucket(table, m["buckets"])).first()[0]
        rows = self._rows(m, table, m["tables"][table]["schema"], [bucket])
        for k, v in zip(TABLES[table].keys, key, strict=True):
            rows = rows.where(F.col(k) == v)
        return rows

    def snapshot(self, table: str, revision: int | None = None) -> DataFrame:
        """The facts as they were at a revision (the active one)."""
        r = self.active_revision() if revision is None else revision
        return self.versions(table).where((F.col("valid_from") <= r) & (F.col("valid_to").isNull() | (F.col("valid_to") >= r))).drop("run_id", "valid_from", "valid_to")

    def identities(self, table: str) -> DataFrame:
        """(keys, fixed attributes, first_seen, last_seen) of every id that ever was."""
        made = F.array(*[F.lit(r).cast("long") for r in self.revisions()])
        until = F.coalesce("valid_to", F.lit(self.active_revision()).cast("long"))
        rows = self.versions(table)
        fixed = [c for c in TABLES[table].fixed if c in rows.columns]
        seen = rows.groupBy(*TABLES[table].keys).agg(*[F.first(c).alias(c) for c in fixed], F.min("valid_from").alias("first_seen"), F.max(until).alias("until"))
        return seen.withColumn("last_seen", F.array_max(F.filter(made, lambda r: r <= F.col("until")))).drop("until")

    # committing

    def commit(self, facts: dict[str, DataFrame], run_id: str, base: int | None = None, revision: int | None = None) -> int:
        """Commits a snapshot of tables as the next revision, or a later number; gives its number.

        base, if given, is the revision that the facts were made from: if another one is active by now, it is a
        conflict. A table that facts lack is committed as empty if it has versions.
        """
        before = self.manifest()
        if base is not None and base != before["revision"]:
            raise Conflict(f"revision {before['revision']} came after {base}")
        r = before["revision"] + 1 if revision is None else revision
        if r <= before["revision"]:
            raise Conflict(f"revision {before['revision']} is there already")
        if before["run_id"] == run_id:
            raise Conflict(f"run {run_id} has been committed")
        buckets = before["buckets"]
        given = {t: checkpointed(df.withColumn("bucket", self._bucket(t, buckets))) for t, df in facts.items()}
        for t, x in before["tables"].items():
            if t not in given:
                given[t] = self.spark.createDataFrame([], x["schema"]).drop("run_id", "valid_from", "valid_to").withColumn("bucket", self._bucket(t, buckets))
        self._validate({t: df.drop("bucket") for t, df in given.items()})
        commit = f"{r:012d}-{uuid.uuid4().hex}"
        try:
            tables = {t: self._merge(before, t, df, run_id, r, commit) for t, df in given.items()}
            self._publish({"revision": r, "run_id": run_id, "buckets": buckets, "tables": tables})
        except BaseException:
            fs, mine = hadoop_path(self.spark, f"{self.path}/data/{commit}")
            with contextlib.suppress(Exception):
                fs.delete(mine, True)
            raise
        return r

    def _validate(self, facts: dict[str, DataFrame]) -> None:
        none = self.spark.createDataFrame([], "edge_id string, source string, target string")
        first = fact_problems(facts["nodes"], facts.get("edges", none), facts.get("symbols"), facts.get("fingerprints")).limit(1).collect()
        if first:
            raise ValueError(f"{first[0]['fact']} {first[0]['id']}: {first[0]['problem']}")

    @staticmethod
    def _digests(df: DataFrame) -> dict[int, list]:
        """Of each bucket (rows, two sums of hashes that take the rows in any order); as many rows as there are buckets."""
        columns = sorted(c for c in df.columns if c != "bucket")
        told = [*columns, *[F.isnull(c) for c in columns]]  # hashes pass over nulls
        sums = df.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*told)).alias("x"), F.sum(F.xxhash64(F.lit(1), *told).cast("decimal(20,0)")).cast("string").alias("s"))
        return {r["bucket"]: [r["n"], r["x"], r["s"]] for r in sums.collect()}

    def _merge(self, before: dict, table: str, given: DataFrame, run_id: str, r: int, commit: str) -> dict:
        t, attributes = TABLES[table], sorted(c for c in given.columns if c not in (*TABLES[table].keys, "bucket"))
        columns = [*t.keys, *attributes]
        schema = ", ".join(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in columns) + ", " + VERSION
        had = before["tables"].get(table, {"schema": schema, "buckets": {}})
        if had["schema"] != schema:
            raise Conflict(f"{table} have other columns than before: {schema}")
        now, entries = self._digests(given), dict(had["buckets"])
        none = [0, None, None]
        touched = [b for b in range(before["buckets"]) if now.get(b, none) != entries.get(str(b), {}).get("digest", none)]
        if not touched:
            return had
        old, new = self._rows(before, table, schema, touched), given.where(F.col("bucket").isin(touched)).select(*columns)
        fixed = [c for c in t.fixed if c in attributes]
        if fixed:
            kept = old.groupBy(*t.keys).agg(F.first(F.struct(*fixed)).alias("was"))
            wrong = new.select(*t.keys, F.struct(*fixed).alias("is")).join(kept, t.keys).where(~F.col("was").eqNullSafe(F.col("is"))).orderBy(*t.keys).limit(1).collect()
            if wrong:
                raise Conflict(t.said.format(wrong[0][t.keys[0]]))
        a = old.where("valid_to IS NULL").select(*t.keys, F.struct(*attributes).alias("was"), F.struct("run_id", "valid_from").alias("made"))
        both = a.join(new.select(*t.keys, F.struct(*attributes).alias("is")), t.keys, "full")
        same = F.col("made").isNotNull() & F.col("is").isNotNull() & F.col("was").eqNullSafe(F.col("is"))
        version = lambda x, run, since, until: F.struct(*[F.col(f"{x}.{c}").alias(c) for c in attributes], run.alias("run_id"), since.cast("long").alias("valid_from"), until.cast("long").alias("valid_to"))
        was = F.when(F.col("made").isNotNull(), version("was", F.col("made.run_id"), F.col("made.valid_from"), F.when(~same, F.lit(r - 1))))
        opened = F.when(F.col("is").isNotNull() & ~same, version("is", F.lit(run_id), F.lit(r), F.lit(None)))
        rows = both.select(*t.keys, F.inline(F.array_compact(F.array(was, opened))))
        rows = old.where("valid_to IS NOT NULL").unionByName(rows).withColumn("bucket", self._bucket(table, before["buckets"]))
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{commit}/{table}")
        for b in touched:
            entries[str(b)] = {"commit": commit, "digest": now.get(b, none)}
        return {"schema": schema, "buckets": entries}
