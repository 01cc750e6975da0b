"""Line dedup against a plain version: awkward rows, a line that most documents hold, bitmaps."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from stratigraph.llm.line_dedup import dedup_lines, keep_bitmaps, line_words

from .common import AWKWARD, DOCS, LOWER, docs

BLANKS = " \t\n\x0b\x0c\r"


def plain(rows, least=10):
    key = lambda line: line.translate(LOWER).strip(BLANKS)
    of = collections.defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            of[key(line)].add((r[0], r[1] or ""))
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        left = [x for x in lines if not key(x) or len(of[key(x)]) < least]
        out.append((r[0], len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in df.collect()), key=str)


SHARED = [(100 + i, f"  Follow us!\t\nown line {i}\n\nFOLLOW US!\nodd {i % 11}\n{'é' if i % 2 else 'É'}tude", "en", "a", 1) for i in range(60)]
LONG = [(500, "\n".join("follow us!" if i % 3 == 0 else f"line {i}" for i in range(5000)), "en", "a", 1), (501, "\n" * 300 + "follow us!", None, None, None)]


@pytest.mark.parametrize("least", [2, 10])
def test_as_plain(spark, least):
    rows = AWKWARD + SHARED + LONG
    assert result(dedup_lines(docs(spark, rows), least)) == plain(rows, least)


def test_repeated_rows_are_one_document(spark):
    rows = [(1, "a\nb", None, None, None)] * 12 + [(2, "a", None, None, None)] + [(None, None, None, None, None)] * 3
    assert result(dedup_lines(docs(spark, rows), 2)) == plain(rows, 2)
    assert dedup_lines(docs(spark, rows), 3).agg(F.sum("n_dropped")).first()[0] == 0


def test_one_id_with_many_texts(spark):
    rows = [(1, f"a\n{i}", None, None, None) for i in range(12)] + [(None, f"a\n{i}", None, None, None) for i in range(3)]
    assert result(dedup_lines(docs(spark, rows), 10)) == plain(rows, 10)


def test_no_rows_and_clashing_columns(spark):
    assert dedup_lines(docs(spark, []), 10).collect() == []
    rows = SHARED[:20]
    extra = docs(spark, rows).selectExpr("*", "1 AS h", "2 AS g", "'x' AS keep", "3 AS word", "4 AS n_dropped", "5 AS of_doc", "6 AS text_hash")
    assert result(dedup_lines(extra, 10)) == plain(rows, 10)


def test_bitmaps_hold_only_what_loses_lines(spark):
    rows = SHARED + [(900, "\n".join(f"u{i}" for i in range(640)) + "\nfollow us!", None, None, None), (901, "nothing", None, None, None)]
    maps = {r["doc_id"]: r for r in keep_bitmaps(docs(spark, rows)).collect()}
    assert 901 not in maps and len(maps) == 61
    assert [(k["word"], k["bits"]) for k in maps[900]["keep"]] == [(10, ~1)] and maps[900]["n_dropped"] == 1


def test_hot_line_travels_as_words_and_sums(spark):
    """A key of all documents is spread over ranges, and its count is one row for each range."""
    df = spark.range(20_000).selectExpr("id AS doc_id", "concat('same\n', id) AS text")
    words = line_words(df)
    ranges = words.repartitionByRange(16, "h", "g", "doc_id", "text_hash")
    sizes = [r["count"] for r in ranges.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2.5 * 40_000 / 16
    kept = dedup_lines(df, 10)
    plan = kept._jdf.queryExecution().toString()
    assert "rangepartitioning" in plan.lower() and "Python" not in plan and "Arrow" not in plan
    assert kept.where("n_dropped != 1 OR kept != CAST(doc_id AS STRING)").count() == 0


def test_digest(spark):
    from stratigraph.llm.queries import QUERIES

    from ..conftest import SF

    rows = spark.read.parquet(f"{SF}/documents.parquet").select(*[c.split()[0] for c in DOCS.split(", ")]).collect()
    want = sorted(((a, b, c, hashlib.sha256(d.encode()).hexdigest()) for a, b, c, d in plain([tuple(r) for r in rows])), key=str)
    got = QUERIES["op11_line_dedup"](spark, SF).collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got), key=str) == want
