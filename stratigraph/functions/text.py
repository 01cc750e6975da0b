"""Shared conventions: rounding, tokens, set similarity, globs, identities, pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = "\x1f"


def r6(x: Column) -> Column:
    """Six decimals, halves away from zero."""
    return F.round(x, 6)


def r6e(x: Column) -> Column:
    """Six decimals, halves to even."""
    return F.bround(x, 6)


def tokens(text: Column) -> Column:
    """Distinct upper-case tokens: split at . : / \\ _ - space and from lower to upper case."""
    split = F.split(F.regexp_replace(text, r"(\p{Ll})(\p{Lu})", "$1 $2"), r"[.:/\\_\- ]+")
    return F.array_distinct(F.transform(F.filter(split, lambda t: t != ""), F.upper))


def name_tokens(text: Column) -> Column:
    """Distinct upper-case tokens: split at what is neither letter nor digit and before an upper behind a lower or digit."""
    split = F.split(F.regexp_replace(text, r"([\p{Ll}\p{Nd}])(\p{Lu})", "$1 $2"), r"[^\p{L}\p{Nd}]+")
    return F.array_distinct(F.transform(F.filter(split, lambda t: t != ""), F.upper))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """|a & b| / |a | b| of two arrays without repeats; empty if both are."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(empty)).otherwise(both / (F.size(a) + F.size(b) - both))


def edge_id(source: Column, target: Column, kind: Column, join_key: Column) -> Column:
    return F.concat(F.lit("edge:"), F.upper(F.sha2(F.concat_ws(UNIT, source, target, kind, F.coalesce(join_key, F.lit(""))), 256)))


def sha256_upper(text: Column) -> Column:
    return F.upper(F.sha2(text, 256))


def glob_regex(glob: str) -> str:
    """A repository glob as an anchored regular expression.

    * and ? stay within a segment, ** is any number of whole segments; a glob of one segment matches any segment of a path.
    """
    parts = [p for p in glob.replace("\\", "/").split("/") if p]
    if not parts:
        raise ValueError("empty glob")
    piece = lambda p: "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in p)
    if len(parts) == 1 and parts[0] != "**":
        return f"(^|.*/){piece(parts[0])}($|/.*)"
    out, started = "^", False
    for k, p in enumerate(parts):
        if p == "**":
            if k == len(parts) - 1:
                out += "(/.*)?" if started else ".*"
            else:
                out += "(/[^/]+)*" if started else "([^/]+/)*"
        else:
            out += ("/" if started else "") + piece(p)
            started = True
    return out + "$"


def page(df: DataFrame, order: list, limit: int, offset: int = 0, most: int = 500) -> DataFrame:
    """A page in a total order, with the count of all rows in total."""
    if not 1 <= limit <= most or not 0 <= offset <= 1_000_000:
        raise ValueError("page out of bounds")
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def top_truncated(df: DataFrame, order: list, limit: int) -> DataFrame:
    """The first limit rows and whether there were more, by one row more."""
    rows = df.orderBy(*order).limit(limit + 1)
    place = F.row_number().over(Window.orderBy(*order))  # at most limit + 1 rows
    return rows.withColumn("place", place).withColumn("truncated", (F.max("place").over(Window.partitionBy()) > limit)).where(F.col("place") <= limit).drop("place")


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1))
