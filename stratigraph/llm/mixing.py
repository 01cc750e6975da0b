"""Mixing sources to target weights by weighted fair queueing, in Spark expressions only.

Documents of a source queue in a seeded random order. A document's virtual finish time is the
source's words up to its end divided by the source's weight; a second lap over the source goes on
where the first ended. Serving all queues in that order until the budget is used is serving up to
one virtual time, at which each source has got weight x time words, or both its laps if these are
fewer. So that time follows from one sum per source: it is found in a few steps, each of which takes
the sources that are used up by then out of the sharing. Documents that finish by it are taken whole,
the one in service at it as far as it is served. The mix is range-sorted by finish time.

The running sum of a source is split: sums of 4096 slices of its order, then the running sum within
each slice. So a source with most of the rows is spread over 4096 tasks' worth of groups. Sources
may be many as well: they are numbered within ranges of their names and by the ranges' counts.

Null texts have size 0 and are never taken; null sources are one source, last in order; repeated rows
are documents of their own; an empty table gives no rows; if all sizes are 0, all targets are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LAPS = 2
#: hexadecimal digits of a document's place that name its slice
SLICE_DIGITS = 3


def n_words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text, 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def numbered(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """sources with their number in the order of names, from 0, null last; no task sees more than a range of names."""
    kept = scratch.keep(sources.repartitionByRange("no_source", "source_key").withColumn("range", F.spark_partition_id()), "sources")
    counts = kept.groupBy("range").agg(F.count("*").alias("n"))
    before = Window.partitionBy().orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("no_source", "source_key")) - 1
    return kept.withColumn("place", place).join(starts, "range").withColumn("number", F.col("start") + F.col("place")).drop("range", "place", "start")


def cut_time(sources: DataFrame, share: float, laps: int) -> float | None:
    """The virtual time at which share x all words are served, from (source_size, weight); None if all laps are fewer."""
    used_up, time = F.lit(False), 0.0
    while True:
        row = sources.agg(F.sum("source_size").alias("size"), F.sum(F.when(used_up, F.col("source_size")).otherwise(0)).alias("gone"), F.sum(F.when(used_up, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        if not row["weight"]:
            return None
        new = (share * row["size"] - laps * row["gone"]) / row["weight"]
        if new <= time:
            return time
        time = new
        used_up = laps * F.col("source_size") / F.col("weight") < time


def targets(slices: DataFrame, scratch: Scratch, weights: tuple = WEIGHTS, share: float = SHARE, laps: int = LAPS) -> DataFrame:
    """slices (no_source, source_key, slice, words) -> (no_source, source_key, source_size, weight, cut, target).

    Sources in code point order, null last, get the weights in turn. They share share x all words by
    weight; none gets more than laps x its own, the rest is shared again by weight.
    """
    sizes = numbered(slices.groupBy("no_source", "source_key").agg(F.sum("words").alias("source_size")), scratch)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    sizes = scratch.keep(sizes.select("no_source", "source_key", "source_size", weight.alias("weight")), "weights")
    cut, most = F.lit(cut_time(sizes, share, laps)).cast("double"), laps * F.col("source_size").cast("double")
    return sizes.select("*", cut.alias("cut"), F.coalesce(F.least(F.col("weight") * cut, most), most).alias("target"))


def queue(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", carry: bool = False, seed: int = 17) -> DataFrame:
    """Each row as (row, doc_id, size, source_size, target, taken, copies, virtual_finish); row holds the input row if carry.

    taken: the words served by the cut, both laps counted; copies: how often the whole document is
    taken, counting a lap if at least half of it is.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if carry else F.lit(None).cast("string")
    rows = docs.select(row.alias("row"), F.col(key).alias("doc_id"), n_words(F.col(text)).alias("size"), F.col(source).isNull().alias("no_source"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source_key"))
    rows = rows.withColumn("place", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))).withColumn("slice", F.substring("place", 1, SLICE_DIGITS))
    slices = scratch.keep(rows.groupBy("no_source", "source_key", "slice").agg(F.sum("size").alias("words")), "slices")
    in_source = Window.partitionBy("no_source", "source_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select("*", F.coalesce(F.sum("words").over(in_source), F.lit(0)).alias("start")).drop("words").join(targets(slices, scratch), ["no_source", "source_key"])
    in_slice = Window.partitionBy("no_source", "source_key", "slice").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = rows.join(starts, ["no_source", "source_key", "slice"]).select("*", (F.col("start") + F.sum("size").over(in_slice)).alias("end"))
    taken, copies = F.lit(0).cast("long"), F.lit(0)
    for lap in range(LAPS):
        begin = F.col("end") - F.col("size") + lap * F.col("source_size")
        finish = (F.col("end") + lap * F.col("source_size")) / F.col("weight")
        in_service = F.greatest(F.lit(0), F.least(F.col("size"), F.floor(F.col("cut") * F.col("weight")) - begin))
        served = F.when(F.col("cut").isNull() | (finish <= F.col("cut")), F.col("size")).when(begin / F.col("weight") < F.col("cut"), in_service).otherwise(0)
        taken = taken + served
        copies = copies + F.when((F.col("size") > 0) & (2 * served >= F.col("size")), 1).otherwise(0)
    return queued.select("row", "doc_id", "size", "source_size", "target", taken.alias("taken"), copies.alias("copies"), (F.col("end") / F.col("weight")).alias("virtual_finish"), "weight")


def mix_plan(docs: DataFrame, **names) -> DataFrame:
    """(doc_id, size, source_size, target, taken, virtual_finish) of all rows in order of virtual finish time."""
    return queue(docs, **names).drop("row", "copies", "weight").orderBy("virtual_finish", "doc_id")


def mixed(docs: DataFrame, **names) -> DataFrame:
    """The mix itself: the rows of docs, those of second laps again, range-sorted by virtual finish time."""
    taken = queue(docs, carry=True, **names).where("copies > 0")
    laps = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("lap"), "virtual_finish", "source_size", "weight")
    return laps.orderBy(F.col("virtual_finish") + (F.col("lap") - 1) * F.col("source_size") / F.col("weight")).select("row.*")
