"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair, and its components.

Plan
1. One pass over the texts makes each document's set of shingle hashes, its 64-bit set
   fingerprint and a frequency sketch: 2**20 counters of document frequency over all rows,
   a fixed 4 MB whatever the input. The sketch only orders shingles (rare first); any order
   gives the same links.
2. A second pass emits each set's prefix: the first n - ceil(t n) + 1 shingles in that order.
   Two sets that link share at least one. Copies within a task are emitted once, since a set is
   known by its fingerprint. Rows whose shingle only one set has go at once. Rows of a shingle that
   the sketch puts far over HOT_ROWS are dealt out in parts, in this and in every later join.
3. Rounds. Each bucket of a shared shingle names hubs; its members are verified against these
   (length and positional filters before, suffix filter in front of the full intersection),
   links are closed into components, and what is left are pairs of a bucket in different
   components: all of those are verified in the last round. So a group of n near copies costs
   about n verifications and no link between components is missed.

Hashes have 64 bits: a false link needs two different sets with one fingerprint, expected
n**2 / 2**65 times among n distinct sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sketch
from .components import components
from .storage import Scratch, lean, met
from .textwords import mix, shingle_sets

HUB_ROUNDS = 1
#: a bucket that the sketch puts far over this many rows is looked at in parts of about so many
HOT_ROWS = 1 << 12


def fingerprint(h: np.ndarray) -> int:
    """Of a set of hashes: any order, signed."""
    if not len(h):
        return 0
    total = np.array([h.sum(dtype=np.uint64) + np.uint64(len(h)), mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)], dtype=np.uint64)
    return int(mix(total[:1] * np.uint64(0xD6E8FEB86659FD93) + mix(total[1:])).view(np.int64)[0])


def prefix_length(n: int, percent: int) -> int:
    """Of sets of n that link at percent / 100 or more, this many in a common order hold a shared one."""
    return n - -(-percent * n // 100) + 1 if n else 0


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """At least |x & y|: both sorted sets are cut at the same pivots of x, and parts can't share more than the smaller holds."""
    pivots = x[np.linspace(0, len(x) - 1, (1 << depth) + 1).astype(np.int64)[1:-1]]
    a = np.diff(np.concatenate(([0], np.searchsorted(x, pivots), [len(x)])))
    b = np.diff(np.concatenate(([0], np.searchsorted(y, pivots), [len(y)])))
    return int(np.minimum(a, b).sum())


def links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 |x & y| >= percent |x | y| of two sorted sets."""
    need = -(-percent * (len(x) + len(y)) // (100 + percent))
    if min(len(x), len(y)) < need or suffix_bound(x, y) < need:
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = int((x[at] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _first_pass(width: int, key: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sketch.empty(), set()
        for batch in batches:
            fps, sizes = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, h in shingle_sets(batch, text, width):
                fps[row], sizes[row] = fp, _ = fingerprint(h), len(h)
                if fp not in seen:
                    seen.add(fp)
                    np.add.at(counts, sketch.slots(h), 1)
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(key)), pa.array(fps), pa.array(sizes), none.cast(pa.int32()), none.cast(pa.binary())], ["doc_id", "fp", "n", "chunk", "counts"])
        if seen:
            chunk, own = sketch.chunk_arrays(counts)
            none = pa.nulls(len(chunk)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, chunk, own], ["doc_id", "fp", "n", "chunk", "counts"])

    return run


def _prefixes(width: int, percent: int, text: str, frequencies, hot_rows: int):
    """Rows (h, fp, pos, part): part is 0, or one of the parts of a hot shingle, by the set's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = frequencies.value, set()
        hot = sketch.hot_limit(counts, hot_rows)
        for batch in batches:
            parts: list[tuple] = []
            held = 0

            def flush():
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in parts])) for k in range(4)], ["h", "fp", "pos", "part"])

            for _, h in shingle_sets(batch, text, width):
                fp, n = fingerprint(h), len(h)
                if fp in seen or not n:
                    continue
                seen.add(fp)
                k = prefix_length(n, percent)
                df = counts[sketch.slots(h)]
                if k < n:
                    limit = np.partition(df, k - 1)[k - 1]
                    near = np.flatnonzero(df <= limit)
                    order = near[np.lexsort((h[near], df[near]))][:k]
                else:
                    order = np.lexsort((h, df))
                own = np.full(k, fp, np.int64)
                parts.append((h[order].view(np.int64), own, np.arange(k, dtype=np.int32), sketch.parts(df[order], own, hot, hot_rows)))
                held += k
                if held > 200_000:
                    yield flush()
                    parts, held = [], 0
            if parts:
                yield flush()

    return run


def _own_texts(width: int):
    """Rows (fp, text) whose text has that fingerprint, each fingerprint once: an id that several texts carry gives others too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fps, own = batch.column(0).to_pylist(), []
            for row, h in shingle_sets(batch, "text", width):
                if fps[row] not in seen and fingerprint(h) == fps[row]:
                    seen.add(fps[row])
                    own.append(row)
            yield batch.take(pa.array(own, pa.int64()))

    return run


def _verify(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (a, text_a, b, text_b), those of one a often in a row: its set is made once."""
        last, set_a = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            ok = []
            changes = [i for i in range(len(a)) if i == 0 or a[i] != a[i - 1]]
            sets_a = dict(zip(changes, (h for _, h in shingle_sets(pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(changes))], ["t"]), "t", width)), strict=True)) if changes else {}
            for i, h in shingle_sets(pa.RecordBatch.from_arrays([batch.column(3)], ["t"]), "t", width):
                if i in sets_a:
                    last, set_a = a[i], sets_a[i]
                if last is not None and links(set_a, h, percent):
                    ok.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in ok], pa.int64()), pa.array([b[i] for i in ok], pa.int64())], ["u", "v"])

    return run


def _passes_filters(percent: int, x: str, y: str) -> str:
    """Length, prefix and positional filters of two rows of one shingle as SQL, if it is the first that the sets share.

    For sets of these two sizes the first shared shingle is within n - need + 1 of either. Before it they
    can share no more than either has ahead of it of shingles that other prefixes hold too, behind it
    no more than either has left.
    """
    need = f"(({percent} * ({x}n + {y}n) + {99 + percent}) DIV {100 + percent})"
    return (
        f"{percent} * greatest({x}n, {y}n) <= 100 * least({x}n, {y}n) AND {x}pos <= {x}n - {need} AND {y}pos <= {y}n - {need} AND "
        f"least({x}ahead, {y}ahead) + least({x}n - {x}pos, {y}n - {y}pos) >= {need}"
    )


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Null or empty texts have no shingles and component_id = doc_id; fewer than width words are one
    shingle; equal sets (copies, repeated rows) link; an empty table gives no rows; other columns
    are not read, so their names don't matter.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    first = scratch.keep(docs.mapInArrow(lean(_first_pass(width, "doc_id", "text")), f"doc_id long, fp long, n long, {sketch.CHUNKS}"), "sets")
    frequencies = spark.sparkContext.broadcast(sketch.collect(first))
    sets = first.where("chunk IS NULL").select("doc_id", "fp", "n")

    prefix = docs.select("text").mapInArrow(lean(_prefixes(width, percent, "text", frequencies, HOT_ROWS)), "h long, fp long, pos int, part int")
    shared = _shared_rows(prefix, sets, percent)
    shared = scratch.keep(shared, "shared")
    scratch.release()

    reps = sets.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    wanted = scratch.keep(met(shared.select("fp").distinct(), reps, "fp"), "wanted")
    texts = scratch.keep(met(docs, wanted, "doc_id").select("fp", "text").mapInArrow(lean(_own_texts(width)), "fp long, text string"), "texts")
    scratch.release()

    found, labels, tried = None, None, None
    for k in range(HUB_ROUNDS + 1):
        rows = shared if labels is None else met(shared, labels.select(F.col("u").alias("fp"), F.col("v").alias("c")), "fp", "left").withColumn("c", F.coalesce("c", "fp"))
        if k:
            # only buckets whose members are not all in one component
            mixed = rows.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("part").alias("parts")).where("lo != hi")
            rows = scratch.keep(met(rows, _in_parts(mixed.select("h", "parts")), ["h", "part"]), f"open-{k}")
        else:
            rows = rows.withColumn("c", F.col("fp"))
        pairs = _hub_pairs(rows, percent, k) if k < HUB_ROUNDS else _all_pairs(rows, percent)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = scratch.keep(pairs, f"pairs-{k}")
        new = scratch.keep(_check(pairs, texts, width, percent), f"links-{k}")
        found = new if found is None else found.union(new)
        tried = pairs if tried is None else tried.union(pairs)
        labels = components(found, scratch, f"component-{k}")
        scratch.release()

    leads = scratch.keep(reps.join(labels.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("v", "fp")).select("fp", "root", "doc_id"), "leads")
    least = scratch.keep(leads.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")  # written, so that joins with a large group can be split
    classes = leads.join(least, "root").select("fp", "component_id")
    out = sets.join(classes.withColumn("n", F.lit(1)), (sets["fp"] == classes["fp"]) & (sets["n"] > 0), "left")
    result = out.select(sets["doc_id"], sets["n"].alias("n_shingles"), F.coalesce("component_id", sets["doc_id"]).alias("component_id"))
    result = scratch.keep(result, "result")
    scratch.keep_only("result")
    return result


def first_of_groups(docs: DataFrame, width: int = 5, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component, that with the least id; all columns stay.

    Of rows that repeat an id with one text one stays; rows without id stay.
    """
    found = jaccard_components(docs, width, percent, key, text)
    flags = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("__rows"), F.min("component_id").alias("__first"))
    flags = Scratch(docs.sparkSession, "groups").keep(flags.where("__rows > 1 OR __first != doc_id").withColumnRenamed("doc_id", "__id"), "flags")
    joined = docs.join(flags, docs[key] == flags["__id"], "left").where("__id IS NULL OR __first = __id")
    if not flags.where("__rows > 1").limit(1).count():
        return joined.select(*docs.columns)
    once = joined.where("__id IS NOT NULL").dropDuplicates([key, text])
    return joined.where("__id IS NULL").select(*(docs.columns)).unionByName(once.select(*docs.columns))


def _shared_rows(prefix: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(h, part, fp, n, pos, ahead): prefix rows whose shingle at least two different sets have, each once, and all of hot shingles.

    ahead counts the set's rows before this one. What only one prefix holds can't be shared ahead of a
    shared shingle, so a row too far behind for its own set to reach the threshold goes at once. Sizes come back here, to the
    rows that are left.
    """
    w = Window.partitionBy("h", "part")
    # copies in different tasks give equal rows; these are dropped behind the window, where few rows are left, and
    # by part too, which h and fp decide, so that the window's partitions serve
    held = prefix.withColumn("lo", F.min("fp").over(w)).withColumn("hi", F.max("fp").over(w)).where("lo != hi OR part > 0").select("h", "part", "fp", "pos").dropDuplicates(["h", "part", "fp"])
    sizes = sets.where("n > 0").groupBy("fp").agg(F.first("n").cast("int").alias("n"))
    ranked = met(held, sizes, "fp").withColumn("ahead", F.row_number().over(Window.partitionBy("fp").orderBy("pos")) - 1)
    return ranked.where(f"100 * (ahead + n - pos) >= {percent} * n")


def _in_parts(buckets: DataFrame) -> DataFrame:
    """A row for each part of a bucket, from rows with its number of parts; 0 stands for the only one."""
    return buckets.withColumn("part", F.explode(F.sequence(F.least(F.lit(1), "parts"), "parts")))


def _hub_pairs(rows: DataFrame, percent: int, k: int) -> DataFrame:
    """Each row with its bucket's hub, if that is in another component: the set with the fewest shingles of its own, ties by a hash of round k.

    An original has none, its copies have their edits, so this finds the middle of a group.
    """
    own = (F.col("pos") - F.col("ahead")).alias("own")
    hubs = rows.groupBy("h").agg(F.min(F.struct(own, F.xxhash64("fp", F.lit(k)).alias("r"), "fp", "n", "pos", "ahead", "c")).alias("hub"), F.max("part").alias("parts"))
    pairs = met(rows, _in_parts(hubs), ["h", "part"]).where(f"fp != hub.fp AND c != hub.c AND {_passes_filters(percent, '', 'hub.')}")
    return pairs.select(F.col("hub.fp").alias("a"), F.col("fp").alias("b")).distinct()


def _all_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs of a bucket in different components that pass the filters; each of its parts meets all of its rows."""
    x, y = rows.alias("x"), _in_parts(rows.drop("part")).alias("y")
    pairs = met(x, y, F.expr(f"x.h = y.h AND x.part = y.part AND x.fp < y.fp AND x.c != y.c AND {_passes_filters(percent, 'x.', 'y.')}"))
    return pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()


def _check(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those that link, as (u, v)."""
    both = met(met(pairs, texts.select(F.col("fp").alias("b"), F.col("text").alias("text_b")), "b"), texts.select(F.col("fp").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "text_a", "b", "text_b").mapInArrow(lean(_verify(width, percent)), "u long, v long")
