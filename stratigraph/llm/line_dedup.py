r"""Lines that many documents hold, as a bitmap of kept lines for each document.

Every line's key (blanks stripped at both ends, A-Z lower-cased) is known by 96 bits of two hashes. A
document's lines of one key are one row for each 64 lines, (key, document, word, bits), made by an
aggregation with partial results, so that repeated rows never travel. These rows are range-partitioned by
key and document and sorted by key, document and position: a key that a third of all lines have is
spread over many ranges by its documents. The first occurrence of a key in each document is counted along
the order, one sum for each key and range, and keys with least_docs documents select their rows; a
document's bits come together as 64-line words. Only words that lose a line are kept, so a bitmap is as
long as what it drops, and no text is moved to find it.

A document is an id with a text: rows that repeat both are one document for the count, and each of them
gets its row; an id with two texts makes two documents; a null id is an id like others. A null text is
an empty one: one line, with an empty key. Lines with keys of fewer than least_chars code points stay. An empty
table gives no rows. Other columns are not read, so their names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_DOCS, LEAST_CHARS = 10, 1
ID = ["doc_id", "text_hash"]


def _identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("text_hash", F.xxhash64("text"))


def line_key(line: Column) -> Column:
    ascii_only = F.octet_length(line) == F.char_length(line)
    return F.btrim(F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER)), F.lit(BLANKS))


def line_words(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(h, g, doc_id, text_hash, word, bits): where a document holds a key, for each 64 of its lines."""
    lines = _identified(docs).select(*ID, F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    keys = lines.select(*ID, "at", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= max(1, least_chars))
    rows = keys.select(F.xxhash64("key").alias("h"), F.hash("key").alias("g"), *ID, F.expr("CAST(at DIV 64 AS INT)").alias("word"), F.expr("shiftleft(1L, at % 64)").alias("bit"))
    return rows.groupBy("h", "g", *ID, "word").agg(F.bit_or("bit").alias("bits"))


def keep_bitmaps(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, text_hash, n_dropped, keep): for each document that loses lines, keep = [(word, bits)] in order of words.

    Bit i of a word is 1 if line 64 * word + i stays; words that are not named lose nothing.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    words = scratch.keep(line_words(docs, least_chars), "words")
    ordered = words.repartitionByRange("h", "g", *ID).sortWithinPartitions("h", "g", *ID, "word")
    # the range partitioning holds a document's words of a key together: no exchange before the first of them
    first = ordered.groupBy("h", "g", *ID).agg(F.min("word").alias("first_word"))
    counted = first.groupBy("h", "g").agg(F.count("first_word").alias("n_docs")).where(F.col("n_docs") >= least_docs)
    # written, so that both sides of the join are dealt out for it alone and Spark can split a key's rows
    common = scratch.keep(counted.select("h", "g"), "common")
    lost = ordered.join(common, ["h", "g"]).groupBy(*ID, "word").agg(F.bit_or("bits").alias("bits"))
    keep = F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits"))))
    return lost.groupBy(*ID).agg(F.sum(F.bit_count("bits")).alias("n_dropped"), keep.alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): each row of docs with the text that its bitmap leaves."""
    marks = bitmaps.select(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_text"), "n_dropped", "keep")
    rows = _identified(docs).join(marks, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_text")), "left")
    dense = "flatten(transform(keep, (x, k) -> concat(array_repeat(-1L, x.word - coalesce(get(keep, k - 1).word, -1) - 1), array(x.bits))))"
    stays = "(shiftright(coalesce(get(words, CAST(k DIV 64 AS INT)), -1L), k % 64) & 1L) = 1L"
    # the list of words is made once a row: it is the variable of a function, not an expression that each line repeats
    left = F.expr(f"array_join(get(transform(array({dense}), words -> filter(split(text, '\\n', -1), (line, k) -> {stays})), 0), '\\n')")
    kept = F.when(F.col("keep").isNull(), F.col("text")).otherwise(left)
    n_lines = (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    return rows.select("doc_id", n_lines.alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def dedup_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): every row of docs without the lines that least_docs documents hold."""
    return apply_bitmaps(docs, keep_bitmaps(docs, least_docs, least_chars))
