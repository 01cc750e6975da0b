"""Quality rules as a bitmask ledger, in Spark expressions only.

Every rule is evaluated once; a ledger row keeps the measurements and one failure bit per rule.
A policy is a versioned set of rules: applying another one, or asking what a rule alone
rejects, reads the ledger and never the texts again.

Null texts count as empty: no words, so they fail. Repeated rows and null ids are judged row by
row; an empty table gives an empty ledger. Columns of the input that clash with a measurement
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: rule name -> condition of failure over the measurements, in the order of bits; the first two are the base
RULES = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 20 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 16 * n_words",
    "shouting": "100 * n_upper > 60 * word_chars",
}
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


POLICIES = {p.version: p for p in (Policy("base", BASE), Policy("v1", tuple(RULES)))}


def _count_chars(text: Column, chars: str) -> Column:
    """How many characters of an ASCII set a text has."""
    total = F.lit(0)
    for c in chars:
        total = total + (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))))
    return total


def _zip_next(a: str, step: int, combine) -> Column:
    """combine(x[i], x[i + step]) of all i; both arrays come straight from a column, so nothing is made anew per element."""
    n = F.size(a) - step
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + step), n), combine)


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper).

    Windows of 8 words are compared by 64-bit hashes within a text.
    """
    t = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    t = t.select(
        "doc_id",
        "t",
        F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("t", "\n"), lambda x: F.octet_length(F.btrim(x, F.lit(SPACES))) > 0).alias("lines"),
    )
    t = t.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        (F.char_length("t") - _count_chars(F.col("t"), SPACES)).cast("long").alias("word_chars"),
        _count_chars(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.octet_length("t") - F.octet_length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        F.when(F.size("words") >= WINDOW, F.transform("words", lambda w: F.xxhash64(w))).alias("h1"),
    )
    rest = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_upper"]
    for step in (1, 2, 4):  # 2, 4, then 8 words
        t = t.select(*rest, F.when(F.col(f"h{step}").isNotNull(), _zip_next(f"h{step}", step, lambda a, b: F.xxhash64(a, b))).alias(f"h{2 * step}"))
    t = t.select(*rest, "h8", (F.size(F.array_distinct("h8")) < F.size("h8")).alias("again"))
    t = t.select(*rest, F.when(F.col("again"), F.sort_array(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("sorted"))
    found = F.flatten(F.filter(_zip_next("sorted", 1, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull()))
    t = t.select(*rest, F.when(F.col("sorted").isNotNull(), F.sort_array(F.array_distinct(found))).alias("at"))
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, i: F.struct((i + WINDOW).alias("end"), (s["n"] + F.least(F.lit(WINDOW), i + WINDOW - s["end"])).alias("n")),
        lambda s: s["n"],
    )
    return t.select(*rest, F.coalesce(F.when(F.col("at").isNotNull(), covered), F.lit(0)).cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The measurements and fail_bits: bit k is set if rule k of RULES fails."""
    bits = F.lit(0).cast("long")
    for k, condition in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, key, text).withColumn("fail_bits", bits)


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """A ledger with kept: no rule of the policy fails."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """(policy, rule, n_failed, n_only): rejected by the rule, and by it alone; the latter would be kept without it."""
    hit = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    sums = []
    for rule in policy.rules:
        bit = 1 << list(RULES).index(rule)
        sums += [F.count_if(hit.bitwiseAND(F.lit(bit)) != 0).alias(f"{rule}_failed"), F.count_if(hit == bit).alias(f"{rule}_only")]
    wide = rows.agg(*sums)
    stack = ", ".join(f"'{r}', {r}_failed, {r}_only" for r in policy.rules)
    return wide.selectExpr(f"'{policy.version}' AS policy", f"stack({len(policy.rules)}, {stack}) AS (rule, n_failed, n_only)")


def keep_good(docs: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """The rows that the policy keeps, with their columns as they were.

    The row number keeps the optimiser from pushing the filter down, which would put all measurements
    into one condition and evaluate shared parts many times over.
    """
    names = docs.columns
    judged = apply_policy(ledger(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text).alias("text")), key="row"), policy)
    return judged.select("doc_id", "kept", F.monotonically_increasing_id().alias("n")).where("kept AND n >= 0").select("doc_id.*")
