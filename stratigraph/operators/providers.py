"""Joins of provider facts: constructor dependencies, call sites, declarations to embed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import block_of, every_level, span_blocks, span_level
from ..functions.text import edge_id, sha256_upper


def dependency_consumptions(sites: DataFrame, types: DataFrame, registrations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (edge_identity, source, target, join_key, confidence) and diagnostics (site_id, diagnostic) of constructor dependencies.

    sites (site_id, file_path, consumer_type, service_type): the consumer is the one type of that name in the
    same file, the service the one of that name anywhere, and it has to be registered; with several
    implementations (registrations source, target) the edge stays and the site is told.
    """
    in_file = types.groupBy("file_path", F.col("name").alias("consumer_type")).agg(F.count("*").alias("n"), F.min("stable_id").alias("source")).where("n = 1").drop("n")
    anywhere = types.groupBy(F.col("name").alias("service_type")).agg(F.count("*").alias("n"), F.min("stable_id").alias("target")).where("n = 1").drop("n")
    registered = registrations.groupBy(F.col("source").alias("target")).agg(F.countDistinct("target").alias("implementations"))
    found = sites.join(in_file, ["file_path", "consumer_type"]).join(anywhere, "service_type", "left").join(registered, "target", "left")
    why = F.when(F.col("target").isNull(), "unresolved_constructor_dependency").when(F.col("implementations").isNull(), "unregistered_constructor_dependency").when(F.col("implementations") > 1, "ambiguous_di_registration")
    told = found.select("site_id", why.alias("diagnostic")).where("diagnostic IS NOT NULL")
    kept = found.where("implementations IS NOT NULL").select("source", "target", F.col("service_type").alias("join_key")).distinct()
    return kept.select(edge_id(F.col("source"), F.col("target"), F.lit("di_consumes"), F.col("join_key")).alias("edge_identity"), "source", "target", "join_key", F.lit(0.8).alias("confidence")), told


def smallest_scope(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """(site_id, symbol_id): the symbol with the smallest range that holds a place (file_path, line, column), ties to the smallest id.

    Ranges (file_path, start_line, start_column, end_line, end_column) are listed by level and block of lines,
    so the join is on (file, level, block). A line counts as 1,000,000 columns. Equal ranges are one with their smallest id,
    and equal places are looked up once; places times levels are never broadcast, whatever size Spark takes them for.
    """
    at, span_at = ["file_path", "line", "column"], ["file_path", "start_line", "start_column", "end_line", "end_column"]
    listed = symbols.groupBy(*span_at).agg(F.min("symbol_id").alias("symbol_id")).withColumn("level", span_level(F.col("start_line"), F.col("end_line")))
    listed = listed.withColumn("block", F.explode(span_blocks(F.col("start_line"), F.col("end_line"), F.col("level"))))
    looked = sites.select(*at).distinct().withColumn("level", every_level()).withColumn("block", block_of(F.col("line"), F.col("level")))
    here = F.struct("line", "column")
    held = looked.join(listed.hint("merge"), ["file_path", "level", "block"]).where((here >= F.struct(F.col("start_line").alias("line"), F.col("start_column").alias("column"))) & (here <= F.struct(F.col("end_line").alias("line"), F.col("end_column").alias("column"))))
    span = (F.col("end_line") - F.col("start_line")).cast("long") * 1_000_000 + F.col("end_column") - F.col("start_column")
    places = held.groupBy(*at).agg(F.min(F.struct(span.alias("span"), "symbol_id")).alias("m"))
    best = sites.select("site_id", *at).join(places.hint("merge"), at).groupBy("site_id").agg(F.min("m").alias("m"))
    return sites.select("site_id").join(best.hint("merge"), "site_id", "left").select("site_id", F.col("m.symbol_id").alias("symbol_id"))


#: kinds of important nodes that get chunks
CHUNK_KINDS = ("PublicApi", "PublicType")


def embedding_chunks(sources: DataFrame, declarations: DataFrame, eligible: DataFrame) -> DataFrame:
    """(stable_id, path, content, content_hash): the declaration that stands for each public API or type, as the text to embed.

    sources (stable_id, path, start_line, end_line); declarations (path, decl_start, decl_end, declaration_kind, is_type,
    signature, documentation, body, text); eligible (stable_id, kind). Of the declarations within a source's
    lines the shortest type is taken, with its kind, documentation and source; without a type the shortest method, with
    signature, documentation and body. A method without a body gives no chunk. Equally long ones go by place; what is not known
    comes last. A source with several ranges gets one chunk for all of them.
    """
    wanted = eligible.where(F.col("kind").isin(*CHUNK_KINDS)).select("stable_id").distinct()
    spans = sources.join(wanted, "stable_id", "left_semi").withColumn("level", span_level(F.col("start_line"), F.col("end_line")))
    spans = spans.select("stable_id", "path", "start_line", "end_line", "level", F.explode(span_blocks(F.col("start_line"), F.col("end_line"), F.col("level"))).alias("block"))
    # places alone meet the spans, so that texts travel once, to the sources that have chosen them
    places = declarations.select("path", "decl_start", "decl_end", "is_type", F.char_length("text").alias("size"), F.xxhash64("declaration_kind", "signature", "documentation", "body", "text").alias("mark"))
    looked = places.withColumn("level", every_level()).withColumn("block", block_of(F.col("decl_start"), F.col("level")))
    held = looked.join(spans.hint("merge"), ["path", "level", "block"]).where("decl_start >= start_line AND decl_end <= end_line")
    last = lambda c: F.col(c).isNull().alias(f"no_{c}")
    best = held.groupBy("stable_id").agg(F.min(F.struct(last("is_type"), ~F.col("is_type"), last("size"), "size", "decl_start", "decl_end", "path", "mark")).alias("m"))
    chosen = best.select("stable_id", "m.path", "m.decl_start", "m.decl_end", "m.mark")
    told = declarations.withColumn("mark", F.xxhash64("declaration_kind", "signature", "documentation", "body", "text")).dropDuplicates(["path", "decl_start", "decl_end", "mark"])
    full = chosen.join(told, ["path", "decl_start", "decl_end", "mark"])
    or_none = lambda c: F.coalesce(c, F.lit(""))
    of_type = F.concat(F.lit("declaration: "), or_none("declaration_kind"), F.lit("\ndocumentation: "), or_none("documentation"), F.lit("\nsource:\n"), or_none(F.btrim("text")))
    of_method = F.concat(F.lit("signature: "), or_none("signature"), F.lit("\ndocumentation: "), or_none("documentation"), F.lit("\nbody:\n"), F.btrim("body"))
    content = F.when(F.col("is_type"), of_type).when(~blank("body"), of_method)
    rows = full.select("stable_id", "path", content.alias("content")).where("content IS NOT NULL")
    return rows.withColumn("content_hash", sha256_upper(F.col("content")))


JOIN_KEY_SCHEMA = "provider-join-key/v1"
JOIN_KEY_STRATEGIES = ("TypeEquality", "StringEquality", "CanonicalPattern", "ConfigurationPath")


def blank(column: str) -> Column:
    """Null, empty, or nothing but white space of any kind."""
    return ~F.coalesce(F.col(column), F.lit("")).rlike(r"(?U)\S")


def join_keys(sites: DataFrame) -> DataFrame:
    """(site_id, schema_version, steps, problem) of typed join keys; problem is null for a valid one.

    sites (site_id, capture_name, strategy, raw_value, normalized_value, normalizer_id, steps, and perhaps schema_version); steps is an
    array of (kind, value). A key needs a capture name, one of four strategies, a normalised value, a
    normaliser, and steps with kinds; equal steps are refused; type equality needs a symbol normaliser, a canonical
    pattern a placeholder step, a configuration path a separator step. Steps of a valid key are in order of kind and value.
    """
    version = F.coalesce("schema_version", F.lit(JOIN_KEY_SCHEMA)) if "schema_version" in sites.columns else F.lit(JOIN_KEY_SCHEMA)
    has = lambda kind: F.exists("steps", lambda s: s["kind"] == kind)
    told = F.transform("steps", lambda s: F.concat(s["kind"], F.lit("\x1f"), F.coalesce(s["value"], F.lit(""))))
    bad_step = F.exists("steps", lambda s: s.isNull() | ~F.coalesce(s["kind"], F.lit("")).rlike(r"(?U)\S"))
    missing = blank("capture_name") | ~F.coalesce(F.col("strategy").isin(*JOIN_KEY_STRATEGIES), F.lit(False)) | blank("normalized_value") | blank("normalizer_id") | F.col("steps").isNull() | F.coalesce(bad_step, F.lit(False))
    problem = (
        F.when(version != JOIN_KEY_SCHEMA, "unsupported_schema").when(missing, "incomplete").when(F.size(F.array_distinct(told)) != F.size("steps"), "repeated_step")
        .when((F.col("strategy") == "TypeEquality") & ~F.startswith("normalizer_id", F.lit("csharp-symbol")), "symbol_normalizer_needed")
        .when((F.col("strategy") == "CanonicalPattern") & ~has("placeholder"), "placeholder_needed")
        .when((F.col("strategy") == "ConfigurationPath") & ~has("separator"), "separator_needed")
    )
    ordered = F.array_sort(F.transform("steps", lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"))))
    return sites.select("site_id", version.alias("schema_version"), F.when(problem.isNull(), ordered).alias("steps"), problem.alias("problem"))
