"""Sources: JSON documents and lines, tool logs, pages of catalogues, files. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLAIMS = "claim_id string, context_id string, claim_text string, resolved_claim string, claim_type string"
SEGMENTS = "seq int, start double, end double, text string, words array<struct<text:string,start:double,end:double>>, scene_index int, slide_number int"
CONTEXT = "struct<context_id:string,text:string,start_time:double,end_time:double,scene_index:int,source_segment_indices:array<int>>"
MERGED = f"domain string, subdomain string, slides array<struct<slide_number:int,title:string,slide_text:string,time_range:string,contexts:array<{CONTEXT}>>>"
METADATA = "filename string, scene_index int, slide_number int, timestamp_sec double, frame_no int, capture_type string, scene_type string, person_presence_ratio double"


def json_document(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Whole-file JSON documents; broken ones are rows of nulls, or an error if ``strict``."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def json_lines(spark: SparkSession, path: str, schema: str = CLAIMS, key: str = "claim_id") -> DataFrame:
    """JSON lines; blank and broken lines and those without the key are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).filter(F.col(key).isNotNull())


def silences(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, end, duration`` from silence-detection logs: starts and ends paired by place within a file."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    start = F.regexp_extract("value", r"silence_start:\s*(-?[0-9.]+)", 1).try_cast("double")
    end = F.regexp_extract("value", r"silence_end:\s*(-?[0-9.]+)", 1).try_cast("double")
    long = F.regexp_extract("value", r"silence_duration:\s*(-?[0-9.]+)", 1).try_cast("double")
    nr = F.row_number().over(Window.partitionBy("file").orderBy("at"))
    starts = lines.select("file", "at", start.alias("start")).filter("start is not null").select("file", nr.alias("nr"), "start")
    ends = lines.select("file", "at", end.alias("end"), long.alias("duration")).filter("end is not null").select("file", nr.alias("nr"), "end", "duration")
    return starts.join(ends, ["file", "nr"]).filter("end > start and duration > 0").select("file", "start", "end", "duration")


def contexts(merged: DataFrame) -> DataFrame:
    """One row for each context of merged documents, numbered within its slide; missing ids are made from the numbers."""
    slides = merged.select("domain", "subdomain", F.explode("slides").alias("s"))
    rows = slides.select("domain", "subdomain", F.col("s.slide_number").alias("slide_number"), F.col("s.title").alias("title"), F.posexplode("s.contexts").alias("at", "c"))
    made = F.format_string("S%03d-C%03d", F.col("slide_number"), F.col("at") + 1)
    return rows.select("domain", "subdomain", "slide_number", "title", (F.col("at") + 1).alias("context_index"), F.coalesce(F.nullif("c.context_id", F.lit("")), made).alias("context_id"), "c.text", "c.start_time", "c.end_time")


def first_file(listing: DataFrame, key: str, path: str, order: list[str]) -> DataFrame:
    """The first existing of several candidate suffixes for each key."""
    rank = F.coalesce(*[F.when(F.col(path).endswith(s), k) for k, s in enumerate(order)])
    best = Window.partitionBy(key).orderBy("_rank", path)
    return listing.withColumn("_rank", rank).filter("_rank is not null").withColumn("_nr", F.row_number().over(best)).filter("_nr = 1").drop("_rank", "_nr")


# The fields of a catalogue's model that are kept.
MODEL_FIELDS = "mode:string, max_input_tokens:long, max_output_tokens:long, supports_reasoning:boolean, supports_vision:boolean, supports_function_calling:boolean, supports_response_schema:boolean, supports_web_search:boolean, supports_pdf_input:boolean"


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Models of all stored pages of a catalogue (JSON documents with a ``data`` array): one row for each provider and id.

    An id may stand as ``model`` and a provider as ``litellm_provider``; entries without either are left out. Of
    repeated entries the last stays, by the pages' file names and the places in them.
    """
    item = f"id:string, model:string, provider:string, litellm_provider:string, {MODEL_FIELDS}"
    pages = spark.read.schema(f"data array<struct<{item}>>").option("multiLine", True).json(path)
    rows = pages.select(F.input_file_name().alias("_file"), F.posexplode("data").alias("_at", "m"))
    told = lambda *names: F.coalesce(*[F.nullif(F.trim(f"m.{n}"), F.lit("")) for n in names])
    names = [f.split(":")[0] for f in MODEL_FIELDS.split(", ")]
    rows = rows.select("_file", "_at", told("id", "model").alias("id"), told("provider", "litellm_provider").alias("provider"), *[f"m.{n}" for n in names])
    last = F.max(F.struct("_file", "_at", *names)).alias("m")
    return rows.filter("id is not null and provider is not null").groupBy("provider", "id").agg(last).select("id", "provider", *[f"m.{n}" for n in names])


def providers(models: DataFrame) -> DataFrame:
    """Each provider of a catalogue with how many models it has."""
    return models.groupBy(F.col("provider").alias("id")).agg(F.count("*").alias("model_count"))
