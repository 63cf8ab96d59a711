"""Readers: each is a file scan plus a parser that also works on rows from elsewhere."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import gpu
from fleetlens.functions import json_values as J
from fleetlens.functions.text import strip
from fleetlens.operators import fleet, lifecycle, offers, state

PAGE_SCHEMA = "listing_id string, page_no int, after_token string, raw string"


def _whole_files(spark: SparkSession, path: str, column: str = "raw") -> DataFrame:
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias(column)
    )


def read_offers(spark: SparkSession, path: str) -> DataFrame:
    """Offers of market answer files; an unparsable file gives no rows."""
    return offers.parse_offers(_whole_files(spark, path))


def read_offer_lines(spark: SparkSession, path: str) -> DataFrame:
    """Offers of JSON lines, one offer each; large files are read by many tasks."""
    lines = spark.read.text(path).select(F.concat(F.lit("["), F.col("value"), F.lit("]")).alias("raw"))
    return offers.parse_offers(lines)


def read_instance_lines(spark: SparkSession, path: str) -> DataFrame:
    """Candidates and rejects of JSON lines ``{"listing_id": ..., "record": {...}}``; large listings are read by many tasks."""
    lines = spark.read.text(path).withColumn("_line", J.fields(J.parse(F.col("value")), "listing_id", "record"))
    records = lines.where(F.col("_line").isNotNull()).select(
        F.try_variant_get("_line.listing_id", "$", "string").alias("listing_id"), F.col("_line.record").alias("record")
    )
    return fleet.normalize_records(records, F.col("record"))


def read_instance_lists(spark: SparkSession, path: str) -> DataFrame:
    """Candidates and rejects of whole-listing files, one listing per file."""
    listings = fleet.list_documents(_whole_files(spark, path).withColumnRenamed("path", "listing_id"))
    return fleet.normalize_records(fleet.explode_records(listings.where(F.col("error") == "")), F.col("record"))


def read_instance_pages(spark: SparkSession, path: str) -> DataFrame:
    """Candidates and rejects of captured pages, JSON lines of ``listing_id, page_no, after_token, raw``."""
    pages = fleet.open_pages(spark.read.schema(PAGE_SCHEMA).json(path))
    return fleet.normalize_records(fleet.paged_records(pages), F.col("record"))


def read_state_documents(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """State documents as rows ``path, kind, raw``."""
    return _whole_files(spark, path).withColumn("kind", F.lit(kind))


def read_batch_state(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Units of the documents that load, and the documents that do not with their error."""
    loaded = state.load_documents(read_state_documents(spark, path, kind))
    return state.loaded_units(loaded), loaded.where(F.col("action").isin("reject", "archive")).drop("units")


def read_batch_state_lenient(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Documents with the verdict of the skipping loader."""
    return state.load_lenient(read_state_documents(spark, path, kind))


def parse_calibration(lines: DataFrame, workload: str | Column, line: str = "value") -> DataFrame:
    """Timing records of one workload; blank, corrupt and non-object lines are dropped."""
    text = strip(F.col(line))
    record = lines.where(text != "").withColumn("record", J.parse(text)).where(J.is_object(F.col("record")))
    return record.where(J.string(J.field(F.col("record"), "workload")) == workload)


def load_calibration(spark: SparkSession, path: str, workload: str) -> DataFrame:
    """Timing records of one workload from JSON lines; a missing path gives no rows."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], "value string")
    if "workload_key" in lines.columns:
        lines = lines.where(F.col("workload_key") == workload)
    return parse_calibration(lines, workload).select("record")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Inventory of a folder tree without reading the files: ``key, size, modified_ts``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(
        _relative(F.col("path"), root).alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_ts")
    )


def collect_outputs(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Files of a folder tree with content; a missing or unreadable file is skipped."""
    reader = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("ignoreMissingFiles", "true")
        .option("ignoreCorruptFiles", "true")
    )
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select(_relative(F.col("path"), root).alias("rel_path"), F.col("length").alias("size"), "content")


def collect_lines(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Lines of the text files of a folder tree: ``rel_path, line``. A large file is read in ranges by many tasks, and many small ones by one."""
    reader = spark.read.option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(root).select(_relative(F.col("_metadata.file_path"), root).alias("rel_path"), F.col("value").alias("line"))


def _relative(path: Column, root: str) -> Column:
    """Part of a file path after ``root``, whatever scheme the scan adds in front."""
    base = root.split(":", 1)[-1].strip("/") + "/"
    return F.substr(path, F.locate(base, path) + len(base))


def read_lifecycle_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of configuration files; the bucket is the file's base name."""
    files = _whole_files(spark, path)
    bucket = F.regexp_extract("path", r"([^/]+?)(?:\.json)?\z", 1)
    return lifecycle.parse_rules(files.select(bucket.alias("bucket"), "raw"))


def parse_telemetry(lines: DataFrame, line: str = "csv_line", *, min_memory_mib: int = 0) -> DataFrame:
    """Add ``temp_c, mem_mib, ecc``; lines of unknown shape get NULLs."""
    reading = gpu.telemetry(F.col(line), min_memory_mib=min_memory_mib)
    return lines.withColumn("_t", reading).select("*", "_t.*").drop("_t")


def parse_diagnostics(documents: DataFrame) -> DataFrame:
    """Sections of diagnostic texts ``path, raw``: header values, section name and body."""
    titles = F.regexp_extract_all("raw", F.lit(r"(?m)^## (.+) ##$"), 1)
    bodies = F.split("raw", r"(?m)^## .+ ##$\n?")

    def header(name: str) -> Column:
        return F.regexp_extract("raw", rf"(?m)^# {name}: (.*)$", 1)

    return (
        documents.withColumn("_titles", titles)
        .withColumn("_bodies", F.slice(bodies, 2, F.greatest(F.size(bodies), F.lit(1))))
        .select(
            "path",
            F.regexp_extract("raw", r"\A# [a-z-]+ diagnostics for (.*)", 1).alias("unit"),
            header("instance_id").alias("instance_id"),
            header("captured_at").alias("captured_at"),
            F.posexplode(F.arrays_zip("_titles", "_bodies")).alias("pos", "_s"),
        )
        .select(
            "path",
            "unit",
            "instance_id",
            "captured_at",
            "pos",
            F.col("_s._titles").alias("section"),
            F.regexp_replace("_s._bodies", r"\n+\z", "").alias("body"),
        )
    )


def read_diagnostics(spark: SparkSession, path: str) -> DataFrame:
    """Sections of diagnostic files."""
    return parse_diagnostics(_whole_files(spark, path))
