"""The driver's tables as files of a shelf."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeshelf.operators.ingest import derive

EPOCH = 1_700_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer partitions; a larger table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _id(column: str) -> F.Column:
    return F.lpad(F.col(column).cast("string"), 12, "0")


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a text file; labels mark favourites (quality) and trash (toxic)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    docs = spread(table(spark, sf_dir, "documents")).join(labels, "doc_id", "left")
    raw = docs.select(
        _id("doc_id").alias("id"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        F.lit("text/plain").alias("mime"),
        F.coalesce("text", F.lit("")).cast("binary").alias("content"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.array("lang", "source").alias("tags"),
        F.concat(F.lit("/docs/"), F.col("lang"), F.lit("/"), F.col("source")).alias("folder"),
        F.coalesce(F.col("quality"), F.lit(0)).alias("favorite"),
        (F.lit(EPOCH) + F.col("doc_id") * 1000).alias("created_at"),
        F.when(F.col("toxic") == 1, F.lit(EPOCH)).otherwise(F.lit(0)).alias("deleted_at"),
        F.to_json(F.struct("lang", F.col("n_chars").alias("length"), F.struct("source").alias("origin"))).alias("metadata"),
    )
    return derive(raw)


def parts_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as an empty record whose metadata are its columns; sizes are the parts' sizes."""
    raw = table(spark, sf_dir, "part").select(
        _id("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.lit("application/json").alias("mime"),
        F.lit(b"").cast("binary").alias("content"),
        F.split("p_name", " ").alias("tags"),
        F.concat(F.lit("/parts/"), F.col("p_brand")).alias("folder"),
        (F.lit(EPOCH) + F.col("p_partkey") * 1000).alias("created_at"),
        F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.array(F.col("p_type"), F.col("p_brand")).alias("labels"))).alias("metadata"),
        F.lit(None).cast("string").alias("text"),
        F.col("p_size").cast("long").alias("declared_size"),
    )
    return derive(raw)


def binary_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Files below a directory as rows for derive, their folders relative to it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    root = path.rstrip("/").split(":", 1)[-1].lstrip("/")
    local = F.regexp_replace("path", r"^[a-z0-9]+:/+", "")
    inside = F.substring(local, len(root) + 2, F.length(local))
    return reader.load(path).select(
        F.sha2(F.col("path"), 256).alias("id"),
        F.regexp_extract(inside, r"([^/]+)$", 1).alias("name"),
        F.regexp_replace(inside, r"[^/]+$", "").alias("folder"),
        "content",
        F.unix_millis("modificationTime").alias("created_at"),
    )
