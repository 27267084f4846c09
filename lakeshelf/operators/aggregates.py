"""Facets and statistics, each in one pass over the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeshelf.operators.select import matched


def facet_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("count"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"),
        F.min("size").alias("min_size"),
        F.max("size").alias("max_size"),
        F.min("created_at").alias("oldest"),
        F.max("created_at").alias("newest"),
    )


def facet_values(rows: DataFrame) -> DataFrame:
    """(facet, value, count) for kinds, extensions and folders by one pass of grouping sets, and tags."""
    rows = rows.select("kind", F.when(F.col("extension") == "", "(none)").otherwise(F.col("extension")).alias("extension"), "folder", "tags")
    keys = ["kind", "extension", "folder"]
    grouped = rows.groupingSets([[F.col(k)] for k in keys], *(F.col(k) for k in keys)).agg(F.grouping_id().alias("_g"), F.count("*").alias("count"))
    facet = F.when(F.col("_g") == 3, "kind").when(F.col("_g") == 5, "extension").otherwise("folder")
    value = F.when(F.col("_g") == 3, F.col("kind")).when(F.col("_g") == 5, F.col("extension")).otherwise(F.col("folder"))
    tags = rows.select(F.explode("tags").alias("value")).groupBy("value").agg(F.count("*").alias("count"))
    return grouped.select(facet.alias("facet"), value.alias("value"), "count").unionByName(tags.select(F.lit("tag").alias("facet"), "value", "count"))


def facets(files: DataFrame, where: dict | None = None, search: str | dict | None = None) -> dict:
    rows = matched(files, where, search)[0]
    out: dict = facet_summary(rows).first().asDict() | {"kind": {}, "extension": {}, "folder": {}, "tag": {}}
    for r in facet_values(rows).toLocalIterator():
        out[r.facet][r.value] = r["count"]
    return out


def stats_summary(files: DataFrame) -> DataFrame:
    live = F.col("deleted_at") == 0
    return files.agg(
        F.count(F.when(live, 1)).alias("count"),
        F.coalesce(F.sum(F.when(live, F.col("size"))), F.lit(0)).alias("size"),
        F.count(F.when(~live, 1)).alias("trashed_count"),
        F.coalesce(F.sum(F.when(~live, F.col("size"))), F.lit(0)).alias("trashed_size"),
        F.min(F.when(live, F.col("created_at"))).alias("oldest"),
        F.max(F.when(live, F.col("created_at"))).alias("newest"),
    )


def stats_by(files: DataFrame, column: str) -> DataFrame:
    return files.where("deleted_at = 0").groupBy(column).agg(F.count("*").alias("count"), F.sum("size").alias("size"))


def stats(files: DataFrame, chunks: DataFrame | None = None, quota: int | None = None) -> dict:
    from lakeshelf.operators.chunks import physical_size

    out: dict = stats_summary(files).first().asDict()
    physical = physical_size(chunks).first()["physical_size"] if chunks is not None else 0
    out |= {"physical_size": physical, "shared_bytes": max(0, out["size"] - physical), "quota": quota}
    for column in ("kind", "mime"):
        out[f"by_{column}"] = {r[column]: {"count": r["count"], "size": r["size"]} for r in stats_by(files, column).toLocalIterator()}
    return out


def folder_tree(files: DataFrame) -> DataFrame:
    """(path, count): live records in each folder and all below it."""
    parts = F.filter(F.split("folder", "/"), lambda p: p != "")
    paths = F.concat(F.array(F.lit("/")), F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda k: k <= F.size(parts)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, k), "/"))))
    return files.where("deleted_at = 0").select(F.explode(paths).alias("path")).groupBy("path").agg(F.count("*").alias("count"))
