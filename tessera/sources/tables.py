"""Sources and sinks: tables as CSV, JSON and Parquet, ranking lists, files by path and digest."""

from __future__ import annotations

import gzip
import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import rules


def read_csv(spark: SparkSession, path: str, schema: str | None = None, literal: bool = False) -> DataFrame:
    """A CSV with a header; without a schema its columns are typed by their values.  literal: no value means null, and a byte order mark before the first name is dropped."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if literal:
        reader = reader.option("nullValue", "\x00").option("emptyValue", "")
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    if literal:  # the reader gives unquoted empty fields as nulls
        df = df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit("")) for c, t in df.dtypes if t == "string"})
    elif not schema:
        df = typed(df)
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns if c.startswith("﻿")})


def typed(df: DataFrame) -> DataFrame:
    """String columns with the usual spellings of no value as nulls, and as longs, doubles or booleans where all their values are."""
    columns = {c: F.when(~F.col(f"`{c}`").isin(*rules.NO_VALUE), F.col(f"`{c}`")) for c, t in df.dtypes if t == "string"}
    df = df.withColumns(columns)
    if not columns:
        return df
    kinds = ("bigint", "double", "boolean")
    fits = [(F.count(F.expr(f"try_cast(`{c}` AS {k})")) == F.count(f"`{c}`")).alias(f"{i}:{k}") for i, c in enumerate(columns) for k in kinds]
    found = df.agg(*fits, *[F.count(f"`{c}`").alias(f"{i}:n") for i, c in enumerate(columns)]).first()
    return df.withColumns({c: F.col(f"`{c}`").cast(k) for i, c in enumerate(columns) if found[f"{i}:n"] and (k := next((k for k in kinds if found[f"{i}:{k}"]), None))})


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """key and value (JSON text) of whole-file JSON objects, gzip-compressed or not; any other document raises."""
    texts = spark.read.text(path, wholetext=True)
    parsed = texts.select(F.col("value").alias("text"), F.from_json("value", "map<string,string>").alias("entries"))
    sound = F.when(F.ltrim("text").startswith("{") & F.col("entries").isNotNull(), F.col("entries")).otherwise(F.raise_error(F.lit("not a JSON object")).cast("map<string,string>"))
    return parsed.select(F.explode(F.map_entries(sound)).alias("e")).select("e.key", "e.value")


def search_rankings(lists: DataFrame, compact: DataFrame, queries: list[str], arms: list[str]) -> DataFrame:
    """The flattened lists if they cover the whole design, else the compact table; raises if that doesn't either."""
    for found in (flatten_rankings(lists), compact.select("query", "arm", "rank", "space_id")):
        if missing_lists(found, queries, arms).isEmpty():
            return found
    raise ValueError("neither the lists nor the compact table cover the design")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Whole-file JSON documents, gzip-compressed or not."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def canonical_json(payload: object) -> bytes:
    """JSON whose bytes depend on the content alone."""
    return (json.dumps(payload, sort_keys=True, ensure_ascii=False, indent=2) + "\n").encode()


def canonical_gzip(payload: object) -> bytes:
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as f:
        f.write(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode())
    return out.getvalue()


def fixed_zip(files: dict[str, bytes]) -> bytes:
    """A ZIP whose bytes depend on the files alone."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), files[name], zipfile.ZIP_DEFLATED)
    return out.getvalue()


def flatten_rankings(lists: DataFrame) -> DataFrame:
    """query, arm, rank (from 1), space_id of (query, arm, items); an empty list is one row of rank 0 and id ''."""
    at = lists.select("query", "arm", F.posexplode_outer("items").alias("pos", "item"))
    return at.select("query", "arm", F.coalesce(F.col("pos") + 1, F.lit(0)).alias("rank"), F.coalesce("item", F.lit("")).alias("space_id"))


def missing_lists(rankings: DataFrame, queries: list[str], arms: list[str]) -> DataFrame:
    """The designed (query, arm) lists that a table doesn't cover; empty if it is complete."""
    spark = rankings.sparkSession
    design = spark.createDataFrame([(q, a) for q in queries for a in arms], "query string, arm string")
    return design.join(rankings.select("query", "arm").distinct(), ["query", "arm"], "left_anti")


def file_manifest(spark: SparkSession, path: str, max_bytes: int = 512_000) -> DataFrame:
    """file_path, bytes, sha256, content (null above ``max_bytes``) of the files of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("file_path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.when(F.col("length") <= max_bytes, F.col("content")).alias("content"))


def cache_key(*parts):
    """The content address of (space, revision, path)."""
    return F.sha2(F.concat_ws("\n", *parts), 256)
