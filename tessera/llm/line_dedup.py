"""Line dedup in DataFrame operations only.

Every line's key becomes a hash with the line's document and position.  The
rows are range-partitioned by hash and sorted by hash, document and position;
one pass over them finds the first document of each hash, and the lines of
others are dropped.  A hash that very many lines share is dealt over ``SALTS``
ranges by document: a line that isn't of its range's first document is dropped
there; what is left, at most one document for each range, meets in a second
pass.  The result is a bitmap per document, run-length coded, and no text; the
kept text is cut from the documents afterwards.

Hashes are 128 bits wide (two 64-bit hashes).  Defined results: null and empty
texts are one empty line; texts and lines may be as long as a row can be; a
null document id is a document of its own that comes after all others; rows
that repeat an id are one document; columns named n_lines, n_dropped,
keep_bitmap or kept_text are replaced by the results, all others are carried
along untouched (names that begin with ``_ld_`` are reserved); an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.runtime import parallelism

#: Ranges over which the lines of one hash are dealt.
SALTS = 16
#: Characters stripped at a line's ends (fixed values: tab, line feed, vertical tab, form feed, carriage return, space).
BLANKS = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def bitmaps(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_ld_id, _ld_text (a hash of the text), _ld_gone (the dropped lines' positions, in order) of each text that loses lines.

    ``dedup`` turns the positions into kept runs (start, length) of 32-bit
    big-endian integers, the keep_bitmap, where it knows a text's last line.
    """
    n = parallelism(docs.sparkSession)
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
    key = F.translate(F.trim(F.col("line"), F.lit(BLANKS)), UPPER, LOWER)
    keyed = lines.withColumn("key", key).filter(F.length("key") >= min_chars)
    keyed = keyed.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"), F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id")).alias("doc"), "text", "pos")
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("doc.id"), F.lit(SALTS)))
    ranged = salted.repartitionByRange(n, "h", "g", "salt").sortWithinPartitions("h", "g", "salt", "doc", "pos")
    # rows come sorted by document, so the first row of a key is of its first document
    in_range = Window.partitionBy("h", "g", "salt").orderBy("doc", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one_pass = ranged.withColumn("first", F.first("doc").over(in_range))
    firsts = one_pass.filter("doc = first").groupBy("h", "g", "doc").agg(F.collect_list(F.struct("text", "pos")).alias("at"))
    whole = Window.partitionBy("h", "g").orderBy("doc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = firsts.withColumn("first", F.first("doc").over(whole)).filter("doc <> first").select(F.col("doc.id").alias("id"), F.inline("at"))
    dropped = one_pass.filter("doc <> first").select(F.col("doc.id").alias("id"), "text", "pos").unionByName(later)
    per_text = dropped.groupBy("id", "text").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    return per_text.select(F.col("id").alias("_ld_id"), F.col("text").alias("_ld_text"), F.col("gone").alias("_ld_gone"))


def dedup(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_lines, n_dropped, keep_bitmap and kept_text."""
    found = bitmaps(docs, min_chars, id_col, text_col)
    rows = docs.withColumn("_ld_key", F.xxhash64(F.coalesce(text_col, F.lit(""))))
    met = rows.join(found, rows[id_col].eqNullSafe(F.col("_ld_id")) & (F.col("_ld_key") == F.col("_ld_text")), "left").withColumn("_ld_lines", _lines(F.col(text_col)))
    met = met.withColumn("_ld_gone", F.coalesce("_ld_gone", F.expr("cast(array() as array<int>)")))
    # kept runs lie between neighbouring dropped positions
    runs = F.expr(
        "filter(transform(sequence(0, size(_ld_gone)), i -> struct("
        "CASE WHEN i = 0 THEN 0 ELSE _ld_gone[i - 1] + 1 END AS start,"
        "CASE WHEN i = size(_ld_gone) THEN size(_ld_lines) ELSE _ld_gone[i] END - CASE WHEN i = 0 THEN 0 ELSE _ld_gone[i - 1] + 1 END AS len)), r -> r.len > 0)"
    )
    met = met.withColumn("_ld_runs", runs)
    kept = F.expr("array_join(flatten(transform(_ld_runs, r -> slice(_ld_lines, r.start + 1, r.len))), '\\n')")
    bitmap = F.expr("unhex(array_join(transform(_ld_runs, r -> concat(lpad(hex(r.start), 8, '0'), lpad(hex(r.len), 8, '0'))), ''))")
    return met.withColumns(
        {"n_lines": F.size("_ld_lines").cast("long"), "n_dropped": F.size("_ld_gone").cast("long"), "keep_bitmap": bitmap, "kept_text": F.when(F.size("_ld_gone") == 0, F.coalesce(text_col, F.lit(""))).otherwise(kept)}
    ).drop("_ld_id", "_ld_text", "_ld_key", "_ld_lines", "_ld_gone", "_ld_runs")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, i, s, translate(trim(s, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(a) AS s, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))
), f AS (
  SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
), m AS (
  SELECT l.doc_id, l.i, l.s, f.k IS NOT NULL AND l.doc_id <> f.first AS gone FROM l LEFT JOIN f ON l.k = f.k
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
