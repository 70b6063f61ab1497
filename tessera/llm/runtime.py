"""What the operators share: durable intermediate tables and global row numbers.

Intermediate tables are Parquet in the folder that ``spark.checkpoint.dir``
names, which driver and executors share, so that a lost executor costs a
re-read and never a wrong row number.  Only where that setting is missing and
driver and executors are one process, as in tests, does the first call choose a
folder of its own.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: So many ids of 8 bytes are broadcast; beyond, a bitmap of BITS bits is.
FEW_IDS, BITS = 200_000, 1 << 27


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; one of our own only where it is unset and nothing has to be shared."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read from there.

    This cuts the lineage and fixes what may differ between two evaluations
    (sampled range bounds, partition numbers).
    """
    path = table_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.settled_at = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``settle`` that no plan still to be run reads."""
    for df in tables:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small_side(ids: DataFrame, limit: int = 200_000) -> DataFrame:
    """``ids`` (one long), to be broadcast if they are counted to be few; else left to a shuffled join."""
    return F.broadcast(ids) if ids.count() <= limit else ids


def _marked(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with ``_hit``: false only where the id is none of ``ids``.

    One bit a hash value, ``BITS`` bits in all whatever the data (16 MB,
    broadcast): the more ids, the more rows are marked in vain.
    """
    at = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(BITS))
    bits = ids.filter(F.col(id_col).isNotNull()).select(at(id_col).alias("_at"))
    bits = bits.groupBy(F.expr("bitmap_bucket_number(_at) AS _cell")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_at)) AS _bits"))
    met = rows.withColumn("_at", at(id_col)).withColumn("_cell", F.expr("bitmap_bucket_number(_at)")).join(F.broadcast(bits), "_cell", "left")
    byte = "conv(hex(substring(_bits, cast(bitmap_bit_position(_at) div 8 as int) + 1, 1)), 16, 10)"
    hit = F.expr(f"coalesce(getbit(cast({byte} as int), cast(bitmap_bit_position(_at) % 8 as int)) = 1, false)")
    return met.withColumn("_hit", hit).drop("_at", "_cell", "_bits")


def having(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id is one of ``ids`` (a settled table of this one column).

    Few ids (counted) are broadcast; of more, a bitmap of fixed size is, and
    only the rows that it marks are shuffled.
    """
    if ids.count() <= FEW_IDS:
        return rows.join(F.broadcast(ids), id_col, "left_semi")
    return _marked(rows, ids, id_col).filter("_hit").drop("_hit").join(ids, id_col, "left_semi").select(rows.columns)


def lacking(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id is none of ``ids``, found as in ``having``; rows without an id are among them."""
    if ids.count() <= FEW_IDS:
        return rows.join(F.broadcast(ids), id_col, "left_anti")
    marked = _marked(rows, ids, id_col)
    doubtful = marked.filter("_hit").drop("_hit").join(ids, id_col, "left_anti").select(rows.columns)
    return marked.filter("NOT _hit").select(rows.columns).unionByName(doubtful)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def number_rows(df: DataFrame, order: list[Column], name: str, position: str = "pos") -> DataFrame:
    """Add ``position``: 0, 1, ... in the given order over the whole table.

    A range sort, one pass, and one count per output partition; no row meets
    all others in one task.  The order must be total for the numbers to be
    the same in every run.  The per-partition counts that reach the driver are
    as many as shuffle partitions.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order)
    stored = settle(ranged.withColumn("_row", F.monotonically_increasing_id()), name)
    counts = stored.groupBy(F.shiftright("_row", 33).alias("_part")).count().orderBy("_part").collect()
    starts, total = {}, 0
    for part, n in counts:
        starts[part] = total
        total += n
    if not starts:
        return stored.withColumn(position, F.lit(0).cast("long")).drop("_row")
    offset = spark.createDataFrame(list(starts.items()), "_part long, _start long")
    numbered = stored.withColumn("_part", F.shiftright("_row", 33)).join(F.broadcast(offset), "_part")
    within = F.col("_row") - F.shiftleft(F.col("_part"), 33)
    return numbered.withColumn(position, F.col("_start") + within).drop("_row", "_part", "_start")
