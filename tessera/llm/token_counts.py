"""Token totals by source, language and tokenizer version, kept up by signed deltas.

A rollup is a folder with three kinds of Parquet tables, all append-only:

- ``ledger``: the state of each document and tokenizer that a batch changed;
- ``deltas``: a batch's signed sums by source, language and tokenizer;
- ``commits``: an empty file per batch, made last.

Totals are the sum of the deltas of committed batches.  Committing a batch id
again changes nothing; a batch that broke off before its commit file left
tables that nobody reads and is done anew.  A batch reads only the ledger rows
of the documents it changes (a join on both sides' hashes); sums are
pre-aggregated before they are shuffled, so a source that holds most rows is
not gathered anywhere.

Changes are (op, doc_id, tokenizer, source, lang, n_tokens) with op insert,
revise or delete.  insert and revise both set a document's state: what was
counted before is taken away first, so a repeated insert doesn't count twice.
delete of what isn't there changes nothing.

Defined results: null source, lang or tokenizer is a group of its own; a null
count is 0; changes without a document id are left out; of several changes to
one document and tokenizer in a batch a delete wins, then the largest count,
source and language; empty batches commit; empty rollups have no totals.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.runtime import settle, table_path

#: A text that more than 1/HOT of all rows hold is joined by a broadcast.
HOT = 4096
GROUP = ["source", "lang", "tokenizer"]
LEDGER = "doc_id long, tokenizer string, source string, lang string, n_tokens long, alive boolean, seq long"
DELTAS = "source string, lang string, tokenizer string, d_docs long, d_tokens long, seq long"


class TokenRollup:
    """A rollup below ``root``, a folder that driver and executors share; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._root = spark, root.rstrip("/")

    def _fs(self, path: str):
        target = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()), target

    def commits(self) -> list[tuple[int, str, str]]:
        """(seq, batch id as in the file's name, folder of its tables) of the committed batches, in order."""
        fs, path = self._fs(f"{self._root}/commits")
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return sorted((int(seq), batch, folder) for seq, batch, folder in (n.split("@") for n in names if n.count("@") == 2))

    def _read(self, kind: str, schema: str) -> DataFrame:
        folders = [f"{self._root}/{kind}/{folder}" for _, _, folder in self.commits()]
        if not folders:
            return self._spark.createDataFrame([], schema)
        return self._spark.read.schema(schema).parquet(*folders)

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch; False if it was applied before."""
        done, name = self.commits(), quote(batch_id, safe="")
        if any(batch == name for _, batch, _ in done):
            return False
        seq, folder = (done[-1][0] + 1 if done else 0), uuid.uuid4().hex
        pick = F.max(F.struct((F.col("op") == "delete").alias("gone"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), "source", "lang"))
        new = changes.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"), "tokenizer").agg(pick.alias("x"))
        new = new.select("doc_id", "tokenizer", "x.source", "x.lang", "x.n_tokens", (~F.col("x.gone")).alias("alive"), F.lit(seq).cast("long").alias("seq"))
        new.write.parquet(f"{self._root}/ledger/{folder}")
        new = self._spark.read.schema(LEDGER).parquet(f"{self._root}/ledger/{folder}")
        old = self._current(new).filter("alive") if done else None
        signed = new.filter("alive").select(*GROUP, F.lit(1).alias("d"), F.col("n_tokens").alias("t"))
        if old is not None:
            signed = signed.unionByName(old.select(*GROUP, F.lit(-1).alias("d"), (-F.col("n_tokens")).alias("t")))
        sums = signed.groupBy(*GROUP).agg(F.sum("d").alias("d_docs"), F.sum("t").alias("d_tokens"))
        sums.withColumn("seq", F.lit(seq).cast("long")).write.parquet(f"{self._root}/deltas/{folder}")
        fs, path = self._fs(f"{self._root}/commits/{seq:012d}@{name}@{folder}")
        fs.create(path, False).close()
        return True

    def _current(self, among: DataFrame) -> DataFrame:
        """The last committed state of the documents and tokenizers in ``among``."""
        keys = among.select(F.col("doc_id").alias("k_doc"), F.col("tokenizer").alias("k_tok"))
        rows = self._read("ledger", LEDGER)
        met = rows.join(keys, (F.col("doc_id") == F.col("k_doc")) & F.col("tokenizer").eqNullSafe(F.col("k_tok")), "left_semi")
        last = F.max_by(F.struct("source", "lang", "n_tokens", "alive"), "seq").alias("x")
        return met.groupBy("doc_id", "tokenizer").agg(last).select("doc_id", "tokenizer", "x.*")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of the groups that have documents."""
        sums = self._read("deltas", DELTAS).groupBy(*GROUP).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 OR n_tokens <> 0")


def count_tokens(docs: DataFrame, tokenizers: dict[str, str | None], text_col: str = "text") -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens: a row for each document and tokenizer version.

    The path None stands for words, split at white space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {name: tokens.load(path) if path else None for name, path in tokenizers.items()}
        for batch in batches:
            for name, ids_of in counters.items():
                # one text at a time: beside the batch, no more than a text's own ids is held
                texts = (t.as_py() or "" for t in batch.column(3))
                counts = [len(ids_of(t)) // 4 if ids_of else len(t.split()) for t in texts]
                yield pa.record_batch([*batch.columns[:3], pa.array([name] * len(counts), pa.string()), pa.array(counts, pa.int64())], ["doc_id", "source", "lang", "tokenizer", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, n_tokens long")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id of the documents whose text (null: empty) a smaller id has as well.

    Fewer than ``HOT`` texts can be held by more than 1/HOT of the rows each;
    their first ids are broadcast, so that no text gathers its rows in a task.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(F.coalesce(text_col, F.lit(""))).alias("h")).filter("doc_id IS NOT NULL")
    first = settle(keyed.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "repeated")
    most = F.lit(docs.count() // HOT)
    hot = F.broadcast(first.filter(F.col("n") > most).select("h", "first"))
    rest = keyed.join(hot, "h", "left_anti").join(first.filter(F.col("n") <= most).select("h", "first"), "h")
    return keyed.join(hot, "h").unionByName(rest).filter("doc_id <> first").select("doc_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted with an estimate (a token for four characters), revised to real counts, and repeated texts deleted.

    Every batch is sent twice, as after a lost answer.
    """
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    versions = {"byte_bpe_50k": public_tokenizers.path("byte_bpe_50k.json"), "words": None}
    names = F.explode(F.array(*[F.lit(v) for v in versions])).alias("tokenizer")
    inserts = docs.select(F.lit("insert").alias("op"), "doc_id", "source", "lang", F.expr("coalesce(length(text), 0) div 4 AS n_tokens"), names)
    revised = count_tokens(docs, versions).withColumn("op", F.lit("revise"))
    copies = repeated(docs)
    deletes = copies.select(F.lit("delete").alias("op"), "doc_id", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(0).cast("long").alias("n_tokens"), names)
    rollup = TokenRollup(spark, table_path(spark, "token-counts"))
    for batch, changes in (("load", inserts), ("recount", revised), ("copies", deletes)):
        rollup.commit(batch, changes)
        rollup.commit(batch, changes)
    return rollup.totals()
