"""Packing documents into sequences by bounded-space online packing.

Each partition keeps ``OPEN`` windows.  A document's ids are cut into full
windows and a rest; the rest goes to the open window with the least room that
holds it.  If none does, the fullest window is filled up with the rest's
beginning and emitted, and what is left is placed in a window of its own.
What stays open at a partition's end (less than one window after joining) is
merged with the leftovers of ``FAN`` other partitions, and so on until one
group is left; its last tokens are cut into sequences of powers of two, which
need no padding.

Only leftovers carry ids beyond the first pass, at most one window for each
partition; every other piece leaves it as numbers and a checksum.

Defined results: a null or empty text is its closing id alone; a null id is
carried along; repeated rows are packed each; other columns are left out; an
empty table gives an empty result.  Texts are tokenized whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.runtime import settle

WINDOW = 2048
#: Open windows of a partition, and partitions whose leftovers meet in one task.
OPEN, FAN = 16, 64
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, group long, ids binary"
NAMES = [x.split()[0] for x in PIECE.split(", ")]
TYPES = [pa.int64()] * 8 + [pa.binary()]

class Packer:
    """Open windows of one partition; what is finished collects in ``rows``."""

    def __init__(self, window: int, open_windows: int, base: int, group: int):
        self.window, self.limit, self.sequence, self.group = window, open_windows, base, group
        self.open: list[list] = []  # [tokens, pieces]
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, tokens in pieces:
            self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), tokens, self.sequence, at, None, None))
            at += len(ids) // 4
        self.sequence += 1

    def add(self, doc: int | None, start: int, ids: bytes, tokens: int) -> None:
        """Place a piece; cut it where that fills a window."""
        room = 4 * self.window
        whole = len(ids) // room * room
        for at in range(0, whole, room):
            self._emit([(doc, start + at // 4, ids[at : at + room], tokens)])
        rest, start = ids[whole:], start + whole // 4
        if not rest:
            return
        n = len(rest) // 4
        fits = [w for w in self.open if w[0] + n <= self.window]
        if fits:
            best = max(fits, key=lambda w: w[0])
        elif len(self.open) < self.limit:
            self.open.append(best := [0, []])
        else:
            fullest = max(self.open, key=lambda w: w[0])
            free = self.window - fullest[0]
            self._emit([*fullest[1], (doc, start, rest[: 4 * free], tokens)])
            self.open.remove(fullest)
            rest, start, n = rest[4 * free :], start + free, n - free
            self.open.append(best := [0, []])
        best[0] += n
        best[1].append((doc, start, rest, tokens))
        if best[0] == self.window:
            self._emit(best[1])
            self.open.remove(best)

    def close(self, last: bool) -> None:
        """Join the open windows; keep the rest for a merge, or (last) cut it into powers of two."""
        pieces = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        left = sum(len(p[2]) // 4 for p in pieces)
        self.open = []
        while left >= self.window or (last and left):
            want = self.window if left >= self.window else 1 << (left.bit_length() - 1)
            left -= want
            taken = []
            while want:
                doc, start, ids, tokens = pieces.pop(0)
                n = min(want, len(ids) // 4)
                taken.append((doc, start, ids[: 4 * n], tokens))
                if n < len(ids) // 4:
                    pieces.insert(0, (doc, start + n, ids[4 * n :], tokens))
                want -= n
            self._emit(taken)
        for doc, start, ids, tokens in pieces:
            self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), tokens, None, None, self.group, ids))

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), TYPES, strict=True)], NAMES)
            self.rows = []


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, open_windows: int = OPEN, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packer, ids_of, end = Packer(window, open_windows, part << 40, part), tokens.load(tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids_of(text.as_py()) + end
                packer.add(doc, 0, ids, len(ids) // 4)
            yield from packer.batches()
        packer.close(last=False)
        yield from packer.batches()

    def merge(level: int, last: bool):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            group = key[0].as_py()
            packer = Packer(window, open_windows, (level << 60) + (group << 40), group)
            table = table.sort_by([("group", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
            for doc, start, ids, tokens in zip(*(table[c].to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
                packer.add(doc, start, ids, tokens)
            packer.close(last)
            out = [pa.array(c, t) for c, t in zip(zip(*packer.rows, strict=True), TYPES, strict=True)] if packer.rows else [pa.array([], t) for t in TYPES]
            return pa.table(dict(zip(NAMES, out, strict=True)))

        return run

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    stored = settle(rows.mapInArrow(first, PIECE), "packing-1")
    done, left, level = stored.filter("sequence_id IS NOT NULL"), stored.filter("sequence_id IS NULL"), 1
    while True:
        groups = left.agg(F.max("group")).first()[0]
        last = groups is None or groups < FAN
        met = left.withColumn("group", F.expr(f"`group` div {FAN}")).groupBy("group").applyInArrow(merge(level, last), PIECE)
        met = settle(met, f"packing-{level + 1}")
        done = done.unionByName(met.filter("sequence_id IS NOT NULL"))
        if last:
            break
        left, level = met.filter("sequence_id IS NULL"), level + 1
    return done.drop("group", "ids").withColumnRenamed("doc_id", id_col)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
