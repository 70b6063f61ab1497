"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its groups.

A document's set is its distinct shingles (64-bit hashes).  Sets are ordered by
an estimate of how many documents hold a shingle, rare ones first, then by
hash.  If two sets have o shingles in common, their prefixes of length
``size - o + l`` share at least l.  Each document takes the l in 1..``MOST``
that costs least by those estimates: a longer prefix means longer lists to go
through, but a candidate must then be met l times before it is verified.  A
pair is held to the smaller l of its two, and to the prefixes that its two
sizes leave it: o grows with both, so documents of like size meet by the first
ninth of their shingles, and only unlike sizes use the whole prefix of a fifth.

The estimates are a sketch of ``SKETCH`` counters over all documents, of fixed
size; they only steer the order, l and the salting, never the result.

Equal sets are one representative.  Only the groups are wanted, so pairs are
found in rounds: each document of a list meets the list's leader (rows grow
with the lists, not with their squares), verified links join groups, and the
rounds go on with other leaders between different groups as long as a round
takes away a tenth of the pairs that are left, and these are many.
Then all pairs of different groups in a list are candidates, so that no link
between groups is lost.  Pairs that were refuted are not compared again.  Lists
of shingles that the sketch knows as frequent are dealt over salts in every
step; texts are read, not shuffled: what is shuffled of a document is its
prefix, and its set once a round for those that are in a candidate pair.

Defined results: null or empty texts, and texts without words, have no
shingles and link with nothing; a text of fewer words than a shingle is one
shingle, apart from any longer text's; rows that repeat an id are one node and
each keep a row; rows whose id is null keep a row, count as no member and have
a null component; texts may be as long as a row can be (batches are worked on
in slices of ``SLICE`` bytes); extra columns are left out, so none can clash;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.runtime import discard, having, lacking, parallelism, settle

#: Counters of the frequency sketch, a power of two; a broadcast of one byte each.
SKETCH = 1 << 20
#: Counters of one row of a partial sketch.
CELL = 1 << 14
#: Largest number of shared prefix shingles asked for, and a verification's cost in list entries.
MOST, VERIFY = 4, 32
#: Pairs that are compared in full at once, besides two for each entry.
FEW_PAIRS = 100_000
#: Entries of a list that one task is given, by the sketch's estimate.
PER_TASK = 11  # as a power of two
#: Bytes of text that a worker splits at once.
SLICE = 8 << 20


def slices(batch: pa.RecordBatch, column: int = 1) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``SLICE`` bytes of text, one row at least."""
    import numpy as np

    texts = batch.column(column)
    ends = np.cumsum(np.diff(np.frombuffer(texts.buffers()[1], "<i4")[texts.offset : texts.offset + len(texts) + 1])) if len(texts) else np.zeros(0)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield batch.slice(at, end - at)
        at = end


def shingle_sets(texts: pa.Array, n: int) -> list:
    """Each text's distinct shingle hashes, sorted; words are split at ASCII white space, A-Z lower-cased."""
    import numpy as np
    import pyarrow.compute as pc
    import xxhash

    texts = pc.coalesce(texts, pa.scalar("", pa.string()))
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    counts = np.asarray(split.value_lengths())
    # white space at either end leaves an empty word
    empty = distinct.index(b"") if b"" in distinct else -1
    if empty >= 0:
        real = codes != empty
        row = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(row[real], minlength=len(counts))
        codes = codes[real]
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], "u8")[codes] if len(codes) else np.zeros(0, "u8")
    mixed = np.zeros(0, "u8")
    if len(h) >= n:
        mixed = np.full(len(h) - n + 1, 0x9E3779B97F4A7C15, "u8")
        for j in range(n):
            mixed = (mixed ^ h[j : len(h) - n + 1 + j]) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
    out, at = [], 0
    for count in counts.tolist():
        if count >= n:
            s = np.sort(mixed[at : at + count - n + 1])
            fresh = np.empty(len(s), bool)
            fresh[0], fresh[1:] = True, s[1:] != s[:-1]
            out.append(s[fresh])
        elif count:
            out.append(np.array([xxhash.xxh3_64_intdigest(np.append(h[at : at + count], np.uint64(count)).astype("u8").tobytes())], "u8"))
        else:
            out.append(np.zeros(0, "u8"))
        at += count
    return out


def _cells_of(sets: list):
    """The sketch counter of each shingle of the sets, one after the other."""
    import numpy as np

    return (np.concatenate(sets) >> np.uint64(44)).astype("i8") & (SKETCH - 1)


def _describe(n: int):
    """Rows (id, n, key) of each document, then a partition's partial sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        sketch, used = np.zeros(SKETCH, "<u4"), False
        for batch in batches:
            for piece in slices(batch):
                sets = shingle_sets(piece.column(1), n)
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                sketch += np.bincount(_cells_of(sets), minlength=SKETCH).astype("<u4")
                used = True
                none = pa.nulls(len(sets), pa.int32())
                yield pa.record_batch({"id": piece.column(0), "n": pa.array([len(s) for s in sets], pa.int64()), "key": pa.array(keys, pa.binary()), "cell": none, "counts": pa.nulls(len(sets), pa.binary())})
        if used:
            cells = SKETCH // CELL
            yield pa.record_batch(
                {
                    "id": pa.nulls(cells, pa.int64()),
                    "n": pa.nulls(cells, pa.int64()),
                    "key": pa.nulls(cells, pa.binary()),
                    "cell": pa.array(range(cells), pa.int32()),
                    "counts": pa.array([x.tobytes() for x in sketch.reshape(cells, CELL)], pa.binary()),
                }
            )

    return run


def _add_cells(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    total = np.zeros(CELL, "i8")
    for batch in batches:
        for x in batch.column("counts"):
            total += np.frombuffer(x.as_py(), "<u4")
    yield pa.record_batch({"cell": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})


def _weights(described: DataFrame):
    """A byte for each counter: 0 for a usual count, else the bits of what it has above that."""
    import numpy as np

    # in two steps, so that no task adds more than a few partial sketches; a row for each of SKETCH / CELL cells is left
    cells = described.filter("cell IS NOT NULL").select("cell", "counts").groupBy("cell").applyInArrow(_add_cells, "cell int, counts binary")
    sketch = np.zeros(SKETCH, "i8")
    for x in cells.toLocalIterator():
        sketch[x.cell * CELL : (x.cell + 1) * CELL] = np.frombuffer(x.counts, "<i8")
    usual = np.median(sketch)
    above = sketch - usual - 8 * np.sqrt(usual + 1) - 4
    return np.where(above > 0, np.ceil(np.log2(np.maximum(above, 1) + 1)), 0).astype("u1")


def needed(size: int, threshold: int) -> int:
    """Least intersection with which a set of this size can reach the threshold (in percent)."""
    return -(-size * threshold // 100)


def _prefixes(n: int, threshold: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        weights = sent.value
        for batch in batches:
            for piece in slices(batch):
                ids, tokens, sizes, places, asks, salts = [], [], [], [], [], []
                for id_, s in zip(piece.column(0).to_pylist(), shingle_sets(piece.column(1), n), strict=True):
                    if not len(s):
                        continue
                    weight = weights[(s >> np.uint64(44)).astype("i8") & (SKETCH - 1)]
                    base = len(s) - needed(len(s), threshold)
                    asked = np.arange(1, min(MOST, len(s) - base) + 1)
                    lists = (base + asked).astype("f8")
                    if weight.any():
                        order = np.argsort(weight, kind="stable")
                        s, weight = s[order], weight[order]
                        lists += np.cumsum(np.where(weight > 0, 2.0 ** np.minimum(weight, 60), 0))[base + asked - 1]
                    ask = int(asked[np.argmin(lists * (1 + VERIFY / asked))])
                    prefix = base + ask
                    ids.append(np.full(prefix, id_, "i8"))
                    tokens.append(s[:prefix].astype("i8"))
                    sizes.append(np.full(prefix, len(s), "i4"))
                    places.append(np.arange(prefix, dtype="i4"))
                    asks.append(np.full(prefix, ask, "i1"))
                    salts.append(1 << np.clip(weight[:prefix].astype("i4") - PER_TASK, 0, 20))
                if ids:
                    columns = [np.concatenate(x) for x in (ids, tokens, sizes, places, asks)] + [np.concatenate(salts).astype("i4")]
                    yield pa.record_batch([pa.array(x) for x in columns], ["id", "token", "n", "pos", "ask", "salts"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                sets = [s.astype("i8") for s in shingle_sets(piece.column(1), n)]
                yield pa.record_batch({"id": piece.column(0), "set": pa.array(sets, pa.list_(pa.int64()))})

    return run


def _verified(pairs: DataFrame, texts: DataFrame, n: int, threshold: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold by their whole sets.

    The side that is read off a hub (a document in many pairs) is a join whose
    skewed partitions are split at runtime; the sets lie on the unique side.
    """
    wanted = settle(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "wanted")
    sets = settle(having(texts, wanted, "id").mapInArrow(_sets(n), "id long, set array<long>"), "sets")
    met = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    common = met.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("both"), (F.size("sa") + F.size("sb")).cast("long").alias("all"))
    links = settle(common.filter(F.col("both") * 100 >= (F.col("all") - F.col("both")) * threshold).select("a", "b"), "links")
    discard(wanted, sets)
    return links


def _candidates(met: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, that meet often enough; ``met``: a row for each shared shingle."""
    pair = F.least("id", "l_id").alias("a"), F.greatest("id", "l_id").alias("b"), F.least("ask", "l_ask").alias("asked")
    # an id that repeats with several texts may ask for several numbers: the least counts for all
    return met.select(*pair).groupBy("a", "b").agg(F.count("*").alias("met"), F.min("asked").alias("asked")).filter("met >= asked").select("a", "b")


def _may_link(threshold: int) -> str:
    """SQL: whether an entry and l_* are of sizes that can link, and in the prefixes that these sizes leave."""
    common = f"((cast(n + l_n as long) * {threshold} + {99 + threshold}) div {100 + threshold})"
    return f"least(n, l_n) * 100L >= greatest(n, l_n) * {threshold}L AND pos < n - {common} + least(ask, l_ask) AND l_pos < l_n - {common} + least(ask, l_ask)"


def _indexed(threshold: int) -> str:
    """SQL: whether an entry can meet one of a set that isn't smaller."""
    return f"pos < n - ((2L * n * {threshold} + {99 + threshold}) div {100 + threshold}) + ask"


def _grouped(lists: DataFrame, groups: DataFrame | None) -> DataFrame:
    if groups is None:
        return lists.withColumn("grp", F.col("id"))
    return lists.join(groups.withColumnsRenamed({"node": "id", "component": "grp"}), "id", "left").withColumn("grp", F.coalesce("grp", "id"))


def _to_salts(per_list: DataFrame) -> DataFrame:
    """A row for each salt of a list."""
    return per_list.withColumn("salt", F.expr("explode(sequence(0, salts - 1))")).drop("salts")


def _divided(lists: DataFrame) -> DataFrame:
    """The entries of lists that more than one group is in."""
    several = lists.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.max("salts").alias("salts")).filter("lo <> hi").select("token", "salts")
    return lists.join(_to_salts(several), ["token", "salt"], "left_semi")


def _cross_pairs(lists: DataFrame) -> int:
    """Pairs of entries of one list and different groups, over all lists."""
    sizes = lists.groupBy("token", "grp").agg(F.count("*").alias("k")).groupBy("token").agg(F.expr("(sum(k) * sum(k) - sum(k * k)) div 2").alias("pairs"))
    return sizes.agg(F.coalesce(F.sum(F.col("pairs").cast("decimal(38,0)")), F.lit(0))).first()[0]


ENTRY = ("id", "n", "pos", "ask", "grp")


def _met_by_leaders(divided: DataFrame, turn: int, threshold: int) -> DataFrame:
    """An entry of each group of a list beside the list's leader; in the first turn every document is a group."""
    rank = F.struct(F.xxhash64("id", F.lit(turn)) if turn else F.col("id"), F.col("id"))
    leader = F.struct(*[F.col(c).alias(f"l_{c}") for c in ENTRY])
    leaders = divided.groupBy("token").agg(F.min_by(leader, rank).alias("l"), F.max("salts").alias("salts"))
    one = divided
    if turn:
        one = divided.groupBy("token", "salt", "grp").agg(F.min_by(F.struct(*ENTRY[:-1]), rank).alias("x")).select("token", "salt", "grp", "x.*")
    return one.join(_to_salts(leaders).select("token", "salt", "l.*"), ["token", "salt"]).filter(f"grp <> l_grp AND {_may_link(threshold)}")


def _met_by_all(divided: DataFrame, threshold: int) -> DataFrame:
    """All pairs of entries of a list and of different groups that may link, once each: the smaller set's is indexed, the other's looks it up."""
    other = divided.filter(_indexed(threshold)).select("token", "salts", *[F.col(c).alias(f"l_{c}") for c in ENTRY])
    once = "(l_n < n OR l_n = n AND l_id < id)"
    return divided.drop("salts").join(_to_salts(other), ["token", "salt"]).filter(f"grp <> l_grp AND {once} AND {_may_link(threshold)}")


def similar_groups(docs: DataFrame, n: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id for each row of ``docs``; threshold in percent."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    described = settle(rows.mapInArrow(_describe(n), "id long, n long, key binary, cell int, counts binary"), "described")
    documents = described.filter("cell IS NULL").select("id", "n", "key")
    members = documents.filter("id IS NOT NULL AND key IS NOT NULL")
    reps = settle(members.groupBy("key").agg(F.min("id").alias("rep")), "reps")
    sent = spark.sparkContext.broadcast(_weights(described))
    # an id that repeats with other texts is one node with several sets; its rows are all read
    copies = settle(members.select("id").distinct().join(reps.select(F.col("rep").alias("id")), "id", "left_anti"), "copies")
    named = rows.filter("id IS NOT NULL")
    entries = lacking(named, copies, "id").mapInArrow(_prefixes(n, threshold, sent), "id long, token long, n int, pos int, ask byte, salts int")
    entries = entries.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).repartition(parallelism(spark), "token", "salt")
    # one shuffle: a list's least and largest id come from a window over what that shuffle has brought together; salted lists stay whole
    whole = Window.partitionBy("token", "salt")
    lists = entries.withColumns({"lo": F.min("id").over(whole), "hi": F.max("id").over(whole)}).filter("lo <> hi OR salts > 1").drop("lo", "hi")
    lists = settle(lists, "lists")
    groups, links, refuted, turn, before = None, None, None, 0, None
    while True:
        divided = settle(_divided(_grouped(lists, groups)), "divided")
        left = _cross_pairs(divided.filter(_indexed(threshold)))
        # where leaders bring little more, or little is left, what is left is compared in full
        last = left <= 2 * divided.count() + FEW_PAIRS or (before is not None and left * 10 > before * 9)
        if divided.isEmpty():
            break
        pairs = _candidates(_met_by_all(divided, threshold) if last else _met_by_leaders(divided, turn, threshold))
        pairs = settle(pairs if refuted is None else pairs.join(refuted, ["a", "b"], "left_anti"), "pairs")
        found = _verified(pairs, named, n, threshold)
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            groups = settle(components(links), "groups")
        if last:
            break
        failed = pairs.join(found, ["a", "b"], "left_anti")
        refuted = settle(failed if refuted is None else failed.unionByName(refuted), "refuted")
        discard(divided, pairs)
        before, turn = left, turn + 1
    homes = reps.select("key", F.col("rep").alias("node"))
    homes = homes.join(groups, "node", "left").select("key", F.coalesce("component", "node").alias("component_id")) if groups is not None else homes.select("key", F.col("node").alias("component_id"))
    out = documents.join(homes, "key", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
