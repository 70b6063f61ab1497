"""Toxicity by maximum-scoring segments.

Fitting: word counts of toxic and of clean labelled documents give every word
a log-odds ratio with an informative Dirichlet prior (the words' joint
frequencies); words, and openings of words, that are toxic with significance
keep their log-odds as score, all other words cost ``NEUTRAL``.  The same
counts give lambda, the Karlin-Altschul scale of the clean documents; it is
solved over whole words, without the openings, and K is not estimated but fixed
at 1, so ``E_MAX`` is a fixed cut on a relative scale, not a calibrated number
of chance passages.  What calibrates a document's score is the logistic curve.

Scoring: one linear pass over a text's words finds all maximal scoring
segments (Ruzzo and Tompa); a segment's score becomes an expected number of
chance segments in a text of that length, and those below ``E_MAX`` are the
toxic passages.  A document's best and summed calibrated scores become a
probability by a logistic curve fitted on the same labelled rows.

Only the text is scored.  Fitting takes at most about ``FIT_ROWS`` labelled
rows, drawn by a hash of the id; the model has at most ``MODEL_WORDS`` entries
(a broadcast of a few MB).  Scoring covers whole texts of all rows.

Defined results: null and empty texts have no passage and the lowest score;
labels that are null or of no document are not used; without both labels
present nothing is toxic (score 0); rows with a null id are scored, not held
out, and never fitted on; repeated rows are scored each; texts may be as long
as a row can be; input columns named toxic_score or toxic_passages are replaced
by the results, all others are carried along; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.runtime import settle, small_side

FIT_ROWS = 60_000
MODEL_WORDS = 50_000
#: Letters of a word's openings that are counted like words; marked so that no word equals them.
OPENINGS = (4, 5, 6)
#: Cost of a word that isn't toxic; strength of the prior, as a share of all uses; log-odds and toxic texts of a toxic word at least.
NEUTRAL, PRIOR, ODDS_LEAST, USES = -0.7, 0.02, 1.5, 4
#: Lambda at most (without clean uses of the kept words it would be unbounded), and how far below the
#: expected largest of so many chance z-scores, sqrt(2 ln tested), a word's may lie: the prior shrinks all z-scores.
SCALE_MOST, Z_SLACK = 2.0, 1.4
#: Expected chance segments below which a passage is significant.
E_MAX = 0.05
WORD = re.compile(r"[^\W\d_]+")
#: Rows of the counted words that hold the sums over all words and over all openings; no word equals them.
WORDS, PARTS = "#words", "#openings"
#: A worker's remembered words; the memory is emptied beyond.
REMEMBERED = 1_000_000


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    scale: float = 1.0  # lambda of the extreme-value law
    volume: float = 1.0  # K of it; fixed, never fitted
    curve: tuple[float, ...] = (-9.0, 0.0, 0.0, 0.0)


def features(word: str) -> list[str]:
    """A word and its openings, as they are counted."""
    return [word, *("^" + word[:n] for n in OPENINGS if len(word) >= n)]


def held_out(id_: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def segments(hits: list[tuple[int, float]], neutral: float = NEUTRAL) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score), from the scoring words and their positions."""
    found: list[list] = []  # first, last, total before, total up to its end, index of the nearest found one that starts lower
    total, at = 0.0, 0
    for position, score in hits:
        total += neutral * (position - at)
        left, right, first = total, total + score, position
        total, at = right, position + 1
        below = len(found) - 1
        while True:
            while below >= 0 and found[below][2] >= left:
                below = found[below][4]
            if below < 0 or found[below][3] >= right:
                found.append([first, position, left, right, below])
                break
            first, left, _, _, before = found[below][0], found[below][2], 0, 0, found[below][4]
            del found[below:]
            below = before
    return [(f, e, r - a) for f, e, a, r, _ in found]


class Scorer:
    """(best, summed) calibrated scores and the significant passages of texts."""

    def __init__(self, model: Model):
        self._model, self._known = model, {}

    def _score(self, word: str) -> float | None:
        found = [s for f in features(word) if (s := self._model.scores.get(f)) is not None]
        return max(found, default=None)

    def __call__(self, text: str | None) -> tuple[float, float, list[tuple[int, int, float, float]]]:
        known, model = self._known, self._model
        words = WORD.findall((text or "").lower())
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self._score(w)
        hits = [(i, s) for i, s in enumerate(map(known.__getitem__, words)) if s is not None]
        best, summed, passages = 0.0, 0.0, []
        for first, last, score in segments(hits):
            bits = model.scale * score - math.log(max(model.volume * len(words), 1e-9))
            best = max(best, bits)
            if bits > -math.log(E_MAX):
                summed += bits
                passages.append((first, last, score, math.exp(-bits)))
        return best, summed, passages


def probability(model: Model, best: float, summed: float, passages: int) -> float:
    a, b, c, d = model.curve
    x = a + b * math.log1p(max(0.0, best)) + c * math.log1p(summed) + d * math.log1p(passages)
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, clean, toxic): how many texts of a partition hold a word or opening, and the sums of these; emptied now and then."""
    from collections import Counter

    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def out() -> pa.RecordBatch:
        for n in counts.values():
            openings = sum(k for w, k in n.items() if w.startswith("^"))
            n[WORDS], n[PARTS] = n.total() - openings, openings
        words = list(set(counts[0]) | set(counts[1]))
        rows = {"word": pa.array(words, pa.string())} | {n: pa.array([counts[k][w] for w in words], pa.int64()) for k, n in enumerate(("clean", "toxic"))}
        counts[0].clear()
        counts[1].clear()
        return pa.record_batch(rows)

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(WORD.findall((text or "").lower()))
            counts[toxic].update({f for w in words for f in features(w)})
        if len(counts[0]) + len(counts[1]) > REMEMBERED:
            yield out()
    yield out()


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the labelled rows of ``docs`` that are not held out."""
    import numpy as np

    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("id"))).distinct()
    n = known.count()
    share = min(1.0, fit_rows / max(1, n))
    drawn = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    # about FIT_ROWS ids, so that no text has to be shuffled; equal texts of one label are fitted on once
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(small_side(drawn), "id")
    texts = settle(texts.select(F.monotonically_increasing_id().alias("row"), "text", "toxic", F.sha2("text", 256).alias("key")), "labelled")
    once = texts.groupBy("key", "toxic").agg(F.min("row").alias("row")).select("row")
    sample = texts.join(small_side(once), "row", "left_semi").select("text", "toxic")
    counted = sample.mapInArrow(_count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    counted = settle(counted.filter(f"t >= {USES} OR word IN ('{WORDS}', '{PARTS}')"), "words")
    sums = {x["word"]: (x["c"], x["t"]) for x in counted.filter(F.col("word").isin(WORDS, PARTS)).collect()}
    counted = counted.filter(~F.col("word").isin(WORDS, PARTS))
    tested = counted.filter(f"t >= {USES}").count()
    # the more words are tested, the larger is the largest z-score of a word that means nothing
    z_least = max(2.0, math.sqrt(2 * math.log(1 + tested)) - Z_SLACK)
    model = Model()
    clean_words, toxic_words = sums.get(WORDS, (0, 0))
    if not clean_words or not toxic_words:
        return model
    # log-odds with a prior in proportion to a word's joint frequency, and its z-score
    a, strength = f"({PRIOR}D * (c + t))", PRIOR * (clean_words + toxic_words)
    odds = f"ln((t + {a}) / ({toxic_words + strength}D - t - {a})) - ln((c + {a}) / ({clean_words + strength}D - c - {a}))"
    scored = counted.filter(f"t >= {USES}").withColumn("odds", F.expr(odds)).filter(f"odds >= {ODDS_LEAST}").withColumn("z", F.expr(f"odds / sqrt(1D / (t + {a}) + 1D / (c + {a}))"))
    kept = scored.filter(f"z >= {z_least}").orderBy(F.desc("z"), "word").limit(MODEL_WORDS).collect()
    model.scores = {x["word"]: float(x["odds"]) for x in kept}
    if not model.scores:
        return model
    # lambda: the positive root of sum p exp(lambda s) = 1 over the clean words
    clean = np.array([[x["odds"], x["c"] / clean_words] for x in kept if not x["word"].startswith("^")] or [[1.0, 0.0]])
    rest = max(1e-9, 1 - clean[:, 1].sum())
    low, high = 1e-3, 20.0
    for _ in range(60):
        middle = (low + high) / 2
        over = (clean[:, 1] * np.exp(np.minimum(middle * clean[:, 0], 600))).sum() + rest * math.exp(middle * NEUTRAL) > 1
        low, high = (low, middle) if over else (middle, high)
    model.scale = min(low, SCALE_MOST)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            rows = [scorer(t) for t in batch.column(0).to_pylist()]
            yield pa.record_batch({"best": pa.array([r[0] for r in rows], pa.float64()), "summed": pa.array([r[1] for r in rows], pa.float64()), "passages": pa.array([len(r[2]) for r in rows], pa.int64()), "toxic": batch.column(1).cast(pa.int64())})

    # at most about FIT_ROWS rows of four numbers
    table = sample.mapInArrow(rows_of, "best double, summed double, passages long, toxic long").toPandas()
    x = np.column_stack([np.ones(len(table)), *(np.log1p(np.maximum(table[c].to_numpy("f8"), 0)) for c in ("best", "summed", "passages"))])
    y, w = table["toxic"].to_numpy("f8"), np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.05 * np.eye(4), x.T @ (y - p) - 0.05 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.curve = tuple(float(v) for v in w)
    return model


SPAN = "array<struct<first:int,last:int,score:double,expected:double>>"


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with toxic_score (0 to 1) and toxic_passages (word spans with score and expected chance number)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.drop("toxic_score", "toxic_passages")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    schema = docs.limit(0).withColumns({"toxic_score": F.lit(0.0), "toxic_passages": F.lit(None).cast(SPAN)}).schema
    span = to_arrow_schema(schema).field("toxic_passages").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            found = [scorer(t) for t in batch.column(at).to_pylist()]
            scores = [probability(sent.value, best, summed, len(p)) for best, summed, p in found]
            passages = [[dict(zip(("first", "last", "score", "expected"), x, strict=True)) for x in p] for _, _, p in found]
            yield pa.record_batch([*batch.columns, pa.array(scores, pa.float64()), pa.array(passages, span)], [*batch.schema.names, "toxic_score", "toxic_passages"])

    return docs.mapInArrow(run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), F.when(F.col("toxic_score") >= 0.3, 1).otherwise(0).alias("predicted"), F.size("toxic_passages").alias("n_passages")
    )
