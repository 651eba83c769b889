"""Toxicity by maximum-scoring segments of token log-odds.

Learning: each word of a labelled document counts once, for itself and for its prefixes (stems that
many words share). A unit's weight is the logarithm of its odds in toxic against other documents
under an informative Dirichlet prior; units whose odds are surely (by MIN_Z deviations) MIN_ODDS or
more form the lexicon, so that words that are slightly more frequent do not add up; all other words
share one slightly negative weight, the log-odds of being in no lexicon.

Scoring: a linear scan of the whole text (Ruzzo and Tompa) finds every maximal segment of positive
sum. Under the weights' distribution in other documents the best segment's score follows an
extreme-value law (Karlin and Altschul): P(best >= x) = 1 - exp(-K n exp(-lambda x)) for n words.
lambda is the root of E exp(lambda w) = 1, K the maximum-likelihood value over the other training
documents. The evidence of a document is -ln of that probability for its best segment, and a
one-variable logistic curve turns it into a score.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.scratch import Scratch

TRAIN_ROWS = 200_000  # labelled rows learned from at most: the bound of what is broadcast
PRIOR = 0.05  # weight of the Dirichlet prior as a share of the counts
MIN_Z = 3.0  # standard deviations
MIN_ODDS = 2.0
PREFIXES = (4, 5, 6)  # letters
EVIDENCE_STEP, MAX_EVIDENCE = 0.05, 60.0
CUT = 0.7
REMEMBERED = 300_000
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def units_of(word: str) -> list[str]:
    """The word itself (marked by its end) and its prefixes."""
    return [f"{word}$", *(word[:n] for n in PREFIXES if len(word) >= n)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    lexicon: dict[str, tuple[float, float]] = field(default_factory=dict)  # unit: weight, significance
    other: float = 0.0  # weight of all other words
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    intercept: float = 0.0

    def weight(self, word: str) -> float:
        """Of the word's units in the lexicon the most significant decides; 0 if none is there."""
        return max((self.lexicon[u] for u in units_of(word) if u in self.lexicon), key=lambda x: x[1], default=(0.0, 0.0))[0]


class _Remembered(dict):
    """Weights of words; forgets all once it is full."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        weight = self[word] = self.model.weight(word)
        return weight


def maximal_segments(scores: list[tuple[int, float]], other: float, n: int) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, place after the last word, sum) of a text of ``n``
    words of weight ``other`` <= 0 except for ``scores``: (place, positive weight) in order.

    Linear in the number of ``scores``: each segment on the stack is joined or left once."""
    stack: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum after, earlier
    total, place = 0.0, 0
    for at, weight in scores:
        total += other * (at - place)
        first, before = at, total
        total, place = total + weight, at + 1
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= before:  # the nearest segment that begins lower
                j = stack[j][4]
            if j < 0 or stack[j][3] >= total:
                stack.append((first, place, before, total, j))
                break
            first, before = stack[j][0], stack[j][2]
            earlier = stack[j][4]
            del stack[j:]
            j = earlier
    return [(a, b, after - before) for a, b, before, after, _ in stack]


def segments(text: str, weights: _Remembered) -> tuple[int, list[tuple[int, int, float]]]:
    words = words_of(text)
    scored = [(i, w) for i, w in enumerate(map(weights.__getitem__, words)) if w > 0]
    return len(words), maximal_segments(scored, weights.model.other, len(words)) if scored else []


def evidence(model: Model, n: int, best: float) -> float:
    """-ln of the chance that a text of n other words has a segment of this score."""
    if best <= 0:
        return 0.0
    expected = model.k * n * math.exp(-model.lam * best)
    chance = -math.expm1(-expected)
    return min(MAX_EVIDENCE, -math.log(chance)) if chance > 0 else MAX_EVIDENCE


def probability(model: Model, x: float) -> float:
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, model.slope * x + model.intercept))))


# --- learning -------------------------------------------------------------------------------------


def _count_words(labelled: DataFrame) -> DataFrame:
    """Per word: in how many toxic and other documents it is (toxic, other)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(), Counter()

        def out() -> pa.RecordBatch:
            words = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array(words, pa.string()), *(pa.array([counts[y][w] for w in words], pa.int64()) for y in (1, 0))]
            return pa.RecordBatch.from_arrays(columns, ["word", "toxic", "other"])

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                counts[toxic].update(set(words_of(text.as_py() or "")))
                if len(counts[0]) + len(counts[1]) > REMEMBERED:
                    yield out()
                    counts = Counter(), Counter()
        yield out()

    partial = labelled.select("text", "toxic").mapInArrow(count, "word string, toxic long, other long")
    return partial.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _with_weights(units: DataFrame) -> DataFrame:
    """Log-odds of each unit (unit, toxic, other) under a Dirichlet prior in proportion to its count
    in all documents, and their significance."""
    sums = units.agg(F.sum("toxic").alias("all_toxic"), F.sum("other").alias("all_other"))
    prior = F.lit(PRIOR) * (F.col("toxic") + F.col("other"))
    odds = lambda n, total: F.log((n + prior) / (total + F.lit(PRIOR) * (F.col("all_toxic") + F.col("all_other")) - n - prior))
    weight = odds(F.col("toxic"), F.col("all_toxic")) - odds(F.col("other"), F.col("all_other"))
    spread = F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("other") + prior))
    return units.join(F.broadcast(sums)).select("unit", "toxic", "other", weight.alias("weight"), (weight / spread).alias("z"))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method, with a small ridge so that separable data converge."""
    design, beta, ridge = np.stack([x, np.ones_like(x)]), np.zeros(2), np.diag([1e-2, 1e-4])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(beta @ design, -500, 500)))
        slope = design @ (n * (y - p)) - ridge @ beta
        curve = (design * (n * p * (1 - p))) @ design.T + ridge
        step = np.linalg.solve(curve, slope)
        beta = beta + step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def _measured(labelled: DataFrame, model: Model) -> DataFrame:
    """toxic, n (words) and best (score of the best segment) of each document."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Remembered(model)
        for batch in batches:
            rows = [segments(t.as_py() or "", weights) for t in batch.column(0)]
            best = [max((s for *_, s in found), default=0.0) for _, found in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).cast(pa.int32()), pa.array([n for n, _ in rows], pa.int64()), pa.array(best, pa.float64())],
                ["toxic", "n", "best"],
            )

    return labelled.select("text", "toxic").mapInArrow(measure, "toxic int, n long, best double")


def learn(documents: DataFrame, labels: DataFrame) -> Model:
    """Learns from the rows of ``labels`` (doc_id, toxic) that are not held out and whose document is
    in ``documents`` (doc_id, text): of more than TRAIN_ROWS rows, those with the smallest hash of
    their id. What reaches the driver are sums, significant units and histograms.

    A document with several labels counts as toxic if one says so; null labels are left out. Without
    labels of both kinds the model knows no toxic words and scores every text alike."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "toxicity")
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = scratch.keep(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS), "chosen")
    labelled = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    words = scratch.keep(_count_words(labelled), "words")
    parts = F.array(F.concat("word", F.lit("$")), *[F.when(F.length("word") >= n, F.substring("word", 1, n)) for n in PREFIXES])
    units = words.select(F.explode(F.array_compact(parts)).alias("unit"), "toxic", "other")
    units = scratch.keep(units.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), "units")
    found = _with_weights(units).where(F.col("weight") * (1 - MIN_Z / F.col("z")) >= math.log(MIN_ODDS)).select("unit", "weight", "z")
    model = Model({r["unit"]: (r["weight"], r["z"]) for r in found.toLocalIterator()})
    if model.lexicon:
        _calibrate(model, words)
        _fit_curve(model, labelled, scratch)
    scratch.drop("words", "units", "chosen", "measured")
    return model


def _calibrate(model: Model, words: DataFrame) -> None:
    """The weight of other words, and lambda."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = pa.array([round(model.weight(w), 2) for w in batch.column(0).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([weights, batch.column(1), batch.column(2)], ["weight", "toxic", "other"])

    weighed = words.mapInArrow(weigh, "weight double, toxic long, other long").groupBy("weight")
    rows = weighed.agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).collect()
    sums = {y: sum(r[y] for r in rows) for y in ("toxic", "other")}
    plain = {y: (sum(r[y] for r in rows if r["weight"] <= 0) + 0.5) / (sums[y] + 1) for y in sums}
    model.other = min(-1e-4, math.log(plain["toxic"] / plain["other"]))
    weights = np.array([r["weight"] if r["weight"] > 0 else model.other for r in rows])
    chance = np.array([r["other"] + 0.5 * (r["weight"] > 0) for r in rows], float)
    chance /= chance.sum()
    low, high = 1e-6, 1.0
    moment = lambda lam: float(chance @ np.exp(np.minimum(lam * weights, 700)))
    while moment(high) < 1 and high < 64:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if moment(middle) < 1 else (low, middle)
    model.lam = min(max(high, 0.05), 4.0)


def _fit_curve(model: Model, labelled: DataFrame, scratch: Scratch) -> None:
    """K, and the logistic curve over a histogram of the evidence."""
    measured = scratch.keep(_measured(labelled, model), "measured")
    drawn = measured.where((F.col("toxic") == 0) & (F.col("n") > 0))
    mean = drawn.agg(F.avg(F.col("n") * F.exp(F.lit(-model.lam) * F.col("best")))).first()[0]
    model.k = 1 / mean if mean else 1.0
    # the same arithmetic as evidence(), for the histogram
    expected = F.lit(model.k) * F.col("n") * F.exp(F.lit(-model.lam) * F.col("best"))
    told = F.when(F.col("best") > 0, F.least(F.lit(MAX_EVIDENCE), -F.log(-F.expm1(-expected)))).otherwise(0.0)
    binned = F.round(F.coalesce(told, F.lit(MAX_EVIDENCE)) / EVIDENCE_STEP).cast("int")
    rows = measured.groupBy(binned.alias("bin"), "toxic").count().collect()
    x, y, n = (np.array([r[c] for r in rows], float) for c in ("bin", "toxic", "count"))
    if len(set(y)) == 2:
        model.slope, model.intercept = _logistic(x * EVIDENCE_STEP, y, n)
        model.slope = max(model.slope, 0.0)


# --- scoring --------------------------------------------------------------------------------------


def score(documents: DataFrame, model: Model) -> DataFrame:
    """For each row of ``documents`` (doc_id, text; other columns are left out): doc_id, held_out,
    score (0 to 1), predicted (1 from CUT on), n_words, evidence, and ``passages``: every maximal
    segment with the places of its first word and after its last, its score and its evidence.

    The whole text is scanned. A null or empty text has no passages and the score of no evidence.
    Repeated rows are scored alike. No rows give no rows."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("evidence", pa.float64())])
    shape = pa.schema([
        ("doc_id", pa.int64()), ("score", pa.float64()), ("n_words", pa.int64()), ("evidence", pa.float64()),
        ("passages", pa.list_(passage)),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        weights = _Remembered(model)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, found = segments(text.as_py() or "", weights)
                told = [{"first": a, "end": b, "score": s, "evidence": evidence(model, n, s)} for a, b, s in found]
                x = max((t["evidence"] for t in told), default=0.0)
                rows.append({"doc_id": doc_id, "score": probability(model, x), "n_words": n, "evidence": x, "passages": told})
            yield pa.RecordBatch.from_pylist(rows, shape)

    scored = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, score double, n_words long, evidence double, "
        "passages array<struct<first: long, end: long, score: double, evidence: double>>",
    )
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"), "n_words", "evidence", "passages",
    )


def without_toxic(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of ``documents`` (with a column text; all columns stay) with a score below CUT. A null or
    empty text has the score of no evidence, repeated rows stay or go alike, and no rows give no rows."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        weights = _Remembered(model)

        def clean(text: str) -> bool:
            n, found = segments(text, weights)
            return probability(model, max((evidence(model, n, s) for *_, s in found), default=0.0)) < CUT

        for batch in batches:
            yield batch.filter(pa.array([clean(t.as_py() or "") for t in batch.column(at)], pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)
