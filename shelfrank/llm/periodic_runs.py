"""Stretches of words that repeat with a period, found by seeds on diagonals.

On the diagonal of lag q the words i and i + q of a document meet. A run of period q and length L, at least
24 and at least 3 q, matches on L - q >= max(24 - q, 2 q) successive places of that diagonal, so on 16 at
least, and for q over k / 2 on more than k. Grams of k = 16 words are therefore seeds of the periods to 16, and
grams of 2 ** j * 16 words of those from half that on. As k is not below q, two occurrences of a gram
within a run less than q apart would give the run a smaller period: successive occurrences are q apart, so
only neighbours in the list of a gram's places are paired, however often it occurs. Grams are numbered by
doubling (a gram of 2 k words is a pair of numbers of k words), and places whose gram occurs once in its
document drop out, so later doublings see repeated text only.

A seed is extended both ways along its diagonal. Per lag the furthest place covered is kept, and seeds
before it are not extended again.
"""

from collections.abc import Iterator
from fractions import Fraction
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORTEST, REPEATS = 24, 3  # words, and periods, that a run has at least
SEED = 16  # the least of max(SHORTEST - q, (REPEATS - 1) * q) over all q
TEXTS, CHARS = 512, 4_000_000  # of one slice; a longer text is a slice of its own
STEP = 64  # words compared at first, doubled from then on
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SHAPE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("strongest", RUN), ("collapsed", pa.string())])
COLUMNS = (
    "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, "
    "strongest struct<start: long, length: long, period: long>, collapsed string"
)


def _doubled(places: np.ndarray, names: np.ndarray, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the grams of 2 k items from those of k, only for places whose gram occurs again."""
    at = np.full(size + k, -1, np.int64)
    at[places] = names
    after = at[places + k]
    places, pair = places[after >= 0], (names * (names.max(initial=0) + 1) + after)[after >= 0]
    return _repeated(places, pair)


def _repeated(places: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, names, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = counts[names] > 1
    return places[again], names[again]


def _seeds(items: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Lag, place and gram length of seeds, ordered by lag and place for each gram length. Of seeds at
    successive places on one diagonal only the first is given: the others extend to the same stretch."""
    places, names = _repeated(np.arange(len(items)), items)
    k = 1
    while len(places):
        if k >= SEED:
            order = np.lexsort((places, names))
            p, n = places[order], names[order]
            lag = np.diff(p)
            fits = (n[1:] == n[:-1]) & (lag <= k) & ((lag > k // 2) | (k == SEED))
            lag, p = lag[fits], p[:-1][fits]
            order = np.lexsort((p, lag))
            lag, p = lag[order], p[order]
            first = np.ones(len(p), bool)
            first[1:] = (lag[1:] != lag[:-1]) | (p[1:] != p[:-1] + 1)
            for d, i in zip(lag[first].tolist(), p[first].tolist()):
                yield d, i, k
        places, names = _doubled(places, names, k, len(items))
        k *= 2


def _matches(items: np.ndarray, x: int, lag: int, way: int) -> int:
    """How many successive places from x on, forwards or backwards, meet an equal word at the lag."""
    found, step = 0, STEP
    while True:
        if way > 0:
            a, b = items[x:x + step], items[x + lag:x + lag + step]
            a = a[:len(b)]
        else:
            low = max(x - step + 1, 0)
            a, b = items[low:x + 1][::-1], items[low + lag:x + lag + 1][::-1]
        if not len(a):
            return found
        differ = a != b
        if differ.any():
            return found + int(differ.argmax())
        found, x, step = found + len(a), x + way * len(a), step * 2


def runs_of(items: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of numbers, by start and period. Parts of it that share
    no number (documents, say) have no run in common."""
    found, furthest = [], {}
    for lag, place, k in _seeds(items):
        if place < furthest.get(lag, -1):
            continue
        start = place - (_matches(items, place - 1, lag, -1) if place else 0)
        end = place + k + _matches(items, place + k, lag, 1)  # of the diagonal
        # Another seed may lie further on, but a stretch is covered to its end by its first seed.
        furthest[lag] = end
        length = end - start + lag
        if length >= max(SHORTEST, REPEATS * lag):
            found.append((start, length, lag))
    return sorted(set(found))


def _slices(texts: list[str]) -> Iterator[range]:
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if i > begin and (i - begin >= TEXTS or held + len(text) > CHARS):
            yield range(begin, i)
            begin, held = i, 0
        held += len(text)
    if texts:
        yield range(begin, len(texts))


def _report(words: list[str], runs: list[tuple[int, int, int]]) -> tuple:
    """Number of words, runs, the strongest of them, and the text without repeats."""
    if not runs:
        return len(words), [], None, " ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    told = [{"start": s, "length": n, "period": q} for s, n, q in runs]
    strongest = max(told, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"]))
    return len(words), told, strongest, " ".join([words[i] for i in keep.nonzero()[0]])


def examine(texts: list[str]) -> Iterator[tuple]:
    """A report for each text; several are searched at once."""
    for part in _slices(texts):
        split = [WORD.findall(texts[i]) for i in part]
        numbers: dict[str, int] = {}
        items = np.fromiter((numbers.setdefault(w, len(numbers)) for words in split for w in words), np.int64)
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        items += np.repeat(np.arange(len(split)) * max(len(numbers), 1), sizes)  # no number in two texts
        begins = np.cumsum(sizes) - sizes
        runs = runs_of(items)
        home = np.searchsorted(begins, [s for s, *_ in runs], side="right") - 1
        of_text: dict[int, list] = {}
        for (start, length, period), i in zip(runs, home.tolist()):
            of_text.setdefault(i, []).append((start - int(begins[i]), length, period))
        for i, words in enumerate(split):
            yield _report(words, of_text.get(i, []))


def periodic_runs(documents: DataFrame) -> DataFrame:
    """For each row of ``documents`` (doc_id, text; other columns are left out) its words, the stretches
    without ASCII white space: n_words; runs, all maximal stretches of smallest period q and a length of 24
    words and 3 q at least, as (start, length, period) with words numbered from 0, by start, then period;
    strongest, that of greatest length / period (ties: smallest start, then period), null without runs;
    collapsed, the words that no run contains after its first q words, joined by blanks.

    A null or empty text has no words, no runs and an empty collapsed text. Texts may be of any length; a
    text is searched as a whole. Repeated rows and rows without id stay. No rows give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), TEXTS):
                part = batch.slice(begin, TEXTS)
                reports = zip(*examine([t.as_py() or "" for t in part.column(1)]))
                columns = [part.column(0), *(pa.array(c, f.type) for c, f in zip(reports, list(SHAPE)[1:]))]
                yield pa.RecordBatch.from_arrays(columns, schema=SHAPE)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, COLUMNS)


def split_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """doc_id and text, where about every tenth text repeats itself from some word on. With
    h = crc32(doc_id), g = h // 10 and n words: if 10 divides h and n > 0, each word i from a = g % n on becomes
    word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8); words are then joined by blanks. Texts without id
    stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i).cast("int"))), " ")

    # the array of one element binds the words, so that they are split once
    planted = F.transform(F.array(split_words(F.col("text"))), lambda w: F.when(F.size(w) > 0, repeated(w)))[0]
    return documents.select("doc_id", F.when(h % 10 == 0, F.coalesce(planted, "text")).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli (1000 length / period, floored) of the
    strongest run, runs_sha256 of `start,length,period` lines, collapsed_sha256."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
