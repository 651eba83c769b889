"""Substring deduplication by content-defined chunks.

A gear hash rolls over each text's bytes; a chunk ends where the hash of the last WINDOW bytes is the
least of its neighbourhood. Borders depend on nothing farther away, so an insertion moves only those
next to it, and a passage is cut alike wherever it stands. Chunks with equal 128-bit digests are
duplicates: the occurrence in the smallest doc_id (there the first one) stays, the others can be cut.
Only runs of duplicate chunks of some length are reported, as short chunks can be equal by chance.

Digests are counted with partial sums before the shuffle; what is joined back to the occurrences is
one row per repeated digest. Chunks are made anew for that join, so that they are never stored.
"""

from collections.abc import Iterator
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
import xxhash

from shelfrank.llm.scratch import Scratch

WINDOW = 16  # bytes under the rolling hash
REACH = 20  # bytes to either side over which a border's hash must be the least
MAX_CHUNK = 256  # bytes, for texts that repeat themselves and so have no borders
MIN_RUN = 120  # bytes of a reported run
BATCH_BYTES = 8 << 20
NO_ID = (1 << 63) - 1

_pick = random.Random(20240229)
GEAR = np.array([_pick.getrandbits(32) for _ in range(256)], np.uint32)


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """At each place, the least of the n values from there on (of fewer at the end)."""
    out, have = values.copy(), 1
    while have < n:
        step = min(have, n - have)
        out[:-step] = np.minimum(out[:-step], out[step:].copy()) if step < len(out) else out[:-step]
        have += step
    return out


def borders(data: np.ndarray) -> np.ndarray:
    """Places where a chunk begins: the gear hash of the WINDOW bytes before is less than at the REACH
    places before and no more than at the REACH places after, and a character begins there. Nothing
    farther than WINDOW + REACH bytes has a part in it."""
    if len(data) <= 2 * REACH:
        return np.empty(0, np.int64)
    rolled = GEAR[data]
    shift = 1
    while shift < WINDOW:
        rolled[shift:] += rolled[:-shift].copy() << np.uint32(shift)
        shift *= 2
    least = _least(rolled, REACH)
    middle = rolled[REACH:-REACH]
    low = (middle < least[:len(middle)]) & (middle <= least[REACH + 1:][:len(middle)])
    places = np.flatnonzero(low) + REACH + 1
    return places[(data[places] & 0xC0) != 0x80]


def chunk_texts(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """For each text the starts, ends and digests of its chunks. Texts are hashed together, with zero
    bytes between them that are wider than what decides about a border."""
    gap = b"\0" * (WINDOW + REACH)
    data = gap + b"".join(text + gap for text in texts)
    places = borders(np.frombuffer(data, np.uint8))
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = len(gap) + np.cumsum(sizes + len(gap)) - sizes - len(gap)
    first = np.searchsorted(places, starts, side="right")
    last = np.searchsorted(places, starts + sizes, side="left")
    digest = xxhash.xxh3_128_digest
    for i, text in enumerate(texts):
        edges = [0, *(places[first[i]:last[i]] - starts[i]).tolist(), len(text)]
        if len(text) == 0:
            yield [], [], []
            continue
        if max(b - a for a, b in zip(edges, edges[1:])) > MAX_CHUNK:
            edges = _split_long(text, edges)
        yield edges[:-1], edges[1:], [digest(text[a:b]) for a, b in zip(edges, edges[1:])]


def _split_long(text: bytes, edges: list[int]) -> list[int]:
    """Chunks above the limit cut at it, where a character begins."""
    out = [0]
    for edge in edges[1:]:
        while edge - out[-1] > MAX_CHUNK:
            place = out[-1] + MAX_CHUNK
            while text[place] & 0xC0 == 0x80:
                place -= 1
            out.append(place)
        out.append(edge)
    return out


CHUNKS = "doc long, text_hash long, start int, end int, d1 long, d2 long, again boolean"
_SHAPE = pa.schema([
    ("doc", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("again", pa.bool_()),
])


def chunks(documents: DataFrame) -> DataFrame:
    """A row per chunk: doc, text_hash (of the whole text, as ids can repeat or lack), start and end (bytes of the UTF-8 text), digest (d1, d2), and whether an
    earlier chunk of the document has the same digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts, held = [], [], 0
            ids = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())
            for doc, text in zip(ids, batch.column(1).cast(pa.binary())):
                docs.append(doc)
                texts.append(text.as_py())
                held += len(texts[-1])
                if held >= BATCH_BYTES:
                    yield pack(docs, texts)
                    docs, texts, held = [], [], 0
            if docs:
                yield pack(docs, texts)

    def pack(docs: list[tuple[int, int]], texts: list[bytes]) -> pa.RecordBatch:
        starts, ends, digests, sizes, again = [], [], [], [], []
        for a, b, d in chunk_texts(texts):
            starts += a
            ends += b
            digests += d
            sizes.append(len(d))
            seen: set[bytes] = set()
            again += [x in seen or bool(seen.add(x)) for x in d]
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        ids = np.repeat(np.array(docs, np.int64), sizes, axis=0)
        columns = [ids[:, 0].copy(), ids[:, 1].copy(), starts, ends, halves[:, 0].copy(), halves[:, 1].copy(), again]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SHAPE)], schema=_SHAPE)

    given = documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
    )
    return given.where(F.col("text") != "").mapInArrow(run, CHUNKS)


def repeated_runs(documents: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """Runs of at least ``min_run`` bytes of chunks that occur more than once in ``documents``
    (doc_id, text; other columns are left out): doc_id, start, end (bytes), n_chunks, copies (of the
    most frequent chunk), first_doc (smallest doc_id that has one of the chunks), cut_bytes and
    ``cuts``: the parts (start, end) of which an earlier occurrence stays.

    The first document of a passage is reported too, with nothing to cut. Null and empty texts have
    no runs. Rows with equal doc_ids are one document: what both have, both keep. Rows without id
    count as one document after all others. Each text has runs of its own, also where ids repeat or
    lack. No rows give no rows."""
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return _text_runs(documents, min_run).select(
        known("doc").alias("doc_id"), "start", "end", "n_chunks", "copies", known("first_doc").alias("first_doc"),
        "cut_bytes", "cuts",
    )


def _text_runs(documents: DataFrame, min_run: int) -> DataFrame:
    """The rows of ``repeated_runs`` with doc and text_hash of their text."""
    scratch = Scratch(documents.sparkSession, "substrings")
    found = chunks(documents)
    counted = found.groupBy("d1", "d2").agg(F.min("doc").alias("first_doc"), F.count("*").alias("copies"))
    repeated = scratch.keep(counted.where(F.col("copies") > 1), "repeated")
    dup = found.join(repeated, ["d1", "d2"]).select(
        "doc", "text_hash", "start", "end", "first_doc", "copies", ((F.col("first_doc") < F.col("doc")) | F.col("again")).alias("cut"),
    )
    in_order = Window.partitionBy("doc", "text_hash").orderBy("start", "end", "cut")
    fresh = F.coalesce(F.lag("end").over(in_order) < F.col("start"), F.lit(True)).cast("int")
    runs = dup.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.struct("start", "end")
    merged = runs.groupBy("doc", "text_hash", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_chunks"),
        F.max("copies").alias("copies"), F.min("first_doc").alias("first_doc"),
        F.array_sort(F.collect_set(F.when(F.col("cut"), part))).alias("cuts"),
    )
    size = F.aggregate("cuts", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return merged.where(F.col("end") - F.col("start") >= min_run).withColumn("cut_bytes", size)


def without_repeats(documents: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """All rows and columns of ``documents`` with the cuts of ``repeated_runs`` taken out of text."""
    runs = _text_runs(documents, min_run).where(F.col("cut_bytes") > 0)
    cuts = runs.groupBy("doc", "text_hash").agg(
        F.array_sort(F.flatten(F.collect_list("cuts"))).alias("cuts")
    )
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    doc = F.coalesce(F.col("row").getField("doc_id").cast("long"), F.lit(NO_ID))
    same = (doc == F.col("doc")) & (F.xxhash64(F.col("row").getField("text").cast("string")) == F.col("text_hash"))
    joined = packed.join(cuts, same, "left")
    data = F.encode(F.col("row").getField("text"), "UTF-8")
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<binary>").alias("kept"))
    kept = F.aggregate("cuts", state, lambda s, c: F.struct(
        c["end"].alias("at"), F.concat(s["kept"], F.array(F.substring(data, s["at"] + 1, c["start"] - s["at"]))).alias("kept"),
    ))
    rest = F.substring(data, kept["at"] + 1, F.length(data) - kept["at"])
    cut_text = F.decode(F.aggregate(kept["kept"], F.lit(b""), lambda s, x: F.concat(s, x), lambda s: F.concat(s, rest)), "UTF-8")
    text = F.when(F.col("cuts").isNull(), F.col("row").getField("text")).otherwise(cut_text)
    return joined.select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in documents.columns])
