"""Exact top-k search over binary codes by incremental multi-index hashing.

Vectors become codes by the signs of their components. Equal codes are merged before anything is
compared; of a code's rows only the k with the smallest ids can be among anyone's nearest, so only
these stay. The distinct query codes and the distinct row codes are dealt into blocks of bounded
size, and each pair of blocks is one task. A task cuts its row codes into m substrings and indexes
each by value; a query looks up all values within radius 0, then 1, 2, ... of its own substrings.
When radius a is done for the first b + 1 substrings (and a - 1 for the others), every code within
distance m a + b has been met (pigeonhole), so a query ends as soon as its kth verified distance is
no larger than that. Nothing is approximate and nothing is cut off.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfrank.llm.scratch import Scratch

ROW_BLOCK = 1 << 18  # distinct codes in a block of rows
QUERY_BLOCK = 1 << 14  # distinct codes in a block of queries
CHUNK = 128  # queries looked up together


def sign_codes(vectors: DataFrame, id_col: str, vector_col: str, bits: int) -> DataFrame:
    """Columns ``id`` and ``code`` (binary, one bit per component: 1 if it is above zero).

    A null component or NaN is no 1. Rows with a null id, a null vector or one of another length
    have no code and are left out; so they are neither queries nor neighbours."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            ones = np.nan_to_num(flat.astype(np.float64)).reshape(-1, bits) > 0
            packed = np.packbits(ones, axis=1, bitorder="little")
            codes = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(packed.shape[1]), len(packed), [None, pa.py_buffer(packed.tobytes())]
            ).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), codes], ["id", "code"])

    fit = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    fit = fit.where(F.col("id").isNotNull() & (F.size("v") == bits))
    return fit.mapInArrow(pack, "id long, code binary")


def _substrings(codes: np.ndarray, width: int) -> list[tuple[np.ndarray, int]]:
    """The substrings' values, and their numbers of bits. ``codes``: a row of bytes per code."""
    bits = np.unpackbits(codes, axis=1, bitorder="little")
    parts = np.array_split(np.arange(bits.shape[1]), max(1, -(-bits.shape[1] // width)))
    return [(bits[:, p].astype(np.int64) @ (1 << np.arange(len(p), dtype=np.int64)), len(p)) for p in parts]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def _expand(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range, its number as often as it has places, and the places."""
    sizes = ends - starts
    which = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    return which, np.arange(sizes.sum()) - first[which] + starts[which]


def _best(query: np.ndarray, row: np.ndarray, dist: np.ndarray, low: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of each query, by distance and smallest id."""
    order = np.lexsort((low[row], dist, query))
    q = query[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return order[place < k]


def search_block(rows: np.ndarray, low: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact k nearest codes of each query code: places of queries and rows, and distances. Codes are
    rows of bytes and distinct; ``low`` has the smallest id of each row code and settles ties."""
    width = int(np.clip(np.round(np.log2(max(len(rows), 2))), 4, 16))
    index = []
    for values, bits in _substrings(rows, width):
        order = np.argsort(values, kind="stable")
        index.append((order, np.concatenate(([0], np.cumsum(np.bincount(values, minlength=1 << bits)))), bits))
    masks = {}
    for bits in {b for *_, b in index}:
        values = np.arange(1 << bits, dtype=np.int64)
        ones = np.bitwise_count(values)
        masks[bits] = [values[ones == a] for a in range(bits + 1)]
    subs, m, out = [v for v, _ in _substrings(queries, width)], len(index), []
    for begin in range(0, len(queries), CHUNK):
        active = np.arange(begin, min(begin + CHUNK, len(queries)))
        found = [np.empty(0, np.int64)] * 3
        kth = np.full(len(queries), np.iinfo(np.int64).max)
        for step in range(m * (width + 1)):
            radius, part = divmod(step, m)
            order, offsets, bits = index[part]
            if radius <= bits:
                keys = (subs[part][active][:, None] ^ masks[bits][radius][None, :]).ravel()
                which, place = _expand(offsets[keys], offsets[keys + 1])
                query, row = active[which // len(masks[bits][radius])], order[place]
                dist = _distances(queries[query], rows[row])
                near = dist <= kth[query]
                query, row, dist = (np.concatenate((old, new[near])) for old, new in zip(found, (query, row, dist)))
                _, once = np.unique(query * len(rows) + row, return_index=True)
                query, row, dist = query[once], row[once], dist[once]
                best = _best(query, row, dist, low, k)
                found = query, row, dist = query[best], row[best], dist[best]
                ends = np.searchsorted(query, active, side="right")
                full = ends - np.searchsorted(query, active) == k
                kth[active[full]] = dist[ends[full] - 1]
            done = kth[active] <= m * radius + part
            if done.any():
                leaves = np.isin(found[0], active[done])
                out.append(tuple(x[leaves] for x in found))
                found, active = tuple(x[~leaves] for x in found), active[~done]
            if not len(active):
                break
        out.append(found)
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3


def _as_bytes(codes: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)


def top_k(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """For each query (id, code; as ``sign_codes`` makes them) its k nearest rows (id, code):
    query_id, rank from 1, neighbor_id, distance. Ties go to the smaller id; a query that is also a
    row finds itself.

    Repeated ids are rows of their own. With fewer than k rows all are returned; with no queries or
    no rows nothing is."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "hamming")
    first = Window.partitionBy("code").orderBy("id")
    merged = scratch.keep(
        rows.select("id", "code").withColumn("n", F.row_number().over(first)).where(F.col("n") <= k)
        .groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes",
    )
    asked = scratch.keep(queries.select(F.col("id").alias("query_id"), "code"), "queries")
    wanted = scratch.keep(asked.select("code").distinct(), "wanted")
    row_blocks = max(1, -(-merged.count() // ROW_BLOCK))
    query_blocks = max(-(-wanted.count() // QUERY_BLOCK), spark.sparkContext.defaultParallelism)
    block = lambda n: F.pmod(F.xxhash64("code"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = merged.select("code", F.get("ids", F.lit(0)).alias("low"), block(row_blocks).alias("rb"), every(query_blocks).alias("qb"))
    right = wanted.select("code", block(query_blocks).alias("qb"), every(row_blocks).alias("rb"))

    def search(index: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        names = ["asked", "code", "distance", "low"]
        if index.empty or ask.empty:
            return pd.DataFrame({c: [] for c in names})
        low = index["low"].to_numpy()
        q, r, d = search_block(_as_bytes(index["code"]), low, _as_bytes(ask["code"]), k)
        return pd.DataFrame(dict(zip(names, (ask["code"].to_numpy()[q], index["code"].to_numpy()[r], d, low[r]))))

    near = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(
        search, "asked binary, code binary, distance long, low long"
    )
    by_code = Window.partitionBy("asked").orderBy("distance", "low")
    near = near.withColumn("n", F.row_number().over(by_code)).where(F.col("n") <= k)
    by_row = Window.partitionBy("asked").orderBy("distance", "neighbor_id")
    listed = (
        near.join(merged, "code").select("asked", "distance", F.explode("ids").alias("neighbor_id"))
        .withColumn("rank", F.row_number().over(by_row)).where(F.col("rank") <= k)
    )
    return asked.join(listed, F.col("asked") == asked["code"]).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "neighbor_id", "distance"
    )
