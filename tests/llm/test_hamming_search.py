"""Exact nearest codes against brute force."""

import numpy as np
import pytest

from shelfrank.llm import hamming_search as H


def brute(rows, queries, k):
    """rows, queries: (id, code as bytes)."""
    out = set()
    for q, code in queries:
        near = sorted((sum((a ^ b).bit_count() for a, b in zip(code, c)), i) for i, c in rows)[:k]
        out |= {(q, rank, i, d) for rank, (d, i) in enumerate(near, 1)}
    return out


def random_codes(n, seed, bits=64):
    rng = np.random.default_rng(seed)
    return [(i, rng.bytes(bits // 8)) for i in range(n)]


@pytest.mark.parametrize("blocks", [(1 << 18, 1 << 14), (40, 16)])
def test_as_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(H, "ROW_BLOCK", blocks[0])
    monkeypatch.setattr(H, "QUERY_BLOCK", blocks[1])
    rows = random_codes(300, 1) + [(1000 + i, b"\x0f" * 8) for i in range(120)] + [(2000, b"\x0f" * 7 + b"\x0e"), (7, b"\xff" * 8)]
    queries = rows[::9]
    frame = lambda x: spark.createDataFrame([(i, bytearray(c)) for i, c in x], "id long, code binary")
    got = H.top_k(frame(queries), frame(rows), 10).collect()
    assert len(got) == 10 * len(queries)
    assert {tuple(r) for r in got} == brute(rows, queries, 10)


def test_small_tables(spark):
    frame = lambda x: spark.createDataFrame([(i, bytearray(c)) for i, c in x], "id long, code binary")
    rows = random_codes(4, 2)
    assert {tuple(r) for r in H.top_k(frame(rows[:1]), frame(rows), 10).collect()} == brute(rows, rows[:1], 10)
    assert H.top_k(frame([]), frame(rows), 3).count() == 0 and H.top_k(frame(rows), frame([]), 3).count() == 0


def test_blocks_alone():
    rng = np.random.default_rng(5)
    for bits, n in ((16, 200), (64, 3000), (128, 500)):
        rows = np.unique(rng.integers(0, 256, (n, bits // 8), dtype=np.uint8), axis=0)
        near = rows[:20].copy()
        near[:, 0] ^= 5
        queries = np.unique(np.concatenate([near, rng.integers(0, 256, (20, bits // 8), dtype=np.uint8)]), axis=0)
        low = rng.permutation(len(rows))
        q, r, d = H.search_block(rows, low, queries, 7)
        for i in range(len(queries)):
            dist = np.bitwise_count(rows ^ queries[i]).sum(axis=1)
            best = np.lexsort((low, dist))[:7]
            assert set(r[q == i]) == set(best) and sorted(d[q == i]) == sorted(dist[best])


def test_codes(spark):
    rows = [(1, [1.0, -1.0, 0.0, 2.0, float("nan"), None, 1e-9, 5.0]), (2, None), (3, [1.0]), (None, [1.0] * 8), (4, [])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, code string")
    got = [tuple(r) for r in H.sign_codes(df, "vec_id", "embedding", 8).collect()]
    assert got == [(1, bytearray([0b11001001]))]
    assert H.sign_codes(df.limit(0), "vec_id", "embedding", 8).count() == 0
