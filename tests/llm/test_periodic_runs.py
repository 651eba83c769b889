"""Periodic runs against the definition."""

from fractions import Fraction
from hashlib import sha256
import random
import re
import zlib

import numpy as np

from shelfrank.llm import periodic_runs as R


def brute(words):
    """All runs straight from the definition: per period, maximal stretches of equal words at that lag."""
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            smaller = any(all(words[x] == words[x + p] for x in range(start, start + length - p)) for p in range(1, q))
            if length >= max(24, 3 * q) and not smaller:
                found.append((start, length, q))
            i = j
    return sorted(found)


def told(doc_id, text):
    """The contract's row, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None,) * 3
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
        sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def test_runs_follow_the_definition():
    pick = random.Random(4)
    for trial in range(1500):
        words = []
        while len(words) < pick.choice((30, 60, 150)):
            unit = [pick.randrange(pick.choice((1, 2, 3, 50))) for _ in range(pick.choice((1, 2, 3, 5, 8, 9, 13, 16, 17, 20, 33, 40)))]
            words += (unit * pick.randint(1, 9))[: pick.randint(1, 140)]
        assert R.runs_of(np.array(words)) == brute(words), words


def test_borders_of_length_and_period():
    fresh = lambda q: list(range(100, 100 + q))
    for q in [*range(1, 36), 48, 64, 65]:
        for length in (max(24, 3 * q) - 1, max(24, 3 * q), max(24, 3 * q) + 1):
            words = [1, 2, 3] + (fresh(q) * (length // q + 1))[:length] + [4, 5]
            expected = [(3, length, q)] if length >= max(24, 3 * q) else []
            assert R.runs_of(np.array(words)) == expected


def test_long_runs_and_hot_words():
    assert R.runs_of(np.zeros(300_000, int)) == [(0, 300_000, 1)]
    unit = np.arange(40_000)
    assert R.runs_of(np.tile(unit, 3)) == [(0, 120_000, 40_000)]
    assert R.runs_of(np.concatenate([np.tile([1, 2], 50), [3], np.tile([1, 2], 50)])) == [(0, 100, 2), (101, 100, 2)]
    assert R.runs_of(np.array([], int)) == [] and R.runs_of(np.arange(100)) == []


def test_documents(spark, monkeypatch):
    pick = random.Random(8)
    rows = [(i, " ".join(pick.choice("abcdefgh") for _ in range(pick.randint(0, 120)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "x " * 60), (503, "x " * 60), (504, "a b c\x1cd\x0be " * 12), (505, "w" * 200_000 + " y")]
    docs = spark.createDataFrame([(i, t, "clash", i) for i, t in rows], "doc_id long, text string, runs string, n_words long")
    got = R.run_digests(R.periodic_runs(R.with_planted_runs(docs)))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted((told(*r) for r in rows), key=key)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)
    assert got.limit(0).count() == 0 and R.periodic_runs(docs.limit(0)).count() == 0


def test_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "a b " * 12), (None, None)], "doc_id long, text string")
    got = R.periodic_runs(R.with_planted_runs(docs)).collect()
    assert sorted((r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got) == [(0, [], ""), (24, [(0, 24, 2)], "a b")]


def test_slices_do_not_show(monkeypatch):
    texts = ["a b " * 20, "", "a b " * 20, "c " * 100, "d e f " * 30] * 3
    whole = list(R.examine(texts))
    monkeypatch.setattr(R, "CHARS", 1)
    assert list(R.examine(texts)) == whole
    assert [r[3] for r in whole[:5]] == ["a b", "", "a b", "c", "d e f"]
