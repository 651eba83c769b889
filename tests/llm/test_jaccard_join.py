"""Classes and link counts against a comparison of all pairs."""

import random

import pytest

from shelfrank.llm import jaccard_join as J
from shelfrank.llm.components import _with_least, components
from shelfrank.llm.scratch import Scratch

PICK = random.Random(2)
WORDS = ["".join(PICK.choice("abcdefghij") for _ in range(PICK.randint(2, 7))) for _ in range(800)]


def prose(n):
    return [PICK.choice(WORDS) for _ in range(n)]


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), doc) if x is not None), default=None)
    return sorted(((doc, least[find(i)], links[i]) for i, (doc, _) in enumerate(rows)), key=str)


def near(words, n):
    """A copy with n words changed."""
    words = list(words)
    for i in PICK.sample(range(len(words)), n):
        words[i] = PICK.choice(WORDS)
    return " ".join(words)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, sid string, n int")
    return sorted((tuple(r)[:3] for r in J.classify(df).collect()), key=str)


def many():
    rows = []
    for _ in range(12):
        base = prose(PICK.choice([30, 120, 400]))
        rows += [near(base, PICK.randint(0, max(1, len(base) // 40))) for _ in range(PICK.randint(2, 12))]
    rows += [" ".join(prose(PICK.randint(1, 200))) for _ in range(40)]
    shared = prose(60)
    rows += [" ".join(prose(100) + shared + prose(100)) for _ in range(15)]
    rows += [rows[0]] * 5 + ["a b", "a  B", "a b c d e", "A b c d e", "x"]
    return [(i, t) for i, t in enumerate(rows)] + [(900, None), (901, ""), (902, " \n"), (None, rows[3]), (None, "only here"), (7, rows[7])]


@pytest.mark.parametrize("sizes", [(256, 512, 256), (4, 6, 3)])
def test_as_brute_force(spark, monkeypatch, sizes):
    for name, size in zip(("SMALL", "SKETCH_BLOCK", "TEXT_BLOCK"), sizes):
        monkeypatch.setattr(J, name, size)
    rows = many()
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, [(1, "a b c d e f")]) == [(1, 1, 0)]
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert J.classify(df.limit(0)).count() == 0


def test_recall_formula():
    assert J.survival(0.8, 1) == pytest.approx(0.84)
    n = J.runs_needed(0.8, J.LAST_DEPTH, J.TARGET_RECALL)
    assert (1 - J.survival(0.8, J.LAST_DEPTH)) ** n <= 1 - J.TARGET_RECALL < (1 - J.survival(0.8, J.LAST_DEPTH)) ** (n - 1)


def test_components_of_a_hub(spark):
    edges = [(70, n) for n in range(100, 3100)] + [(5, 70), (4000, 4001)]
    found = components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t"), "hub").collect()
    want = {n: 5 for n in [5, 70, *range(100, 3100)]} | {4000: 4000, 4001: 4000}
    assert len(found) == len(want) and {r["node"]: r["root"] for r in found} == want
    met = _with_least(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(met) == len(edges) and {(r["u"], r["m"]) for r in met} == {(70, 100), (5, 70), (4000, 4001)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (50, 50), (200, 100), (7, 3)]
    found = components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t"), "c").collect()
    assert {(r["node"], r["root"]) for r in found} == {(i, 1) for i in range(1, 41)} | {(i, 90) for i in (90, 95, 100, 200)}


def test_one_text_a_set_reaches_the_blocks(spark, monkeypatch):
    base, seen = prose(60), []
    rows = [(n, near(base, 1)) for n in (None, None, None, 5, 5, 7)] + [(n, " ".join(prose(40))) for n in [None] * 50 + [5] * 20]
    rows += [rows[0]] * 30
    exact = J._exact_links

    def spy(dealt, threshold):
        seen.append((dealt.count(), dealt.select("sid").distinct().count()))
        return exact(dealt, threshold)

    monkeypatch.setattr(J, "_exact_links", spy)
    assert run(spark, rows) == brute(rows)
    (dealt, sets), = seen
    assert dealt == sets >= 6
