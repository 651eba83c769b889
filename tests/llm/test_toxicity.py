"""Maximal segments against brute force, calibration, and held-out accuracy."""

import random
import zlib

from pyspark.sql import functions as F
import pytest

from shelfrank.llm import toxicity as T

PICK = random.Random(4)
PLAIN = ["".join(PICK.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
BAD = ["zyx" + "".join(PICK.choice("abcdefgh") for _ in range(3)) for _ in range(30)]


def ruzzo_tompa(scores):
    """All maximal scoring segments by their recursive definition."""
    def best(a, b):
        found = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if found is None or found[0] <= 0:
            return []
        i, j = found[3:]
        return [*best(a, i), (i, j, found[0]), *best(j, b)]

    return best(0, len(scores))


def test_segments_as_defined():
    pick = random.Random(1)
    for _ in range(300):
        n, other = pick.randint(0, 25), -pick.choice([0.25, 0.5, 1.0])
        scores = [pick.choice([0, 0, 0, 1.0, 2.0, 0.75]) or other for _ in range(n)]
        got = T.maximal_segments([(i, s) for i, s in enumerate(scores) if s > 0], other, n)
        assert sorted(got) == sorted(ruzzo_tompa(scores))


def corpus(n):
    docs, labels = [], []
    for i in range(n):
        words = [PICK.choice(PLAIN) for _ in range(PICK.randint(20, 150))]
        toxic = int(i % 8 == 0)
        if toxic:
            at = PICK.randrange(len(words))
            words[at:at] = [PICK.choice(BAD) for _ in range(PICK.randint(4, 9))]
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = corpus(1600)
    docs += [(5000, None), (5001, ""), (5002, " ".join(PLAIN * 300) + " " + " ".join(BAD)), (None, "a b"), (3, docs[3][1])]
    df = spark.createDataFrame([(*d, 1, 0.5) for d in docs], "doc_id long, text string, toxic int, score double")
    marks = spark.createDataFrame([*labels, (8, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    model = T.learn(df, marks)
    return docs, dict(labels), df, model, T.score(df, model).collect()


def test_held_out(scored):
    docs, labels, df, model, rows = scored
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows if r["doc_id"] is not None)
    test = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in test) / len(test) > 0.99
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[5002]["predicted"] == 1 and by_id[5000]["score"] == by_id[5001]["score"] < 0.7
    assert not by_id[None]["held_out"] and by_id[5000]["passages"] == []


def test_passages(scored):
    docs, labels, df, model, rows = scored
    texts = dict(docs)
    for r in rows[:400]:
        if r["predicted"]:
            words = T.words_of(texts[r["doc_id"]])
            best = max(r["passages"], key=lambda p: p["score"])
            inside = words[best["first"]:best["end"]]
            assert sum(w in BAD for w in inside) >= 0.8 * len(inside)


def test_filter_keeps_what_is_not_predicted(scored):
    docs, _, df, model, rows = scored
    kept = T.without_toxic(df, model)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in rows if not r["predicted"])


def test_no_labels(spark, scored):
    df = scored[2].limit(5)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.learn(df, none)
    assert {r["score"] for r in T.score(df, model).collect()} == {0.5}
    assert T.score(df.limit(0), model).count() == 0 and T.without_toxic(df, model).count() == df.count()


def test_labels_only_of_rows_that_are_not_held_out(spark):
    """Labels of held-out documents change nothing."""
    docs, labels = corpus(400)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    models = [
        T.learn(df, spark.createDataFrame([(i, 1 - y if flip and out(i) else y) for i, y in labels], "doc_id long, toxic int"))
        for flip in (False, True)
    ]
    assert models[0] == models[1]
