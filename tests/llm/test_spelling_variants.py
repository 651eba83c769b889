"""Spelling variants against comparing all pairs of words."""

from collections import Counter
import random
import re
import zlib

from pyspark.sql import functions as F
import pytest

from shelfrank.llm import spelling_variants as S
from shelfrank.llm.scratch import Scratch


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts):
    """The contract's rows from all pairs."""
    rows, form_of = {}, {}
    for word, n in counts.items():
        others = [w for w in counts if near(w, word)]
        best = min(others, key=lambda w: (-counts[w], w), default=None)
        form_of[word] = best if best is not None and counts[best] >= 10 * n else None
        rows[word] = (n, len(others))
    out = set()
    for word, (n, n_near) in rows.items():
        root = word
        while form_of[root] is not None:
            root = form_of[root]
        form = form_of[word]
        out.add((word, form, root, n, n_near, counts[form] if form is not None else None))
    return out


def count_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def random_words(pick, letters, sizes, n):
    return sorted({"".join(pick.choice(letters) for _ in range(pick.choice(sizes))) for _ in range(n)})


def test_composition_finds_all_pairs_once():
    pick = random.Random(2)
    for trial in range(400):
        long = pick.randint(1, 5)
        words = random_words(pick, "abc"[: pick.randint(1, 3)], (long, long - 1), pick.randint(1, 25))
        behind = pick.choice(("", "a", "b"))
        pairs = S.near_within(words, long, behind)
        assert len(set(map(frozenset, pairs))) == len(pairs)
        whole = lambda w: w + behind
        expected = set()
        for i, a in enumerate(words):
            for k, b in enumerate(words[:i]):
                if not near(a, b) or max(len(a), len(b)) < long:
                    continue
                short, tall = sorted((whole(a), whole(b)), key=len)
                same = next((x for x, (c, d) in enumerate(zip(short, tall)) if c != d), len(short))
                if same < long:  # else the last place to delete at is behind the window
                    expected.add(frozenset((i, k)))
        assert set(map(frozenset, pairs)) == expected, (words, long, behind)


def test_acceptor_is_minimal_and_ranks():
    words = random_words(random.Random(3), "ab", range(6), 200)
    acceptor = S.Acceptor(words)
    assert acceptor.size[acceptor.root] == len(words)
    languages = []
    for q, arcs in enumerate(acceptor.arcs):
        own = {""} if acceptor.final[q] else set()
        languages.append(frozenset(own | {x + w for x, (to, _) in arcs.items() for w in languages[to]}))
    assert len(set(languages)) == len(languages) and languages[acceptor.root] == set(words)
    for rank, word in enumerate(words):
        q, at = acceptor.root, 0
        for letter in word:
            q, before = acceptor.arcs[q][letter]
            at += before
        assert acceptor.final[q] and at == rank


@pytest.mark.parametrize("limit", [2000, 3, 1])
def test_groups(spark, monkeypatch, limit):
    monkeypatch.setattr(S, "LIMIT", limit)
    pick = random.Random(limit)
    words = random_words(pick, "abé", (0, 1, 2, 3, 4, 5, 7), 250) + ["commonbeginning" + x for x in random_words(pick, "abc", (1, 2, 3), 60)]
    words += ["z" * 3000, "z" * 2999, "z" * 1500 + "y" + "z" * 1499]
    counts = {w: pick.choice((2, 2, 3, 20, 25, 200, 2500, 30000)) for w in words}
    rows = [(w, n, "x") for w, n in counts.items()] + [(None, 5, "x"), ("abc", None, "x")]
    data = spark.createDataFrame(rows, "word string, n long, best string")
    assert set(map(tuple, S.group_variants(data).collect())) == brute(counts)
    pairs = [tuple(r) for r in S.near_pairs(data.where("word is not null and n is not null"), Scratch(spark, "t")).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in words for b in words if a < b and near(a, b)}


def test_repeated_rows_and_none(spark):
    data = spark.createDataFrame([("abcdefg", 1), ("abcdefg", 2), ("abcdefgh", 30)], "word string, n long")
    assert set(map(tuple, S.group_variants(data).collect())) == brute({"abcdefg": 3, "abcdefgh": 30})
    assert S.group_variants(data.limit(0)).count() == 0


def test_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", F.lit(1).alias("word"), F.lit("n").alias("n"))
    extra = [(None, "Ünäbcdéfg ÜNÄBCDéfg ×××÷÷÷÷ ×××÷÷÷÷", 1, "n"), (-1, None, 1, "n"), (-2, "", 1, "n"), (-3, "WORDWORD wordword wordwordx", 1, "n")]
    extra += [(-4, "q" * 100_000, 1, "n"), (-5, "Q" * 100_000, 1, "n")] + [(-6, "verycommon " * 3000 + "verycommn verycommn", 1, "n")] * 2
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    counts = count_words([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["word"]: r["n"] for r in S.vocabulary(docs).collect()} == counts
    few = {w for w in counts if w[0] in "aqvwü"}
    got = S.group_variants(S.vocabulary(docs).where(F.col("word").isin(few)))
    assert set(map(tuple, got.collect())) == brute({w: counts[w] for w in few})
