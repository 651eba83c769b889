"""Content-defined chunks, and repeated runs against a brute-force count of chunks."""

from collections import Counter, defaultdict
import random

from shelfrank.llm import substring_dedup as S

PICK = random.Random(1)
WORDS = ["".join(PICK.choice("abcdefghijklmnopé") for _ in range(PICK.randint(2, 8))) for _ in range(3000)]


def prose(n, pick=PICK):
    return " ".join(pick.choice(WORDS) for _ in range(n))


def test_chunks_cover_each_text_alone():
    texts = [prose(200).encode(), b"", b"x", ("é" * 700).encode(), b"a" * 1000, prose(3).encode()]
    together = list(S.chunk_texts(texts))
    for text, got in zip(texts, together):
        assert [got] == list(S.chunk_texts([text]))
        starts, ends, _ = got
        assert b"".join(text[a:b] for a, b in zip(starts, ends)) == text
        assert all(0 < b - a <= S.MAX_CHUNK for a, b in zip(starts, ends))
        for a, b in zip(starts, ends):
            text[a:b].decode()


def test_insertion_moves_few_borders():
    text = prose(2000).encode()
    a, b = ({d for d in got[2]} for got in S.chunk_texts([text, text[:5000] + b"inserted " + text[5000:]]))
    assert len(a & b) >= len(a) - 6


def brute(rows):
    where = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        for start, end, d in zip(*next(S.chunk_texts([(text or "").encode()]))):
            where[d].append((doc, start, end))
    repeated = {d: min(doc for doc, *_ in v) for d, v in where.items() if len(v) > 1}
    runs = set()
    for doc in {d for d, _ in rows}:
        spans = sorted({(s, e) for d in repeated for x, s, e in where[d] if x == doc})
        while spans:
            run = [spans.pop(0)]
            while spans and spans[0][0] <= run[-1][1]:
                run.append(spans.pop(0))
            if run[-1][1] - run[0][0] >= S.MIN_RUN:
                runs.add((doc, run[0][0], run[-1][1]))
    return runs


def test_runs_as_brute_force(spark):
    passage, other = prose(60), prose(51)
    rows = [(i, prose(80)) for i in range(30)]
    rows += [(100 + i, f"{prose(30)} {passage} {prose(20 + i)}") for i in range(4)]
    rows += [(200, f"{other} {prose(10)} {other}"), (300, rows[5][1]), (301, None), (302, ""), (303, "short"), (304, "short")]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, text string, start string, d1 int")
    got = S.repeated_runs(df).collect()
    assert {(r["doc_id"], r["start"], r["end"]) for r in got} == brute(rows)
    assert {r["doc_id"] for r in got} == {5, 100, 101, 102, 103, 200, 300}
    cut = {r["doc_id"]: r["cut_bytes"] for r in got}
    assert cut[5] == cut[100] == 0 and cut[300] == len(rows[5][1].encode())
    left = {r["doc_id"]: r["text"] for r in S.without_repeats(df).collect()}
    assert left[300] == "" and left[5] == rows[5][1] and left[301] is None and left[303] == "short"
    assert len(left[101]) < len(dict(rows)[101]) - len(passage) / 2
    counts = Counter(" ".join(t or "" for t in left.values()).split())
    assert all(counts[w] for w in passage.split())


def test_ids_that_repeat_or_lack(spark):
    text = prose(100)
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, text)], "doc_id long, text string")
    got = {(r["doc_id"], r["cut_bytes"]) for r in S.repeated_runs(df).collect()}
    assert got == {(1, 0), (None, len(text.encode()))}
    assert S.repeated_runs(df.limit(0)).count() == 0


def test_different_texts_under_one_id_do_not_mix(spark):
    texts = [prose(n) for n in (60, 55, 70)]
    own = [prose(40) for _ in range(4)]
    inside = [f"{own[0]} {texts[0]}", f"{texts[1]} {own[1]}", f"{own[2]} {texts[2]} {own[3]}", prose(90)]
    rows = [(n, t) for n, t in enumerate(texts)]
    apart = spark.createDataFrame(rows + [(10 + n, t) for n, t in enumerate(inside)], "doc_id long, text string")
    cuts = lambda df, low: sorted(
        (r["start"], r["end"], r["n_chunks"], r["cut_bytes"]) for r in S.repeated_runs(df).collect() if r["doc_id"] is None or r["doc_id"] >= low
    )
    told = cuts(apart, 10)
    assert len(told) == 3
    left = {r["text"] for r in S.without_repeats(apart).collect()}
    for doc in (None, 10):
        together = spark.createDataFrame(rows + [(doc, t) for t in inside], apart.schema)
        assert cuts(together, 10) == told
        assert {r["text"] for r in S.without_repeats(together).collect()} == left
