"""Chat formatting, line deduplication and sharding: SQL, hand-made cases, no Python in the plans."""

from collections import Counter
from hashlib import sha256

from pyspark.sql import functions as F
import pytest

from conftest import plan_of
from shelfrank.llm import chat_format as C
from shelfrank.llm import line_dedup as L
from shelfrank.llm import sharding as S
from shelfrank.llm.queries import registered


@pytest.mark.parametrize("name", ["op5_chat_format", "op6_line_dedup", "op7_sharding"])
def test_no_python(name, spark, folder):
    plan = plan_of(registered()[name](spark, folder))
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))


# --- chat formatting


ROWS = [
    (1, 0, "system", "be ~ [INST] brief"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "~0~1~2[<"),
    (2, 0, "assistant", "first"), (2, 1, "user", None),
    (3, 0, "user", "a"), (3, 1, "tool] [x", "b"), (3, 2, "assistant", "c"),
    (4, 0, None, ""), (5, 0, "user", "x" * 200_000), (5, 1, "assistant", "é😀" * 50_000),
    (6, 1, "user", "q"), (6, 1, "user", "q"), (None, 0, "user", "hi"), (None, None, "system", "s"),
]


@pytest.fixture(scope="module")
def chats(spark):
    df = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "conv_id long, turn long, role string, text string, segments string, n_turns int")
    return C.format_chats(df)


def test_round_trip(chats):
    turns = {}
    for conv, turn, role, text in sorted(ROWS, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        turns.setdefault(conv, []).append((role or "", text or ""))
    got = {r["conv_id"]: r for r in C.chat_digests(chats).collect()}
    assert set(got) == set(turns)
    for conv, told in turns.items():
        learned = "".join(t for r, t in told if r == "assistant")
        digest = sha256("".join(f"{r}\n{t}\n" for r, t in told).encode()).hexdigest()
        row = got[conv]
        assert (row["n_turns"], row["turns_sha256"]) == (len(told), digest)
        assert (row["loss_chars"], row["loss_sha256"]) == (len(learned), sha256(learned.encode()).hexdigest())


def test_machine_and_segments(chats):
    got = {r["conv_id"]: r for r in chats.collect()}
    assert [got[i]["valid"] for i in (1, 2, 3, 4, 5, 6)] == [True, False, False, False, True, False]
    assert [got[i]["bad_turn"] for i in (1, 2, 3, 4, 5, 6)] == [None, 0, 1, 0, None, 1]
    assert got[1]["complete"] and got[1]["end_state"] == "assistant" and got[3]["end_state"] == "user"
    assert got[None]["valid"] and not got[None]["complete"]
    segments = got[1]["segments"]
    assert "".join(s["text"] for s in segments) == got[1]["formatted"]
    assert [s["text"] for s in segments if s["loss"]] == ["~00~01~02~1~2"]
    assert got[1]["formatted"].count("[INST] ") == 1


def test_no_conversations(chats, spark):
    assert C.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- line deduplication


def test_lines(spark):
    rows = [(i, "a.example", f"menu\nown {i}\n\nfooter\nfooter") for i in range(9)] + [(9, "a.example", "menu\nlong " + "y" * 300_000)]
    rows += [(20, None, "x\nz"), (21, None, "x"), (22, None, "x\nx"), (30, "tiny", "same"), (31, "tiny", "same")]
    rows += [(40, "a.example", None), (41, "a.example", ""), (0, "a.example", rows[0][2])]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, host string, text string, line string, lines int")
    got = Counter(tuple(r) for r in L.drop_boilerplate(df, "host", ratio=0.7).select("doc_id", "host", "text", "n_lines", "n_dropped").collect())
    pages = Counter(h for _, h, _ in rows)
    where = Counter((h, line) for _, h, t in rows for line in set((t or "").split("\n")) if line.strip())
    expected = Counter()
    for doc, host, text in rows:
        lines = [] if text is None else text.split("\n")
        stay = [x for x in lines if not (where[host, x] >= L.MIN_PAGES and where[host, x] > 0.7 * pages[host])]
        expected[doc, host, None if text is None else "\n".join(stay), len(lines), len(lines) - len(stay)] += 1
    assert got == expected
    assert L.drop_boilerplate(df, "host").columns == [*df.columns, "n_lines", "n_dropped"]
    assert L.drop_boilerplate(df, "host", counts=False).columns == df.columns
    assert L.drop_boilerplate(df.limit(0), "host").count() == 0


def test_share_equal_to_the_ratio_stays(spark):
    df = spark.createDataFrame([(i, "h", "a" if i < 3 else "b") for i in range(6)], "doc_id int, host string, text string")
    assert L.drop_boilerplate(df, "host", ratio=0.5).where("n_dropped > 0").count() == 0


# --- sharding


def by_turns(shards, size):
    """The table by literally going through each shard's order of preference."""
    orders = []
    for s in shards:
        offset, skip = S._number(f"offset:{s}") % size, S._number(f"skip:{s}") % (size - 1) + 1
        orders.append([(offset + j * skip) % size for j in range(size)])
    owner = {}
    while len(owner) < size:
        for i, order in enumerate(orders):
            if len(owner) < size:
                owner[next(slot for slot in order if slot not in owner)] = i
    return [owner[i] for i in range(size)]


def test_table():
    names = [f"s{i}" for i in range(7)]
    assert S.fill_table(names, 101) == by_turns(names, 101)
    counts = Counter(S.fill_table(names, 1009))
    assert max(counts.values()) - min(counts.values()) <= 1
    before, after = S.fill_table(names, 8191), S.fill_table(names[:-1], 8191)
    kept = sum(a == b for a, b in zip(before, after) if a != 6)
    assert kept > 0.8 * sum(a != 6 for a in before)
    for bad in ((names, 100), ([], 101), (["a", "a"], 101), (names, 5)):
        with pytest.raises(ValueError):
            S.fill_table(*bad)


def test_placement(spark):
    rows = [(f"k{i % 50}", i) for i in range(500)] + [(None, 1), ("", 2), ("hot", 3), ("hot", 3), ("x" * 100_000, 4)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "key string, n int, shard string")
    got = S.place(df, "key", ["a", "b", "c"], 101)
    assert got.columns == ["key", "n", "slot", "shard"] and got.count() == len(rows)
    per = got.groupBy("key").agg(F.count_distinct("shard").alias("n")).where("n > 1")
    assert per.isEmpty()
    table = S.fill_table(["a", "b", "c"], 101)
    for r in got.collect():
        slot = S._number(r["key"] or "") % 101
        assert (r["slot"], r["shard"]) == (slot, "abc"[table[slot]])
    assert S.place(df.limit(0), "key", ["a"], 101).count() == 0


def test_shards_written(spark, tmp_path):
    path = str(tmp_path / "shards")
    placed = S.place(spark.range(300), "id", ["a", "b", "c"], 101)
    S.write_shards(placed, path, 2)
    back = spark.read.parquet(path)
    assert {tuple(r) for r in back.select("id", "shard").collect()} == {tuple(r) for r in placed.select("id", "shard").collect()}
