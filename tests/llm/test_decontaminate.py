"""Template windows against plain search and hand-made cases."""

import random
import time

from shelfrank.llm import decontaminate as D

ITEM = "Alice bought 12 apples for 3 dollars each and gave 4 of them to Bob before Alice walked 5 km home with the rest of her apples"
PLAIN = "which of the following gases is the most common one in the air that we breathe every day"


def held(spark, docs, items):
    left = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    right = spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, doc_id string")
    kept = {r["doc_id"] for r in D.decontaminate(left, right).collect()}
    found = {(r["doc_id"], r["item_id"]): r for r in D.find_items(left, right).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in found}
    return found


def test_cases(spark):
    other = ITEM.replace("Alice", "Carol").replace("Bob", "Dan").replace("12", "17").replace("dollars", "euros").replace("km", "miles")
    docs = [
        (1, f"some words before. {ITEM} and after"), (2, f"Text, {other}!"), (3, other.replace("Carol walked", "Erin walked")),
        (4, PLAIN.upper().lower() + " " + "filler " * 5000), (5, " ".join(PLAIN.split()[:7]) + " and nothing else in here"),
        (6, None), (7, ""), (8, "of them to"), (9, "what a short one this is"), (10, "a b c " * 3),
        (11, " ".join(PLAIN.split()[:14]) + " inserted " + " ".join(PLAIN.split()[14:])),
    ]
    found = held(spark, docs, [(100, ITEM), (101, PLAIN), (102, None), (103, ""), (104, "short one this"), (105, ITEM)])
    assert set(found) == {(1, 100), (1, 105), (2, 100), (2, 105), (4, 101), (9, 104), (11, 101)}
    assert found[1, 100]["exact"] and not found[2, 100]["exact"] and found[2, 100]["coverage"] == 1.0
    assert found[1, 100]["first_token"] == 3 and 0.5 <= found[11, 101]["coverage"] < 1


def test_names_and_numbers_alone_do_not_match(spark):
    docs = [(1, "Ann Bob Cid Dan 1 2 3 4 Eve Flo Gus Hal 5 6 7 8"), (2, "Zoe Yan Xia Wim 9 8 7 6 Vic Uwe Tim Sam 5 4 3 2")]
    assert set(held(spark, docs, [(7, docs[0][1])])) == {(1, 7)}


def test_empty_tables(spark):
    docs = [(1, PLAIN), (None, PLAIN), (1, PLAIN)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(None, PLAIN)], "item_id long, text string")
    assert D.find_items(df, items).count() == 3
    assert D.find_items(df, items.limit(0)).count() == 0 and D.find_items(df.limit(0), items).count() == 0
    assert D.decontaminate(df, items.limit(0)).count() == 3 and D.decontaminate(df, items).count() == 0


def test_slices_add_up(spark, monkeypatch):
    monkeypatch.setattr(D, "SLICE_BYTES", 60)
    assert set(held(spark, [(1, ITEM), (2, PLAIN), (3, "x")], [(1, ITEM), (2, PLAIN)])) == {(1, 1), (2, 2)}


def test_as_plain_search(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text")
    whole = {
        (d["doc_id"], i["item_id"]) for d in docs.collect() for i in items.collect()
        if " ".join(i["text"].split()) in " ".join(d["text"].split())
    }
    found = {(r["doc_id"], r["item_id"]) for r in D.find_items(docs, items).collect()}
    assert whole and whole == found


WORDS = "the quick survey of river plants shows that most reeds grow where slow water meets a bank of clay".split()
LONG = [f"{a}{b}" for a in ("bar", "cel", "dor", "fen", "gim", "hul") for b in ("an", "eth", "il", "osk", "um", "yr", "ack", "ond")]


def test_few_changed_words_and_long_parts(spark):
    changed = [(), (9,), (2, 12), (5, 10), (3, 7, 14), (4, 9, 14), (6, 7, 12)]
    docs = [(n, "before it " + " ".join("zq" if k in c else w for k, w in enumerate(WORDS)) + " after") for n, c in enumerate(changed)]
    docs += [(20, "x y " + " ".join(LONG[16:32]) + " z"), (21, "x y " + " ".join(LONG[16:24] + ["zq"] + LONG[25:33]) + " z")]
    docs += [(30, " ".join(WORDS[:8]) + " and then nothing else at all"), (31, " ".join(LONG[5:14])), (32, " ".join(sorted(WORDS)))]
    found = held(spark, docs, [(1, " ".join(WORDS)), (2, " ".join(LONG))])
    assert set(found) == {(n, 1) for n in range(len(changed))} | {(20, 2), (21, 2)}


def test_copies_of_an_item_are_all_found(spark):
    item = "the eleven words of this item lead to one short answer"
    edited = item.replace("this", "that")
    for n in (1, 64, 65, 1000):
        found = held(spark, [(1, f"so {edited} then"), (2, "so it is")], [(i, item) for i in range(n)])
        assert set(found) == {(1, i) for i in range(n)}


def test_anchors_and_windows_that_many_items_share_lead_to_all():
    """As many different items as the old bound and many more; each copy has its own words edited away."""
    prompt = "choose the one answer that fits the text best"
    items = [(i, f"{prompt} case{i} number{i} of these") for i in range(3000)]
    index, codes = D.Index(items), D._Codes()
    texts = [f"{prompt} zq zq of these", f"{prompt.replace('fits', 'suits')} zq number7 of these", "nothing that fits the text"]
    found = {(d, i) for d, i, *_ in index.matches(D.canonical(texts, codes))}
    assert found == {(0, i) for i in range(3000)} | {(1, i) for i in range(3000)}


def test_shared_prompt_lines_cost_little():
    prompt = "choose the one answer that fits the text best"
    pick = random.Random(3)
    items = [(i, " ".join([prompt, *("".join(pick.choice("aeioubdfgklmnprst") for _ in range(5)) for _ in range(30))])) for i in range(10_000)]
    index, codes = D.Index(items), D._Codes()
    texts = [f"{prompt} {n} and other words" for n in range(20)]
    began = time.perf_counter()
    assert not list(index.matches(D.canonical(texts, codes)))
    assert (time.perf_counter() - began) / len(texts) < 0.1
    assert [i for _, i, *_ in index.matches(D.canonical([items[77][1]], codes))] == [77]


def test_bound_loses_nothing(monkeypatch):
    """With and without the count of equal tokens before the close look, in blocks of any size."""
    pick = random.Random(11)
    word = lambda: pick.choice(WORDS + ["Ann", "Bob", "3", "17", "km"])
    items = [(i, " ".join(word() for _ in range(pick.randint(1, 40)))) for i in range(60)]
    texts = []
    for _ in range(150):
        words = pick.choice(items)[1].split()
        texts.append(" ".join(word() if pick.random() < 0.2 else w for w in words for _ in range(pick.choice((1, 1, 1, 1, 2)))))
    index, codes = D.Index(items), D._Codes()
    found = list(index.matches(D.canonical(texts, codes)))
    monkeypatch.setattr(D, "AT_ONCE", 7)
    assert list(index.matches(D.canonical(texts, codes))) == found
    monkeypatch.setattr(D.Index, "_equal", lambda self, texts, doc, item, shift: self.length[item] + 13)
    assert list(index.matches(D.canonical(texts, codes))) == found and found


def test_copies_in_other_case(spark):
    item = "The Danube rises in the Black Forest and, after Passau, Linz and Vienna, Bratislava and Budapest, reaches the Black Sea in Romania; die Straße führt entlang"
    docs = [(1, item.lower()), (2, item.upper()), (3, item.title()), (4, "so " + ITEM.upper()), (5, PLAIN.upper()), (6, PLAIN.title())]
    found = held(spark, docs, [(1, item), (2, ITEM), (3, PLAIN)])
    assert set(found) == {(1, 1), (2, 1), (3, 1), (4, 2), (5, 3), (6, 3)}
    assert all(r["coverage"] == 1.0 and r["exact"] for r in found.values())


def test_contradictory_slots_take_only_their_windows(spark):
    item = " ".join(["The", *LONG[:11], "7", *LONG[11:24], "The", *LONG[24:36], "7", *LONG[36:]])
    others = [w[::-1] for w in LONG]
    renamed = " ".join(["Ann", *others[:9], "Ann", *others[9:20], "Ann", *others[20:30], "5", *others[30:]])
    docs = [
        (1, item.replace("The", "A", 1)), (2, item[::-1].replace("7", "8", 1)[::-1]), (3, item.replace("The", "A", 1).replace("7", "9", 1)),
        (4, renamed.replace("Ann", "Eve").replace("5", "6")), (5, renamed.replace("Ann", "Eve", 2).replace("Ann", "Kim")), (6, PLAIN),
    ]
    found = held(spark, docs, [(1, item), (2, renamed)])
    assert set(found) == {(1, 1), (2, 1), (3, 1), (4, 2), (5, 2)}
    assert found[4, 2]["coverage"] == 1.0 and found[1, 1]["matched_windows"] == found[1, 1]["n_windows"] - 1
    assert found[2, 1]["n_windows"] - found[2, 1]["matched_windows"] == 8
