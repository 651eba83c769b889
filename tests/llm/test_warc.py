"""WARC writer and salvage reader."""

from hashlib import sha1
import random

import pytest

from shelfrank.llm.warc import Gap, Record, archive_pages, make_record, member, read_archives, salvage


def records(n=6, size=400):
    bodies = [f"page {i} ".encode() * size for i in range(n)]
    return bodies, [make_record(i, f"http://a.example/{i}", b, sha1(b).hexdigest(), None) for i, b in enumerate(bodies)]


def split(content):
    found = list(salvage(content))
    return [x.payload() for x in found if isinstance(x, Record)], [(x.offset, x.length) for x in found if isinstance(x, Gap)]


@pytest.mark.parametrize("pack", [member, bytes])
def test_sound_file_has_no_gaps(pack):
    bodies, made = records()
    assert split(b"".join(map(pack, made))) == (bodies, [])


@pytest.mark.parametrize("pack", [member, bytes])
@pytest.mark.parametrize("hurt", ["flip", "cut", "noise", "drop"])
def test_damage_costs_one_record_and_is_logged(pack, hurt):
    bodies, made = records()
    parts = [pack(r) for r in made]
    p = parts[2]
    parts[2] = {
        "flip": p[: len(p) // 2] + bytes([p[len(p) // 2] ^ 255]) + p[len(p) // 2 + 1:],
        "cut": p[: len(p) // 2],
        "noise": p[:10] + b"\x1f\x8b\x08WARC/1.1\r\nX" + p[30:],
        "drop": b"WARC/1.1\r\nContent-Length: 99999999\r\n\r\n",
    }[hurt]
    got, gaps = split(b"".join(parts))
    assert got == bodies[:2] + bodies[3:]
    assert gaps == [(len(parts[0] + parts[1]), len(parts[2]))]


def test_end_and_start_of_file():
    bodies, made = records(3)
    whole = b"".join(map(member, made))
    assert split(b"junk" + whole) == (bodies, [(0, 4)])
    assert split(whole[:-3])[0] == bodies[:2]
    assert split(b"") == ([], [])
    assert split(b"nothing at all") == ([], [(0, 14)])


def test_several_records_in_one_member():
    bodies, made = records(4)
    hurt = bytearray(made[1])
    hurt[-50] ^= 1
    got, gaps = split(member(made[0] + bytes(hurt) + made[2]) + member(made[3]))
    assert got == [bodies[0], bodies[2], bodies[3]] and len(gaps) == 1


@pytest.mark.parametrize("size", [40, 4000])
def test_damaged_member_gives_its_sound_records(size):
    """Records before the damage are kept, the member's bytes are logged, and what follows is read."""
    rng = random.Random(size)
    bodies = [bytes(rng.choice(b"abcdefgh \n") for _ in range(size * 10)) for _ in range(4)]
    made = [make_record(i, None, b, sha1(b).hexdigest(), None) for i, b in enumerate(bodies)]
    one, other = member(b"".join(made)), member(made[0])
    flipped = one[:-len(one) // 8] + bytes([one[-len(one) // 8] ^ 255]) + one[1 - len(one) // 8:]
    for hurt in (one[: len(one) * 7 // 8], flipped):
        got, gaps = split(hurt + other)
        assert got == [*bodies[:3], bodies[0]]
        assert gaps == [(0, len(hurt))]
    wrong_sum = one[:-8] + b"\0\0\0\0" + one[-4:]
    assert split(wrong_sum + other) == ([bodies[0]], [(0, len(one))])  # any header may be wrong


def test_archive_round_trip(spark):
    long = "x" * 1500
    rows = [
        (1, "http://a/1", long), (2, None, long), (7, "http://a\n/7", long), (7, "http://a/7", long),
        (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", long), (9, "ü", "é" * 600),
        (8, "u", "y" * 3_000_000),
    ]
    pages = spark.createDataFrame([(*r, 0, "clash") for r in rows], "page_id long, url string, html string, n int, digest string")
    got = sorted(tuple(r)[:5] for r in archive_pages(pages).collect() if r["page_id"] is not None)
    expected = []
    for i, _, html in rows:
        if i is None:
            continue
        data = (html or "").encode()
        revisit = html == long and i != 7
        expected.append((i, len(data), sha1(data).hexdigest(), "revisit" if revisit else "response", 7 if revisit else None))
    assert got == sorted(expected)
    assert archive_pages(pages).where("page_id is null").first()["record_type"] == "response"
    assert archive_pages(pages.limit(0)).count() == 0


def test_reader_rows(spark):
    bodies, made = records(3)
    content = member(made[0]) + b"???" + member(made[2])
    rows = read_archives(spark.createDataFrame([("f", content), ("g", None)], "path string, content binary")).collect()
    assert [(r["gap"], r["page_id"], r["payload"]) for r in rows] == [
        (False, 0, bytearray(bodies[0])), (True, None, None), (False, 2, bytearray(bodies[2])),
    ]
