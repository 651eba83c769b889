"""The transducer against the tiktoken library."""

from base64 import b64encode
from hashlib import sha256
import random
from struct import pack

import public_tokenizers
import pytest
import tiktoken

from shelfrank.llm import bpe_transducer as B

OURS = B.Transducer(B.rank_file(), public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=OURS.ranks, special_tokens={})
TEXTS = [
    "", " ", "  \n\n  x", "it's we'll 'tis I'D", "tionenreeauenaux " * 50, "naïve Éreaux ßß 漢字 😀👩‍👩‍👧", "a<|endoftext|>b",
    "﻿\x00\x1c\x1f\x85\xa0 ", "1234567890²½Ⅻ", "x" * 5000, " " * 3000 + "y", "=-" * 4000, "࢏౜ a႔0b", "é" * 20000, "\t\t\tcode = {'a': 1}\r\n",
]


def ids(text, machine=OURS):
    return [i for block in machine.encode(text) for i in memoryview(block).cast("I")]


@pytest.mark.parametrize("text", TEXTS)
def test_same_as_library(text):
    told = LIBRARY.encode_ordinary(text)
    assert ids(text) == told
    assert B.digests(OURS, text) == (len(told), sha256(pack(f"<{len(told)}I", *told)).hexdigest(), sha256(text.encode()).hexdigest(), len(text))


def test_other_vocabulary_and_random_words():
    other = B.Transducer(B.rank_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("other", pat_str=public_tokenizers.PATTERN, mergeable_ranks=other.ranks, special_tokens={})
    pick = random.Random(3)
    for letters in ("a", "ab", "thein", "=-", "etaoinshr", " \n", "éa", "aäöü漢字", "0123"):
        for _ in range(20):
            text = "".join(pick.choice(letters) for _ in range(pick.randint(1, 900)))
            assert ids(text) == LIBRARY.encode_ordinary(text)
            assert ids(text, other) == library.encode_ordinary(text)


def test_every_character():
    bulk = (range(0x3400, 0x9F00), range(0xAC00, 0xD700), range(0xD800, 0xE000))  # letters alike, no characters
    every = [chr(c) for c in range(0x20000) if not any(c in r for r in bulk)] + [chr(c) for c in range(0x2A600, 0x110000, 97)]
    for begin in range(0, len(every), 5000):
        text = "".join(f"a{c}{c}1{c} .{c}b" for c in every[begin:begin + 5000])
        assert ids(text) == LIBRARY.encode_ordinary(text)


def test_bounds_do_not_show(monkeypatch):
    for name, value in {"STATES": 3, "PAIRS": 5, "WORDS": 2, "PIECE": 40, "BLOCK": 30}.items():
        monkeypatch.setattr(B, name, value)
    small = B.Transducer(B.rank_file(), public_tokenizers.PATTERN)
    pick = random.Random(6)
    text = " ".join("".join(pick.choice("etaoinshr") for _ in range(pick.randint(1, 60))) for _ in range(400))
    assert ids(text, small) == LIBRARY.encode_ordinary(text)
    assert len(small.states) <= 4


def test_output_lags_by_a_bounded_number_of_bytes():
    """No state holds back more than a few tokens, whatever is read and however long the word."""
    pick = random.Random(9)
    for letters in ("a", "ab", "etaoinshr", "=-"):
        state, held = OURS.start, 0
        for _ in range(20_000):
            _, state = state[ord(pick.choice(letters))]
            held = max(held, sum(len(OURS.bytes_of[t]) for t in memoryview(state.last).cast("I")))
        assert held < 3 * OURS.longest


def test_rank_files_that_merges_do_not_reach():
    lines = b"\n".join(b64encode(bytes([b])) + b" %d" % b for b in range(256))
    with pytest.raises(ValueError, match="no merges"):
        B.Transducer(lines + b"\n" + b64encode(b"abc") + b" 256\n", public_tokenizers.PATTERN)


def test_decoder_takes_any_split():
    decoder = B.TextDecoder(OURS.bytes_of)
    some = [OURS.ranks[bytes([b])] for b in "é漢😀x".encode()] + [OURS.ranks[b"\xff"]]
    parts = [decoder.push(pack("<I", i)) for i in some]
    assert b"".join(data for data, _ in parts) == "é漢😀x".encode() + b"\xff"
    assert "".join(text for _, text in parts) + decoder.finish() == "é漢😀x�"


def test_documents(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(90, None, "x"), (91, "tie", "x"), (91, "tie", "x"), (None, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = B.encode_ranked(docs, B.rank_file(), with_ids=True).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, text, _ in rows:
        told = LIBRARY.encode_ordinary(text or "")
        assert by_id[i]["ids"] == told and by_id[i]["n_tokens"] == len(told) and by_id[i]["decoded_chars"] == len(text or "")
        assert by_id[i]["decoded_sha256"] == sha256((text or "").encode()).hexdigest()
    assert B.encode_ranked(docs.limit(0), B.rank_file()).count() == 0
