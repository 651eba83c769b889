"""Encoding and decoding against the tokenizers library."""

from hashlib import sha256
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from shelfrank.llm import bpe
from shelfrank.llm.bpe import tokenizer_json

LIBRARY = Library.from_file(public_tokenizers.path("byte_bpe_50k.json"))
OURS = bpe.Tokenizer(tokenizer_json())


def ids(text):
    return [int(i) for b in OURS.encode(text) for i in b.split(b",")]


def expected(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


TEXTS = [
    "", " ", "  \n\n  x", "it's we'll 'tis I'D", "tionenreeauenaux " * 50, "naïve Éreaux ßß 漢字 😀👩‍👩‍👧", "a<|endoftext|>b <|endoftext|>",
    "<|endoftext|><|endoftext|>", "﻿\x00\x1c\x1f\x85\xa0 ", "1234567890²½Ⅻ", "x" * 5000, " " * 3000 + "y", "=-" * 4000,
    "࢏౜ a႔0b", "é" * 20000, "\t\t\tcode = {'a': 1}\r\n", "é ‍",
]


@pytest.mark.parametrize("text", TEXTS)
def test_same_as_library(text):
    assert ids(text) == expected(text)
    decoder = bpe.Decoder(OURS)
    parts = [decoder.push([b"%d" % i]) for i in ids(text)]
    assert "".join(parts) + decoder.finish() == LIBRARY.decode(expected(text), skip_special_tokens=False)


def test_every_character():
    bulk = (range(0x3400, 0x9F00), range(0xAC00, 0xD700), range(0xD800, 0xF900))  # letters alike, no characters, private
    every = [chr(c) for c in range(0x20000) if not any(c in r for r in bulk)]
    every += [chr(c) for first in (0x2A600, 0x2B700, 0x2CEA0, 0x323A0, 0x33470, 0x3CFF0, 0x3FC30, 0xE0000) for c in range(first, first + 400)]
    for begin in range(0, len(every), 5000):
        text = "".join(f"a{c}{c}1{c} .{c}b" for c in every[begin:begin + 5000])
        assert ids(text) == expected(text)


def test_windows_do_not_show(monkeypatch):
    assert 128 <= OURS.lookahead < 1000
    monkeypatch.setattr(bpe, "WINDOW", 1)
    monkeypatch.setattr(bpe, "PIECE", 50)
    pick = random.Random(3)
    for letters in ("a", "ab", "thein", "=-", "etaoinshr", " \n", "éa"):
        for _ in range(6):
            text = "".join(pick.choice(letters) for _ in range(2500))
            assert ids(text) == expected(text)
    words = " ".join("".join(pick.choice("etaoinshr") for _ in range(pick.randint(1, 12))) for _ in range(500))
    assert ids(words) == expected(words)


def test_invalid_bytes_decode_as_in_library():
    pick = random.Random(5)
    for _ in range(200):
        some = [pick.randrange(256) for _ in range(30)] + [pick.randrange(50000) for _ in range(10)]
        decoder = bpe.Decoder(OURS)
        assert decoder.push([b"%d" % i for i in some]) + decoder.finish() == LIBRARY.decode(some, skip_special_tokens=False)


def test_documents(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(90, None, "x"), (91, "tie", "x"), (91, "tie", "x"), (None, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode_documents(docs, tokenizer_json(), with_ids=True).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, text, _ in rows:
        told = expected(text or "")
        assert by_id[i]["ids"] == told and by_id[i]["n_tokens"] == len(told)
        assert by_id[i]["ids_sha256"] == sha256(",".join(map(str, told)).encode()).hexdigest()
        assert by_id[i]["decoded_sha256"] == sha256(LIBRARY.decode(told, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(docs.limit(0), tokenizer_json()).count() == 0
