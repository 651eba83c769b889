"""Byte-level BPE by a rank file, compiled into a finite-state transducer.

A list of tokens is what the merges make of a word exactly if no merge crosses any two neighbours, and
whether one crosses two given tokens can be told from these two alone. So a nondeterministic transducer
that guesses where tokens end, and accepts a token only if it keeps apart from the one before, reads a
word in exactly one way. It has as many states as there are pairs of a token and a beginning of one, too
many to write out, and it is made deterministic lazily: a state of the deterministic machine is the set of
open guesses, each with the tokens that it has not emitted yet. Of the token before, a guess keeps only
which tokens it still allows, and a guess that allows none is closed, so ways that go on alike share a
state. What all open guesses agree on is emitted on the step. States and steps are made when a text first
needs them and are forgotten together once there are too many. A guess stays open for at most the longest
token, and guesses differ only where a merge may still reach, so output lags behind the input by a bounded
number of bytes. The way of a short word from the start to its end is remembered as one step, in a table of
bounded size.

The rank of a token is its id. Decoding pushes tokens through an incremental UTF-8 state machine, which
holds three bytes at most.
"""

from base64 import b64decode
from codecs import getincrementaldecoder
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from pathlib import Path
from struct import pack

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
import regex

STATES = 100_000  # states held at once
PAIRS = 500_000  # answers about pairs of tokens held at once
WORDS, SHORT = 250_000, 48  # words remembered in each of two generations, and their longest
FEW = 48  # tokens with one beginning that are judged together
PIECE = 1 << 16  # characters cut into words at once
BLOCK = 1 << 14  # bytes walked at once
TEXTS = 256  # texts held as Python objects at once
NONE = 1 << 62
PLACE = regex.compile(r"(?<=\S) (?=\S)")  # a word always begins with this blank


def rank_file(name: str = "byte_bpe_50k.tiktoken") -> bytes:
    """The content of a public rank file: a token in base64 and its rank in each line."""
    return Path(public_tokenizers.path(name)).read_bytes()


class _State(dict):
    """By byte, the ids emitted and the state after it. ``last`` holds the ids that the end of the word adds;
    ids are little-endian unsigned 32-bit numbers."""

    __slots__ = ("guesses", "last", "machine")

    def __missing__(self, byte: int) -> tuple[bytes, "_State"]:
        self[byte] = step = self.machine.step(self.guesses, byte)
        return step


class _Words(dict):
    """Ids of short words, each the way from the start state to its end. A full table becomes the older
    generation, whose words are taken over when they come again and are forgotten the next time."""

    def __init__(self, machine: "Transducer"):
        super().__init__()
        self.machine, self.older = machine, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = b"".join(self.machine.walk(word.encode()))
            if len(word) > SHORT:
                return ids
        if len(self) >= WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Transducer:
    """Encoder for the words that ``pattern`` cuts from a text."""

    def __init__(self, content: bytes, pattern: str):
        self.ranks = {b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        if any(self.ranks.get(bytes([b]), NONE) >= 256 for b in range(256)):
            raise ValueError("the ranks of single bytes must be the least")
        self.parts = {rank: self._parts(token) for token, rank in self.ranks.items() if len(token) > 1}
        self.longest = max(map(len, self.ranks))
        self.words = regex.compile(pattern)
        self.arcs: dict[int, int] = {}  # beginnings of tokens as numbers; 0 is the empty one
        self.ends = [-1]  # the token that a beginning is, if it is one
        self.below: list[list[int]] = [[]]  # the longer tokens that begin so; FEW and one where there are more
        for token, rank in self.ranks.items():
            at = 0
            for byte in token:
                if (arc := at << 8 | byte) not in self.arcs:
                    self.arcs[arc] = len(self.ends)
                    self.ends.append(-1)
                    self.below.append([])
                if len(self.below[at]) <= FEW:
                    self.below[at].append(rank)
                at = self.arcs[arc]
            self.ends[at] = rank
        self._allowed: dict[tuple[int, int], int | tuple] = {}
        self._apart: dict[int, bool] = {}
        self.states: dict[tuple, _State] = {}
        self.start = self._state(((0, -1, ()),))
        self.remembered = _Words(self)

    def _parts(self, token: bytes) -> tuple[int, int]:
        """The two tokens that the last merge puts together. The merges must make the token from its
        bytes, else the library would give it for a whole word and for no part of one."""
        parts = [bytes([b]) for b in token]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(a + b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NONE:
                raise ValueError(f"no merges lead to {token!r}")
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses two neighbouring tokens. Their merges are undone, the latest first;
        what then touches must not merge before the merge undone. Of merges of equal rank the left one
        comes first."""
        if left < 0:
            return True
        key = left << 32 | right
        if (known := self._apart.get(key)) is not None:
            return known
        before, answer = NONE, True
        a, b = left, right
        while True:
            if self.ranks.get(self.bytes_of[a] + self.bytes_of[b], NONE) < before:
                answer = False
                break
            if b >= a and b in self.parts:
                before, b = b + 1, self.parts[b][0]
            elif a in self.parts:
                before, a = a, self.parts[a][1]
            else:
                break
        if len(self._apart) >= PAIRS:
            self._apart.clear()
        self._apart[key] = answer
        return answer

    def allowed(self, before: int, at: int) -> int | tuple:
        """What may follow the token ``before`` and is longer than the beginning ``at``: the tokens, if few
        begin so, else ``before`` itself."""
        if len(self.below[at]) > FEW:
            return before
        key = before, at
        if (known := self._allowed.get(key)) is None:
            if len(self._allowed) >= PAIRS:
                self._allowed.clear()
            known = self._allowed[key] = tuple(t for t in self.below[at] if self.apart(before, t))
        return known

    def _state(self, guesses: tuple) -> _State:
        if (state := self.states.get(guesses)) is None:
            if len(self.states) >= STATES:
                for old in self.states.values():
                    old.clear()
                self.states.clear()
                self.states[self.start.guesses] = self.start
            state = self.states[guesses] = _State()
            ready = guesses[-1][2]  # the youngest guess stands where all bytes are in tokens
            state.guesses, state.last, state.machine = guesses, pack(f"<{len(ready)}I", *ready), self
        return state

    def step(self, guesses: tuple, byte: int) -> tuple[bytes, _State]:
        """A guess is a begun token, what may become of it, and the tokens before it not yet emitted."""
        arcs, ends, moved, ready = self.arcs, self.ends, [], None
        for at, allowed, pending in guesses:
            if (at := arcs.get(at << 8 | byte)) is None:
                continue
            token = ends[at]
            if isinstance(allowed, int):
                if token >= 0 and ready is None and self.apart(allowed, token):
                    ready, newest = (*pending, token), token
                allowed = self.allowed(allowed, at)
            else:
                if token in allowed:
                    ready, newest = (*pending, token), token
                allowed = tuple(t for t in self.below[at] if t in allowed)
            if allowed != ():
                moved.append((at, allowed, pending))
        moved.append((0, newest, ready))
        agreed = min(len(pending) for _, _, pending in moved)
        while any(pending[:agreed] != ready[:agreed] for _, _, pending in moved):
            agreed -= 1
        if agreed:
            moved = [(at, allowed, pending[agreed:]) for at, allowed, pending in moved]
        return pack(f"<{agreed}I", *ready[:agreed]), self._state(tuple(moved))

    def cut(self, text: str) -> Iterator[list[str]]:
        """Lists of words; the text is cut piece by piece at places where a word begins."""
        at = 0
        while at < len(text):
            place = PLACE.search(text, at + PIECE) if at + PIECE < len(text) else None
            end = place.start() if place else len(text)
            yield self.words.findall(text if end - at == len(text) else text[at:end])
            at = end

    def walk(self, word: bytes) -> Iterator[bytes]:
        """What the states on the way of one word emit."""
        state = self.start
        for byte in word:
            ids, state = state[byte]
            if ids:
                yield ids
        yield state.last

    def encode(self, text: str) -> Iterator[bytes]:
        """Blocks of ids as little-endian unsigned 32-bit numbers."""
        for words in self.cut(text):
            if max(map(len, words)) <= BLOCK:
                yield b"".join(map(self.remembered.__getitem__, words))
            else:
                for word in words:
                    yield from self.walk(word.encode())


class TextDecoder:
    """Token ids to bytes and to text as they come; bytes that are no UTF-8 become replacement
    characters in the text."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self._bytes = bytes_of
        self._machine = getincrementaldecoder("utf-8")("replace")

    def push(self, ids: bytes) -> tuple[bytes, str]:
        data = b"".join(map(self._bytes.__getitem__, memoryview(ids).cast("I")))
        return data, self._machine.decode(data)

    def finish(self) -> str:
        return self._machine.decode(b"", True)


@lru_cache(maxsize=2)
def compiled(content: bytes, pattern: str) -> Transducer:
    """One per worker, so that its states last from task to task."""
    return Transducer(content, pattern)


def digests(machine: Transducer, text: str, kept: list[int] | None = None) -> tuple[int, str, str, int]:
    """Number of tokens, digests of the ids and of the bytes decoded from them, and the number of code
    points decoded; ``kept`` takes the ids."""
    ids_hash, bytes_hash, decoder = sha256(), sha256(), TextDecoder(machine.bytes_of)
    n_tokens = n_chars = 0
    for ids in machine.encode(text):
        n_tokens += len(ids) // 4
        ids_hash.update(ids)
        data, more = decoder.push(ids)
        bytes_hash.update(data)
        n_chars += len(more)
        if kept is not None:
            kept.extend(memoryview(ids).cast("I"))
    return n_tokens, ids_hash.hexdigest(), bytes_hash.hexdigest(), n_chars + len(decoder.finish())


def encode_ranked(documents: DataFrame, ranks: bytes, pattern: str = public_tokenizers.PATTERN, with_ids: bool = False) -> DataFrame:
    """For each row of ``documents`` (doc_id, text; other columns are left out): doc_id, n_tokens,
    ids_sha256 (of the ids as little-endian unsigned 32-bit numbers), decoded_sha256 (of the decoded
    bytes), decoded_chars (code points of the decoded text) and, if wanted, the array ``ids``.

    ``ranks`` is the content of the rank file, of fixed size, and is broadcast. A null or empty text has
    no tokens and the digests of nothing; texts of any length are walked in blocks; repeated rows and rows
    without id stay. No rows give no rows."""
    sent = documents.sparkSession.sparkContext.broadcast(ranks)
    shape = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("decoded_chars", pa.int64())])
    if with_ids:
        shape = shape.append(pa.field("ids", pa.list_(pa.int32())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(sent.value, pattern)
        for batch in batches:
            for begin in range(0, len(batch), TEXTS):
                part = batch.slice(begin, TEXTS)
                rows = []
                for text in part.column(1):
                    kept: list[int] | None = [] if with_ids else None
                    rows.append((*digests(machine, text.as_py() or "", kept), *([kept] if with_ids else [])))
                columns = [part.column(0), *map(pa.array, zip(*rows))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, shape)], schema=shape)

    columns = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_chars long" + ", ids array<int>" * with_ids
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, columns)
