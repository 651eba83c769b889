"""Byte-pair encoding and decoding by transducers with bounded look-ahead and memory.

Encoding: the text is cut into words by the tokenizer's splitting rule; no merge crosses a word's
end. Inside a word, merges apply in the order of their rank. What follows can change a token only
through a chain of merges of rising rank, each of which takes or leaves the token to its left. The
heaviest such chain that the merge list allows is its sufficient look-ahead: a token with that many
bytes behind it is final. Words longer than that are therefore read through a window: final tokens
are emitted, the rest stays in the window. Short words are remembered in a table of bounded size.

Decoding: the bytes of the tokens run through an incremental UTF-8 state machine, which keeps at
most three bytes between two tokens.
"""

from codecs import getincrementaldecoder
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import repeat
import json
from pathlib import Path

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
import regex

REMEMBERED = 300_000  # short words
SHORT = 64  # bytes of a word that is remembered
PIECE = 1 << 16  # characters split into words at once
WINDOW = 1 << 14  # bytes read beyond the look-ahead
PAIR, NONE = 20, 1 << 40  # bits of an id; above all ranks

# Fixed value: the splitting rule of byte-level tokenizers.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{inner}]+|\s+(?!\S)|\s+"
# Ranges of code points that the tokenizer's Unicode tables do not know yet.
UNKNOWN = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 "
    "10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 "
    "16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 "
    "1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed "
    "1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
_RANGES = "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in UNKNOWN.split())
WORD = regex.compile(SPLIT.replace("{L}", r"\p{L}").replace("{N}", r"\p{N}").replace("{inner}", r"\p{L}\p{N}"))
CAREFUL_WORD = regex.compile(
    SPLIT.replace("{L}", rf"[\p{{L}}--[{_RANGES}]]").replace("{N}", rf"[\p{{N}}--[{_RANGES}]]")
    .replace(r"[^\s{inner}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{_RANGES}])"), regex.V1,
)
IS_UNKNOWN = regex.compile(f"[{_RANGES}]")
SAFE_CUT = regex.compile(r"(?<=\S) (?=\S)")  # a word always begins with this blank


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in vocabulary files: printable Latin-1 for
    themselves, all others counted up from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token beyond which nothing can change it.

    ``heaviest[x]`` is the weight of the heaviest chain whose last merge has x on its left. A merge
    can continue a chain if its right token begins with that x, as only then does the chain reach
    into it; ranks rise along the chain because merges are read in their order."""
    heaviest: dict[bytes, int] = {}
    for left, right in merges:
        reach = max((heaviest.get(right[:n], 0) for n in range(1, len(right) + 1)), default=0)
        weight = len(left) + max(reach, len(right))
        heaviest[left] = max(heaviest.get(left, 0), weight)
    return max(heaviest.values(), default=0)


def _is_latin(text: str) -> bool:
    """Whether no character is beyond the first 256, none of which is unknown; quick to tell."""
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return False


class _Remembered(dict):
    """Encoded words. Once it is full, what it holds becomes the older generation; words of that are
    taken over when they come again, and the rest is forgotten the next time."""

    def __init__(self, tokenizer: "Tokenizer", most: int):
        super().__init__()
        self.tokenizer, self.older, self.most = tokenizer, {}, most

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            data, known = word.encode(), self.tokenizer
            if len(data) > SHORT:
                return b",".join(b"%d" % i for i in known.encode_word(data))
            ids = b",".join([known.id_text[t] for t in known.merge(data)])
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Tokenizer:
    """A byte-level tokenizer read from the text of its JSON file."""

    def __init__(self, content: str, remembered: int = REMEMBERED):
        told = json.loads(content)
        alphabet = byte_alphabet()
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        self.ids = {as_bytes(token): i for token, i in told["model"]["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        merges = [(as_bytes(a), as_bytes(b)) for a, b in pairs]
        self.id_text = {i: b"%d" % i for i in self.ids.values()}
        self.size_of = {i: len(token) for token, i in self.ids.items()}
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        # a pair of ids as one number; the merged token by rank
        self.rank = {self.ids[a] << PAIR | self.ids[b]: i for i, (a, b) in enumerate(merges)}
        self.merged = [self.ids[a + b] for a, b in merges]
        made = {a + b: i for i, (a, b) in reversed(list(enumerate(merges)))}
        if max(self.ids.values()) >> PAIR:
            raise ValueError(f"ids must have at most {PAIR} bits")
        if any(made.get(part, -1) >= i for i, m in enumerate(merges) for part in m):
            raise ValueError("a merge uses a token that is made later")
        self.longest = max(map(len, self.ids))
        self.lookahead = sufficient_lookahead(merges)
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.bytes_of = {b"%d" % i: token for token, i in self.ids.items()}
        self.bytes_of |= {b"%d" % i: token.encode() for token, i in self.special.items()}
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._remembered = _Remembered(self, remembered)

    def merge(self, data: bytes) -> list[int]:
        """Ids of the tokens of a short word or window."""
        byte_ids, rank, merged = self.byte_ids, self.rank.get, self.merged
        ids = [byte_ids[b] for b in data]
        if len(ids) > SHORT:
            return self._merge_long(ids)
        ranks = [rank(a << PAIR | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < NONE:
            i = ranks.index(best)
            ids[i] = merged[best]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(ids[i] << PAIR | ids[i + 1], NONE)
            if i:
                ranks[i - 1] = rank(ids[i - 1] << PAIR | ids[i], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of merges, leftmost first among equals."""
        end, rank = len(ids), self.rank.get
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rank(a << PAIR | b)) is not None]
        heapify(heap)
        while heap:
            r, i, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j >= end or ids[j] != b:
                continue
            new = self.merged[r]
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if (r := rank(new << PAIR | ids[k])) is not None:
                    heappush(heap, (r, i, new, ids[k]))
            if (h := before[i]) >= 0 and (r := rank(ids[h] << PAIR | new)) is not None:
                heappush(heap, (r, h, ids[h], new))
        return [i for i in ids if i >= 0]

    def encode_word(self, data: bytes) -> Iterator[int]:
        """Token ids of one word, emitted once no later byte can change them."""
        at = 0
        while at < len(data):
            window = data[at:at + max(WINDOW, self.longest) + self.lookahead]
            last = at + len(window) == len(data)
            final = len(window) if last else len(window) - self.lookahead
            for token in self.merge(window):
                final -= self.size_of[token]
                if final < 0:
                    break
                at += self.size_of[token]
                yield token

    def words(self, text: str) -> Iterator[list[str]]:
        """Lists of words; the text is split piece by piece at places where a word begins."""
        split = WORD if _is_latin(text) or not IS_UNKNOWN.search(text) else CAREFUL_WORD
        at = 0
        while at < len(text):
            cut = SAFE_CUT.search(text, at + PIECE) if at + PIECE < len(text) else None
            end = cut.start() if cut else len(text)
            yield split.findall(text, at, end) if not cut and not at else split.findall(text[at:end])
            at = end

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as decimal numbers with commas between them, block by block; no block is empty."""
        for i, part in enumerate(self._special.split(text) if self._special else [text]):
            if i % 2:
                yield b"%d" % self.special[part]
            else:
                for words in self.words(part):
                    yield b",".join(map(self._remembered.__getitem__, words))


class Decoder:
    """Tokens to text as they come; bytes that are no UTF-8 become replacement characters."""

    def __init__(self, tokenizer: Tokenizer):
        self._bytes = tokenizer.bytes_of
        self._machine = getincrementaldecoder("utf-8")("replace")

    def push(self, ids: list[bytes]) -> str:
        return self._machine.decode(b"".join(map(self._bytes.__getitem__, ids)))

    def finish(self) -> str:
        return self._machine.decode(b"", True)


def code(tokenizer: Tokenizer, text: str, kept: list[bytes] | None = None) -> tuple[int, str, str]:
    """Number of tokens, and the digests of the ids and of the text decoded from them; ``kept`` takes
    the ids."""
    ids_hash, text_hash, decoder, n = sha256(), sha256(), Decoder(tokenizer), 0
    for block in tokenizer.encode(text):
        if n:
            ids_hash.update(b",")
        ids_hash.update(block)
        ids = block.split(b",")
        n += len(ids)
        if kept is not None:
            kept += ids
        text_hash.update(decoder.push(ids).encode())
    text_hash.update(decoder.finish().encode())
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


@lru_cache(maxsize=2)
def load(content: str, remembered: int) -> Tokenizer:
    """One per worker, so that remembered words last from task to task."""
    return Tokenizer(content, remembered)


def tokenizer_json(name: str = "byte_bpe_50k.json") -> str:
    """The file of a public tokenizer."""
    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def encode_documents(documents: DataFrame, tokenizer_json: str, with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """For each row of ``documents`` (doc_id, text; other columns are left out): doc_id, n_tokens,
    ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the text decoded from the ids)
    and, if wanted, the array ``ids``.

    ``tokenizer_json`` is the text of the tokenizer's file, of fixed size, and is broadcast. ``remembered``
    bounds the short words that a worker keeps in each of two generations. A null
    text is empty: no tokens, digests of nothing. Repeated rows stay. No rows give no rows."""
    sent = documents.sparkSession.sparkContext.broadcast(tokenizer_json)
    shape = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    if with_ids:
        shape = shape.append(pa.field("ids", pa.list_(pa.int32())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(sent.value, remembered)
        for batch in batches:
            for begin in range(0, len(batch), 256):  # few texts at a time as Python objects
                part = batch.slice(begin, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = [[] if with_ids else None for _ in texts]
                columns = [part.column(0), *map(pa.array, zip(*map(code, repeat(tokenizer), texts, ids)))]
                if with_ids:
                    columns.append(pa.array([list(map(int, i)) for i in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, shape)], schema=shape)

    columns = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, columns)
