"""Benchmark decontamination by template windows.

Texts are canonicalised: numbers, names (capitalised words) and units next to a number become typed
placeholders, all other words are literals. Windows of WINDOW tokens are hashed over the template and,
without regard to case, over their own words, and joined with the windows of the benchmark by hash;
templates with few literals say little and are left out. Along each alignment of a document with an item the
slots must be consistent: one value of the item stands for one value of the document and the other
way round, for each type, so that a question with other numbers and names is caught but a chance
match of the template is not. Windows over a slot that contradicts the others are left out.

Edits break windows, so these only lead to an alignment. Along it all tokens are compared: a document
holds an item if half of the item's tokens are equal or in matched windows, or if windows of equal
words hold ENOUGH words, which a part of a long item does. Items that a few edits can leave without
a whole window are found by shorter runs of equal tokens too. Windows and runs lead to all items that have
them, however many: items of equal text are one entry, and the alignments of all others are counted
through at once before any is looked at closely.

The windows of the benchmark are broadcast in slices of bounded size; each slice holds whole items,
so the results of the slices add up.
"""

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
import xxhash

WINDOW = 8
MIN_LITERALS = 4
MIN_SHARE = 0.5  # of the item's tokens that are equal or in matched windows
ENOUGH = 13  # words in equal windows that show an item of any length
ANCHORS = ((4, 24), (6, 32))  # equal tokens that lead to an item of fewer tokens, of which edits may leave no window
BAND = 8  # tokens put in or left out between alignments that count together
SLICE_BYTES = 32 << 20  # text of a slice of the benchmark
REMEMBERED = 300_000
BATCH_CHARS = 4 << 20
AT_ONCE = 1 << 20  # tokens compared at once

TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[%$€£°]")
LITERAL, NUMBER, NAME, UNIT = range(4)
# fixed values: units of measurement, money and time
UNITS = frozenset(
    "% $ € £ ° mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons "
    "tonne tonnes ounce ounces lb lbs pound pounds ml cl l litre litres liter liters gallon gallons s sec second seconds "
    "min minute minutes h hour hours day days week weeks month months year years cent cents dollar dollars euro euros "
    "percent degree degrees mph kmh kph watt watts volt volts".split()
)
_PLACE = np.array([0, *(xxhash.xxh3_64_intdigest(f"<{k}>") >> 1 for k in ("number", "name", "unit"))], np.int64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0x5851F42D4C957F2D)


class _Codes(dict):
    """Token to a hash without regard to case, with its kind in the low bits; forgets all once it is full."""

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        low = token.casefold()
        kind = UNIT if low in UNITS else NUMBER if token[0].isdigit() else NAME if token[0].isupper() else LITERAL
        self[token] = code = (xxhash.xxh3_64_intdigest(low) >> 3) << 2 | kind
        return code


@dataclass
class Canonical:
    """The tokens of several texts, one after another."""

    word: np.ndarray  # hash of each token without regard to case or kind
    template: np.ndarray  # the same with placeholders
    kind: np.ndarray  # LITERAL, NUMBER, NAME or UNIT
    edges: np.ndarray  # where each text begins, and the end

    def keys(self, size: int, form: str) -> tuple[np.ndarray, np.ndarray]:
        """First tokens and hashes of the windows of so many tokens that lie in one text: of all over
        their words, or of those with slots and enough literals over the template."""
        n = len(self.word) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        ends = np.repeat(self.edges[1:], np.diff(self.edges))
        inside = np.arange(n) + size <= ends[:n]
        if form == "template":
            literals = np.concatenate(([0], np.cumsum(self.kind == LITERAL)))
            literals = literals[size:] - literals[:-size]
            inside &= (literals >= MIN_LITERALS) & (literals < size)
        starts = np.flatnonzero(inside)
        return starts, self._roll(self.word if form == "word" else self.template, size)[starts]

    def _roll(self, codes: np.ndarray, size: int) -> np.ndarray:
        n = len(codes) - size + 1
        mixed = codes.view(np.uint64) * _OTHER
        mixed ^= mixed >> np.uint64(29)
        total = np.zeros(n, np.uint64)
        for j in range(size):
            total = total * _BASE + mixed[j:j + n]
        return total ^ (total >> np.uint64(31))


def canonical(texts: list[str], codes: _Codes) -> Canonical:
    tokens = [TOKEN.findall(t) for t in texts]
    edges = np.cumsum([0, *map(len, tokens)])
    own = np.array([c for t in tokens for c in map(codes.__getitem__, t)], np.int64)
    kind = own & 3
    number = np.concatenate(([False], kind == NUMBER, [False]))
    first, last = np.zeros(len(own), bool), np.zeros(len(own), bool)
    filled = np.diff(edges) > 0
    first[edges[:-1][filled]] = last[edges[1:][filled] - 1] = True
    beside = (number[:-2] & ~first) | (number[2:] & ~last)
    kind = np.where((kind == UNIT) & ~beside, LITERAL, kind)
    word = own >> 2
    return Canonical(word, np.where(kind == LITERAL, word, _PLACE[kind]), kind, edges)


class _Places:
    """Windows of one size and form, ordered by hash."""

    def __init__(self, size: int, form: str, keys: np.ndarray, items: np.ndarray, places: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.size, self.form = size, form
        self.keys, self.items, self.places = keys[order], items[order], places[order]
        self.mask = np.uint64((1 << max(20, (8 * len(keys)).bit_length())) - 1)
        self.sieve = np.zeros(int(self.mask) + 1, bool)
        self.sieve[keys & self.mask] = True

    def found(self, texts: Canonical) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First token, item and place in the item of all windows that ``texts`` share."""
        starts, keys = texts.keys(self.size, self.form)
        maybe = self.sieve[keys & self.mask]
        starts, keys = starts[maybe], keys[maybe]
        first = np.searchsorted(self.keys, keys, side="left")
        n = np.searchsorted(self.keys, keys, side="right") - first
        rows = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(starts, n), self.items[rows], self.places[rows]


class Index:
    """Windows of benchmark items by hash."""

    def __init__(self, given: list[tuple[int, str]]):
        of_text: dict[str, list] = {}
        for i, t in given:
            of_text.setdefault(t, []).append(i)
        items = list(of_text)
        texts = canonical(items, _Codes())
        self.ids = list(of_text.values())  # of all items with a text
        self.texts, self.length = texts, np.diff(texts.edges)
        self.size = np.minimum(self.length, WINDOW)
        self.windows = np.where(self.length > 0, self.length - self.size + 1, 0)
        self.needed = np.where(self.length > WINDOW, np.maximum(WINDOW, np.ceil(MIN_SHARE * self.length)), self.length)
        of = np.repeat(np.arange(len(items)), self.length)
        self.tables: list[_Places] = []

        def add(size: int, form: str, wanted: np.ndarray) -> None:
            """Windows of the items ``wanted``."""
            starts, keys = texts.keys(size, form)
            some = wanted[of[starts]]
            starts, keys = starts[some], keys[some]
            if len(starts):
                self.tables.append(_Places(size, form, keys, of[starts], starts - texts.edges[of[starts]]))

        for size in sorted({int(s) for s in self.size if s}):
            for form in ("word", "template"):
                add(size, form, self.size == size)
        shortest = WINDOW + 1
        for size, below in ANCHORS:
            add(size, "word", (self.length >= shortest) & (self.length < below))
            shortest = below

    def matches(self, texts: Canonical) -> Iterator[tuple[int, int, int, int, bool]]:
        """(number of the text, number of the item, windows matched, first token, whether all slots
        are equal) for each text that holds an item."""
        found = [(*t.found(texts), t.size) for t in self.tables]
        if not sum(len(f[0]) for f in found):
            return
        start, item, place = (np.concatenate([f[k] for f in found]) for k in range(3))
        size = np.repeat([f[3] for f in found], [len(f[0]) for f in found])
        slots = np.repeat([t.size * (t.form == "template") for t in self.tables], [len(f[0]) for f in found])
        doc, shift = np.searchsorted(texts.edges, start, side="right") - 1, start - place
        order = np.lexsort((place, shift, item, doc))
        doc, item, shift, place, size, slots = (x[order] for x in (doc, item, shift, place, size, slots))
        turn = (np.diff(doc) != 0) | (np.diff(item) != 0)
        pairs = np.flatnonzero(np.concatenate(([True], turn, [True])))
        lines = np.flatnonzero(np.concatenate(([True], turn | (np.diff(shift) != 0), [True])))
        ends = np.searchsorted(lines, pairs)
        at = lines[:-1]
        most = self._equal(texts, doc[at], item[at], shift[at]) + np.add.reduceat(slots, at)
        able = np.add.reduceat(most, ends[:-1]) >= np.minimum(self.needed[item[pairs[:-1]]], ENOUGH)
        for begin, first, last in zip(pairs[:-1][able].tolist(), ends[:-1][able].tolist(), ends[1:][able].tolist()):
            d, i = int(doc[begin]), int(item[begin])
            aligned = []
            for a, b in zip(lines[first:last].tolist(), lines[first + 1:last + 1].tolist()):
                line = self._line(texts, d, i, int(shift[a]), place[a:b], size[a:b])
                if line is not None:
                    aligned.append((int(shift[a]), *line))
            if aligned and self._enough(i, aligned):
                windows = set().union(*(w for _, _, _, w, _, _ in aligned))
                at = min(s + f for s, _, _, _, f, _ in aligned) - int(texts.edges[d])
                yield d, i, len(windows), at, all(e for *_, e in aligned)

    def _equal(self, texts: Canonical, doc: np.ndarray, item: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """The number of equal tokens along each of many alignments."""
        base = self.texts.edges[item]
        low = np.maximum(0, texts.edges[doc] - shift)
        n = np.maximum(np.minimum(self.length[item], texts.edges[doc + 1] - shift) - low, 0)
        total, out = np.concatenate(([0], np.cumsum(n))), np.zeros(len(n), np.int64)
        cuts = np.unique(np.searchsorted(total, np.arange(0, total[-1] + AT_ONCE, AT_ONCE))).clip(max=len(n))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            which = np.repeat(np.arange(a, b), n[a:b])
            inner = np.arange(len(which)) - (total[a:b] - total[a])[which - a] + low[which]
            same = self.texts.word[base[which] + inner] == texts.word[shift[which] + inner]
            out[a:b] = np.bincount(which[same] - a, minlength=b - a)
        return out

    def _line(self, texts: Canonical, doc: int, item: int, shift: int, places: np.ndarray, sizes: np.ndarray):
        """Of one alignment: the item's tokens that windows cover or that are equal, those of equal
        windows that are no numbers, the whole windows, the first token and whether all slots are
        equal; None if nothing is left."""
        base, n = int(self.texts.edges[item]), int(self.length[item])
        low, high = max(0, int(texts.edges[doc]) - shift), min(n, int(texts.edges[doc + 1]) - shift)
        same = np.zeros(n, bool)
        same[low:high] = self.texts.word[base + low:base + high] == texts.word[shift + low:shift + high]
        spans = sorted({(p, p + s) for p, s in zip(places.tolist(), sizes.tolist())})
        equal = [(p, q) for p, q in spans if same[p:q].all()]
        kept = spans
        if len(equal) < len(spans):
            kept = self._consistent(texts, base, shift, spans, equal)
        if not kept:
            return None
        equal = [span for span in equal if span in kept]
        covered, sure = same.copy(), np.zeros(n, bool)
        for p, q in kept:
            covered[p:q] = True
        for p, q in equal:
            if q - p >= WINDOW:
                sure[p:q] = True
        sure &= self.texts.kind[base:base + n] != NUMBER
        windows = {p for p, q in kept if q - p == self.size[item]}
        return covered, sure, windows, kept[0][0], len(kept) == len(equal)

    def _consistent(self, texts: Canonical, base: int, shift: int, spans: list, equal: list) -> list:
        """The windows that stay: those not over a slot that contradicts others. A value stands for
        itself if it does so anywhere, else for what it stands for most often; if that is open for
        one of them, only whole windows of equal words stay."""
        covered = np.unique(np.concatenate([np.arange(p, q) for p, q in spans]))
        slots = covered[self.texts.kind[base + covered] != LITERAL]
        pairs = list(zip(
            self.texts.kind[base + slots].tolist(), self.texts.word[base + slots].tolist(), texts.word[shift + slots].tolist()
        ))
        there, back = defaultdict(Counter), defaultdict(Counter)
        for kind, a, b in pairs:
            there[kind, a][b] += 1
            back[kind, b][a] += 1
        stands = [{key: self._stands_for(key[1], seen) for key, seen in side.items()} for side in (there, back)]
        if any(None in side.values() for side in stands):
            return [(p, q) for p, q in equal if q - p >= WINDOW]
        wrong = [s for s, (kind, a, b) in zip(slots.tolist(), pairs) if (stands[0][kind, a], stands[1][kind, b]) != (b, a)]
        return [(p, q) for p, q in spans if (p, q) in equal or not any(p <= s < q for s in wrong)]

    @staticmethod
    def _stands_for(value: int, seen: Counter) -> int | None:
        if value in seen:
            return value
        (first, n), *others = seen.most_common(2)
        return None if others and others[0][1] == n else first

    def _enough(self, item: int, aligned: list) -> bool:
        """Whether alignments (shift, covered tokens, sure tokens, windows, ...) show the item: tokens
        of alignments close to one another count together, whole windows from anywhere."""
        n, size = int(self.length[item]), int(self.size[item])
        anywhere = np.zeros(n, bool)
        before = covered = sure = None
        for shift, now, certain, windows, *_ in aligned:
            for p in windows:
                anywhere[p:p + size] = True
            near = before is not None and shift - before <= BAND
            covered, sure, before = (covered | now, sure | certain, shift) if near else (now, certain, shift)
            if covered.sum() >= self.needed[item] or sure.sum() >= ENOUGH:
                return True
        return bool(anywhere.sum() >= self.needed[item])


def _slices(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, text) with words, in slices of about SLICE_BYTES of text."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // SLICE_BYTES)
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield [(r["item_id"], r["text"]) for r in part.toLocalIterator()]


def _parts(batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Pieces of a batch with few characters each, and their texts."""
    begin = held = 0
    texts: list[str] = []
    for i, t in enumerate(batch.column(text)):
        texts.append(t.as_py() or "")
        held += len(texts[-1])
        if held >= BATCH_CHARS:
            yield batch.slice(begin, i + 1 - begin), texts
            begin, held, texts = i + 1, 0, []
    if texts:
        yield batch.slice(begin), texts


def find_items(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and benchmark item that it holds: doc_id, item_id, matched_windows,
    n_windows (of the item), coverage, first_token (of the document) and exact (no slot differs).
    ``documents`` has doc_id and text, ``benchmark`` item_id and text; other columns are left out.

    Whole texts are searched. Null and empty texts hold nothing, items without words are held by
    none; an item of fewer than WINDOW tokens is one window. ``coverage`` is of windows and can be small
    or 0 where edits broke them. Repeated documents and items give rows of their own; null ids stay null. An empty table on either side gives no rows."""
    shape = pa.schema([
        ("doc_id", pa.int64()), ("item_id", pa.int64()), ("matched_windows", pa.int64()), ("n_windows", pa.int64()),
        ("coverage", pa.float64()), ("first_token", pa.int64()), ("exact", pa.bool_()),
    ])
    columns = "doc_id long, item_id long, matched_windows long, n_windows long, coverage double, first_token long, exact boolean"
    spark = documents.sparkSession
    given = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = given.where("false").selectExpr("doc_id", *(f"cast(null as {c.split()[1]}) {c.split()[0]}" for c in columns.split(", ")[1:]))
    for items in _slices(benchmark):
        sent = spark.sparkContext.broadcast(items)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, codes = Index(sent.value), _Codes()
            for batch in batches:
                for part, texts in _parts(batch, 1):
                    rows = [
                        (part.column(0)[d].as_py(), item_id, n, int(index.windows[i]), n / int(index.windows[i]), at, same)
                        for d, i, n, at, same in index.matches(canonical(texts, codes)) for item_id in index.ids[i]
                    ]
                    yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r)) for r in rows], shape)

        found = found.unionByName(given.mapInArrow(search, columns))
    return found


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` (with a column text; all columns stay) that hold no benchmark item;
    see ``find_items``."""
    at = documents.columns.index("text")
    for items in _slices(benchmark):
        sent = documents.sparkSession.sparkContext.broadcast(items)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, codes = Index(sent.value), _Codes()
            for batch in batches:
                for part, texts in _parts(batch, at):
                    clean = np.ones(len(texts), bool)
                    clean[[d for d, *_ in index.matches(canonical(texts, codes))]] = False
                    yield part.filter(pa.array(clean))

        documents = documents.mapInArrow(keep, documents.schema)
    return documents
