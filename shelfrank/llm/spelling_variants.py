"""Groups of words that differ by one inserted, deleted or replaced letter, found by composing the
vocabulary's minimal acceptor with a one-edit transducer and the acceptor again.

The vocabulary is dealt to initial states of that composition. A window is a range [i, j) of places in words
of M letters; the state of a word is its letters before and behind the window (of a word of M - 1 letters,
those that are left if one letter of the window is deleted). Two words that one edit within the window
leads to each other are in the same state, so the two halves of every M find all pairs, with four rows a word.
States with more than ``LIMIT`` words are dealt anew by the halves of their windows, as often as needed: a
window of one place has no more words than letters, so no group is unbounded and none is cut.

For each state a task builds the minimal acceptor of the words' letters within the window. Its composition is
walked from the last states to the first: a pair of states that an edit has led apart is followed on equal
letters only, each such pair once. Words are known by their rank among the words that a state accepts.
Of the places where a letter can be deleted with the same result the last counts, so no pair is found twice.
"""

from collections.abc import Callable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.scratch import Scratch

LIMIT = 2_000  # words of one initial state
MIN_LENGTH, MIN_COUNT, FACTOR = 7, 2, 10
# What a word is made of, and the letters that have a lower-case form here.
RUN = f"[A-Za-z\\u00C0-\\u00FF]{{{MIN_LENGTH},}}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DELETE_EVERY = 31
Pairs = list[tuple[int, int]]


class Acceptor:
    """The minimal acceptor of different words given in code-point order. States are numbered so that arcs
    lead to lower ones; ``arcs`` has by letter the next state and how many accepted words come before."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.size: list[int] = []  # words accepted from the state
        self._known: dict[tuple, int] = {}
        open_states: list[tuple[list, bool]] = [([], False)]  # along the last word: arcs, final
        path = ""
        for word in words:
            same = 0
            while same < len(path) and path[same] == word[same]:
                same += 1
            self._close(open_states, path, same)
            open_states += [([], False) for _ in word[same:]]
            open_states[-1] = (open_states[-1][0], True)
            path = word
        self._close(open_states, path, 0)
        self.root = self._state(*open_states[0])

    def _close(self, open_states: list, path: str, keep: int) -> None:
        while len(open_states) > keep + 1:
            state = self._state(*open_states.pop())
            open_states[-1][0].append((path[len(open_states) - 1], state))

    def _state(self, arcs: list[tuple[str, int]], final: bool) -> int:
        key = final, *arcs
        if (state := self._known.get(key)) is None:
            state = self._known[key] = len(self.arcs)
            before, ranked = int(final), {}
            for letter, to in arcs:
                ranked[letter] = to, before
                before += self.size[to]
            self.arcs.append(ranked)
            self.final.append(final)
            self.size.append(before)
        return state


class _OneEdit:
    """The composition of an acceptor, one edit and the acceptor. ``behind`` is the letter that follows
    the window in all words ("" for none)."""

    def __init__(self, acceptor: Acceptor, behind: str):
        self.a, self.behind = acceptor, behind
        self._both: dict[tuple[int, int], Pairs] = {}

    def _both_arcs(self, p: int, q: int) -> Iterator[tuple[int, int, int, int]]:
        there = self.a.arcs[q]
        for letter, (to, before) in self.a.arcs[p].items():
            if letter in there:
                yield to, before, *there[letter]

    def both(self, p: int, q: int) -> Pairs:
        """Ranks, from p and from q, of the words that both accept."""
        todo, known = [(p, q)], self._both
        while todo:
            pair = todo[-1]
            if pair in known:
                todo.pop()
                continue
            steps = list(self._both_arcs(*pair))
            if missing := [(x, y) for x, _, y, _ in steps if (x, y) not in known]:
                todo += missing
                continue
            ends = [(0, 0)] if self.a.final[pair[0]] and self.a.final[pair[1]] else []
            known[pair] = ends + [(m + i, n + k) for x, m, y, n in steps for i, k in known[x, y]]
            todo.pop()
        return known[p, q]

    def shorter(self, q: int, letter: str) -> Pairs:
        """Ranks from q of the words w and letter + w, where w does not begin with the letter."""
        to, skipped = self.a.arcs[q][letter]
        ends = [(0, skipped)] if self.a.final[q] and self.a.final[to] and letter != self.behind else []
        after = self.a.arcs[to]
        for x, (y, before) in self.a.arcs[q].items():
            if x != letter and x in after:
                z, more = after[x]
                ends += [(before + i, skipped + more + k) for i, k in self.both(y, z)]
        return ends

    def pairs(self) -> Pairs:
        """Ranks of all pairs of accepted words that one edit leads to each other."""
        found: list[Pairs] = []
        for q, arcs in enumerate(self.a.arcs):
            here: Pairs = []
            for (to, before), (other, more) in combinations(arcs.values(), 2):
                here += [(before + i, more + k) for i, k in self.both(to, other)]
            for letter in arcs:
                here += self.shorter(q, letter)
            for to, before in arcs.values():
                here += [(before + i, before + k) for i, k in found[to]]
            found.append(here)
        return found[self.a.root]


def near_within(middles: list[str], longest: int, behind: str) -> Pairs:
    """Places of the pairs within one window of ``longest`` letters; middles are in code-point order. Pairs
    of words that both leave a letter out belong to the next shorter M."""
    if len(middles) < 2:
        return []
    pairs = _OneEdit(Acceptor(middles), behind).pairs()
    return [(i, k) for i, k in pairs if len(middles[i]) == longest or len(middles[k]) == longest]


def _dealt(words: DataFrame, window: Column) -> DataFrame:
    """A row (window, before, behind, middle, n) for each window of each row (word, n)."""
    rows = words.select("word", "n", window.alias("window"))
    m, i, j = (F.col("window")[x] for x in ("m", "i", "j"))
    end = j - (m - F.length("word"))
    return rows.select(
        "window", F.substring("word", F.lit(1), i).alias("before"), F.substring("word", end + 1, F.length("word")).alias("behind"),
        F.substring("word", i + 1, end - i).alias("middle"), "n",
    )


def _window(m: Column, i: Column, j: Column) -> Column:
    return F.struct(m.cast("int").alias("m"), i.cast("int").alias("i"), j.cast("int").alias("j"))


def _halves(m: Column, i: Column, j: Column) -> Column:
    half = F.floor((i + j) / 2)
    return F.array(_window(m, i, half), _window(m, half, j))


STATE = ["window", "before", "behind"]


def initial_states(words: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows (word, n) of different words dealt to windows, at most LIMIT of them to each."""
    length, zero = F.length("word"), F.lit(0)
    first = F.explode(F.concat(_halves(length, zero, length), _halves(length + 1, zero, length + 1)))
    rows, ready, turn = scratch.keep(_dealt(words, first), "dealt0"), [], 0
    while True:
        wide = rows.where(F.col("window")["j"] - F.col("window")["i"] > 1)
        large = scratch.keep(wide.groupBy(*STATE).count().where(F.col("count") > LIMIT).drop("count"), f"large{turn}")
        if large.isEmpty():
            break
        ready.append(rows.join(large, STATE, "left_anti"))
        whole = rows.join(large, STATE, "left_semi").select(F.concat("before", "middle", "behind").alias("word"), "n", F.col("window").alias("old"))
        old = F.col("old")
        halves = whole.withColumn("new", F.explode(_halves(old["m"], old["i"], old["j"])))
        turn += 1
        rows = scratch.keep(_dealt(halves, F.col("new")), f"dealt{turn}")
    for more in ready:
        rows = rows.unionByName(more)
    return rows


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str], list[int]]]:
    """States with their words' middles and counts; rows of one state follow each other."""
    state, middles, counts = None, [], []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for *now, middle, n in zip(*columns):
            if now != state:
                if len(middles) > 1:
                    yield state, middles, counts
                state, middles, counts = now, [], []
            middles.append(middle)
            counts.append(n)
    if len(middles) > 1:
        yield state, middles, counts


Emit = Callable[[list[str], list[int], Pairs], Iterator[tuple]]


def _compose(words: DataFrame, scratch: Scratch, emit: Emit, columns: str, shape: pa.Schema) -> DataFrame:
    rows = initial_states(words, scratch)
    w = F.col("window")
    flat = rows.select(w["m"].alias("m"), w["j"].alias("j"), (w["j"] - w["i"]).alias("width"), "before", "behind", "middle", "n")
    state = ["m", "j", "before", "behind"]
    grouped = flat.repartition(*state).sortWithinPartitions(*state, "middle").select("before", "behind", "m", "width", "middle", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for (before, behind, _, width), middles, counts in _groups(batches):
            if pairs := near_within(middles, width, behind[:1]):
                held += emit([before + x + behind for x in middles], counts, pairs)
            if len(held) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), shape)], schema=shape)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), shape)], schema=shape)

    return grouped.mapInArrow(run, columns)


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """Each pair of near words of ``words`` (word, n; different words) once: a, b with a < b."""
    shape = pa.schema([("a", pa.string()), ("b", pa.string())])

    def emit(group: list[str], counts: list[int], pairs: Pairs) -> Iterator[tuple]:
        return ((min(group[i], group[k]), max(group[i], group[k])) for i, k in pairs)

    return _compose(words.select("word", "n"), scratch, emit, "a string, b string", shape)


def near_counts(words: DataFrame, scratch: Scratch) -> DataFrame:
    """For each row (word, n) of different words: word, n, n_near and the near word of largest n (ties: least
    in code-point order) as best, best_n. A state sends one row a word however many pairs it has."""
    shape = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())])

    def emit(group: list[str], counts: list[int], pairs: Pairs) -> Iterator[tuple]:
        near: dict[int, list] = {}
        for pair in pairs:
            for i, k in (pair, pair[::-1]):
                rank = -counts[k], group[k]
                known = near.setdefault(i, [0, rank])
                known[0] += 1
                known[1] = min(known[1], rank)
        return ((group[i], counts[i], n_near, word, -minus) for i, (n_near, (minus, word)) in near.items())

    parts = _compose(words, scratch, emit, "word string, n long, n_near long, best string, best_n long", shape)
    alone = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("best"), F.lit(None).cast("long").alias("best_n"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("minus"), F.col("best"))))
    each = parts.unionByName(alone).groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return each.select("word", "n", "n_near", F.col("b")["best"].alias("best"), (-F.col("b")["minus"]).alias("best_n"))


def group_variants(words: DataFrame) -> DataFrame:
    """For each row (word, n) of ``words``: word, form, root, n, n_near, form_n.

    Words are near if they differ by one inserted, deleted or replaced code point; n_near counts near words.
    form is the near word of largest n (ties: least in code-point order) if that is 10 n or more, else null,
    as is form_n. root is reached by following forms: as n grows tenfold on each step, five rounds
    of doubled steps are enough for any count.

    Rows of one word count as one word with their n added; rows without word or n are left out;
    other columns are left out. Words may be of any length, the empty one included. No rows give no rows."""
    scratch = Scratch(words.sparkSession, "spelling")
    valid = words.where(F.col("word").isNotNull() & F.col("n").isNotNull())
    once = scratch.keep(valid.groupBy("word").agg(F.sum("n").cast("long").alias("n")), "words")
    each = near_counts(once, scratch)
    has_form = F.col("best_n") >= FACTOR * F.col("n")
    formed = scratch.keep(each.select(
        "word", "n", "n_near", F.when(has_form, F.col("best")).alias("form"), F.when(has_form, F.col("best_n")).alias("form_n"),
    ), "formed")
    roots, turn = formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), 0
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = roots.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        turn += 1
        roots = scratch.keep(moved, f"roots{turn}")
        if not roots.where("moved").limit(1).count():
            break
        roots = roots.drop("moved")
    joined = formed.join(roots.select("word", "root"), "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def vocabulary(documents: DataFrame) -> DataFrame:
    """Words of ``documents`` (doc_id, text; other columns are left out) and how often they occur.

    A run of letters of 7 code points or more has only A-Z lower-cased; if 31 divides h, the crc32 of
    `<doc_id>:<run>`, its code point h % length is deleted. Of the results those with 7 code points or more
    and two occurrences or more are words. A row without id is hashed as if its id were empty text; null and
    empty texts have no words. Only counts of words are shuffled."""
    runs = documents.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"),
    )
    lowered = runs.select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = lowered.select("run", F.crc32(F.concat_ws(":", "doc", "run").cast("binary")).alias("h"))
    at = F.col("h") % F.length("run")
    shortened = F.concat(F.substring("run", F.lit(1), at.cast("int")), F.substring("run", (at + 2).cast("int"), F.length("run")))
    words = hashed.select(F.when(F.col("h") % DELETE_EVERY == 0, shortened).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= MIN_COUNT)
