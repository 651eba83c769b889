"""N-gram Jaccard join by chosen paths.

Documents are sets of hashed word n-grams. Equal sets become one; copies are counted, never paired.
Each set is drawn as SKETCH min-hash tokens, of which two sets share a share that estimates their
Jaccard similarity. From the root of a tree every set follows one or two randomly chosen tokens (the
choice is made by the node, so alike for all sets in it) to the node of that token, and so on: sets
that share much stay together, others part. Nodes with few sets are compared by brute force, larger
ones are split again; nodes that stay large are compared in blocks. Runs with other random choices
are repeated until a pair at the threshold is missed with less than the target probability.

Brute force compares the sketches with a wide margin and leaves links of a spanning forest. Within
each connected component of these, every pair of sets is compared exactly, block by block, from the
texts: links are counted and joined to classes there. Pairs of sets are never written as rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
import xxhash

from shelfrank.llm.components import components
from shelfrank.llm.scratch import Scratch

N_GRAM = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.9999  # of a pair at the threshold, before the comparison within components
SKETCH = 128
MARGIN = 0.18  # five standard deviations of the estimate
SECOND = 0.25  # chance of a second child: 1 / 0.8 children on average
FIRST_DEPTH, LAST_DEPTH = 2, 5
SMALL = 256  # sets in a node that is compared at once
SKETCH_BLOCK, TEXT_BLOCK = 512, 256
REMEMBERED = 300_000
TILE = 1024
ROWS = 4096

_random = np.random.default_rng(31)
_A = _random.integers(0, 1 << 31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _random.integers(0, 1 << 32, SKETCH, dtype=np.uint32)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words; forgets all once it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


def n_grams(text: str, words: _Words, n: int = N_GRAM) -> np.ndarray:
    """The sorted set of hashed n-grams of lower-case words; a text of fewer words is one n-gram."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    codes = _mix(np.array(list(map(words.__getitem__, found)), np.uint64))
    size = min(n, len(codes))
    total = np.zeros(len(codes) - size + 1, np.uint64)
    for j in range(size):
        total = total * _M2 + codes[j:len(codes) - size + 1 + j]
    return np.unique(_mix(total))


def sketch(grams: np.ndarray) -> np.ndarray:
    """The least value of the set under each of SKETCH hash functions."""
    low = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for begin in range(0, len(low), TILE):
        np.minimum(least, (low[None, begin:begin + TILE] * _A[:, None] + _B[:, None]).min(axis=1), out=least)
    return least


def survival(similarity: float, depth: int) -> float:
    """Chance that two sets meet in some node of this depth in one run."""
    chance = 1.0
    for _ in range(depth):
        lost = 1 - similarity * chance
        chance = 1 - (1 - SECOND) * lost - SECOND * lost**2
    return chance


def runs_needed(similarity: float, depth: int, recall: float) -> int:
    return int(np.ceil(np.log(1 - recall) / np.log(1 - survival(similarity, depth))))


def _children(nodes: np.ndarray, rows: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes below: each node chooses one token, or two, and a set goes where its own leads."""
    drawn = _mix(nodes)
    one = drawn % np.uint64(SKETCH)
    two = (one + np.uint64(1) + (drawn >> np.uint64(16)) % np.uint64(SKETCH - 1)) % np.uint64(SKETCH)
    second = (drawn >> np.uint64(40)) < np.uint64(SECOND * (1 << 24))
    out = []
    for chosen, where in ((one, slice(None)), (two, second)):
        at, row = chosen[where], rows[where]
        token = sketches[row, at].astype(np.uint64) << np.uint64(8) | at
        out.append((_mix(nodes[where] * _M1 ^ _mix(token + np.uint64(1))), row))
    return tuple(np.concatenate(x) for x in zip(*out))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


# --- tables ---------------------------------------------------------------------------------------


def _sketched(documents: DataFrame) -> DataFrame:
    """doc_id, the text's hash, sid (digest of the set; null without words), the sketch, and the low
    byte of each of its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            rows = []
            for text in batch.column(2):
                grams = n_grams(text.as_py() or "", words)
                tokens = sketch(grams)
                row = xxhash.xxh3_128_digest(grams.tobytes()), tokens.tobytes(), tokens.astype(np.uint8).tobytes()
                rows.append(row if len(grams) else (None, None, None))
            columns = [pa.array(c, pa.binary()) for c in zip(*rows)] if rows else [pa.array([], pa.binary())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "text_hash", "sid", "sketch", "low"])

    return documents.mapInArrow(run, "doc_id long, text_hash long, sid binary, sketch binary, low binary")


def _first_nodes(sets: DataFrame, runs: int) -> DataFrame:
    """node, sid of every set at FIRST_DEPTH of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), ROWS):
                part = batch.slice(begin, ROWS)
                sketches = _matrix(part.column(1), np.uint32)
                rows = np.tile(np.arange(len(part)), runs)
                nodes = np.repeat(_mix(np.arange(1, runs + 1, dtype=np.uint64)), len(part))
                for _ in range(FIRST_DEPTH):
                    nodes, rows = _children(nodes, rows, sketches)
                yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), part.column(0).take(pa.array(rows))], ["node", "sid"])

    return sets.select("sid", "sketch").mapInArrow(run, "node long, sid binary")


def _next_nodes(members: DataFrame) -> DataFrame:
    """One level deeper: node, sid of ``members`` (node, sid, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), ROWS):
                part = batch.slice(begin, ROWS)
                nodes = part.column(0).to_numpy().view(np.uint64)
                nodes, rows = _children(nodes, np.arange(len(part)), _matrix(part.column(2), np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), part.column(1).take(pa.array(rows))], ["node", "sid"])

    return members.select("node", "sid", "sketch").mapInArrow(run, "node long, sid binary")


def _blocks(grouped: DataFrame, key: str, n: str, size: int) -> DataFrame:
    """Deals each group's rows into blocks of about ``size`` and gives every pair of blocks a group of
    its own (``key``, left, right); ``block`` is the row's own. A small group is one pair."""
    count = F.ceil(F.col(n) / F.lit(size)).cast("int")
    block = F.pmod(F.xxhash64("sid"), F.greatest(count, F.lit(1))).cast("int")
    dealt = grouped.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    return dealt.select("*", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")).drop("other", n)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that end where a group ends, and where each group begins (with the end), of rows sorted
    by their first ``keys`` columns."""
    held = None
    for batch in batches:
        for begin in range(0, len(batch), ROWS):
            part = batch.slice(begin, ROWS)
            table = pa.Table.from_batches([part] if held is None else [held, part]).combine_chunks().to_batches()[0]
            marks = np.stack([table.column(k).to_numpy(zero_copy_only=False) for k in range(keys)])
            edges = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            if len(edges):
                yield table.slice(0, edges[-1]), np.concatenate(([0], edges))
                held = table.slice(edges[-1])
            else:
                held = table
    if held is not None and len(held):
        yield held, np.array([0, len(held)])


def _least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the least place that it is linked with over pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _sketch_links(dealt: DataFrame, threshold: float) -> DataFrame:
    """Links u, v of a spanning forest of the sketches' similarity in each group."""
    shared = int(np.floor((threshold - MARGIN) * SKETCH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in _whole_groups(batches, 3):
            sizes = np.diff(edges)
            group = np.repeat(np.arange(len(sizes)), sizes)
            block, halves = table.column(3).to_numpy(), table.column(1).to_numpy() == table.column(2).to_numpy()
            sketches = _matrix(table.column(5), np.uint8)
            pairs = []
            for step in range(1, int(sizes.max())):
                a = np.flatnonzero(group[:-step] == group[step:])
                a = a[halves[a] | (block[a] != block[a + step])]
                for begin in range(0, len(a), ROWS):
                    some = a[begin:begin + ROWS]
                    alike = (sketches[some] == sketches[some + step]).sum(axis=1) >= shared
                    pairs.append(np.stack([some[alike], some[alike] + step]))
            a, b = np.concatenate(pairs, axis=1) if pairs else (np.empty(0, np.int64),) * 2
            label = _least_linked(len(table), a, b)
            linked = np.flatnonzero(label != np.arange(len(table)))
            sid = table.column(4)
            yield pa.RecordBatch.from_arrays([sid.take(pa.array(linked)), sid.take(pa.array(label[linked]))], ["u", "v"])

    keys = ["node", "left", "right"]
    ordered = dealt.select(*keys, "block", "sid", "low").repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, "u binary, v binary")


def candidate_links(sets: DataFrame, scratch: Scratch, threshold: float, recall: float) -> DataFrame:
    """Links u, v between sets (sid, sketch) that connect all pairs at the threshold."""
    runs = runs_needed(threshold, LAST_DEPTH, recall)
    nodes = scratch.keep(_first_nodes(sets, runs), f"nodes{FIRST_DEPTH}")
    found = []
    for depth in range(FIRST_DEPTH, LAST_DEPTH + 1):
        full = nodes.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > 1)
        members = scratch.keep(nodes.join(full, "node"), f"members{depth}")
        scratch.drop(f"nodes{depth}")
        last = depth == LAST_DEPTH
        ready = members if last else members.where(F.col("n") <= SMALL)
        with_low = ready.join(sets.select("sid", "low"), "sid")
        links = _sketch_links(_blocks(with_low, "node", "n", SKETCH_BLOCK), threshold)
        found.append(scratch.keep(links.distinct(), f"links{depth}"))
        large = members.where(F.col("n") > SMALL)
        if last or large.limit(1).count() == 0:
            break
        nodes = scratch.keep(_next_nodes(large.join(sets.select("sid", "sketch"), "sid")), f"nodes{depth + 1}")
        scratch.drop(f"members{depth}")
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links


def _exact_links(dealt: DataFrame, threshold: float) -> DataFrame:
    """sid, root, links: for each set with links in a group, the least set it is linked with there,
    directly or through others, and the number of documents linked directly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for table, edges in _whole_groups(batches, 3):
            for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
                yield one(table.slice(begin, end - begin), words)

    def one(rows: pa.RecordBatch, words: _Words) -> pa.RecordBatch:
        sids = rows.column(4).to_pylist()
        grams = [n_grams(t.as_py() or "", words) for t in rows.column(6)]
        # a text whose hash another one shares can be the other's
        fits = {s: i for i, s in enumerate(sids) if xxhash.xxh3_128_digest(grams[i].tobytes()) == s}
        keep = sorted(fits.values())
        sids, grams = [sids[i] for i in keep], [grams[i] for i in keep]
        copies = rows.column(5).to_numpy()[keep]
        block, halves = rows.column(3).to_numpy()[keep], rows.column(1)[0].as_py() == rows.column(2)[0].as_py()
        sizes = np.array([len(g) for g in grams], np.int64)
        common = _intersections(grams)
        union = sizes[:, None] + sizes[None, :] - common
        near = common >= threshold * union - 1e-9
        np.fill_diagonal(near, False)
        if not halves:
            near &= block[:, None] != block[None, :]
        a, b = np.nonzero(np.triu(near))
        label = _least_linked(len(sids), a, b)
        links = near @ copies
        out = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [pa.array([sids[i] for i in out], pa.binary()), pa.array([sids[label[i]] for i in out], pa.binary()), pa.array(links[out], pa.int64())],
            ["sid", "root", "links"],
        )

    keys = ["comp", "left", "right"]
    ordered = dealt.select(*keys, "block", "sid", "copies", "text").repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, "sid binary, root binary, links long")


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted sets, over slices of what occurs in two or more."""
    every, inverse, counts = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = counts > 1
    number = np.cumsum(shared) - 1
    inside = shared[inverse]
    column, row = number[inverse[inside]], owner[inside]
    total = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for begin in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, [begin, begin + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[a:b], column[a:b] - begin] = 1
        total += part @ part.T
    return np.rint(total).astype(np.int64)


def classify(documents: DataFrame, threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text; other columns are left out): doc_id, class_id
    (the least doc_id of all that are linked with it, directly or through others), n_links (documents
    whose similarity is the threshold or more), text_hash, and class_key, which is null for texts
    without words and else tells classes apart even where document ids repeat.

    Words are what white space separates, in lower case. Texts without words have no links and are
    classes of their own. Repeated rows are documents of their own and linked with one another; rows
    without id are linked as others are, and a class of such rows only has no id. No rows give no
    rows. A pair of different sets can be missed with a probability of at most 1 - ``recall``."""
    scratch = Scratch(documents.sparkSession, "jaccard")
    one = ["id", "no_id", "text_hash"]
    named = lambda df: df.withColumns({"id": F.coalesce("doc_id", F.lit(0)), "no_id": F.col("doc_id").isNull()})
    given = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        F.col("text").cast("string").alias("text"),
    )
    sketched = scratch.keep(_sketched(given), "sketched")
    worded = sketched.where(F.col("sid").isNotNull())
    counted = named(worded).groupBy("sid").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("least_doc"), F.min(F.struct(*one)).alias("one"),
        F.first("sketch").alias("sketch"), F.first("low").alias("low"),
    )
    sets = scratch.keep(counted, "sets")
    links = candidate_links(sets, scratch, threshold, recall)
    comps = scratch.keep(components(links, scratch, "candidates").select(F.col("node").alias("sid"), F.xxhash64("root").alias("comp")), "comps")
    sizes = comps.groupBy("comp").agg(F.count("*").alias("n"))
    wanted = comps.join(sizes, "comp").join(sets.select("sid", "copies", "one.*"), "sid")
    # One text of each set is enough: it has all n-grams. Copies go before they meet in a task.
    distinct = named(given).groupBy(*one).agg(F.first("text").alias("text"))
    texts = wanted.join(distinct, one).drop(*one)
    exact = scratch.keep(_exact_links(_blocks(texts, "comp", "n", TEXT_BLOCK), threshold), "exact")
    roots = components(exact.select(F.col("sid").alias("u"), F.col("root").alias("v")), scratch, "classes")
    n_links = exact.groupBy("sid").agg(F.sum("links").alias("links"))
    joined = sets.select("sid", "copies", "least_doc").join(roots, F.col("sid") == F.col("node"), "left").join(n_links, "sid", "left")
    joined = scratch.keep(joined.select(
        "sid", F.coalesce("root", "sid").alias("root"), "least_doc", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    ), "joined")
    least = joined.groupBy("root").agg(F.min("least_doc").alias("class_id"))
    classes = scratch.keep(joined.join(least, "root").select("sid", F.col("root").alias("class_key"), "class_id", "n_links"), "classes")
    return sketched.select("doc_id", "text_hash", "sid").join(classes, "sid", "left").select(
        "doc_id", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "text_hash", "class_key",
    )


def one_per_class(documents: DataFrame, threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """The rows of ``documents`` (with doc_id and text; all columns stay) without near duplicates: of
    each class (see ``classify``) the row with the least doc_id stays, rows without id come last, and
    equal rows count once. Rows whose text has no words all stay."""
    first = Window.partitionBy("class_key").orderBy(F.col("doc_id").asc_nulls_last(), "text_hash")
    found = Scratch(documents.sparkSession, "kept").keep(classify(documents, threshold, recall), "classes")
    worded = found.where(F.col("class_key").isNotNull()).withColumn("n", F.row_number().over(first)).where(F.col("n") == 1)
    wordless = found.where(F.col("class_key").isNull()).select("doc_id", "text_hash").distinct()
    kept = worded.select("doc_id", "text_hash", F.lit(True).alias("once")).union(wordless.withColumn("once", F.lit(False)))
    kept = kept.select(F.struct("doc_id", "text_hash").alias("key"), "once")
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    joined = documents.select(key.alias("key"), row.alias("row")).join(kept, "key")
    place = F.row_number().over(Window.partitionBy("key").orderBy("once"))
    return joined.withColumn("place", place).where(~F.col("once") | (F.col("place") == 1)).select("row.*")
