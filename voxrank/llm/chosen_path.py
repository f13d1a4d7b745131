"""Similarity join of texts on word n-grams (Jaccard), by the Chosen Path method.

1. Each text becomes the set of hashes of its five-word windows. Texts with equal sets
   are one set from here on, so copies are never compared.
2. Each set is embedded as ``TOKENS`` tokens, its least hash by each of as many functions.
   In every run a few token places are sampled, on average 1 / threshold of them, and
   sets with the same token at a sampled place go to one bucket. A bucket of more than
   ``BRUTE`` sets is split again on freshly sampled tokens, to ``DEPTH`` levels; what
   remains is compared by brute force on the tokens, whatever its size. Buckets of more
   than ``WINDOW`` sets are counted first and dealt again in Spark, level by level; those
   still as large at the last level are compared as pairs of blocks. A pair at the
   threshold survives a run with chance threshold**DEPTH at least, and the runs are
   repeated until the chance to miss it in all of them is below 1 - recall.
   Of the pairs found in a bucket only a spanning forest is kept.
3. The connected sets are compared exactly, in blocks: two sets are linked if their
   Jaccard similarity reaches the threshold (integers, no rounding). Each set sums up
   its links; the pairs themselves never leave a task. Classes are the components.

Defined cases: a text of one to four words has one window, of all its words; texts
without words (null, empty) are copies of each other; a class has the least doc_id
among its texts; repeated rows are copies; further columns are ignored; an empty table
gives an empty result. Equal 64-bit hashes count as equal windows.

The sets of one bucket, or of one pair of its blocks, stand in one task: about ``WINDOW``
at most, TOKENS * 2 bytes each; copies do not add to them. The driver holds the keys of
the buckets above ``WINDOW``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxrank.llm import textbytes as tb
from voxrank.llm.components import components
from voxrank.session import materialise

WORDS = 5
THRESHOLD = Fraction(4, 5)
RECALL = 0.999
TOKENS, BRUTE, DEPTH, WINDOW = 64, 1024, 3, 100_000
#: Token agreement that makes a candidate: four deviations of the estimate below the threshold,
#: whatever the sizes of the sets; a pair at the threshold falls below it with chance 0.00013.
_CANDIDATE = 0.6
#: Most sets and most windows in a block of the exact comparison.
_BLOCK_SETS, _BLOCK_WINDOWS = 1024, 1_000_000
U = np.uint64
#: An odd factor for each token place, and the members multiplied at once.
_FACTORS = tb.mix(np.arange(1, TOKENS + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
_HASHED = 512


def runs_needed(threshold: float, recall: float, depth: int = DEPTH) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth)))


def _sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    starts, ends, bounds = tb.tokens(data, offsets)
    windows, window_bounds = tb.window_hashes(tb.token_hashes(data, starts, ends), bounds, WORDS)
    for a, b in zip(window_bounds[:-1], window_bounds[1:], strict=True):
        yield np.unique(windows[a:b])


def _set_id(members: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = tb.mix(members + U(0x2545F4914F6CDD1D)).sum(dtype=U) + U(len(members))
    return int(tb.mix(np.array([total], U)).view(np.int64)[0])


def _tokens(members: np.ndarray) -> np.ndarray:
    """16 bits of the least member at each place, by the place's own hash function: two sets agree at each as often as they are similar."""
    if not len(members):
        return np.zeros(TOKENS, np.uint16)
    least = np.full(TOKENS, ~U(0))
    for at in range(0, len(members), _HASHED):
        np.minimum(least, (members[at : at + _HASHED, None] * _FACTORS).min(axis=0), out=least)
    return (tb.mix(least) >> U(48)).astype(np.uint16)


def sampled_places(threshold: float, runs: int, seed: int) -> list[tuple[int, int]]:
    """(run, token place) pairs of the first split: each place with chance 1 / (threshold * TOKENS), one at least."""
    random = np.random.default_rng(seed)
    out = []
    for run in range(runs):
        chosen = np.flatnonzero(random.random(TOKENS) < 1 / (threshold * TOKENS))
        out += [(run, int(p)) for p in (chosen if len(chosen) else random.integers(TOKENS, size=1))]
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, set_id, the number of windows and the tokens of each row."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    schema = rows.drop("text").schema.add("set_id", "long").add("size", "integer").add("tokens", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tb.chunks(batches):
            ids, sizes, tokens = [], [], []
            for members in _sets(data, offsets):
                ids.append(_set_id(members))
                sizes.append(len(members))
                tokens.append(_tokens(members).tobytes())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("text_hash"), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()),
                 pa.array(tokens, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by ``keys``, cut again so that no group is spread over two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [np.asarray(batch.column(k)) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for k in key:
            change |= k[1:] != k[:-1]
        same = held and all(np.asarray(held[-1].column(k))[-1] == v[0] for k, v in zip(keys, key, strict=True))
        last = int(np.flatnonzero(change)[-1]) + 1 if change.any() else 0
        if held and not same:
            yield _joined(held)
            held = []
        if last:
            yield _joined([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _spanning(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``count`` nodes the least node of its component under the pairs."""
    label = np.arange(count)
    while len(left):
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _alike(tokens: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return (tokens[one] == tokens[other]).sum(axis=-1) >= _CANDIDATE * TOKENS


def _brute(tokens: np.ndarray, members: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the alike pairs among ``members``: a search that compares each found set with all unfound."""
    forest, rest = [], members
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            hit = (tokens[rest] == tokens[at]).sum(axis=1) >= _CANDIDATE * TOKENS
            forest += [(at, x) for x in rest[hit]]
            queue += list(rest[hit])
            rest = rest[~hit]
    return forest


def _across(tokens: np.ndarray, one: np.ndarray, other: np.ndarray) -> list[tuple[int, int]]:
    """As ``_brute``, of the pairs with a set in either block."""
    forest, rest = [], [one, other]
    while len(rest[0]) and len(rest[1]):
        queue, rest[0] = [(rest[0][0], 1)], rest[0][1:]
        while queue:
            at, facing = queue.pop()
            hit = (tokens[rest[facing]] == tokens[at]).sum(axis=1) >= _CANDIDATE * TOKENS
            forest += [(at, x) for x in rest[facing][hit]]
            queue += [(x, 1 - facing) for x in rest[facing][hit]]
            rest[facing] = rest[facing][~hit]
    return forest


def _fresh_places(path: int, threshold: float) -> np.ndarray:
    random = np.random.default_rng(path)
    places = np.flatnonzero(random.random(TOKENS) < 1 / (threshold * TOKENS))
    return places if len(places) else random.integers(TOKENS, size=1)


def _split(
    tokens: np.ndarray, members: np.ndarray, path: int, depth: int, threshold: float, brute: int = BRUTE
) -> list[tuple[int, int]]:
    if len(members) < 2:
        return []
    if len(members) <= brute or depth >= DEPTH:
        return _brute(tokens, members)
    forest = []
    for place in _fresh_places(path, threshold):
        value = tokens[members, place]
        order = np.argsort(value, kind="stable")
        for part in np.split(members[order], np.flatnonzero(np.diff(value[order])) + 1):
            forest += _split(tokens, part, int(tb.mix(np.array([path + int(place) + 1], U))[0] >> U(1)), depth + 1, threshold, brute)
    return forest


def _path(key: int) -> int:
    return int(key) & (2**62 - 1)


def _dealt(
    tokens: np.ndarray, places: list[tuple[int, int]], hot: list[np.ndarray], threshold: float
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, rows, bucket of each) at every level to len(hot) + 1; rows of the buckets ``hot[k]`` are dealt again at level k + 2."""
    every = np.arange(len(tokens))
    parts = ((every, tb.mix(tokens[:, p].astype(U) + U((run * TOKENS + p + 1) << 20)).view(np.int64)) for run, p in places)
    for level in range(1, len(hot) + 2):
        deeper = []
        for rows, key in parts:
            yield level, rows, key
            if level > len(hot):
                continue
            for path in np.intersect1d(key, hot[level - 1]):
                some = rows[key == path]
                for place in _fresh_places(_path(path), threshold):
                    base = tb.mix(np.array([_path(path) + int(place) + 1], U))
                    deeper.append((some, tb.mix(base + tokens[some, place].astype(U)).view(np.int64)))
        parts = deeper


def _token_rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint16).reshape(-1, TOKENS)


def hot_buckets(sets: DataFrame, places: list[tuple[int, int]], threshold: float, window: int) -> list[dict[int, int]]:
    """For each level that has some, its buckets of more than ``window`` sets, with their sizes."""
    hot: list[dict[int, int]] = []
    while len(hot) < DEPTH:
        above = [np.array(sorted(h), np.int64) for h in hot]

        def count(batches: Iterator[pa.RecordBatch], above: list[np.ndarray] = above) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                for level, _, key in _dealt(_token_rows(batch), places, above, threshold):
                    if level > len(above):
                        found, n = np.unique(key, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["bucket", "n"])

        # 2**16 buckets at most for each place of a level and path
        sizes = sets.select("tokens").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
        large = {r.bucket: r.n for r in sizes.where(F.col("n") > window).collect()}
        if not large:
            break
        hot.append(large)
    return hot


def candidates(sets: DataFrame, threshold: float, runs: int, seed: int = 1) -> DataFrame:
    """Edges (u, v) between set_ids that span the candidate pairs of all runs."""
    places = sampled_places(threshold, runs, seed)
    window, brute = WINDOW, BRUTE
    hot = hot_buckets(sets, places, threshold, window)
    above = [np.array(sorted(h), np.int64) for h in hot]
    last = hot[-1] if len(hot) == DEPTH else {}
    blocks = np.array([-(-2 * last[k] // window) for k in above[-1]], np.int64) if last else None

    def rows_of(batch: pa.RecordBatch, rows: np.ndarray, key: np.ndarray, level: int) -> pa.RecordBatch:
        take = pa.array(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(np.full(len(rows), level, np.int32)), batch.column("set_id").take(take),
             batch.column("tokens").take(take)], names=["bucket", "level", "set_id", "tokens"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of buckets to compare, by level; of a block in a pair of blocks the level is -1 (the lower) or -2."""
        for batch in batches:
            if not batch.num_rows:
                continue
            own = tb.mix(np.asarray(batch.column("set_id")).view(U))
            for level, rows, key in _dealt(_token_rows(batch), places, above[: DEPTH - 1], threshold):
                if level > len(hot):
                    yield rows_of(batch, rows, key, level)
                    continue
                large = np.isin(key, above[level - 1])
                yield rows_of(batch, rows[~large], key[~large], level)
                if level < DEPTH or not large.any():
                    continue
                rows, key = rows[large], key[large]
                count = blocks[np.searchsorted(above[-1], key)]
                block = (own[rows] % count.astype(U)).astype(np.int64)
                for other in range(int(count.max())):
                    some = np.flatnonzero(count > other)
                    low, high = np.minimum(block[some], other), np.maximum(block[some], other)
                    pair = tb.mix(key[some].view(U) + tb.mix((low << 32 | high).view(U) + U(1))).view(np.int64)
                    for side, mine in ((-1, block[some] == low), (-2, block[some] != low)):
                        yield rows_of(batch, rows[some[mine]], pair[mine], side)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, ["bucket"]):
            key, ids = np.asarray(batch.column("bucket")), np.asarray(batch.column("set_id"))
            starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
            sizes = np.diff(np.append(starts, len(key)))
            used = np.repeat(sizes > 1, sizes)
            if not used.any():
                continue
            tokens, level = _token_rows(batch), np.asarray(batch.column("level"))
            size_of = np.repeat(sizes, sizes)
            left, right = [], []
            some = np.flatnonzero(used & (size_of <= 32))
            for step in range(1, 32):  # pairs of small buckets, at each distance
                one = some[some + step < len(key)]
                one = one[key[one] == key[one + step]]
                if not len(one):
                    break
                hit = _alike(tokens, one, one + step)
                left.append(one[hit])
                right.append(one[hit] + step)
            for start, size in zip(starts[sizes > 32], sizes[sizes > 32], strict=True):
                members = np.arange(start, start + size)
                side = level[members]
                if (side == -2).any():
                    forest = _across(tokens, members[side == -1], members[side == -2])
                elif side[0] == -1:
                    forest = _brute(tokens, members)
                else:
                    forest = _split(tokens, members, _path(key[start]), int(side[0]), threshold, brute)
                if forest:
                    found = np.array(forest)
                    left.append(found[:, 0])
                    right.append(found[:, 1])
            if not left:
                continue
            label = _spanning(len(key), np.concatenate(left), np.concatenate(right))
            moved = np.flatnonzero(label != np.arange(len(key)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["u", "v"])

    dealt = sets.select("set_id", "tokens").mapInArrow(deal, "bucket long, level int, set_id long, tokens binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(pairs, "u long, v long")


def bloom(ids: DataFrame) -> tuple[np.ndarray, int]:
    """Bit set of the hashes in the one column of ``ids``, 16 bits each up to 8 MB in all."""
    count = ids.count()
    words = 1 << min(20, max(6, math.ceil(math.log2(max(1, count)) - 2)))
    name = ids.columns[0]
    bits = ids.select(F.explode(F.array(F.col(name), F.shiftrightunsigned(name, 32))).alias("h")).select(
        F.pmod("h", F.lit(words)).alias("word"), F.expr("shiftleft(1L, int(pmod(shiftright(h, 20), 64)))").alias("bit"))
    found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(words, np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    return table.view(U), words


def in_bloom(h: np.ndarray, table: np.ndarray, words: int) -> np.ndarray:
    """Which hashes may be in the set."""
    out = np.ones(len(h), bool)
    for value in (h, (h.view(U) >> U(32)).view(np.int64)):
        bit = ((value >> 20) % 64).astype(U)
        out &= (table[value % words] >> bit) & U(1) > 0
    return out


def _members(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """set_id and members of one text of each set in ``wanted`` (set_id, first_hash).

    The texts are read again and only those that pass a bit set of bounded size are
    shuffled; the join that follows drops the few that pass by chance.
    """
    table, words = bloom(wanted.select("first_hash"))
    sent = docs.sparkSession.sparkContext.broadcast(table)
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("id_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in tb.chunks(batches):
            own = np.asarray(part.column("id_hash"))
            pass_on = in_bloom(own, sent.value, words)
            ids, members, hashes = [], [], []
            for r, some in enumerate(_sets(data, offsets)):
                if pass_on[r]:
                    ids.append(_set_id(some))
                    members.append(some.tobytes())
                    hashes.append(own[r])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(members, pa.binary())],
                names=["set_id", "first_hash", "members"])

    found = rows.mapInArrow(run, "set_id long, first_hash long, members binary")
    # rows repeated with their doc_id give the same set again
    return found.join(wanted, ["set_id", "first_hash"]).dropDuplicates(["set_id"])


def _overlaps(members: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    owner = np.repeat(np.arange(len(members)), [len(m) for m in members])
    _, column, count = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    shared = count > 1  # a window of one set alone is in no intersection
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    out = np.zeros((len(members), len(members)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        dense = np.zeros((len(members), min(width, int(shared.sum()) - low)), np.float32)
        dense[owner[a:b], column[a:b] - low] = 1
        out += dense @ dense.T
    return out


def links(blocks: DataFrame, threshold: Fraction) -> DataFrame:
    """For each set and block pair: its links there (sets and documents), and its root there.

    ``blocks``: component, low, high, block, set_id, copies, members; sorted inside by the first three.
    """
    num, den = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, ["component", "low", "high"]):
            key = np.column_stack([np.asarray(batch.column(c)) for c in ("component", "low", "high")])
            edges = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]])
            ids, block, copies = (np.asarray(batch.column(c)) for c in ("set_id", "block", "copies"))
            members = batch.column("members").to_pylist()
            n_sets, n_docs, root = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), ids.copy()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                arrays = [np.frombuffer(m, U) for m in members[a:b]]
                size = np.array([len(x) for x in arrays], np.int64)
                both = _overlaps(arrays).astype(np.int64)
                linked = den * both >= num * (size[:, None] + size[None, :] - both)
                linked &= both > 0
                np.fill_diagonal(linked, False)
                if key[a, 1] != key[a, 2]:
                    linked &= block[a:b, None] != block[None, a:b]
                n_sets[a:b] = linked.sum(axis=1)
                n_docs[a:b] = linked @ copies[a:b]
                left, right = np.nonzero(np.triu(linked))
                root[a:b] = ids[a:b][_spanning(b - a, left, right)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(n_sets), pa.array(n_docs), pa.array(root)], names=["set_id", "sets", "docs", "root"])

    return blocks.mapInArrow(run, "set_id long, sets long, docs long, root long")


def join(docs: DataFrame, threshold: Fraction = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, text_hash, class_id, n_links, n_text_links and is_first of each row.

    ``n_links`` counts the other rows linked to it, copies among them; ``n_text_links``
    the other window sets linked to its own; ``is_first`` marks the class's first text,
    by doc_id (nulls last) and text hash.
    """
    rows = materialise(signatures(docs), "signatures")
    sets = rows.groupBy("set_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"),
        F.first("tokens").alias("tokens"))
    sets = materialise(sets, "window-sets")
    runs = runs_needed(float(threshold), recall)
    near = components(candidates(sets.where("size > 0"), float(threshold), runs))
    near = materialise(
        near.withColumnsRenamed({"u": "set_id", "root": "component"}).join(sets.drop("tokens"), "set_id")
        .withColumn("first_hash", F.xxhash64("first.doc_id")), "near-sets")
    sums = near.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("windows"))
    sums = sums.select("component", F.greatest(
        F.ceil(F.col("n") / _BLOCK_SETS), F.ceil(F.col("windows") / _BLOCK_WINDOWS)).cast("int").alias("blocks"))
    placed = near.join(sums, "component").withColumn("block", F.pmod(F.xxhash64("set_id"), "blocks").cast("int"))
    placed = _members(docs, placed.select("set_id", "first_hash", "component", "copies", "blocks", "block"))
    with_block = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "block", "set_id", "copies", "members")
    keys = ["component", "low", "high"]
    found = materialise(links(with_block.repartition(*keys).sortWithinPartitions(*keys), threshold), "links")
    linked = found.groupBy("set_id").agg(F.sum("sets").alias("sets"), F.sum("docs").alias("docs"))
    roots = components(found.select(F.col("set_id").alias("u"), F.col("root").alias("v")))
    classes = (
        sets.select("set_id", "first", "copies").join(roots.withColumnRenamed("u", "set_id"), "set_id", "left")
        .join(linked, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    )
    least = classes.groupBy("root").agg(F.min("first").alias("least"))
    classes = classes.join(least, "root").select(
        "set_id", "least", (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("sets", F.lit(0)).alias("n_text_links"))
    first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & F.col("text_hash").eqNullSafe(F.col("least.text_hash"))
    return rows.select("doc_id", "text_hash", "set_id").join(classes, "set_id").select(
        "doc_id", "text_hash", F.col("least.doc_id").alias("class_id"), "n_links", "n_text_links", first.alias("is_first"))


def keep_first(docs: DataFrame, threshold: Fraction = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row of ``docs`` of each class, unchanged: its first text, and of rows repeated with it any one."""
    key = F.xxhash64("doc_id", "text_hash").alias("_key")
    firsts = join(docs, threshold, recall).where("is_first").select(key).distinct()
    rows = docs.withColumn("_key", F.xxhash64("doc_id", F.xxhash64("text")))
    number = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    return rows.join(firsts, "_key", "left_semi").withColumn("_number", number).where("_number = 1").select(*docs.columns)
