"""Source divergence audit: exact term shares of every source against its language, by a minimal-perfect-hash recount.

The first pass counts, exactly, in how many documents of a language each term stands; the
frequent terms of a language are kept. They are cut into shards by their hash, and a task
builds for each shard a minimal perfect hash: levels of bits in which a term that is
alone at its place takes the bit, and the number of bits before it is its slot. Each slot
stores its term, so a term that was not kept is never taken for one that was.

The second pass broadcasts the shards and increments, for each group (language, source), a
dense array with one count a slot. Shards go out in rounds of at most ``ROUND_BYTES``, one scan
a round, so a broadcast has a proven bound however many terms are kept; a task that holds
``MOST_CELLS`` counts sends them on and starts anew. Counts are summed by slot in Spark, so a hot
group is one small row a slot and task.

Sources of a language are compared in tiles of sources by shards of slots, as dense matrices of
whole numbers; all arithmetic is exact.

Defined cases: null text, lang or source is the empty string; a group without terms, and a
language without kept terms (value 0 for each pair), are listed; a language with one source
has no pairs; repeated rows count each; other columns are ignored; very long texts
are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxrank.llm import textbytes as tb
from voxrank.operators.skew import counted_broadcast
from voxrank.session import materialise

LEAST_DOCUMENTS, SCALE, PRIOR, MOST_TERMS = 30, 1_000_000_000, 5, 50
#: Terms of a shard, about; sources of a tile; bytes of a broadcast; counts held by a task.
SHARD_TERMS, TILE, ROUND_BYTES, MOST_CELLS = 4_096, 256, 64 << 20, 4_000_000
_LEVELS, _ROOM = 32, 2.0  # levels of a perfect hash, bits for each term that is left
_U = np.uint64

#: Bytes outside terms: all ASCII but letters. Bytes of other characters belong to terms.
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[0x41:0x5B] += 0x20


@dataclass
class Terms:
    """The different terms of a chunk and the (row, term) of every occurrence."""

    words: pa.LargeBinaryArray
    row: np.ndarray
    term: np.ndarray


def terms_of(data: np.ndarray, offsets: np.ndarray) -> Terms:
    starts, ends, bounds = tb.tokens(data, offsets, _SEPARATOR)
    letters = _FOLDED[data[~_SEPARATOR[data]]]
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    every = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(letters)])
    coded = every.dictionary_encode()
    return Terms(coded.dictionary, np.repeat(np.arange(len(offsets) - 1), np.diff(bounds)), coded.indices.to_numpy())


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an array of binaries."""
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def word_hashes(words: pa.Array) -> np.ndarray:
    data, offsets = _bytes_of(words)
    return tb.token_hashes(data, offsets[:-1], offsets[1:])


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> _U(1)) % _U(max(1, shards))).astype(np.int64)


def _same(left: np.ndarray, at_left: np.ndarray, right: np.ndarray, at_right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether equally long, not empty ranges of two byte arrays are equal."""
    if not len(size):
        return np.zeros(0, bool)
    firsts = np.cumsum(size) - size
    inner = np.arange(size.sum()) - np.repeat(firsts, size)
    differ = left[np.repeat(at_left, size) + inner] != right[np.repeat(at_right, size) + inner]
    return ~np.logical_or.reduceat(differ, firsts)


def _place(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (tb.mix(hashes + _U((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % _U(bits)).astype(np.int64)


@dataclass
class PerfectHash:
    """Slots 0 to n - 1 for n terms, with the terms in order of slot; ``find`` gives -1 for any other term."""

    sizes: list[int] = field(default_factory=list)  # bits of each level
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, _U))
    ranks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # bits set before each word
    data: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    rest: dict[bytes, int] = field(default_factory=dict)  # terms that never stood alone: equal hashes

    @classmethod
    def build(cls, terms: pa.Array) -> PerfectHash:
        """``terms``: different, not empty binaries."""
        self, left, hashes = cls(), np.arange(len(terms)), word_hashes(terms)
        bits, owners = [], []
        for level in range(_LEVELS):
            if not len(left):
                break
            size = -(-max(64, int(_ROOM * len(left))) // 64) * 64
            at = _place(hashes[left], level, size)
            alone = np.bincount(at, minlength=size) == 1
            owner = np.full(size, -1)
            owner[at] = left
            bits.append(alone)
            owners.append(owner[alone])
            self.sizes.append(size)
            left = left[~alone[at]]
        order = np.concatenate([*owners, left]).astype(np.int64)
        if bits:
            self.words = np.packbits(np.concatenate(bits), bitorder="little").view("<u8")
            self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])
        ordered = terms.take(pa.array(order))
        self.data, self.offsets = (x.copy() for x in _bytes_of(ordered))
        self.rest = {bytes(ordered[i].as_py()): i for i in range(len(terms) - len(left), len(terms))}
        return self

    def to_bytes(self) -> bytes:
        return pickle.dumps(vars(self), protocol=5)

    @classmethod
    def from_bytes(cls, stored: bytes) -> PerfectHash:
        return cls(**pickle.loads(stored))

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def find(self, terms: pa.Array, hashes: np.ndarray) -> np.ndarray:
        slots = np.full(len(terms), -1, np.int64)
        left, first = np.arange(len(terms)), 0
        for level, size in enumerate(self.sizes):
            at = _place(hashes[left], level, size) + first
            word, bit = self.words[at >> 6], (at & 63).astype(_U)
            hit = (word >> bit) & _U(1) == 1
            below = np.bitwise_count(word[hit] & ((_U(1) << bit[hit]) - _U(1)))
            slots[left[hit]] = self.ranks[at[hit] >> 6] + below
            left, first = left[~hit], first + size
        # the stored term decides
        data, offsets = _bytes_of(terms)
        found = np.flatnonzero(slots >= 0)
        size = np.diff(offsets)[found]
        fits = size == np.diff(self.offsets)[slots[found]]
        slots[found[~fits]] = -1
        found, size = found[fits], size[fits]
        equal = _same(data, offsets[found], self.data, self.offsets[slots[found]], size)
        slots[found[~equal]] = -1
        if self.rest:
            for i in left:
                slots[i] = self.rest.get(terms[int(i)].as_py(), -1)
        return slots


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("text", *[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")])


def frequent_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, n_docs) of the terms in at least ``least`` documents of a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tb.chunks(batches):
            found = terms_of(data, offsets)
            if not len(found.row):
                continue
            n = len(found.words)
            once = np.unique(found.row * np.int64(n) + found.term)
            langs = rows.column("lang").dictionary_encode()
            pairs, docs = np.unique(langs.indices.to_numpy()[once // n] * np.int64(n) + once % n, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(pairs // n)), found.words.take(pa.array(pairs % n)).cast(pa.binary()), pa.array(docs)],
                names=["lang", "term", "n"])

    counted = _texts(docs).select("text", "lang").mapInArrow(count, "lang string, term binary, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n_docs")).where(F.col("n_docs") >= least)


def build_shards(kept: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(lang, shards, shard, slots, hash) with the perfect hash of each shard as bytes, of the terms in ``kept``."""
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    sizes = materialise(sizes.select("lang", F.expr(f"(v + {shard_terms - 1}) div {shard_terms}").alias("shards")), "audit-sizes")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, of = word_hashes(batch.column("term")), batch.column("shards").to_numpy()
            shard = ((hashes >> _U(1)) % of.astype(_U)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("term"), batch.column("shards"), pa.array(shard)], names=["lang", "term", "shards", "shard"])

    dealt = kept.select("lang", "term").join(counted_broadcast(sizes), "lang").select("lang", "term", "shards")
    dealt = dealt.mapInArrow(deal, "lang string, term binary, shards long, shard long")

    def build(group: pa.Table) -> pa.Table:
        terms = group.column("term").combine_chunks()
        built = PerfectHash.build(terms).to_bytes()
        head = {c: group.column(c)[:1] for c in ("lang", "shards", "shard")}
        return pa.table({**head, "slots": pa.array([len(terms)], pa.int64()), "hash": pa.array([built], pa.binary())})

    return dealt.groupBy("lang", "shard").applyInArrow(build, "lang string, shards long, shard long, slots long, hash binary")


def slot_terms(shards: DataFrame) -> DataFrame:
    """(lang, shard, slot, term) of every slot."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, shard, stored in zip(*(batch.column(c).to_pylist() for c in ("lang", "shard", "hash")), strict=True):
                known = PerfectHash.from_bytes(stored)
                terms = pa.Array.from_buffers(
                    pa.large_binary(), len(known), [None, pa.py_buffer(known.offsets), pa.py_buffer(known.data)])
                n = len(known)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n), pa.array(np.full(n, shard)), pa.array(np.arange(n)), terms.cast(pa.large_string()).cast(pa.string())],
                    names=["lang", "shard", "slot", "term"])

    return shards.select("lang", "shard", "hash").mapInArrow(read, "lang string, shard long, slot long, term string")


class _Counts:
    """Dense counts of the groups that a task has seen."""

    def __init__(self) -> None:
        self.cells: dict[tuple[str, str, int], np.ndarray] = {}
        self.held = 0

    def add(self, lang: str, source: str, shard: int, slots: int, at: np.ndarray, n: np.ndarray) -> None:
        key = (lang, source, shard)
        if key not in self.cells:
            self.cells[key] = np.zeros(slots, np.int64)
            self.held += slots
        self.cells[key][at] += n

    def flush(self) -> Iterator[pa.RecordBatch]:
        for (lang, source, shard), counts in self.cells.items():
            slots = np.flatnonzero(counts)
            n = len(slots)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(np.full(n, shard)), pa.array(slots), pa.array(counts[slots])],
                names=["lang", "source", "shard", "slot", "n"])
        self.cells, self.held = {}, 0


def _rounds(spark: SparkSession, shards: DataFrame, most: int) -> Iterator[list]:
    """The shards in lists of at most ``most`` bytes (at least one shard): what one broadcast holds."""
    sizes = shards.select("lang", "shard", F.octet_length("hash").alias("bytes")).orderBy("lang", "shard").collect()
    groups, held = [[]], 0
    for row in sizes:
        if groups[-1] and held + row.bytes > most:
            groups.append([])
            held = 0
        groups[-1].append((row.lang, row.shard))
        held += row.bytes
    for group in groups:
        if group:
            wanted = F.broadcast(spark.createDataFrame(group, "lang string, shard long"))
            yield shards.join(wanted, ["lang", "shard"], "left_semi").collect()


def recount(docs: DataFrame, shards: DataFrame, round_bytes: int = ROUND_BYTES, most_cells: int = MOST_CELLS) -> DataFrame:
    """(lang, source, shard, slot, n): the occurrences of every kept term in every group that has it."""
    spark, found = docs.sparkSession, None
    for group in _rounds(spark, shards, round_bytes):
        tables: dict[str, tuple[int, dict[int, PerfectHash]]] = {}
        for row in group:
            tables.setdefault(row.lang, (row.shards, {}))[1][row.shard] = PerfectHash.from_bytes(bytes(row.hash))
        sent = spark.sparkContext.broadcast(tables)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = _Counts()
            for rows, data, offsets in tb.chunks(batches):
                for lang, source, shard, slots, at, n in _chunk_counts(rows, terms_of(data, offsets), sent.value):
                    held.add(lang, source, shard, slots, at, n)
                    if held.held > most_cells:
                        yield from held.flush()
            yield from held.flush()

        part = _texts(docs).mapInArrow(count, "lang string, source string, shard long, slot long, n long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "lang string, source string, shard long, slot long, n long")
    return found.groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n"))


def _chunk_counts(rows: pa.RecordBatch, found: Terms, tables: dict) -> Iterator[tuple]:
    if not len(found.row):
        return
    langs, sources = (rows.column(c).dictionary_encode() for c in ("lang", "source"))
    n_terms, n_sources = len(found.words), len(sources.dictionary)
    group = langs.indices.to_numpy().astype(np.int64) * n_sources + sources.indices.to_numpy()
    pairs, counts = np.unique(group[found.row] * n_terms + found.term, return_counts=True)
    of, term = pairs // n_terms, pairs % n_terms
    hashes = word_hashes(found.words)
    for lang, name in enumerate(langs.dictionary.to_pylist()):
        if name not in tables:
            continue
        shards, parts = tables[name]
        here = np.flatnonzero(of // n_sources == lang)
        used = np.unique(term[here])
        slot, shard = np.full(n_terms, -1, np.int64), np.full(n_terms, -1, np.int64)
        shard[used] = shard_of(hashes[used], shards)
        for number, known in parts.items():
            mine = used[shard[used] == number]
            slot[mine] = known.find(found.words.take(pa.array(mine)), hashes[mine])
        here = here[slot[term[here]] >= 0]
        # one run for each group and shard
        key = of[here] % n_sources * np.int64(shards) + shard[term[here]]
        here = here[np.argsort(key, kind="stable")]
        key = np.sort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key, prepend=-1, append=-1)) if len(key) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            source, number = sources.dictionary[int(key[a] // shards)].as_py(), int(key[a] % shards)
            yield name, source, number, len(parts[number]), slot[term[here[a:b]]], counts[here[a:b]]


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (counts + PRIOR) / total), exact for totals below 2**53, by long division in base 1000."""
    rest = counts.astype(np.int64) + PRIOR
    total = np.maximum(total, 1)
    out = np.zeros_like(rest)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def _share(count: str, total: str) -> Column:
    """The same in Spark, over exact decimals."""
    return F.expr(
        f"cast({SCALE} as decimal(10,0)) * cast({count} + {PRIOR} as decimal(20,0)) div cast({total} as decimal(20,0))") + 1


def _divergences(counts: DataFrame, groups: DataFrame, shards: DataFrame, tile: int) -> DataFrame:
    """(lang, a, b, value) for all ordered pairs of sources, by number, of a language."""
    tiles = F.expr(f"(n_sources + {tile - 1}) div {tile}")
    mine = F.expr(f"number div {tile}")
    with_tiles = groups.withColumns({"tiles": tiles, "tile": mine}).withColumn(
        "pair", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda t: F.struct(
            F.least(t, F.col("tile")).alias("low"), F.greatest(t, F.col("tile")).alias("high")))))
    with_tiles = with_tiles.select("lang", "source", "number", "tile", "total", "pair.low", "pair.high")
    sides = with_tiles.join(shards.select("lang", "shard", "slots"), "lang", "left")
    key = ["lang", "shard", "low", "high"]
    left = counts.join(counted_broadcast(with_tiles), ["lang", "source"]).select(*key, "number", "slot", "n")
    right = sides.select(*key, "number", "tile", "total", "slots").toDF("lang_", "shard_", "low_", "high_", "number_", "tile", "total", "slots")
    right_key = [f"{c}_" for c in key]

    def compare(cells: pa.Table, sources: pa.Table) -> pa.Table:
        number, tile_of, total = (sources.column(c).to_numpy() for c in ("number_", "tile", "total"))
        order = np.argsort(number)
        number, tile_of, total = number[order], tile_of[order], total[order]
        slots = sources.column("slots")[0].as_py() or 0
        dense = np.zeros((len(number), slots), np.int64)
        if cells.num_rows:
            at = np.searchsorted(number, cells.column("number").to_numpy())
            dense[at, cells.column("slot").to_numpy()] = cells.column("n").to_numpy()
        share = shares(dense, total[:, None])
        low, high = sources.column("low_")[0].as_py(), sources.column("high_")[0].as_py()
        first, second = np.flatnonzero(tile_of == low), np.flatnonzero(tile_of == high)
        a, b, value = [], [], []
        for i in first:
            others = second[second > i] if low == high else second
            a.append(np.full(len(others), number[i]))
            b.append(number[others])
            value.append(np.abs(share[others] - share[i]).sum(1))
        a, b, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, value))
        lang = pa.array([sources.column("lang_")[0].as_py()] * (2 * len(a)), pa.string())
        return pa.table({"lang": lang, "a": np.concatenate([a, b]), "b": np.concatenate([b, a]), "value": np.concatenate([value, value])})

    parts = left.groupBy(*key).cogroup(right.groupBy(*right_key)).applyInArrow(compare, "lang string, a long, b long, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame, least: int = LEAST_DOCUMENTS, most_terms: int = MOST_TERMS, shard_terms: int = SHARD_TERMS,
    tile: int = TILE, round_bytes: int = ROUND_BYTES, most_cells: int = MOST_CELLS,
) -> DataFrame:
    """lang, source, part ("pair" or "term"), item, value and rank, as stated in the module's head.

    A group's share of a term is ``1 + floor(10**9 * (n + 5) / (N + 5 V))``: n its occurrences there, N those of all kept
    terms, V their number. Pairs sum the differences of two sources over all kept terms; terms list the
    ``most_terms`` of a source that most exceed their share in the language.
    """
    kept = materialise(frequent_terms(docs, least), "audit-kept")
    shards = materialise(build_shards(kept, shard_terms), "audit-shards")
    counts = materialise(recount(docs, shards, round_bytes, most_cells), "audit-counts")
    v = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("n_all"))
    groups = _texts(docs).select("lang", "source").distinct()
    groups = groups.join(sums, ["lang", "source"], "left").join(v, "lang", "left").select(
        "lang", "source", F.coalesce("n_all", F.lit(0)).alias("n_all"), F.coalesce("v", F.lit(0)).alias("v"))
    per_lang = Window.partitionBy("lang")
    groups = materialise(groups.select(
        "lang", "source", (F.row_number().over(per_lang.orderBy("source")) - 1).cast("long").alias("number"),
        F.count(F.lit(1)).over(per_lang).alias("n_sources"), (F.col("n_all") + PRIOR * F.col("v")).alias("total"),
        (F.sum("n_all").over(per_lang) + PRIOR * F.col("v")).alias("lang_total")), "audit-groups")

    names = counted_broadcast(groups.select("lang", "source", "number"))
    pairs = _divergences(counts, groups, shards, tile)
    pairs = pairs.join(names.withColumnRenamed("number", "a"), ["lang", "a"]).join(
        names.select("lang", F.col("number").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    totals = counted_broadcast(groups.select("lang", "source", "total", "lang_total"))
    slot = ["lang", "shard", "slot"]
    over = counts.withColumn("n_lang", F.sum("n").over(Window.partitionBy(*slot))).join(totals, ["lang", "source"])
    over = over.withColumn("value", _share("n", "total") - _share("n_lang", "lang_total")).where("value > 0")
    over = over.join(slot_terms(shards).withColumnRenamed("term", "item"), slot)
    over = over.select("lang", "source", F.lit("term").alias("part"), "item", "value")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(best).alias("rank")
    return pairs.select("*", rank).unionByName(over.select("*", rank).where(F.col("rank") <= most_terms))
