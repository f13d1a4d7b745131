"""TF-IDF features, keywords, representatives and cohesion."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, StopWordsRemover
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxrank import fixed_values as fixed
from voxrank.functions import text as tx
from voxrank.operators import late
from voxrank.operators.skew import join_by_frequency
from voxrank.session import materialise, store

# How a stored ML vector reads as plain columns.
_MEANS_BYTES = 64 * 1024 * 1024  # most topic means ever broadcast at once
_AT_ONCE = 1 << 21  # words or characters counted at once
_PAIRS_OUT = 1 << 16  # (text, term) pairs of a batch
_CANDIDATES = 200_000  # most words broadcast, with their numbers, to count pairs
_STORED_VECTOR = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


def english_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def word_terms(text: Column, stop_words: Sequence[str], pairs: bool = True) -> Column:
    """Words of two or more characters without stop words, then neighbouring pairs."""
    kept = tx.without(tx.words(text), stop_words)
    return tx.with_word_pairs(kept) if pairs else kept


def _idf(documents: Column, document_frequency: Column) -> Column:
    return F.log((documents + 1) / (document_frequency + 1)) + 1


def vocabulary(docs: DataFrame, max_features: int | None = None, terms: str = "terms") -> DataFrame:
    """(term, total, doc_freq, idf); the ``max_features`` most frequent terms.

    Term and document frequency come from one explode and one grouping whose
    partial sums run before the shuffle. Ties at the cut go to the earlier term.
    """
    tokens = F.col(terms)
    both = F.concat(
        F.transform(tokens, lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df"))),
        F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df"))),
    )
    counts = (
        docs.select(F.inline(both))
        .groupBy("term").agg(F.sum("tf").alias("total"), F.sum("df").alias("doc_freq"))
    )
    if max_features is not None:
        counts = counts.orderBy(F.desc("total"), "term").limit(max_features)
    documents = docs.agg(F.count("*").alias("n")).scalar()
    return counts.withColumn("idf", _idf(documents, F.col("doc_freq")))


def _counted(row: np.ndarray, code: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different codes (below ``span``), how often each occurs and in how many rows."""
    code, back = (code, None) if span < 1 << 40 else np.unique(code, return_inverse=True)
    if back is not None:
        known, code, span = code, back, len(code)
    key, times = np.unique(row * span + code, return_counts=True)
    code = key % span
    order = np.argsort(code, kind="stable")
    code, times = code[order], times[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    total = np.add.reduceat(times, first) if len(first) else times
    found = code[first]
    return (found if back is None else known[found]), total, np.diff(np.append(first, len(code)))


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    """Some rows at a time, and (row, word) of all words of their last column, lists of words or words joined by spaces."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        if pa.types.is_string(lists.type):
            yield from _joined_batches(batch, lists)
            continue
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(lists):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _AT_ONCE, "right")))
            part = lists.slice(at, to - at)
            sizes = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
            yield batch.slice(at, to - at), np.repeat(np.arange(len(part)), sizes), part.flatten()
            at = to


def _joined_batches(batch: pa.RecordBatch, joined: pa.Array) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    sizes = pc.fill_null(pc.binary_length(joined), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < len(joined):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4 * _AT_ONCE, "right")))
        texts = pc.fill_null(joined.slice(at, to - at), "")
        _, bounds, data = texts.buffers()
        bounds = np.frombuffer(bounds, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        space = data == 0x20
        opens = np.zeros(len(data), bool)
        opens[1:] = space[:-1]
        opens[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        starts = np.flatnonzero(opens)
        offsets = np.append(starts, len(data)) - np.concatenate([[0], np.cumsum(space)])[np.append(starts, len(data))]
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[~space])).cast(pa.string())
        yield batch.slice(at, to - at), np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, bounds))), words
        at = to


_TERM_COUNTS = ("total long", "doc_freq long")


def _sums(parts: DataFrame, *keys: str) -> DataFrame:
    return parts.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("doc_freq").alias("doc_freq"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(term, total, doc_freq) of the lists of words in the one column of ``docs``, summed per batch before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, row, words in _word_batches(batches):
            coded = words.dictionary_encode()
            code, total, seen = _counted(row, coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary)))
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary.take(pa.array(code)), pa.array(total, pa.int64()), pa.array(seen, pa.int64())],
                names=["term", "total", "doc_freq"])

    return _sums(docs.mapInArrow(run, ", ".join(("term string", *_TERM_COUNTS))), "term")


def _pair_counts(docs: DataFrame, known: list[str]) -> DataFrame:
    """(term, total, doc_freq) of neighbouring words that are both among ``known``, counted as pairs of their numbers."""
    spark, size = docs.sparkSession, len(known)
    sent = spark.sparkContext.broadcast(known)  # at most _CANDIDATES words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(sent.value, pa.string())
        for _, row, words in _word_batches(batches):
            coded = words.dictionary_encode()
            numbers = pc.fill_null(pc.index_in(coded.dictionary, values), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            number = numbers[coded.indices.to_numpy()]
            pair = np.flatnonzero((row[1:] == row[:-1]) & (number[1:] >= 0) & (number[:-1] >= 0))
            code, total, seen = _counted(row[pair], number[pair] * size + number[pair + 1], size * size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(code, pa.int64()), pa.array(total, pa.int64()), pa.array(seen, pa.int64())], names=["code", "total", "doc_freq"])

    return _sums(docs.mapInArrow(run, ", ".join(("code long", *_TERM_COUNTS))), "code")


def word_vocabulary(docs: DataFrame, max_features: int, words: str = "words") -> DataFrame:
    """``vocabulary`` of the words and neighbouring pairs of a written table of words, lists or joined by spaces.

    A pair occurs at most as often as each of its words. So only pairs of words that reach the
    total of the ``max_features``-th word can be among the most frequent terms; all others are
    left uncounted. If very many words reach it, all terms are counted plainly.
    """
    lists = docs.select(words)
    singles = materialise(word_counts(lists), "word-counts")
    cut = singles.orderBy(F.desc("total")).select("total").limit(max_features).agg(
        F.min("total").alias("least"), F.count("*").alias("n")).first()
    least = cut.least if cut.n == max_features else 0
    likely = singles.where(F.col("total") >= least)
    known = [r.term for r in likely.select("term").limit(_CANDIDATES + 1).collect()] if max_features else []
    if len(known) > _CANDIDATES:
        listed = tx.split_words(F.col(words)) if dict(docs.dtypes)[words] == "string" else F.col(words)
        return vocabulary(docs.select(tx.with_word_pairs(listed).alias("terms")), max_features)
    if known:
        names = docs.sparkSession.createDataFrame(list(enumerate(known)), "number long, word string")
        pairs = _pair_counts(lists, known).where(F.col("total") >= least)
        left, right = names.toDF("_left", "_first"), names.toDF("_right", "_second")
        pairs = pairs.withColumns({"_left": F.expr(f"code div {len(known)}"), "_right": F.col("code") % len(known)})
        pairs = pairs.join(F.broadcast(left), "_left").join(F.broadcast(right), "_right").select(
            F.concat_ws(" ", "_first", "_second").alias("term"), "total", "doc_freq")
        likely = likely.unionByName(pairs)
    counts = likely.orderBy(F.desc("total"), "term").limit(max_features)
    documents = docs.agg(F.count("*").alias("n")).scalar()
    return counts.withColumn("idf", _idf(documents, F.col("doc_freq")))


def character_vocabulary(docs: DataFrame, max_features: int, text: str = "text") -> DataFrame:
    """``vocabulary`` of the runs of one to three characters of ``text``, counted as numbers.

    Lower case and white space are settled in the JVM (``functions.text.flat_text``); the runs
    of a stretch of texts are numbers over its different characters.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            ends = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _AT_ONCE, "right")))
                yield from count(texts.slice(at, to - at))
                at = to

    def count(texts: pa.Array) -> Iterator[pa.RecordBatch]:
        row = np.repeat(np.arange(len(texts)), pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
        points = np.frombuffer("".join(t or "" for t in texts.to_pylist()).encode("utf-32-le"), np.uint32)
        letters, code = np.unique(points, return_inverse=True)
        letters, code, size = letters.astype(np.int64), code.astype(np.int64), len(letters) + 1  # 0: no character
        one = code + 1
        for length in (1, 2, 3):
            here = np.flatnonzero(row[length - 1 :] == row[: len(row) - length + 1]) if len(row) >= length else np.zeros(0, np.int64)
            runs = sum(one[here + k] * size**k for k in range(length)) if len(here) else np.zeros(0, np.int64)
            found, total, seen = _counted(row[here], runs, size**length)
            term = np.zeros((len(found), length), np.uint32)
            for k in range(length):
                term[:, k] = letters[found // size**k % size - 1]
            text = term.tobytes().decode("utf-32-le")
            yield pa.RecordBatch.from_arrays(
                [pa.array([text[i : i + length] for i in range(0, len(text), length)], pa.string()), pa.array(total, pa.int64()),
                 pa.array(seen, pa.int64())], names=["term", "total", "doc_freq"])

    sums = _sums(docs.select(text).mapInArrow(run, ", ".join(("term string", *_TERM_COUNTS))), "term")
    counts = sums.orderBy(F.desc("total"), "term").limit(max_features)
    documents = docs.agg(F.count("*").alias("n")).scalar()
    return counts.withColumn("idf", _idf(documents, F.col("doc_freq")))


@dataclass
class LexicalFeatures:
    """Stored TF-IDF vectors with unit length and the vocabulary behind them.

    ``vectors`` has (row_no, features) for Spark ML; ``sparse`` shows the same
    file as (row_no, indices, values). Both carry topic_id once it is known.
    ``terms`` is the vocabulary in index order.
    """

    vectors: DataFrame
    sparse: DataFrame
    terms: list[str]
    method: str

    def with_topics(self, assigned: DataFrame) -> LexicalFeatures:
        """The same vectors stored beside their topic: one join for all later passes."""
        placed = assigned.select("row_no", "topic_id").join(self.vectors.select("row_no", "features"), "row_no")
        return _stored(placed, self.terms, self.method)

    def entries(self) -> DataFrame:
        """One row per stored weight: (row_no, term, weight)."""
        spark = self.sparse.sparkSession
        names = spark.createDataFrame(list(enumerate(self.terms)), "index int, term string")
        cells = self.sparse.select("row_no", F.inline(F.arrays_zip("indices", "values"))).toDF("row_no", "index", "weight")
        # at most max_features names
        return cells.join(F.broadcast(names), "index").select("row_no", "term", "weight")


def _stored(vectors: DataFrame, terms: list[str], method: str) -> LexicalFeatures:
    path = store(vectors, "tfidf")
    reader = vectors.sparkSession.read
    known = T.StructType([T.StructField(f.name, VectorUDT()) if f.name == "features" else f for f in vectors.schema])
    plain = ", ".join(f"{n} {k}" for n, k in vectors.dtypes if n != "features")
    sparse = reader.schema(f"{plain}, features {_STORED_VECTOR}").parquet(path).select(
        *[n for n in vectors.columns if n != "features"],
        F.col("features.indices").alias("indices"), F.col("features.values").alias("values"),
    )
    return LexicalFeatures(reader.schema(known).parquet(path), sparse, terms, method)


def _vectorise(docs: DataFrame, carried: list[str], tokens: Column, vocab: list, method: str) -> LexicalFeatures:
    terms = [r.term for r in vocab]
    count = CountVectorizerModel.from_vocabulary(terms, inputCol="_terms", outputCol="_counts")
    weigh = ElementwiseProduct(scalingVec=Vectors.dense([r.idf for r in vocab]), inputCol="_counts", outputCol="_weighted")
    unit = Normalizer(p=2.0, inputCol="_weighted", outputCol="features")

    counted = count.transform(docs.select(*carried, tokens.alias("_terms"))).drop("_terms")
    return _stored(unit.transform(weigh.transform(counted)).select(*carried, "features"), terms, method)


def _vectorise_words(listed: DataFrame, carried: list[str], vocab: list) -> LexicalFeatures:
    """``_vectorise`` of the words and neighbouring pairs of word lists: words are looked up once a
    batch, pairs as numbers, and no pair is ever put together."""
    terms = [r.term for r in vocab]
    split = [t.split(" ") for t in terms]
    known = sorted({w for words in split for w in words})
    number, size = {w: i for i, w in enumerate(known)}, len(known)
    single = np.full(size, -1)
    for index, words in enumerate(split):
        if len(words) == 1:
            single[number[words[0]]] = index
    pairs = sorted((number[w[0]] * size + number[w[1]], index) for index, w in enumerate(split) if len(w) == 2)
    codes, pair_index = np.array(pairs, np.int64).reshape(-1, 2).T.copy()
    sent = listed.sparkSession.sparkContext.broadcast((known, single, codes, pair_index, np.array([r.idf for r in vocab])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, single, codes, pair_index, idf = sent.value
        values, size = pa.array(known, pa.string()), len(known)
        for rows, row, words in _word_batches(batches):
            coded = words.dictionary_encode()
            numbers = pc.fill_null(pc.index_in(coded.dictionary, values), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            number = numbers[coded.indices.to_numpy()]
            index = np.where(number >= 0, single[number], -1)
            pair = np.flatnonzero((row[1:] == row[:-1]) & (number[1:] >= 0) & (number[:-1] >= 0))
            code = number[pair] * size + number[pair + 1]
            at = np.searchsorted(codes, code)
            hit = np.flatnonzero(at < len(codes))
            hit = hit[codes[at[hit]] == code[hit]]
            where = np.concatenate([row[index >= 0], row[pair[hit]]])
            key, times = np.unique(where * len(idf) + np.concatenate([index[index >= 0], pair_index[at[hit]]]), return_counts=True)
            where, index = key // len(idf), key % len(idf)
            weight = times * idf[index]
            weight = weight / np.sqrt(np.bincount(where, weight**2, rows.num_rows))[where]
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(where, minlength=rows.num_rows))]), pa.int32())
            vectors = pa.StructArray.from_arrays(
                [pa.array(np.zeros(rows.num_rows, np.int8)), pa.array(np.full(rows.num_rows, len(idf), np.int32)),
                 pa.ListArray.from_arrays(ends, pa.array(index, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(weight))],
                names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], vectors], names=[*carried, "features"])

    source = listed.select(*carried, "words")
    plain = ", ".join(f"{n} {k}" for n, k in source.dtypes[:-1])
    return _stored(source.mapInArrow(run, f"{plain}, features {_STORED_VECTOR}"), terms, "words")


def lexical_features(
    docs: DataFrame, stop_words: Sequence[str] | None = None, max_words: int = fixed.WORD_FEATURES,
    max_characters: int = fixed.CHARACTER_FEATURES, text: str = "topic_text",
) -> LexicalFeatures:
    """TF-IDF over words and word pairs, or over characters if no word remains.

    Only the vocabulary, at most ``max_words`` rows, reaches the driver. Each
    text then becomes a vector inside its own row, so the table of weights is
    never shuffled, and it is stored once for every later pass. A topic_id
    column of ``docs`` is stored along.
    """
    carried = ["row_no", *[c for c in docs.columns if c in ("topic_id", late.PLACE)]]
    stops = english_stop_words() if stop_words is None else stop_words
    listed = materialise(tx.with_words(docs.select(*carried, text), text, "words", stops), "words")
    vocab = word_vocabulary(listed, max_words).orderBy("term").collect()
    if vocab:
        return _vectorise_words(listed, carried, vocab)
    return character_features(docs, max_characters, text)


def character_features(docs: DataFrame, max_characters: int = fixed.CHARACTER_FEATURES, text: str = "topic_text") -> LexicalFeatures:
    """TF-IDF over runs of one to three characters."""
    carried = ["row_no", *[c for c in docs.columns if c in ("topic_id", late.PLACE)]]
    letters = tx.character_runs(F.col(text))
    vocab = character_vocabulary(docs.select(tx.flat_text(F.col(text)).alias("text")), max_characters).orderBy("term").collect()
    return _vectorise(docs, carried, letters, vocab, "characters")


def topic_sums(features: LexicalFeatures) -> DataFrame:
    """(topic_id, index, weight), written: summed before the shuffle, at most topics x vocabulary rows remain."""
    cells = features.sparse.select("topic_id", F.inline(F.arrays_zip("indices", "values"))).toDF("topic_id", "index", "weight")
    return materialise(cells.groupBy("topic_id", "index").agg(F.sum("weight").alias("weight")), "topic-sums")


def topic_keywords(features: LexicalFeatures, size: int = fixed.KEYWORDS_PER_TOPIC, sums: DataFrame | None = None) -> DataFrame:
    """(topic_id, keywords, label): terms of highest mean weight."""
    sums = topic_sums(features) if sums is None else sums
    names = sums.sparkSession.createDataFrame(list(enumerate(features.terms)), "index int, term string")
    named = sums.where("weight > 0").join(F.broadcast(names), "index")  # at most max_features names
    return _top_terms(named, features.sparse.select("topic_id").distinct(), size)


def _top_terms(sums: DataFrame, topics: DataFrame, size: int) -> DataFrame:
    best = Window.partitionBy("topic_id").orderBy(F.desc(F.round("weight", 9)), "term")
    top = sums.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= size)
    keywords = top.groupBy("topic_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_rank", "term"))), lambda x: x["term"]).alias("keywords")
    )
    described = topics.join(keywords, "topic_id", "left")
    words = F.coalesce("keywords", F.array().cast("array<string>"))
    label = F.array_join(F.transform(F.slice(words, 1, fixed.LABEL_WORDS), tx.title_case), " / ")
    return described.select(
        "topic_id", words.alias("keywords"),
        F.when(F.col("topic_id") == fixed.OUTLIER_TOPIC, fixed.OUTLIER_LABEL).otherwise(label).alias("label"),
    )


def _dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def _nearest(scored: DataFrame, size: int) -> DataFrame:
    nearest = Window.partitionBy("topic_id").orderBy(F.desc(F.round("similarity", 9)), "row_no")
    top = scored.withColumn("_rank", F.row_number().over(nearest)).where(F.col("_rank") <= size)
    return top.select("topic_id", "row_no", F.col("_rank").alias("position"), "similarity")


def _topic_means(sums: DataFrame, counts: DataFrame, dimensions: int) -> DataFrame:
    """(topic_id, mean, length, n), written, from (topic_id, index, weight) and (topic_id, n).

    Sums over (topic, index) have met before this; one array a topic is put together at the end.
    """
    def dense(group: pa.Table) -> pa.Table:
        mean = np.zeros(dimensions)
        mean[group.column("index").to_numpy()] = group.column("weight").to_numpy() / group.column("n")[0].as_py()
        return pa.table({
            "topic_id": group.column("topic_id")[:1], "mean": pa.array([mean], pa.list_(pa.float64())),
            "length": pa.array([float(np.sqrt(mean @ mean))]), "n": group.column("n")[:1]})

    kind = dict(sums.dtypes)["topic_id"]
    rows = counts.join(sums, "topic_id", "left").select(
        "topic_id", F.coalesce("index", F.lit(0)).alias("index"), F.coalesce("weight", F.lit(0.0)).alias("weight"), "n")
    return materialise(rows.groupBy("topic_id").applyInArrow(
        dense, f"topic_id {kind}, mean array<double>, length double, n long"), "means")


def _join_means(rows: DataFrame, means: DataFrame, dimensions: int) -> DataFrame:
    """Each row beside its topic's mean, broadcasting at most _MEANS_BYTES of them."""
    return join_by_frequency(rows, means, ["topic_id"], "n", max(1, _MEANS_BYTES // (8 * max(1, dimensions))))


def lexical_representatives(
    features: LexicalFeatures, size: int = fixed.REPRESENTATIVES_PER_TOPIC, sums: DataFrame | None = None
) -> DataFrame:
    """(topic_id, row_no, position, similarity): rows nearest their topic mean.

    The mean is one dense array per topic, so each row is compared inside the
    row and only the best few of each task reach the shuffle.
    """
    sums = topic_sums(features) if sums is None else sums
    counts = features.sparse.groupBy("topic_id").agg(F.count("*").alias("n"))
    means = _topic_means(sums, counts, len(features.terms))
    dot = F.aggregate(
        F.arrays_zip("indices", "values"), F.lit(0.0),
        lambda s, x: s + x["values"] * F.get("mean", x["indices"]),
    )
    scored = _join_means(features.sparse, means, len(features.terms)).select(
        "topic_id", "row_no", F.when(F.col("length") > 0, dot / F.col("length")).otherwise(0.0).alias("similarity")
    )
    return _nearest(scored, size)


def embedding_representatives(
    assigned: DataFrame, embedding: str = "embedding", size: int = fixed.REPRESENTATIVES_PER_TOPIC
) -> DataFrame:
    """The same over an embedding column of ``assigned``."""
    rows = assigned.select("row_no", "topic_id", F.col(embedding).cast("array<double>").alias("v"))
    sums = rows.select("topic_id", F.posexplode("v").alias("index", "weight")).groupBy("topic_id", "index").agg(F.sum("weight").alias("weight"))
    counts = rows.groupBy("topic_id").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"))
    counts = materialise(counts, "topic-counts")
    dimensions = counts.agg(F.max("d").alias("d")).first().d or 1
    means = _topic_means(sums, counts.select("topic_id", "n"), dimensions)
    scale = F.sqrt(_dot(F.col("v"), F.col("v"))) * F.col("length")
    scored = _join_means(rows, means, dimensions).select(
        "topic_id", "row_no", F.when(scale > 0, _dot(F.col("v"), F.col("mean")) / scale).otherwise(0.0).alias("similarity")
    )
    return _nearest(scored, size)


def _ordered_pairs(listed: DataFrame) -> DataFrame:
    """(place, term, tf) of the words and neighbouring pairs of all texts of ``listed`` (place, words), in the order of
    terms for many texts at a time, so that they take little space in a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, row, words in _word_batches(batches):
            coded = words.dictionary_encode()
            order = pc.sort_indices(coded.dictionary).to_numpy()
            names, rank = coded.dictionary.take(pa.array(order)), np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            number, size, texts = rank[coded.indices.to_numpy()], len(order) + 1, max(1, rows.num_rows)
            beside = np.flatnonzero(row[1:] == row[:-1])
            # a word alone comes before its pairs, as the space comes before every letter
            code = np.concatenate([number * size, number[beside] * size + number[beside + 1] + 1])
            known, code = np.unique(code, return_inverse=True)
            key, times = np.unique(code * texts + np.concatenate([row, row[beside]]), return_counts=True)
            second = known % size
            joined = pc.binary_join_element_wise(names.take(pa.array(known // size)), names.take(pa.array(np.maximum(second - 1, 0))), " ")
            terms = pc.if_else(pa.array(second > 0), joined, names.take(pa.array(known // size)))
            for at in range(0, len(key), _PAIRS_OUT):
                code, where = key[at : at + _PAIRS_OUT] // texts, pa.array(key[at : at + _PAIRS_OUT] % texts)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(where), terms.take(pa.array(code)), pa.array(times[at : at + _PAIRS_OUT], pa.int32())],
                    names=[late.PLACE, "term", "tf"])

    return listed.select(late.PLACE, "words").mapInArrow(run, f"{late.PLACE} long, term string, tf int")


def _numbered_terms(ordered: DataFrame) -> DataFrame:
    """``ordered`` rows with _part and the number of their ``term`` in their partition, whose rows come in the order of terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last = -1, None
        for batch in batches:
            if not batch.num_rows:
                continue
            terms = batch.column("term").dictionary_encode()
            code = terms.indices.to_numpy()
            new = np.concatenate([[terms.dictionary[int(code[0])].as_py() != last], code[1:] != code[:-1]])
            numbers = number + np.cumsum(new)
            number, last = int(numbers[-1]), terms.dictionary[int(code[-1])].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=[*batch.schema.names, "_number"])

    staged = ordered.withColumn("_part", F.spark_partition_id())
    return staged.mapInArrow(run, T.StructType([*staged.schema.fields, T.StructField("_number", T.LongType())]))


def uncut_weights(docs: DataFrame, stop_words: Sequence[str] | None = None, text: str = "topic_text") -> tuple[DataFrame, DataFrame]:
    """TF-IDF over the whole vocabulary: (row_no, term, weight, index) and the dictionary (term, doc_freq, index).

    Nothing of the vocabulary reaches the driver. All (text, term) pairs are shuffled once, by ranges of terms; a
    range is sorted, so document frequencies and the terms' numbers come from neighbouring rows, and one row
    a range carries the offsets. A term stands in one task, once a text. Lengths are sums of partial sums and come back by place.
    """
    stops = english_stop_words() if stop_words is None else stop_words
    listed = late.stored(tx.with_words(docs.select("row_no", text), text, "words", stops), "words")
    documents = listed.count()
    ordered = _ordered_pairs(listed).repartitionByRange("term").sortWithinPartitions("term")
    counted = ordered.withColumn("doc_freq", F.count("*").over(Window.partitionBy("term")))
    pairs = materialise(_numbered_terms(counted), "pairs")
    sizes = pairs.groupBy("_part").agg((F.max("_number") + 1).alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset")), "offsets")
    pairs = pairs.join(F.broadcast(offsets), "_part").withColumn("index", F.col("_offset") + F.col("_number"))  # one row a partition
    weight = F.col("tf") * _idf(F.lit(documents), F.col("doc_freq"))
    lengths = pairs.groupBy(late.PLACE).agg(F.sqrt(F.sum(weight * weight)).alias("length"))
    texts = lengths.join(listed, late.PLACE).select(late.PLACE, F.struct("row_no", "length").alias("_text"))
    units = late.with_value(pairs, materialise(texts, "lengths"), "_text").select(
        "_text.row_no", "term", (weight / F.col("_text.length")).alias("weight"), "index")
    return units, pairs.groupBy("term", "index").agg(F.first("doc_freq").alias("doc_freq")).select("term", "doc_freq", "index")


def _pairs_of(known: Callable[[], pa.Array], batches: Iterator[pa.RecordBatch], rare: bool) -> Iterator[tuple]:
    """Some rows at a time, their different (row, word) with counts, words as numbers among the ``known``; or the
    others (``rare``), as numbers of the array of words that ends the tuple."""
    values = known()
    for rows, row, words in _word_batches(batches):
        coded = words.dictionary_encode()
        numbers = pc.fill_null(pc.index_in(coded.dictionary, values), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        code = coded.indices.to_numpy().astype(np.int64)
        number = np.where(numbers[code] < 0, code, -1) if rare else numbers[code]
        size = max(1, len(coded.dictionary if rare else values))
        key, times = np.unique(row[number >= 0] * size + number[number >= 0], return_counts=True)
        yield rows, key // size, key % size, times, coded.dictionary if rare else values


def _topic_squares(listed: DataFrame, counts: DataFrame, documents: int, most: int) -> DataFrame:
    """(topic_id, squares): the squared length of each topic's sum of unit rows.

    ``listed`` is a stored table of (place, topic_id, words), ``counts`` a written one of (term, total, doc_freq).
    The ``most`` frequent words are numbers that meet their weight, and sum up, inside the batch; the
    others, few in any text, are pairs joined by word and by place.
    """
    found = counts.orderBy(F.desc("doc_freq"), "term").select("term", "doc_freq").limit(most + 1).collect()
    frequent, more = found[:most], len(found) > most
    weights = np.log((documents + 1) / (np.array([r.doc_freq for r in frequent], float) + 1)) + 1
    sent = listed.sparkSession.sparkContext.broadcast(([r.term for r in frequent], weights))
    kind = dict(listed.dtypes)["topic_id"]

    def known() -> pa.Array:
        return pa.array(sent.value[0], pa.string())

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, where, number, times, _ in _pairs_of(known, batches, False):
            own = np.bincount(where, (times * sent.value[1][number]) ** 2, rows.num_rows)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(own, pa.float64())], names=[late.PLACE, "own"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, where, number, times, words in _pairs_of(known, batches, True):
            at = pa.array(where)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(at), rows.column(1).take(at), words.take(pa.array(number)), pa.array(times, pa.int64())],
                names=[late.PLACE, "topic_id", "term", "tf"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, where, number, times, values in _pairs_of(known, batches, False):
            weight, size = times * sent.value[1][number], max(1, len(values))
            length = np.bincount(where, weight**2, rows.num_rows) + pc.fill_null(rows.column(2), 0.0).to_numpy(zero_copy_only=False)
            topic = rows.column(1).dictionary_encode(null_encoding="encode")
            key, back = np.unique(topic.indices.to_numpy().astype(np.int64)[where] * size + number, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [topic.dictionary.take(pa.array(key // size)), pa.array(key % size, pa.int64()),
                 pa.array(np.bincount(back, weight / np.sqrt(length)[where], len(key)), pa.float64())], names=["topic_id", "number", "unit"])

    rows, rare = listed.withColumn("_rare", F.lit(0.0)), None
    if more:
        pairs = listed.select(late.PLACE, "topic_id", "words").mapInArrow(others, f"{late.PLACE} long, topic_id {kind}, term string, tf long")
        weight = F.col("tf") * _idf(F.lit(documents), F.col("doc_freq"))
        pairs = materialise(pairs.join(counts.select("term", "doc_freq"), "term").withColumn("weight", weight), "rare")
        beside = materialise(pairs.groupBy(late.PLACE).agg(F.sum(F.col("weight") * F.col("weight")).alias("_rare")), "rare-squares")
        rows = late.with_value(listed, beside, "_rare")
        own = listed.select(late.PLACE, "words").mapInArrow(squares, f"{late.PLACE} long, own double")
        rare = pairs.join(own.join(beside, late.PLACE), late.PLACE).groupBy("topic_id", "term").agg(
            F.sum(F.col("weight") / F.sqrt(F.col("own") + F.col("_rare"))).alias("unit")).select("topic_id", "unit")
    found = rows.select(late.PLACE, "topic_id", "_rare", "words").mapInArrow(sums, f"topic_id {kind}, number long, unit double")
    whole = found.groupBy("topic_id", "number").agg(F.sum("unit").alias("unit")).select("topic_id", "unit")
    whole = whole if rare is None else whole.unionByName(rare)
    return whole.groupBy("topic_id").agg(F.sum(F.col("unit") * F.col("unit")).alias("squares"))


def lexical_cohesion(reviews: DataFrame, text: str = "review_text", most: int = _CANDIDATES) -> DataFrame:
    """Mean cosine of each row's TF-IDF to its topic mean, over all words.

    Rows have unit length, so the mean cosine to the topic mean equals the length of that mean:
    no row is compared with anything.
    """
    listed = late.stored(tx.with_words(reviews.select("topic_id", text), text, "words", shortest=1), "words").select(
        late.PLACE, "topic_id", "words")
    counts = materialise(word_counts(listed.select("words")), "word-counts")
    documents = listed.count()
    lengths = _topic_squares(listed, counts, documents, most).select("topic_id", F.sqrt("squares").alias("length"))
    groups = reviews.groupBy("topic_id", "topic").agg(F.count("*").alias("n"), F.min("row_no").alias("first")).groupBy(
        "topic_id"
    ).agg(F.min_by("topic", "first").alias("topic"), F.sum("n").alias("review_count"))
    return groups.join(lengths, "topic_id", "left").select(
        "topic_id", "topic", "review_count", (F.col("review_count") / documents).alias("share"),
        (F.coalesce("length", F.lit(0.0)) / F.col("review_count")).alias("lexical_cohesion"),
        (F.col("review_count") == 1).alias("singleton"),
    )


def example_texts(reviews: DataFrame, size: int = fixed.EXAMPLES_PER_TOPIC) -> DataFrame:
    """(topic_id, examples): the first texts of each topic in source order."""
    first = Window.partitionBy("topic_id").orderBy("row_no")
    top = reviews.select("topic_id", "row_no", "review_text").withColumn("_rank", F.row_number().over(first)).where(
        F.col("_rank") <= size
    )
    ordered = F.sort_array(F.collect_list(F.struct("_rank", "review_text")))
    return top.groupBy("topic_id").agg(F.transform(ordered, lambda x: x["review_text"]).alias("examples"))


def cohesion_summary(cohesion: DataFrame) -> DataFrame:
    n, c = F.col("review_count"), F.col("lexical_cohesion")
    return cohesion.agg((F.sum(c * n) / F.sum(n)).alias("weighted_mean"), F.avg(c).alias("unweighted_mean"))
