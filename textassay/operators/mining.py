"""Fingerprints of sources: counts, log-odds, vocabulary, catalog and vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textassay.functions import features as X
from textassay.functions.bags import Index, counted_rows, family_counts
from textassay.sources.scratch import bounded_batches, materialise

UNMATCHED = "unmatched"
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
ALPHA = 1000.0
LEAST_COUNT = 5
#: Cells (features times families) of a catalog that is sent to every task: 8 bytes each.  Larger ones are refused.
MOST_CELLS = 20_000_000


@dataclass(frozen=True)
class Catalog:
    """``features(feature, idf, base)``, ``weights(feature, family, rate, w)``, ``families(family, samples, bias)``."""

    features: DataFrame
    weights: DataFrame
    families: DataFrame

    def persist(self) -> Catalog:
        return Catalog(*(df.persist() for df in vars(self).values()))

    def stored(self) -> Catalog:
        """The catalog written to the shared folder: what follows reads three small tables."""
        return Catalog(*(materialise(df, f"catalog-{name}") for name, df in vars(self).items()))


def feature_bag(text: Column, words: Column) -> Column:
    """All features of a text: words, pairs, marks and layout, each as often as it stands there."""
    return F.concat(X.word_features(words), X.pair_features(words), X.mark_features(text), X.layout_features(text))


def with_features(df: DataFrame, text_col: str = "text", out_col: str = "features") -> DataFrame:
    """``df`` with the bag; the words have a column of their own below it, so that they are split once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumn("__words", X.words(text)).withColumn(out_col, feature_bag(text, F.col("__words"))).drop("__words")


#: Buckets of features, and the least of them for each partition of a shuffle: one must fit a worker, so they go with the partitions.
BUCKETS, BUCKETS_EACH = 1024, 8
#: A bucket's part of a batch: its number and its counts, packed.  A length of -1 is null.
PACKED = {"names": np.uint8, "name_lengths": np.int16, "families": np.uint8, "family_lengths": np.int32, "y": np.int64, "df": np.int64}
PACKED_SCHEMA = ", ".join(["bucket int", *(f"{name} binary" for name in PACKED)])
#: The bucket of what a family has in all; its rows have no feature.
TOTALS = -1


def cells_of(keys: np.ndarray, most: int, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys below ``most`` in order, and the sum of each of the (whole) ``weights`` over them."""
    if most <= 8 * len(keys):
        cells = np.flatnonzero(np.bincount(keys, minlength=1))
        return cells, *(np.bincount(keys, w)[cells].astype(np.int64) for w in weights)
    cells, place = np.unique(keys, return_inverse=True)
    return cells, *(np.bincount(place, w, len(cells)).astype(np.int64) for w in weights)


def packed(buckets: np.ndarray, families: pa.Array, features: pa.Array, y: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
    """Counts in the order of their buckets, a row for each bucket.  What one bucket has stands together, so that nothing is copied."""
    first = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
    ends = np.r_[first, len(buckets)]
    columns = [pa.array(buckets[first], pa.int32())]

    def pack(data: pa.Buffer | None, places: np.ndarray) -> None:
        columns.append(pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(places.astype(np.int32)), data]))

    def pack_numbers(values: np.ndarray) -> None:
        pack(pa.py_buffer(values), ends * values.itemsize)

    for strings, kind in ((features, PACKED["name_lengths"]), (families, PACKED["family_lengths"])):
        offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
        pack(strings.buffers()[2], offsets[ends])
        pack_numbers(np.where(np.asarray(strings.is_null()), -1, np.diff(offsets)).astype(kind))
    pack_numbers(y)
    pack_numbers(df)
    return pa.RecordBatch.from_arrays(columns, names=["bucket", *PACKED])


def unpacked(rows: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """The families, features and numbers that ``packed`` was given, of all rows."""

    def values(name: str) -> np.ndarray:
        parts = []
        for batch in rows:
            _, offsets, data = (column := batch.column(name)).buffers()
            ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
            parts.append(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8))
        return np.concatenate(parts).view(PACKED[name])

    def strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
        offsets = pa.py_buffer(np.r_[0, np.cumsum(np.maximum(lengths, 0), dtype=np.int64)])
        known = lengths >= 0
        valid = None if known.all() else pa.py_buffer(np.packbits(known, bitorder="little"))
        return pa.LargeStringArray.from_buffers(len(lengths), offsets, pa.py_buffer(data), valid)

    return strings(values("families"), values("family_lengths")), strings(values("names"), values("name_lengths")), values("y"), values("df")


def count_partition(batches: Iterator[pa.RecordBatch], buckets: int, totals: bool) -> Iterator[pa.RecordBatch]:
    """Features of (family, text) rows counted within a batch, packed by bucket; with ``totals``, what a family's texts have in all and how many they are."""
    for batch in batches:
        families = batch.column("family").dictionary_encode()
        names = pa.concat_arrays([families.dictionary.cast(pa.string()), pa.nulls(1, pa.string())])
        family = np.asarray(families.indices.fill_null(len(families.dictionary))).astype(np.int64)
        total, texts = np.zeros(len(names), np.int64), np.bincount(family, minlength=len(names))
        for bucket, own, features, y, df in family_counts(batch.column("text"), family, buckets):
            total += np.bincount(own, y, len(names)).astype(np.int64)
            if len(own):
                yield packed(bucket, names.take(pa.array(own)), features, y, df)
        some = np.flatnonzero(texts)
        if totals and len(some):
            yield packed(np.full(len(some), TOTALS), names.take(pa.array(some)), pa.nulls(len(some), pa.string()), total[some], texts[some])


#: Rows that are put together before neighbours are compared.
MERGED_ROWS = 100_000


def merge_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that stand together by feature and family, summed, with the feature's own sums; features that no family uses often enough are left out.

    A feature may go on in the next rows, so the last one waits, summed.
    """

    def summed(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
        """A row for each feature and family, and the number of its feature."""
        features = rows["feature"].combine_chunks()
        named, families = features.fill_null(""), np.asarray(rows["family"].combine_chunks().dictionary_encode("encode").indices)
        other = np.r_[True, np.asarray(pc.not_equal(named[1:], named[:-1]))]
        first = np.flatnonzero(other | np.r_[True, families[1:] != families[:-1]])
        sums = {name: pa.array(np.add.reduceat(np.asarray(rows[name]), first)) for name in ("y", "df")}
        at = pa.array(first)
        return pa.table({"family": rows["family"].combine_chunks().take(at), "feature": features.take(at)} | sums), np.cumsum(other)[first] - 1

    def shown(rows: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        y, df = np.asarray(rows["y"]), np.asarray(rows["df"])
        kept = (np.maximum.reduceat(y, first) >= LEAST_COUNT)[group] | np.asarray(rows["feature"].combine_chunks().is_null())
        whole = [pa.array(np.add.reduceat(x, first)[group]) for x in (y, df)]
        arrays = [*(c.combine_chunks() for c in rows.columns), *whole]
        return pa.RecordBatch.from_arrays(arrays, names=[*rows.column_names, "y_w", "df_w"]).filter(pa.array(kept))

    def gathered() -> Iterator[pa.Table]:
        some, n = [], 0
        for batch in batches:
            some.append(batch)
            n += batch.num_rows
            if n >= MERGED_ROWS:
                yield pa.Table.from_batches(some)
                some, n = [], 0
        if n:
            yield pa.Table.from_batches(some)

    waiting = None
    for rows in gathered():
        rows, group = summed(rows if waiting is None else pa.concat_tables([waiting, rows.select(waiting.column_names)]))
        cut = int(np.searchsorted(group, group[-1]))
        waiting = rows.slice(cut)
        if cut:
            yield shown(rows.slice(0, cut), group[:cut])
    if waiting is not None:
        yield shown(waiting, np.zeros(len(waiting), np.int64))


#: Bytes of packed counts that are put together before they are merged.
MERGED_BYTES = 16 << 20


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Rows in the order of buckets, some buckets at a time, none of them cut."""
    waiting: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in (b for b in batches if b.num_rows):
        buckets = np.asarray(batch.column("bucket"))
        cut = int(np.searchsorted(buckets, buckets[-1]))
        # A bucket begins at the cut, unless it is that of all rows and of the last that waits.
        if size + batch.nbytes >= MERGED_BYTES and (cut or last not in (None, buckets[0])):
            yield [*waiting, batch.slice(0, cut)]
            waiting, size, batch = [], 0, batch.slice(cut)
        waiting.append(batch)
        size, last = size + batch.nbytes, buckets[-1]
    if waiting:
        yield waiting


#: Rows of a batch that goes back to Spark.
SHOWN_ROWS = 200_000


def sum_buckets(batches: Iterator[pa.RecordBatch], pooled: bool = False, apart: bool = True) -> Iterator[pa.RecordBatch]:
    """Packed rows in the order of buckets: each feature's counts by family, all of them together.

    With ``pooled``, sums over the families under a null family; without ``apart``, these alone.
    """
    for rows in whole_buckets(batches):
        family, feature, y, df = unpacked(rows)
        families, features = family.dictionary_encode("encode"), feature.dictionary_encode("encode")
        n = max(len(families.dictionary), 1)
        keys = np.asarray(features.indices).astype(np.int64) * n + np.asarray(families.indices)
        cells, y, df = cells_of(keys, len(features.dictionary) * n, y, df)
        names, kinds = features.dictionary.cast(pa.string()), families.dictionary.cast(pa.string())
        found = [(kinds.take(pa.array(cells % n)), names.take(pa.array(cells // n)), y, df)] if apart else []
        if pooled:
            codes = cells // n
            whole = [np.bincount(codes, x, len(names)).astype(np.int64) for x in (y, df)]
            found.append((pa.nulls(len(names), pa.string()), names, *whole))
        for arrays in found:
            made = pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in arrays], names=["family", "feature", "y", "df"])
            yield from (made.slice(k, SHOWN_ROWS) for k in range(0, len(made), SHOWN_ROWS))


def sum_often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return merge_partition(sum_buckets(batches))


def counted(df: DataFrame, family_col: str, text_col: str, merge: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, totals: bool = False) -> DataFrame:
    """All features counted by family and merged, in one shuffle by buckets of features.

    Arrow batches of texts are counted by passes over their bytes, without a Python
    object for any word.  What a batch counted travels as one row for each bucket, so
    that nothing is done for a feature outside these passes: a corpus has about as many
    pairs of words as words, and most of them once.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    buckets = max(BUCKETS, BUCKETS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = df.select(F.col(family_col).cast("string").alias("family"), F.col(text_col).cast("string").alias("text"))
    rows = texts.mapInArrow(partial(count_partition, buckets=buckets, totals=totals), PACKED_SCHEMA)
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, schema)


def used_often(df: DataFrame, family_col: str = "family", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``family, feature, y, df, y_w, df_w`` of all features that some family has ``LEAST_COUNT`` times or more, and ``family, total, samples``.

    Nothing else can be nominated. Every feature is counted, in one shuffle by
    feature: what its families have stands together then, so its sums need no
    second one, and the many rare features are not stored.
    """
    merged = counted(df, family_col, text_col, sum_often, "family string, feature string, y long, df long, y_w long, df_w long", totals=True)
    stored = materialise(merged, "counts")
    totals = stored.filter("feature IS NULL").select("family", F.col("y").alias("total"), F.col("df").alias("samples"))
    return stored.filter("feature IS NOT NULL"), materialise(totals, "totals")


COUNTED = "family string, feature string, y long, df long"


def feature_counts(df: DataFrame, family_col: str = "family", text_col: str = "text") -> DataFrame:
    """``family, feature, y`` (occurrences) and ``df`` (texts that have it), in one shuffle."""
    return counted(df, family_col, text_col, sum_buckets, COUNTED)


def pooled_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``feature, y_w, df`` over all families, which need not be told apart."""
    merge = partial(sum_buckets, pooled=True, apart=False)
    return counted(df.withColumn("__family", F.lit("")), "__family", text_col, merge, COUNTED).select("feature", F.col("y").alias("y_w"), "df")


def grouped_counts(df: DataFrame, family_col: str = "family", text_col: str = "text") -> DataFrame:
    """``family, feature, y`` at all levels: by both, by feature, by family and of the whole, with nulls for what a level doesn't tell apart."""
    # Totals have no feature, so that their sum over families is the whole.  A family whose texts have no feature isn't counted.
    return counted(df, family_col, text_col, partial(sum_buckets, pooled=True), COUNTED, totals=True).filter("y > 0").drop("df")


def text_counts(df: DataFrame, kinds: str = "wbps", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, feature, n``: how often each feature stands in the texts of an id.

    A text is counted in its own row and nothing but ids is shuffled, unless ids are
    repeated: only the counts of these are summed over rows.  Rows without an id are one.
    """
    bounded_batches(df.sparkSession)
    texts = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    count = lambda rows: rows.mapInArrow(partial(counted_rows, kinds=kinds), f"doc_id {dict(texts.dtypes)['doc_id']}, feature string, n long")
    repeated = materialise(texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(F.col("doc_id").alias("__id")), "repeated")
    if repeated.isEmpty():
        return count(texts)
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    summed = count(texts.join(repeated, same, "left_semi")).groupBy("doc_id", "feature").agg(F.sum("n").alias("n"))
    return count(texts.join(repeated, same, "left_anti")).unionByName(summed)


def family_totals(counts: DataFrame, df: DataFrame, family_col: str = "family") -> DataFrame:
    """``family, total`` (occurrences of all features) and ``samples``."""
    samples = df.groupBy(F.col(family_col).alias("family")).agg(F.count(F.lit(1)).alias("samples"))
    totals = counts.groupBy("family").agg(F.sum("y").alias("total"))
    return samples.join(totals, "family", "left").select("family", F.coalesce("total", F.lit(0)).alias("total"), "samples")


def log_odds(y: Column, y_w: Column, total: Column, n: Column) -> Column:
    """z of a family's use of a feature against the pooled corpus as prior; all double."""
    prior = F.lit(ALPHA) * (y_w / n)
    own, pool = y + prior, y_w + prior
    delta = F.log(own / (total + ALPHA - own)) - F.log(pool / (n + ALPHA - pool))
    return delta / F.sqrt(F.lit(1.0) / own + F.lit(1.0) / pool)


def scored_features(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """``family, feature, y, z`` of the features that a family uses often enough; ``counts`` has ``y_w``."""
    n = totals.agg(F.sum("total").cast("double").alias("n"))
    rows = counts.filter(F.col("y") >= LEAST_COUNT).join(F.broadcast(totals.select("family", "total")), "family").crossJoin(F.broadcast(n))
    d = lambda c: F.col(c).cast("double")
    return rows.select("family", "feature", "y", log_odds(d("y"), d("y_w"), d("total"), F.col("n")).alias("z"))


def nominated(scored: DataFrame, top_k: int) -> DataFrame:
    """Each family's ``top_k`` features by |z| (rounded, ties by name)."""
    conf = scored.sparkSession.conf
    # Each task keeps its own first top_k before families are put together: above this threshold Spark would sort a family's rows in one task.
    if 0 <= int(conf.get(GROUP_LIMIT)) < top_k:
        conf.set(GROUP_LIMIT, str(top_k))
    order = Window.partitionBy("family").orderBy(F.round(F.abs("z"), 6).desc(), "feature")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def mine(df: DataFrame, top_k: int = 2000, family_col: str = "family", text_col: str = "text") -> Catalog:
    """A catalog without weights: what the families nominate, with rates and document frequencies."""
    counts, totals = used_often(df, family_col, text_col)
    vocabulary = materialise(nominated(scored_features(counts, totals), top_k).select("feature").distinct(), "vocabulary")
    over = totals.agg(F.sum("total").cast("double").alias("n"), F.sum("samples").cast("double").alias("docs"))
    known = counts.join(vocabulary, "feature", "left_semi")
    described = known.groupBy("feature").agg(F.first("y_w").alias("y_w"), F.first("df_w").alias("df")).crossJoin(F.broadcast(over))
    features = described.select("feature", (F.log((F.lit(1.0) + F.col("docs")) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"), (F.col("y_w") / F.col("n") * 1000.0).alias("base"))
    grid = vocabulary.crossJoin(F.broadcast(totals.select("family", "total")))
    rates = grid.join(known.select("family", "feature", "y"), ["family", "feature"], "left")
    weights = rates.select("feature", "family", F.coalesce(F.try_divide(F.col("y").cast("double"), F.col("total").cast("double")) * 1000.0, F.lit(0.0)).alias("rate"), F.lit(0.0).alias("w"))
    families = totals.select("family", "samples", F.lit(0.0).alias("bias"))
    return Catalog(features, weights, families).stored()


def with_index(catalog: Catalog) -> DataFrame:
    """``feature, idx``: places in byte order, from 0.  A catalog is bounded by top_k times families."""
    return catalog.features.select("feature", (F.row_number().over(Window.orderBy("feature")) - 1).alias("idx"))


@dataclass(frozen=True)
class Matrix:
    """A catalog in memory: features and families by name, cells by feature and family."""

    features: pa.Array
    idf: np.ndarray
    base: np.ndarray
    families: list[str]
    bias: np.ndarray
    weights: np.ndarray
    rates: np.ndarray

    @cached_property
    def index(self) -> Index:
        return Index(self.features)

    def entries(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, places and values of the texts' vectors, in this order: (1 + ln c) idf, each text of length one."""
        rows, places, counts = self.index.counts(texts)
        values = (1.0 + np.log(counts.astype(np.float64))) * self.idf[places]
        norms = np.sqrt(np.bincount(rows, values * values, len(texts)))[rows]
        return rows, places, np.where(norms > 0, values / np.where(norms > 0, norms, 1), values)


def in_memory(catalog: Catalog) -> Matrix:
    """The catalog on the driver; refused where it has more than ``MOST_CELLS`` cells."""
    families = catalog.families.orderBy("family").collect()
    n = catalog.features.count()
    if n * max(len(families), 1) > MOST_CELLS:
        raise ValueError(f"a catalog of {n} features and {len(families)} families; at most {MOST_CELLS} cells are sent to tasks")
    features = catalog.features.select("feature", "idf", "base").orderBy("feature").toArrow()
    names = features.column("feature").combine_chunks()
    cells = catalog.weights.select("feature", "family", "rate", "w").toArrow()
    order = [r.family for r in families]
    at = np.asarray(pc.index_in(cells.column("feature"), value_set=names)), np.asarray(pc.index_in(cells.column("family"), value_set=pa.array(order, pa.string())))
    weights, rates = np.zeros((n, len(order))), np.zeros((n, len(order)))
    weights[at], rates[at] = np.asarray(cells.column("w")), np.asarray(cells.column("rate"))
    return Matrix(names, np.asarray(features.column("idf")), np.asarray(features.column("base")), order, np.array([r.bias for r in families]), weights, rates)


def texts_of(df: DataFrame, carry: dict[str, Column], text_col: str) -> DataFrame:
    """The columns ``carry`` and, last, the text of each row, for Arrow batches."""
    bounded_batches(df.sparkSession)
    return df.select(*[c.alias(name) for name, c in carry.items()], F.col(text_col).cast("string").alias("__text"))


def vectors(df: DataFrame, catalog: Catalog, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, feature, v``: (1 + ln c) idf of the features in the catalog, each text of length one.

    A text is a row: rows that share an id, or have none, are not put together.
    Nothing is shuffled.  A null text has the features of an empty one.
    """
    matrix = df.sparkSession.sparkContext.broadcast(in_memory(catalog))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, values = matrix.value.entries(batch.column("__text"))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), matrix.value.features.take(pa.array(places)), pa.array(values)], names=["id", "feature", "v"])

    return texts_of(df, {"id": F.col(id_col)}, text_col).mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, feature string, v double")
