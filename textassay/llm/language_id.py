"""Language by a string kernel.

Two texts are alike by the character n-grams (1 to ``SPECTRUM`` characters) that
both hold, whatever their counts: the blended-spectrum presence kernel,
normalised by the texts' own values.  Nyström landmarks turn it into features,
one-versus-rest kernel ridge regression is fitted on them, and documents are
scored many at a time by matrix products.

The fit takes a bounded sample: of every language the ``SAMPLE_ROWS`` labelled
texts with a letter that come first by a hash of id and text, the first
``LANDMARKS`` of which are landmarks.  A sampled text travels as the bits of its
n-grams, ``BUCKETS`` / 8 bytes however long it is; so no text is passed over, and
fit and scoring both take whole texts.  N-grams are hashed to ``BUCKETS`` features.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty

SPECTRUM = 3
BUCKETS = 1 << 15
SAMPLE_ROWS = 200
#: A language with fewer sampled texts than that knows too little to reject any.
JUDGING_ROWS = 50
#: Languages that a fit takes: the sample grows with them.
MOST_LANGUAGES = 1000
LANDMARKS = 48
RIDGE = 1e-2
UNKNOWN = "und"
ASCII_LETTER = re.compile("[A-Za-z]")
#: Documents in one matrix product.
BLOCK = 64


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of Unicode's categories L; numbers like ½ or Ⅷ are none."""
    return bool(text) and (ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def ngram_buckets(text: str) -> list[np.ndarray]:
    """The buckets of all n-grams of a text, one array for each length; white space is one space."""
    points = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    out, code = [], points.astype(np.uint32)
    for n in range(1, SPECTRUM + 1):
        if n > 1:
            code = code[:-1] * np.uint32(0x01000193) ^ points[n - 1 :]
        out.append(((code * np.uint32(0x9E3779B1)) >> np.uint32(17)) & np.uint32(BUCKETS - 1))
    return out


def presence(texts: list[str]) -> np.ndarray:
    """A row of zeros and ones for each text."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for row, text in zip(out, texts, strict=True):
        for buckets in ngram_buckets(text):
            row[buckets] = 1
    return out


@dataclass(frozen=True)
class Model:
    """``weights``: buckets x languages, landmarks and their coefficients multiplied out; ``seen``: which grams each language's sample has; ``floor``: the least share of a sample's own n-grams that the rest of the sample has."""

    languages: tuple[str, ...]
    weights: np.ndarray
    seen: np.ndarray
    floor: tuple[float, ...]

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text and language the response, and the share of the text's n-grams that the language's sample has."""
        grams = presence(texts)
        own = np.maximum(grams.sum(axis=1), 1)[:, None]
        return (grams @ self.weights) / np.sqrt(own), (grams @ self.seen) / own


def fit(rows: list[tuple[str, bytes]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """From (language, bits of n-grams) rows, which come in a fixed order."""
    languages = tuple(sorted({lang for lang, _ in rows}))
    if not rows:
        return Model((), *[np.zeros((BUCKETS, 0), np.float32)] * 2, ())
    by = {lang: [bits for own, bits in rows if own == lang] for lang in languages}
    unpacked = lambda some: np.unpackbits(np.frombuffer(b"".join(some), np.uint8).reshape(len(some), -1), axis=1).astype(np.float32)
    marks = unpacked([bits for lang in languages for bits in by[lang][:landmarks]])
    marks /= np.sqrt(np.maximum(marks.sum(axis=1, keepdims=True), 1))
    every = [bits for lang in languages for bits in by[lang]]
    kernel = []
    for at in range(0, len(every), BLOCK):
        grams = unpacked(every[at : at + BLOCK])
        kernel.append((grams @ marks.T) / np.sqrt(np.maximum(grams.sum(axis=1, keepdims=True), 1)))
    among = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(among)
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])  # Nyström: features whose products are the kernel's
    features = np.concatenate(kernel).astype(np.float64) @ whiten
    target = np.repeat(np.where(np.eye(len(languages), dtype=bool), 1.0, -1.0), [len(by[lang]) for lang in languages], axis=0)
    even = np.repeat([1 / len(by[lang]) for lang in languages], [len(by[lang]) for lang in languages])  # languages count alike
    weighted = features * even[:, None]
    coefficients = np.linalg.solve(weighted.T @ features + ridge * np.eye(features.shape[1]), weighted.T @ target)
    seen, floor = [], []
    for lang in languages:
        grams = unpacked(by[lang])
        counts = grams.sum(axis=0)
        seen.append((counts > 0).astype(np.float32))
        floor.append(0.0 if len(grams) < JUDGING_ROWS else float(((grams @ (counts > 1)) / np.maximum(grams.sum(axis=1), 1)).min()))
    return Model(languages, (marks.T @ (whiten @ coefficients)).astype(np.float32), np.stack(seen, axis=1), tuple(floor))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def packed(text: str) -> bytes:
    """The n-grams of a text as ``BUCKETS`` bits."""
    return np.packbits(presence([text])[0].astype(bool)).tobytes()


def pack_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = pa.array([packed(t) for t in batch.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), bits], names=["lang", "h", "bits"])


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int) -> list[tuple[str, bytes]]:
    """The bounded sample, sorted: each language's first ``rows`` texts by a hash, the same for any partitioning.

    Texts that repeat with their id count once.  Every task ranks its own hashes
    first, so what is shuffled is bounded too.
    """
    lang, text = F.col(lang_col).cast("string"), F.col(text_col)
    known = lang.isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col) & text.isNotNull() & text.rlike(r"\p{L}")
    labelled = docs.filter(known).select(lang.alias("lang"), F.xxhash64(F.col(id_col), text).alias("h"), text.alias("text"))
    order = Window.partitionBy("lang").orderBy("h")
    first = labelled.select("lang", "h").withColumn("r", F.dense_rank().over(order)).filter(F.col("r") <= rows).select("lang", "h").distinct()
    chosen = first.limit(MOST_LANGUAGES * rows + 1).collect()
    if len({r.lang for r in chosen}) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: is {lang_col} a column of languages?")
    if not chosen:
        return []
    wanted = docs.sparkSession.createDataFrame([(r.lang, r.h) for r in chosen], "lang string, h long")
    texts = labelled.join(F.broadcast(wanted), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.first("text").alias("text"))
    found = texts.mapInArrow(pack_partition, "lang string, h long, bits binary").collect()
    return [(r.lang, bytes(r.bits)) for r in sorted(found, key=lambda r: (r.lang, r.h))]


PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
    """For each text a language, a score from 0 to 1 (half of one plus the best response, clipped) and the share of known n-grams."""
    langs, scores, shares = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    known = [k for k, t in enumerate(texts) if has_letter(t)] if model.languages else []
    for at in range(0, len(known), BLOCK):
        some = known[at : at + BLOCK]
        found, share = model.scores([texts[k] for k in some])
        best = found.argmax(axis=1)
        rows = np.arange(len(some))
        for k, b, s, part in zip(some, best.tolist(), found[rows, best].tolist(), share[rows, best].tolist(), strict=True):
            langs[k], scores[k], shares[k] = model.languages[b], min(1.0, max(0.0, (1 + s) / 2)), part
    return langs, scores, shares


def predict_partition(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, _ = predict(model.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=PREDICTED)

    return run


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``docs``.

    The model learns from rows with a language and an id outside the held-out
    quarter.  A text that is null or has no letter gets ``und`` with score 0, as
    do all if there is nothing to learn from.  Repeated rows are predicted alike,
    ties between languages go to the first by name.  A null id is not held out.
    Other columns are ignored, whatever their names; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(fit(training_rows(docs, id_col, text_col, lang_col, sample_rows)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(predict_partition(model), "doc_id long, held_out boolean, lang_pred string, score double")


#: A text is in a language if at least so many of its distinct n-grams stand in that language's sample.
LEAST_KNOWN = 0.5


def keep_partition(model, text_at: int, least: float, wanted: tuple[str, ...] | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            if not model.value.languages:
                yield batch.filter(pa.array(map(has_letter, texts), pa.bool_()))
                continue
            langs, _, shares = predict(model.value, texts)
            bound = {lang: min(least, low) for lang, low in zip(model.value.languages, model.value.floor, strict=True)}
            yield batch.filter(pa.array([lang != UNKNOWN and s >= bound[lang] and (wanted is None or lang in wanted) for lang, s in zip(langs, shares, strict=True)], pa.bool_()))

    return run


def drop_unknown(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST_KNOWN, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of ``docs`` in a recognised language, with all columns.

    A row goes if its text is null, empty or without a letter, if less than
    ``least`` of its distinct n-grams are known from the language that the kernel
    model gives it (so another script or random signs, which the model would have
    to call something; the bound is never above what the sample's own texts share with
    the rest of it, and 0 in a language of fewer than ``JUDGING_ROWS`` sampled texts), or if that language is not among ``wanted`` (None: any will
    do).  Where there is nothing to learn from, no prediction is made and
    every text with a letter stays.  Ties between languages go to the first by
    name; repeated rows fare alike; columns come back as they were, whatever their
    names; an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(training_rows(docs, id_col, text_col, lang_col, SAMPLE_ROWS)))
    return docs.mapInArrow(keep_partition(model, docs.columns.index(text_col), least, wanted), docs.schema)
