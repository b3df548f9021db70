"""Near duplicates: SimHash fingerprints found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits.  Every 23-bit
word lies within four bits of one or six codewords of the perfect binary Golay
code, and two words at most two bits apart always have one of these codewords in
common; a segment is a word with zeros below it.  Of at most four differing bits,
either some segment holds none and some other at most two, or two segments hold
one each and the third at most two.  So fingerprints that link share a whole
segment and a codeword of another, or a half of each of two segments and a
codeword of the third.  These keys, of 33 bits or more, gather candidates; the
bits that really differ decide.

Only distinct fingerprints take part.  A bucket of a key gives the edges of a
spanning forest of its links, never all pairs, and components follow from the
edges.  Buckets of more than ``BUCKET`` fingerprints are put aside, cut into
blocks, and every two blocks of a bucket are searched as a task of their own.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, materialise, salted_join, text_or_empty
from .components import star_components

WORDS, SEED, BITS = 4, 42, 4
BUCKET = 2048
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
#: First bits and lengths of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))

# --- fingerprints


def shingle_hashes(text: str, words: int = WORDS) -> list[int]:
    """XXH64 of every shingle of a text, or of all its words if they are too few."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z are lowered, \x20 and \x09-\x0D part
    if not tokens:
        return []
    if len(tokens) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(tokens), SEED)]
    line = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of hashes: the bits set in over half of them; 0 for an empty run.

    Eight bits are counted at once in the bytes of a word, over at most 255 hashes.
    """
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    sizes = sizes[full]
    first = np.cumsum(sizes) - sizes
    pieces = -(-sizes // 255)
    piece_first = np.cumsum(pieces) - pieces
    within = np.arange(pieces.sum()) - np.repeat(piece_first, pieces)
    starts = np.repeat(first, pieces) + 255 * within
    fingerprints = np.zeros(len(full), np.uint64)
    lanes = np.uint64(0x0101010101010101)
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & lanes, starts)
        counts = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), piece_first, axis=0)
        for byte in range(8):
            fingerprints |= (2 * counts[:, byte] > sizes).astype(np.uint64) << np.uint64(8 * byte + bit)
    out[full] = fingerprints
    return out


def fingerprint_partition(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes(t, words) for t in batch.column("text").to_pylist()]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            hashes = np.fromiter(itertools.chain.from_iterable(found), np.uint64, int(sizes.sum()))
            carried = batch.drop_columns("text")
            yield pa.RecordBatch.from_arrays([*carried.columns, pa.array(majority_bits(hashes, sizes).view(np.int64))], names=[*carried.schema.names, "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, carry: str | None = None) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed number), one row per row of ``docs``; carry: a text column to take along."""
    bounded_batches(docs.sparkSession)
    more = [F.col(carry).cast("string").alias(carry)] if carry else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *more, text_or_empty(text_col).alias("text")).mapInArrow(fingerprint_partition(words), "doc_id long, " + f"{carry} string, " * bool(carry) + "fp long")


# --- the code


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    rest = words.astype(np.int64)
    for shift in range(11, -1, -1):
        rest = rest ^ ((rest >> (shift + 11)) & 1) * (GENERATOR << shift)
    return rest


def _patterns() -> np.ndarray:
    """For each syndrome the errors of at most four bits: one, or six (one is then repeated)."""
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        errors = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(23), weight)], np.int64)
        for e, s in zip(errors.tolist(), syndromes(errors).tolist(), strict=True):
            found[s].append(e)
    return np.array([(f * 6)[:6] for f in found], np.int64)


_patterns_made: list[np.ndarray] = []


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords within four bits of each 23-bit word, six columns."""
    if not _patterns_made:
        _patterns_made.append(_patterns())
    # The code is cyclic and systematic in its upper 12 bits: these number the codewords.
    return (words.astype(np.int64)[:, None] ^ _patterns_made[0][syndromes(words)]) >> 11


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``prints`` and the keys of their fingerprints, without repeats.

    A key is a number of what it is made of, 22 bits of segments that must be
    equal, and 12 bits of a codeword.
    """
    bits = prints.view(np.uint64)
    parts = [((bits >> np.uint64(at)) & np.uint64((1 << size) - 1)).view(np.int64) for at, size in SEGMENTS]
    halves = [(p & 0x3FF, p >> 10) for p in parts]
    owners, keys, made = [], [], 0
    for c, (_, size) in enumerate(SEGMENTS):
        i, j = (k for k in range(3) if k != c)
        equal = [parts[i], parts[j], *((x << 12) | y for x in halves[i] for y in halves[j])]
        codes = codeword_indices(parts[c] << (23 - size))
        rest = np.flatnonzero(codes[:, 0] != codes[:, 1])  # these have six codewords, the others one
        for column in range(6):
            use = rest if column else np.arange(len(prints))
            for number, same in enumerate(equal, made):
                owners.append(use)
                keys.append((number << 36) | (same[use] << 12) | codes[use, column])
        made += len(equal)
    return np.concatenate(owners), np.concatenate(keys)


def key_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        owners, keys = golay_keys(prints)
        for at in range(0, len(keys), 200_000):
            some = slice(at, at + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(prints[owners[some]])], names=["key", "fp"])


# --- links in buckets


def spanning_links(prints: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    words, edges = prints.view(np.uint64), []
    rest = np.arange(len(words))
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            at = todo.pop()
            near = np.bitwise_count(words[rest] ^ words[at]) <= bits
            if near.any():
                reached = rest[near].tolist()
                edges += [(at, r) for r in reached]
                todo += reached
                rest = rest[~near]
    return edges


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("block", pa.int64())])


def _links(a: np.ndarray, b: np.ndarray, key: np.ndarray | None = None, block: np.ndarray | None = None) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), none if b is None else pa.array(b, pa.int64()), none if key is None else pa.array(key, pa.int64()), none if block is None else pa.array(block, pa.int64())], schema=LINKS)


class Buckets:
    """Cuts rows sorted by key into buckets: small ones many at a time, large ones to blocks."""

    def __init__(self, bits: int, bucket: int) -> None:
        self.bits, self.bucket = bits, bucket
        self.key: int | None = None  # of a bucket that is being put aside
        self.put = 0

    def search(self, keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links of whole buckets, none of which is large."""
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[first, len(keys)])
        large = sizes > 6
        base = np.flatnonzero(np.repeat(~large & (sizes > 1), sizes))
        words = prints.view(np.uint64)
        for step in range(1, 6):
            base = base[base + step < len(keys)]
            base = base[keys[base] == keys[base + step]]
            near = base[np.bitwise_count(words[base] ^ words[base + step]) <= self.bits]
            if len(near):
                yield _links(prints[near], prints[near + step])
        edges = []
        for at, size in zip(first[large].tolist(), sizes[large].tolist(), strict=True):
            edges += [(at + a, at + b) for a, b in spanning_links(prints[at : at + size], self.bits)]
        if edges:
            a, b = np.array(edges).T
            yield _links(prints[a], prints[b])

    def aside(self, prints: np.ndarray) -> pa.RecordBatch:
        """Rows of the large bucket with their blocks: fp in a, no b."""
        blocks = (self.put + np.arange(len(prints))) // self.bucket
        self.put += len(prints)
        return _links(prints, None, np.full(len(prints), self.key), blocks)

    def run(self, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for more_keys, more_prints in parts:
            if not len(more_keys):
                continue
            keys, prints = np.r_[keys, more_keys], np.r_[prints, more_prints]
            if self.key is not None:
                n = int((keys == self.key).sum())
                yield self.aside(prints[:n])
                keys, prints = keys[n:], prints[n:]
                if not len(keys):
                    continue
                self.key = None
            yield from self._whole(keys, prints, last := int(np.searchsorted(keys, keys[-1])))
            keys, prints = keys[last:], prints[last:]
            if len(keys) > self.bucket:
                self.key, self.put = int(keys[0]), 0
                yield self.aside(prints)
                keys, prints = keys[:0], prints[:0]
        if len(keys):
            yield from self._whole(keys, prints, len(keys))

    def _whole(self, keys: np.ndarray, prints: np.ndarray, end: int) -> Iterator[pa.RecordBatch]:
        """The first ``end`` rows, which are whole buckets."""
        if not end:
            return
        keys, prints = keys[:end], prints[:end]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[first, end])
        for at, size in zip(first[sizes > self.bucket].tolist(), sizes[sizes > self.bucket].tolist(), strict=True):
            self.key, self.put = int(keys[at]), 0
            yield self.aside(prints[at : at + size])
            self.key = None
        small = np.repeat(sizes <= self.bucket, sizes)
        if small.any():
            yield from self.search(keys[small], prints[small])


def bucket_partition(bits: int, bucket: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ((b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)) for b in batches)
        yield from Buckets(bits, bucket).run(parts)

    return run


def block_pair(bits: int) -> Callable:
    """Links among at most two blocks of a bucket."""

    def run(table: pa.Table) -> pa.Table:
        prints = np.unique(table.column("fp").to_numpy())
        edges = np.array(spanning_links(prints, bits), np.int64).reshape(-1, 2)
        return pa.table({"a": prints[edges[:, 0]], "b": prints[edges[:, 1]]})

    return run


#: Fingerprints whose keys one task makes: some 96 keys each.
KEYED_ROWS = 20_000


def fingerprint_links(prints: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """Edges ``a, b`` that connect all fingerprints (distinct, column fp) at most ``bits`` apart."""
    if not 0 <= bits <= 4:
        raise ValueError("the keys guarantee links of at most four bits")
    spark = prints.sparkSession
    # A fingerprint is small and its keys are many: the table's few files would make too few tasks.
    dealt = prints.select("fp").repartition(max(1, -(-prints.count() // KEYED_ROWS)), "fp")
    keyed = dealt.mapInArrow(key_partition, "key long, fp long")
    found = materialise(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(bucket_partition(bits, bucket), "a long, b long, key long, block long"), "links")
    links = found.filter("b IS NOT NULL").select("a", "b").distinct()
    large = found.filter("b IS NULL").select("key", "block", F.col("a").alias("fp"))
    if large.isEmpty():
        return links
    last = materialise(large.groupBy("key").agg(F.max("block").alias("last"), F.count(F.lit(1)).alias("n")), "large-buckets")
    # Block i meets every block from 0 to last: itself and the later ones as the first, the earlier ones as the second.
    pairs = salted_join(large, last, ["key"], "n", ["block", "fp"]).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp")
    return links.unionByName(pairs.groupBy("key", "i", "j").applyInArrow(block_pair(bits), "a long, b long")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """Every document's fingerprint and component.

    Returns ``doc_id, fingerprint, component_id``, one row per row of ``docs``;
    ``component_id`` is the smallest id that can be reached over links of at most
    ``bits`` differing bits, null if none of those rows has an id.  A text
    without words (null, empty, white space) has fingerprint zero and links like
    any other.  Repeated rows share a fingerprint.  Other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, words), "fingerprints")
    prints = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "prints")
    rooted = materialise(rooted_prints(prints, bits), "rooted")
    named = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("prints")), "components")
    fate = materialise(salted_join(rooted.select("fp", "root", "n"), named, ["root"], "prints", ["fp"]).select("fp", "component_id", "n"), "fate")
    placed = salted_join(rows, fate, ["fp"], "n", [F.monotonically_increasing_id()])
    return placed.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def rooted_prints(prints: DataFrame, bits: int) -> DataFrame:
    """``prints`` (distinct fp) with ``root``, the smallest fingerprint of its component."""
    roots = star_components(fingerprint_links(prints, bits))
    return prints.join(roots, prints["fp"] == roots["node"], "left").drop("node").withColumn("root", F.coalesce("root", "fp"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns.

    The row with the smallest id stays (rows without an id come last; of several
    with that id, the one whose text has the smallest SHA-256, and of rows alike
    in both any one).  A null text counts as empty; texts without words are one
    component.  All columns come back as they were, whatever their names; an
    empty table stays empty.
    """
    sha_name, kept_id, kept_sha = (free_name(docs.columns, x) for x in ("__sha", "__kept_id", "__kept_sha"))
    sha = F.sha2(text_or_empty(text_col), 256)
    rows = materialise(fingerprints(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), sha.alias("sha")), "i", "t", words, carry="sha"), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("sha"))
    prints = materialise(rows.groupBy("fp").agg(F.min(order).alias("first")), "prints")
    stay = materialise(rooted_prints(prints, bits).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias(kept_id), F.col("first.sha").alias(kept_sha)), "stay")
    alike = rows.groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    once = F.col(id_col).cast("long").eqNullSafe(F.col(kept_id)) & (F.col(sha_name) == F.col(kept_sha))
    kept = docs.withColumn(sha_name, sha).join(stay, once, "left_semi")
    twice = materialise(alike.select(F.col("doc_id").alias(kept_id), F.col("sha").alias(kept_sha)), "alike")
    if twice.isEmpty():
        return kept.select(docs.columns)
    return kept.join(twice, once, "left_anti").select(docs.columns).unionByName(kept.join(twice, once, "left_semi").dropDuplicates([id_col, sha_name]).select(docs.columns))
