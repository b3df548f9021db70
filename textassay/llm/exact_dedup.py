"""Exact duplicates by Patricia tries that own whole byte strings.

Texts are dealt to partitions by their length and content hash, and there the
full byte strings are inserted into a compressed radix trie.  A terminal node
keeps the identifier that stays and the number of rows.

A first trie in each input partition folds the copies that the partition holds,
so that a text that fills a third of the corpus crosses the network once per
task.  When it outgrows ``TRIE_BYTES``, whole subtrees, the largest first, are
spilled as rows to the shuffle; copies of their texts that come later meet them
behind it.  The partitions are read in the order of length and hash, so that a
trie knows which of its texts are complete: when it outgrows its bound, subtrees
of these leave as results.  So a trie holds as many texts as the bound allows,
and texts are told apart by the trie alone: two that share length and hash are
still two terminals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, pylists, text_or_empty

#: Bytes that one trie may hold, its nodes counted, before subtrees are spilled.
TRIE_BYTES = 64 << 20
#: What a node takes beside its label: two lists, a dictionary, a tuple.
NODE_BYTES = 400


class Patricia:
    """A compressed radix trie over byte strings.

    A node is ``[children, terminal]``; children map the first byte of an edge
    to ``(label, node)``.
    """

    def __init__(self) -> None:
        self.root: list = [{}, None]
        self.bytes = 0

    def terminal(self, key: bytes) -> list:
        """The node at the end of ``key``, made where it is missing."""
        node, at, end = self.root, 0, len(key)
        while at < end:
            edge = node[0].get(key[at])
            if edge is None:
                leaf: list = [{}, None]
                node[0][key[at]] = (key[at:], leaf)
                self.bytes += end - at + NODE_BYTES
                return leaf
            label, child = edge
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = shared_length(label, key, at)
            middle: list = [{label[same]: (label[same:], child)}, None]
            node[0][key[at]] = (label[:same], middle)
            self.bytes += NODE_BYTES
            node, at = middle, at + same
        return node

    def spill(self, most: int) -> Iterator[tuple[bytes, list]]:
        """Remove subtrees below a fork, the largest first, to come down to ``most`` bytes; their keys with terminals.

        The fork is the first below which no subtree alone is more than what must go.
        """
        sizes = subtree_bytes(self.root)
        labels, node = [], self.root
        while node[0]:
            order = sorted(node[0], key=lambda first: -sizes[id(node[0][first][1])])
            label, child = node[0][order[0]]
            if child[0] and sizes[id(child)] > self.bytes - most:
                labels.append(label)
                node = child
                continue
            for first in order:
                if self.bytes <= most:
                    break
                label, child = node[0].pop(first)
                yield from self._walk(b"".join(labels) + label, label, child)
            return

    def pop_all(self) -> Iterator[tuple[bytes, list]]:
        """Remove everything; keys with their terminals, in order."""
        if self.root[1] is not None:
            yield b"", self.root[1]
        children = self.root[0]
        self.root = [{}, None]
        for first in sorted(children):
            label, node = children.pop(first)
            yield from self._walk(label, label, node)

    def _walk(self, prefix: bytes, label: bytes, node: list) -> Iterator[tuple[bytes, list]]:
        stack = [(prefix, label, node)]
        while stack:
            prefix, own, node = stack.pop()
            self.bytes -= len(own) + NODE_BYTES
            if node[1] is not None:
                yield prefix, node[1]
            stack += [(prefix + e[0], e[0], e[1]) for _, e in sorted(node[0].items(), reverse=True)]


def subtree_bytes(root: list) -> dict[int, int]:
    """Bytes of every node's subtree, with the label that leads to it, by the node's id()."""
    found, order = {id(root): 0}, []
    stack = [root]
    while stack:
        node = stack.pop()
        for label, child in node[0].values():
            found[id(child)] = len(label) + NODE_BYTES
            order.append((id(child), id(node)))
            stack.append(child)
    for child, parent in reversed(order):  # below first
        found[parent] += found[child]
    return found


def shared_length(label: bytes, key: bytes, at: int) -> int:
    """How many leading bytes of ``label`` stand in ``key`` from ``at``; halving."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if key.startswith(label[low:mid], at + low):
            low = mid
        else:
            high = mid - 1
    return low


def join_owners(old: list | None, owner: int | None, rows: int, owner_rows: int, larger: bool) -> list:
    """Fold rows into a terminal ``[owner, rows, rows that have the owner's id]``; null ids own last."""
    if old is None:
        return [owner, rows, owner_rows]
    old[1] += rows
    if owner == old[0]:
        old[2] += owner_rows
    elif old[0] is None or owner is not None and (owner > old[0] if larger else owner < old[0]):
        old[0], old[2] = owner, owner_rows
    return old


FOLDED = pa.schema([("n", pa.int64()), ("h", pa.int64()), ("text", pa.binary()), ("owner", pa.int64()), ("rows", pa.int64()), ("owner_rows", pa.int64())])
OWNED = pa.schema([("sha", pa.string()), ("owner", pa.int64()), ("rows", pa.int64())])


def _batches(rows: Iterator[tuple], sizes: Callable[[tuple], int], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of a bounded size."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sizes(row)
        if size > 4 << 20 or len(held) >= 4000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def fold_partition(larger: bool, limit: int) -> Callable:
    """Copies within an input partition folded; a terminal also keeps its text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Patricia()

        def folded() -> Iterator[tuple]:
            for ids, texts, hs in pylists(batches):
                for i, text, h in zip(ids, texts, hs, strict=True):
                    node = trie.terminal(text)
                    if node[1] is None:
                        node[1] = [i, 1, 1, h]
                    else:
                        join_owners(node[1], i, 1, 1, larger)
                    if trie.bytes > limit:
                        yield from trie.spill(limit // 2)
            yield from trie.pop_all()

        rows = ((len(text), t[3], text, *t[:3]) for text, t in folded())
        yield from _batches(rows, lambda row: row[0], FOLDED)

    return run


def own_partition(larger: bool, limit: int) -> Callable:
    """Owners of each distinct text, over rows sorted by length and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, at = Patricia(), None

        def owned() -> Iterator[tuple]:
            nonlocal at
            for ns, hs, texts, owners, rows, owner_rows in pylists(batches):
                for n, h, text, owner, k, own_k in zip(ns, hs, texts, owners, rows, owner_rows, strict=True):
                    if (n, h) != at:
                        if trie.bytes > limit:  # every text in the trie is complete here
                            yield from trie.spill(limit // 2)
                        at = (n, h)
                    node = trie.terminal(text)
                    node[1] = join_owners(node[1], owner, k, own_k, larger)
            yield from trie.pop_all()

        yield from _batches(((hashlib.sha256(text).hexdigest(), t[0], t[1]) for text, t in owned()), lambda row: 64, OWNED)

    return run


def text_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct text: ``sha`` (of its UTF-8 bytes), ``owner``, ``rows``."""
    if keep not in ("max", "min"):
        raise ValueError("keep is 'max' or 'min'")
    bounded_batches(docs.sparkSession)
    text = text_or_empty(text_col)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("h"))
    folded = slim.mapInArrow(fold_partition(keep == "max", trie_bytes), "n long, h long, text binary, owner long, rows long, owner_rows long")
    dealt = folded.repartition("n", "h").sortWithinPartitions("n", "h")
    return dealt.mapInArrow(own_partition(keep == "max", trie_bytes), "sha string, owner long, rows long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The decision on every document.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``, one row per row
    of ``docs``.  Texts are equal when they are the same bytes; null counts as
    empty.  The row with the largest id stays (``keep="min"``: the smallest).
    Rows with a null id stay only where no row of the group has an id; keep_id
    is null then.  Of rows that repeat both id and text exactly one is kept.
    Other columns of ``docs`` are ignored, whatever their names; an empty table
    gives an empty result.
    """
    owners = text_owners(docs, id_col, text_col, keep)
    # Rows alike in id and text are counted first: no key is so frequent that it must be one task's.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text_or_empty(text_col), 256).alias("text_sha256")).groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("alike"))
    joined = rows.join(owners.select(F.col("sha").alias("text_sha256"), F.col("owner").alias("keep_id"), F.col("rows").alias("group_size")), "text_sha256")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("alike").cast("int")))).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    As ``exact_duplicates``: null counts as empty, a row without an id stays only
    where no row of its group has one, and of rows alike in id and text any one
    stays.  All columns come back as they were, whatever their names; an empty
    table stays empty.
    """
    sha, owner, sha_of, id_of = (free_name([*docs.columns, "n"], x) for x in ("__sha", "__owner", "__sha_of", "__id_of"))
    owners = text_owners(docs, id_col, text_col, keep).select(F.col("sha").alias(sha), F.col("owner").alias(owner))
    marked = docs.withColumn(sha, F.sha2(text_or_empty(text_col), 256))
    alike = marked.groupBy(F.col(sha).alias(sha_of), F.col(id_col).alias(id_of)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(sha_of, id_of)
    kept = marked.join(owners, sha).filter(F.col(id_col).cast("long").eqNullSafe(F.col(owner)))
    many = (F.col(sha) == F.col(sha_of)) & F.col(id_col).eqNullSafe(F.col(id_of))
    once = kept.join(alike, many, "left_anti")
    first = kept.join(alike, many, "left_semi").dropDuplicates([sha])
    return once.select(docs.columns).unionByName(first.select(docs.columns))
