"""Benchmark passages in documents, found in an FM-index of every shard.

A shard is a few megabytes of documents in one task.  Its index is over words:
suffix array by prefix doubling, Burrows-Wheeler transform, a wavelet matrix for
ranks, and suffix positions sampled by place.  All windows of the benchmark are
searched backwards at once; each occurrence is located by walking to a sampled
position.  Hit words are merged to spans for removal.

Words that the benchmark doesn't have part the text: no window can cross them,
so the index takes only runs of benchmark words that are long enough for a
window, which is exact.  The benchmark is sent to the tasks in blocks of at most
``BLOCK_BYTES``; one that is larger is searched block after block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty

WINDOW = 10
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 4 << 20
SAMPLE = 16

#: Word bytes are a-z, 0-9 and all beyond ASCII; A-Z are lowered, the rest parts.
FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


class FMIndex:
    """Backward search over a sequence of small numbers; 0 is kept for its end."""

    def __init__(self, seq: np.ndarray, symbols: int, sample: int = SAMPLE) -> None:
        seq = np.r_[seq.astype(np.int64), 0]
        n = len(seq)
        suffixes = suffix_array(seq)
        self.bwt = seq[suffixes - 1]
        self.before = np.r_[0, np.cumsum(np.bincount(seq, minlength=symbols))]
        self.levels: list[tuple[int, np.ndarray, int]] = []
        now = self.bwt
        for bit in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            ones = (now >> bit) & 1
            self.levels.append((bit, np.r_[0, np.cumsum(ones)].astype(np.int32), n - int(ones.sum())))
            now = np.r_[now[ones == 0], now[ones == 1]]
        self.sampled = np.full(n, -1, np.int64)
        marked = suffixes % sample == 0
        self.sampled[marked] = suffixes[marked]

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each end."""
        low, high = np.zeros_like(ends), ends
        for bit, ones, zeros in self.levels:
            one = ((symbols >> bit) & 1).astype(bool)
            low_ones, high_ones = ones[low], ones[high]
            low = np.where(one, zeros + low_ones, low - low_ones)
            high = np.where(one, zeros + high_ones, high - high_ones)
        return high - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``patterns`` the range of its suffixes."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt), np.int64)
        live = np.arange(len(patterns))
        for column in patterns.T[::-1]:
            c = column[live]
            low[live] = self.before[c] + self.rank(c, low[live])
            high[live] = self.before[c] + self.rank(c, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows start."""
        out = np.zeros(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            known = self.sampled[at] >= 0
            out[todo[known]] = self.sampled[at[known]] + steps
            todo, at = todo[~known], at[~known]
            c = self.bwt[at]
            at = self.before[c] + self.rank(c, at)
            steps += 1
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; the last symbol is unique and smallest."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    ranks = np.empty(n, np.int64)
    sorted_seq = seq[order]
    ranks[order] = np.cumsum(np.r_[0, sorted_seq[1:] != sorted_seq[:-1]])
    step = 1
    while ranks.max(initial=0) < n - 1:
        second = np.r_[ranks[step:] + 1, np.zeros(min(step, n), np.int64)]
        key = ranks * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        ranks[order] = np.cumsum(np.r_[0, sorted_key[1:] != sorted_key[:-1]])
        step *= 2
    return order


def item_text(i: int | None) -> str:
    return "" if i is None else str(i)


class Phrases:
    """The windows of a block of benchmark items, given as (id, words)."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.ids = [i for i, _ in items]
        windows: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, (_, words) in enumerate(items):
            if words:
                numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words], np.int32)
                size = min(window, len(numbers))
                windows.setdefault(size, []).append((k, np.lib.stride_tricks.sliding_window_view(numbers, size)))
        #: Windows of each length, each once; they are numbered from the shortest on.
        self.by_length: dict[int, np.ndarray] = {}
        pairs, made = [np.zeros((0, 2), np.int64)], 0
        for size, found in sorted(windows.items()):
            self.by_length[size], number = np.unique(np.concatenate([w for _, w in found]), axis=0, return_inverse=True)
            item = np.repeat([k for k, _ in found], [len(w) for _, w in found])
            pairs.append(np.unique(np.stack([number.reshape(-1) + made, item], 1), axis=0))
            made += len(self.by_length[size])
        # The items of window w are owners[owned[w]:owned[w + 1]].
        owners = np.concatenate(pairs)
        self.owners = owners[:, 1].astype(np.int32)
        self.owned = np.searchsorted(owners[:, 0], np.arange(made + 1))
        self.shortest = min(self.by_length, default=0)


class Shard:
    """Documents of one index: what stands where in its sequence."""

    def __init__(self, phrases: Phrases) -> None:
        self.phrases = phrases
        self.counts: list[int] = []
        self.runs: list[np.ndarray] = []
        self.docs: list[int] = []
        self.starts: list[int] = []

    def add(self, text: str | None) -> int:
        words = words_of(text or "")
        k, n = len(self.counts), len(words)
        self.counts.append(n)
        need = self.phrases.shortest
        if need and n >= need:
            ids = np.fromiter(map(self.phrases.vocabulary.get, words, repeat(0)), np.int32, n)
            edges = np.flatnonzero(np.diff(np.r_[False, ids > 0, False]))
            begins, ends = edges[::2], edges[1::2]
            long = ends - begins >= need
            for a, b in zip(begins[long].tolist(), ends[long].tolist(), strict=True):
                self.runs.append(ids[a:b])
                self.docs.append(k)
                self.starts.append(a)
        return n

    def hits(self) -> dict[int, tuple[list[tuple[int, int]], set[int]]]:
        """For each document with occurrences: merged spans of words, and items."""
        if not self.runs:
            return {}
        sizes = np.fromiter(map(len, self.runs), np.int64, len(self.runs))
        begins = np.cumsum(sizes + 1) - sizes - 1
        seq = np.ones(int((sizes + 1).sum()), np.int64)  # 1 parts the runs
        for a, run in zip(begins.tolist(), self.runs, strict=True):
            seq[a : a + len(run)] = run
        index = FMIndex(seq, len(self.phrases.vocabulary) + 2)
        rows, lengths, windows, numbered = [], [], [], 0
        for size, patterns in self.phrases.by_length.items():
            low, high = index.search(patterns)
            counts = high - low
            # The rows of all ranges, one range after another: all are located together.
            rows.append(np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum()))
            windows.append(np.repeat(np.arange(len(patterns)), counts) + numbered)
            lengths.append(np.full(counts.sum(), size))
            numbered += len(patterns)
        place, length, window = index.locate(np.concatenate(rows)), np.concatenate(lengths), np.concatenate(windows)
        if not len(place):
            return {}
        run = np.searchsorted(begins, place, "right") - 1
        first = place - begins[run] + np.array(self.starts)[run]
        doc = np.array(self.docs)[run]
        out: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
        for k in np.lexsort((first, doc)).tolist():
            d, a, b = int(doc[k]), int(first[k]), int(first[k] + length[k])
            spans, found = out.setdefault(d, ([], set()))
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
            else:
                spans.append((a, b))
            low, high = self.phrases.owned[window[k] : window[k] + 2]
            found.update(self.phrases.owners[low:high].tolist())
        return out


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of code points."""
    found = [m.span() for m in WORD.finditer(text)]
    return [(found[a][0], found[b - 1][1]) for a, b in spans]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    for a, b in reversed(spans):
        text = text[:a] + text[b:]
    return text


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches gathered until they are large enough for an index."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SHARD_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def shard_hits(texts: list[str], blocks: list) -> tuple[list[int], dict[int, tuple[list[tuple[int, int]], set[str]]]]:
    """Word counts; for documents with occurrences their spans and items over all blocks."""
    counts: list[int] = []
    out: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
    for block in blocks:
        phrases = block.value
        shard = Shard(phrases)
        counts = [shard.add(t) for t in texts]
        for k, (spans, items) in shard.hits().items():
            old = out.get(k, ([], set()))
            out[k] = (merged(old[0] + spans), old[1] | {item_text(phrases.ids[x]) for x in items})
        if len(blocks) > 1:
            release(block)
    return counts, out


def release(block) -> None:
    """Free a worker's copy of a broadcast block; it is read again when needed."""
    if hasattr(block, "_path") and hasattr(block, "_value"):
        del block._value


FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
FOUND_SQL = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>, items array<string>"


def search_partition(blocks: list) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in shards(batches):
            texts = [t for batch in held for t in batch.column("text").to_pylist()]
            ids = [i for batch in held for i in batch.column("doc_id").to_pylist()]
            counts, hits = shard_hits(texts, blocks)
            for at in range(0, len(ids), 1000):
                rows = []
                for k in range(at, min(at + 1000, len(ids))):
                    spans, found = hits.get(k, ((), ()))
                    items = sorted(found)
                    chars = char_spans(texts[k], spans) if spans else []
                    digest = hashlib.sha256(",".join(items).encode()).hexdigest()
                    rows.append((ids[k], counts[k], sum(b - a for a, b in spans), len(items), digest, bool(spans), [{"start": a, "end": b} for a, b in chars], items))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FOUND, strict=True)], schema=FOUND)

    return run


def pieces_of(words: list[bytes], window: int, most: int) -> Iterator[list[bytes]]:
    """An item's words in pieces that start at most ``most`` windows each; together they have its windows."""
    for at in range(0, max(1, len(words) - window + 1), most):
        yield words[at : at + most + window - 1]


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> list:
    """The benchmark's windows as broadcast blocks, each of a bounded size: of long items, too, a block takes a part."""
    context, blocks, items, size = benchmark.sparkSession.sparkContext, [], [], 0
    for i, text in benchmark.select(F.col(item_col).cast("long"), text_or_empty(text_col)).toLocalIterator():
        for words in pieces_of(words_of(text), window, max(1, block_bytes // 8)):
            items.append((i, words))
            size += sum(map(len, words)) + len(words)
            if size >= block_bytes:
                blocks.append(context.broadcast(Phrases(items, window)))
                items, size = [], 0
    if items or not blocks:
        blocks.append(context.broadcast(Phrases(items, window)))
    return blocks


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What of the benchmark every document holds.

    Returns, one row per row of ``docs``, ``doc_id, n_words, n_hit`` (words inside
    an occurrence of a window), ``n_items, items_sha256`` (of the sorted ids),
    ``contaminated``, ``spans`` (code points to remove) and ``items``.  A null or
    empty text has no words.  An item without words is in no document; items that
    share an id count once; an item without an id counts under an empty name.
    Repeated documents are judged one by one.  Other columns are ignored, whatever
    their names; an empty table gives an empty result, an empty benchmark no hits.
    """
    bounded_batches(docs.sparkSession)
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, window, block_bytes)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(search_partition(blocks), FOUND_SQL)


def clean_partition(blocks: list, text_at: int, chars_at: int | None) -> Callable:
    """Cut the spans out of the texts, again until no window is left, and keep all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in shards(batches):
            for batch, texts in zip(held, cleaned([b.column(text_at).to_pylist() for b in held], blocks), strict=True):
                columns = list(batch.columns)
                old = columns[text_at].to_pylist()
                if chars_at is not None:
                    lengths = columns[chars_at].to_pylist()
                    columns[chars_at] = pa.array([n if a == b else len(b) for a, b, n in zip(old, texts, lengths, strict=True)], batch.schema.field(chars_at).type)
                columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def cleaned(texts: list[list[str | None]], blocks: list) -> list[list[str | None]]:
    flat = [t for some in texts for t in some]
    todo = list(range(len(flat)))
    while todo:
        _, hits = shard_hits([flat[k] or "" for k in todo], blocks)
        for k, (spans, _) in hits.items():
            flat[todo[k]] = without(flat[todo[k]], char_spans(flat[todo[k]], spans))
        todo = [todo[k] for k in hits]
    rest = iter(flat)
    return [[next(rest) for _ in some] for some in texts]


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs``, all rows and columns, without the passages of the benchmark.

    Texts without an occurrence (null ones too) are left as they are.  Where a
    text changes, ``chars_col``, if ``docs`` has it, gets the new length.
    """
    bounded_batches(docs.sparkSession)
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, window, block_bytes)
    chars_at = docs.columns.index(chars_col) if chars_col in docs.columns else None
    return docs.mapInArrow(clean_partition(blocks, docs.columns.index(text_col), chars_at), docs.schema)
