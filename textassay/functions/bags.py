"""Feature bags of an Arrow array of texts at once, by passes over their bytes.

The same features as the native columns of ``features`` and the bag of one text in
``bag``; tests hold all three together.  No Python object is made for a text or a
word: words are runs of bytes, they and their pairs are counted by numbers, and
names are made for what is distinct in the batch alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from . import patterns as P
from .features import LONGEST_WORD

WORD, MARK, SPACE = 1, 2, 4
KINDS = ("fence", "heading", "bullet", "boldlead", "numlist", "blank", "line_short", "line_mid", "line_long", "line_para")


@cache
def classes() -> np.ndarray:
    """What each code point is: part of a word, a mark, white space."""
    every = "".join(" " if 0xD800 <= c < 0xE000 else chr(c) for c in range(0x110000))
    table = np.full(len(every), MARK, np.uint8)
    for pattern, kind in ((r"[\p{Alphabetic}\p{N}']+", WORD), (r"\p{White_Space}+", 0)):
        for found in regex.finditer(pattern, every):
            table[found.start() : found.end()] = kind
    table[[ord(c) for c in P.SPACES]] |= SPACE
    table[0xD800:0xE000] = 0
    return table


@dataclass(frozen=True)
class Bags:
    """Of ``size`` texts: how often (``counts``) which feature (``codes``, places in ``names``) stands in which (``rows``); each pair once, in no order."""

    size: int
    rows: np.ndarray
    codes: np.ndarray
    counts: np.ndarray
    names: pa.Array


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII letters in lower case."""
    return data + (((data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.diff(np.r_[first, len(keys)])


def mixed(x: np.ndarray) -> np.ndarray:
    """The numbers (unsigned, of 64 bits) hashed: splitmix64, the same on every machine."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word by its bytes; none is empty."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    if not len(words):
        return np.zeros(0, np.uint64)
    place = np.arange(ends[-1] - ends[0]) - np.repeat(ends[:-1] - ends[0], np.diff(ends))
    of_byte, of_place = mixed(np.arange(256, dtype=np.uint64)), mixed(np.arange(256, 320, dtype=np.uint64)) | np.uint64(1)
    values = of_byte[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] * of_place[place & 63]
    return mixed(np.add.reduceat(values, ends[:-1] - ends[0]))


def prefixed(prefix: str, names: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(pa.scalar(prefix), names, "")


class Texts:
    """The bytes of an array of texts and what each of them is part of.  A null text is an empty one."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.string()), "")
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:  # broken characters become U+FFFD, as in Java
            texts = pa.array([x.decode("utf-8", "replace") for x in texts.cast(pa.binary()).to_pylist()], pa.string())
        self.size = len(texts)
        _, offsets, data = texts.buffers()
        self.offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + self.size + 1].astype(np.int64) if self.size else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.bytes = data[self.offsets[0] : self.offsets[-1]]
        self.offsets = self.offsets - self.offsets[0]
        filled = np.diff(self.offsets) > 0
        self.starts, self.ends = self.offsets[:-1][filled], self.offsets[1:][filled]
        self.filled = np.flatnonzero(filled)
        self._classify()

    def _classify(self) -> None:
        b, table = self.bytes, classes()
        self.flags = np.r_[table[:128], np.zeros(128, np.uint8)][b]
        lead = np.flatnonzero(b >= 0xC0)
        head = b[lead]
        more = 1 + (head >= 0xE0) + (head >= 0xF0)
        points = (head & np.array([0, 0x1F, 0x0F, 0x07], np.uint8)[more]).astype(np.int32)
        for k in (1, 2, 3):
            on = more >= k
            points[on] = points[on] << 6 | b[lead[on] + k] & 0x3F
        kinds = table[points]
        self.flags[lead] = kinds
        for k in (1, 2, 3):
            on = more >= k
            self.flags[lead[on] + k] = kinds[on]
        self.lead, self.points = lead[kinds == MARK], points[kinds == MARK]

    def rows_of(self, positions: np.ndarray) -> np.ndarray:
        """The texts in which ascending positions are."""
        return np.repeat(np.arange(self.size), np.diff(np.searchsorted(positions, self.offsets)))

    def opens(self, inside: np.ndarray) -> np.ndarray:
        """Where runs begin; none crosses texts."""
        found = inside.copy()
        found[1:] &= ~inside[:-1]
        found[self.starts] = inside[self.starts]
        return np.flatnonzero(found)

    def closes(self, inside: np.ndarray) -> np.ndarray:
        found = inside.copy()
        found[:-1] &= ~inside[1:]
        found[self.ends - 1] = inside[self.ends - 1]
        return np.flatnonzero(found) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """In order, the text and the number of each word, and the words by number, lower-cased."""
        inside = (self.flags & WORD) != 0
        first, last = self.opens(inside), self.closes(inside)
        long = last - first >= LONGEST_WORD
        for a, z in zip(first[long], last[long], strict=True):
            inside[a:z] = False
        first, last = first[~long], last[~long]
        places = np.r_[0, np.cumsum(last - first)].astype(np.int32)
        words = pa.StringArray.from_buffers(len(first), pa.py_buffer(places), pa.py_buffer(ascii_lower(self.bytes[inside]))).dictionary_encode()
        codes, names = np.asarray(words.indices).astype(np.int64), words.dictionary
        ascii_only = pc.string_is_ascii(names)
        if not pc.all(ascii_only).as_py():
            # One string for all of them: no word has the separator, and letters beyond it don't count for how one is lowered.
            other = pc.invert(ascii_only)
            joined = "\n".join(names.filter(other).to_pylist())
            if (lower := joined.lower()) != joined:
                lowered = pc.replace_with_mask(names, other, pa.array(lower.split("\n"), pa.string())).dictionary_encode()
                codes, names = np.asarray(lowered.indices).astype(np.int64)[codes], lowered.dictionary
        return self.rows_of(first), codes, names

    def marks(self) -> tuple[np.ndarray, np.ndarray]:
        """Texts and code points."""
        plain = np.flatnonzero((self.flags == MARK) & (self.bytes < 0x80))
        return np.r_[self.rows_of(plain), self.rows_of(self.lead)], np.r_[self.bytes[plain].astype(np.int64), self.points]

    def layout(self) -> tuple[np.ndarray, np.ndarray]:
        """Texts and kinds of their lines."""
        b = self.bytes
        after = np.flatnonzero(b == 10) + 1
        first = np.union1d(self.starts, after[after < len(b)])
        # A text's end is the next one's start or the end of all: an empty last line doesn't count.
        last = np.r_[first[1:], len(b)][: len(first)]
        inked = self.opens((self.flags & SPACE) == 0)
        at = np.searchsorted(inked, first)
        n = np.searchsorted(inked, last) - at
        body = np.r_[inked, 0][at]
        is_at = lambda k, char: (np.r_[b, 0, 0, 0][body + k] == ord(char)) & (body + k < last)
        ink = n > 0
        points = np.flatnonzero((b[:-1] == ord(".")) & (b[1:] == ord(" ")))
        dotted = np.searchsorted(points, last - 1) > np.searchsorted(points, body)
        digit = (b[np.minimum(body, max(len(b) - 1, 0))] - np.uint8(48)) < 10 if len(b) else ink
        kinds = np.select(
            [~ink, is_at(0, "`") & is_at(1, "`") & is_at(2, "`"), is_at(0, "#"), (is_at(0, "-") | is_at(0, "*")) & is_at(1, " "), is_at(0, "*") & is_at(1, "*"), digit & dotted, n < 10, n < 25, n < 50],
            [5, 0, 1, 2, 3, 4, 6, 7, 8],
            9,
        )
        return self.rows_of(first), kinds


def bags(texts: pa.Array, kinds: str = "wbps") -> Bags:
    """The features of each text: words, pairs, marks and layout, or some of these."""
    read = Texts(texts)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []
    if "w" in kinds or "b" in kinds:
        rows, codes, names = read.words()
        n = max(len(names), 1)
        if "w" in kinds:
            keys, counts = runs(rows * n + codes)
            found.append((keys // n, keys % n, counts, prefixed("w:", names)))
        if "b" in kinds:
            within = rows[1:] == rows[:-1]
            keys, counts = runs((rows[1:] * (n * n) + codes[:-1] * n + codes[1:])[within])
            pairs = pa.array(keys % (n * n), pa.int64()).dictionary_encode()
            first, second = np.divmod(np.asarray(pairs.dictionary), n)
            named = pc.binary_join_element_wise(prefixed("b:", names).take(pa.array(first)), names.take(pa.array(second)), " ")
            found.append((keys // (n * n), np.asarray(pairs.indices).astype(np.int64), counts, named))
    if "p" in kinds:
        keys, counts = runs(np.ravel_multi_index(read.marks(), (max(read.size, 1), 0x110000)))
        points, codes = np.unique(keys % 0x110000, return_inverse=True)
        found.append((keys // 0x110000, codes, counts, pa.array([f"p:{chr(c)}" for c in points], pa.string())))
    if "s" in kinds:
        rows, codes = read.layout()
        keys, counts = runs(rows * len(KINDS) + codes)
        found.append((keys // len(KINDS), keys % len(KINDS), counts, pa.array([f"s:{k}" for k in KINDS], pa.string())))
    before = np.cumsum([0, *(len(f[3]) for f in found)])
    rows, codes, counts = (np.concatenate(x) for x in ([f[0] for f in found], [f[1] + k for f, k in zip(found, before)], [f[2] for f in found]))
    return Bags(read.size, rows, codes, counts, pa.concat_arrays([f[3] for f in found]))


def family_counts(texts: pa.Array, family: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """By kind, in the order of buckets: the bucket, the family (a number, given by text), the name, the occurrences and the texts of each feature that a family has.

    A bucket depends on a feature's name alone.
    """
    read = Texts(texts)
    size = max(read.size, 1)
    by_family = np.argsort(family, kind="stable")
    place = np.empty(read.size, np.int64)
    place[by_family] = np.arange(read.size)
    # The smallest kind of number, as those of 16 bits are sorted in linear time.
    narrow = np.min_scalar_type(buckets - 1)

    def counted(rows: np.ndarray, codes: np.ndarray, numbers: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, ...]:
        """Sorted by code, family and text, occurrences stand together."""
        keys, counts = runs(codes * size + place[rows])
        codes, at = np.divmod(keys, size)
        families = family[by_family[at]] if len(at) else at
        first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (families[1:] != families[:-1])][: len(codes)])
        y, df = (np.add.reduceat(counts, first) if len(first) else counts), np.diff(np.r_[first, len(codes)])
        codes, families = codes[first], families[first]
        bucket = (numbers(codes) % np.uint64(buckets)).astype(narrow)
        order = np.argsort(bucket, kind="stable")
        return bucket[order], families[order], codes[order], y[order], df[order]

    rows, codes, names = read.words()
    of_word, n = hashes(names), max(len(names), 1)
    bucket, families, found, y, df = counted(rows, codes, lambda c: of_word[c])
    yield bucket, families, prefixed("w:", names.take(pa.array(found))), y, df
    within = rows[1:] == rows[:-1]
    bucket, families, found, y, df = counted(rows[1:][within], (codes[:-1] * n + codes[1:])[within], lambda c: mixed(of_word[c // n] * np.uint64(3) + of_word[c % n]))
    first, second = np.divmod(found, n)
    yield bucket, families, pc.binary_join_element_wise(prefixed("b:", names).take(pa.array(first)), names.take(pa.array(second)), " "), y, df
    bucket, families, found, y, df = counted(*read.marks(), lambda c: mixed(c.astype(np.uint64)))
    points, at = np.unique(found, return_inverse=True)
    yield bucket, families, pa.array([f"p:{chr(c)}" for c in points], pa.string()).take(pa.array(at)), y, df
    bucket, families, found, y, df = counted(*read.layout(), lambda c: mixed(c.astype(np.uint64) + np.uint64(0x110000)))
    yield bucket, families, pa.array([f"s:{k}" for k in KINDS], pa.string()).take(pa.array(found)), y, df


class Index:
    """Names of features by what they are made of, to find these alone in texts: no name is made for anything else.

    A name that no text can have is never found.
    """

    def __init__(self, names: pa.Array):
        listed = [(k, name[:2], name[2:]) for k, name in enumerate(names.to_pylist())]
        pairs = [(k, *rest.split(" ")) for k, kind, rest in listed if kind == "b:" and rest.count(" ") == 1]
        singles = {rest: k for k, kind, rest in listed if kind == "w:"}
        words = sorted({*singles, *(w for _, a, b in pairs for w in (a, b))})
        number = {w: k for k, w in enumerate(words)}
        self.size = len(names)
        self.words = pa.array(words, pa.string())
        self.of_word = np.array([*(singles.get(w, -1) for w in words), -1])  # the last is for words that are in none
        pairs = sorted((number[a] * len(words) + number[b], k) for k, a, b in pairs)
        self.pairs, self.of_pair = (np.array([p[j] for p in pairs], np.int64) for j in (0, 1))
        self.of_mark = np.full(0x110000, -1)
        for k, kind, rest in listed:
            if kind == "p:" and len(rest) == 1:
                self.of_mark[ord(rest)] = k
        layout = {rest: k for k, kind, rest in listed if kind == "s:"}
        self.of_kind = np.array([layout.get(kind, -1) for kind in KINDS])

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, places among the names and counts, in the order of rows and places."""
        read = Texts(texts)
        rows, codes, names = read.words()
        words = np.asarray(pc.index_in(names, value_set=self.words).fill_null(-1)).astype(np.int64)[codes]
        found = [(rows, self.of_word[words])]
        both = np.flatnonzero((rows[1:] == rows[:-1]) & (words[1:] >= 0) & (words[:-1] >= 0))
        if len(self.pairs):
            keys = words[both] * len(self.words) + words[both + 1]
            at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            found.append((rows[both], np.where(self.pairs[at] == keys, self.of_pair[at], -1)))
        for where, table in ((read.marks(), self.of_mark), (read.layout(), self.of_kind)):
            found.append((where[0], table[where[1]]))
        rows, places = (np.concatenate(x) for x in zip(*found, strict=True))
        known = places >= 0
        keys, counts = runs(rows[known] * self.size + places[known])
        return *np.divmod(keys, max(self.size, 1)), counts


def counted_rows(batches: Iterator[pa.RecordBatch], kinds: str) -> Iterator[pa.RecordBatch]:
    """Of (id, text) rows, ``id, feature, n`` within each."""
    for batch in batches:
        found = bags(batch.column(1), kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found.rows)), found.names.take(pa.array(found.codes)), pa.array(found.counts.astype(np.int64))], names=["doc_id", "feature", "n"])
