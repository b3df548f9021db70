"""Token ids of whole texts by a word-wise BPE tokenizer, with a memory for words.

The tokenizer drops white space before BPE, so that the ids of a text are those
of its space-separated words, one after another.  Words are encoded once per
worker, many at a time; ids of a text are then a join of byte strings.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Words that a worker remembers, and the longest of them; beyond, it starts anew.
REMEMBERED = 1_000_000
LONGEST = 48
TOGETHER = 256

MARKS = b".,;:!?"
#: Words for which normalising is plain: letters whose lower case is one letter and which are composed already.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")

_loaded: dict[str, WordTokens] = {}


class WordTokens:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.word_wise = self._is_word_wise(spec)
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        if self.word_wise:
            for piece, i in self.tokenizer.get_vocab().items():
                self.ends[i] = piece.endswith("</w>")
        self.words: dict[bytes, bytes] = {}

    @staticmethod
    def _is_word_wise(spec: dict) -> bool:
        """Whether white space only parts words: it is dropped, and every word ends in a marked piece."""
        norm = [n.get("type") for n in ((spec.get("normalizer") or {}).get("normalizers") or [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        return norm == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True and spec["model"].get("end_of_word_suffix") == "</w>" and not spec.get("post_processor") and not spec.get("truncation") and not spec.get("padding")

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def _learn(self, missing: set[bytes]) -> None:
        """Enter the ids of words; plain ones by their lower-case letters and the marks behind them."""
        words, composed, odd = self.words, [], []
        letters: dict[bytes, bytes] = {}  # to encode, and the words that stand for themselves
        for w in missing:
            core = w.rstrip(MARKS)
            if len(w) > LONGEST:
                odd.append(w)
            elif core.isalpha():
                low = core.lower()
                letters[low] = low
                if low is not w and low != w:
                    composed.append((w, low, w[len(core) :]))
            elif core and LETTERS.fullmatch(text := core.decode()):
                low = text.lower().encode()
                letters[low] = low
                if low != w:
                    composed.append((w, low, w[len(core) :]))
            else:
                odd.append(w)
        new = [p for p in letters if p not in words]
        for at in range(0, len(new), TOGETHER):
            some = new[at : at + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                raw, low = ids.tobytes(), 0
                for p, high in zip(some, (cuts * 4).tolist(), strict=True):
                    words[p] = raw[low:high]
                    low = high
            else:
                words.update(zip(some, self._encode(some), strict=True))
        marks = {m for _, _, m in composed}.difference(words)
        words.update(zip(marks, self._encode(list(marks)), strict=True))
        for w, low, m in composed:
            words[w] = words[low] + words[m]
        words.update(zip(odd, self._encode(odd), strict=True))

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """For each UTF-8 text its ids, four little-endian bytes each."""
        if not self.word_wise:
            return self._encode(texts)
        if len(self.words) > REMEMBERED:
            self.words = {}
        # A-Z may be lowered at once, unless that would make the string of a special token.
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        found = [list(map(self.words.get, words)) for words in split]
        holes = [[k for k, ids in enumerate(f) if ids is None] for f in found]
        missing = {words[k] for words, own in zip(split, holes, strict=True) for k in own}
        if missing:
            self._learn(missing)
            for words, f, own in zip(split, found, holes, strict=True):
                for k in own:
                    f[k] = self.words[words[k]]
            for w in missing:
                if len(w) > LONGEST:
                    del self.words[w]
        return [b"".join(f) for f in found]


def word_tokens(path: str) -> WordTokens:
    """The worker's tokenizer for a file, loaded once."""
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]
