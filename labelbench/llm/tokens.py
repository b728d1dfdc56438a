"""Byte-level BPE ids of whole texts, with a bounded memo of words in front of the tokenizer.

A byte-level BPE splits a text into pre-tokens before it merges bytes, and no pre-token spans a
step from a non-space character to a white-space one; a single space belongs to the word after
it, a single line feed stands alone.  A text without two white-space characters in a row may
therefore be cut at its spaces and line feeds and encoded word by word; the ids are those of
the whole text.  Any other text, and one that holds the added token's string, goes through the
tokenizer whole.  ``batch`` does the same for an Arrow column: its texts are cut and their words numbered
without a Python object for each, only the distinct words are looked up, and the ids are
gathered as arrays.  ``tests/llm/test_tokens_packing.py`` compares all of them.
"""

from __future__ import annotations

import codecs
import itertools
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Vocabulary of the public byte-level BPE; a parameter of every operator that needs ids.
VOCABULARY = "byte_bpe_50k.json"
#: Words in one generation of the memo (two are kept, about 200 bytes a word), and letters of a word that is kept: 90 MB in a worker at most,
#: for as long as it lives.
MEMO_WORDS, MEMO_LETTERS = 200_000, 64
#: Bytes of the texts that ``batch`` cuts at a time.
SLICE = 8_000_000

# White space as the tokenizer's pattern sees it (Unicode White_Space).
_WS = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_WS_RE2 = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Texts that are not cut: two white-space characters, the added token, or the character that sets marks apart.
_MARKS = "\0"
_WHOLE = _WS_RE2 + _WS_RE2 + r"|<\|endoftext\|>|\x00"
# A pre-token ends between a letter or digit and marks; marks behind the last one of a word are units of their own.
_END_MARKS = r"([A-Za-z0-9\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([!-/:-@\[-`{-~]+)( |$)"
_RUN = re.compile(_WS + _WS)
_ADDED = "<|endoftext|>"
# Letters whose class no Unicode version disputes, then marks.
_PLAIN = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([!-/:-@\[-`{-~]*)\Z")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Memo(dict):
    """ids of words as bytes; a missing word is looked up in the older generation, or encoded."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.older = encode, limit, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.encode(word)
            if len(word) > MEMO_LETTERS:
                return found
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found


class _Units(dict):
    """Number of each unit; by it, where its ids lie and how many they are."""

    def __init__(self, code: str):
        super().__init__()
        self.flat, self.begin, self.count = array(code), array("q"), array("q")

    def learn(self, units: list[str], ids: list) -> None:
        self.update(zip(units, range(len(self), len(self) + len(units))))
        counts = array("q", map(len, ids))
        self.begin.extend(itertools.accumulate(counts[:-1], initial=len(self.flat)) if counts else ())
        self.count.extend(counts)
        self.flat.extend(itertools.chain.from_iterable(ids))


class Encoder:
    """``ids(text)``: equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.feed_ids = self._plain("\n").tolist()
        self.feed = self._plain("\n").tobytes()
        # how the vocabulary shows bytes: printable Latin-1 as it is, the others from U+0100 on
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
        self.shown = {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.space = self.shown[32]
        self.table = "".join(self.shown.get(b, chr(b)) for b in range(256))
        self.marks = _Memo(lambda run: self._plain(run).tobytes(), 10_000)
        # words with the space in front of them, and words at a line's start, which have none
        self.inside = _Memo(lambda w: self._word(w, self.inside, " "), memo_words)
        self.leading = _Memo(lambda w: self._word(w, self.leading, ""), memo_words // 8)
        self.most_units = 2 * memo_words  # that ``batch`` keeps numbered before it starts again
        self.units = _Units(self.code)

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def _word(self, w: str, memo: _Memo, space: str) -> bytes:
        """Plain words are letters, which are one pre-token and go to the model, and maybe a run of marks
        behind them, which is another; the tokenizer takes all others."""
        if not (w.isascii() and w.isalpha()):
            m = _PLAIN.match(w)
            if not m:
                return self._plain(space + w).tobytes() if space + w else b""
            letters, marks = m.groups()
            if marks:
                return memo[letters] + self.marks[marks]
            w = w if w.isascii() else w.encode().decode("latin-1").translate(self.shown)
        return array(self.code, [t.id for t in self.model.tokenize(self.space + w if space else w)]).tobytes()

    def _unit(self, unit: str) -> list[int]:
        """A unit is a word behind a space, a line feed and the word behind it, or (behind a zero) marks at the end of a word."""
        if unit[:1] == _MARKS:
            return self._plain(unit[1:]).tolist()
        feed, space, w = (self.feed_ids, "", unit[1:]) if unit[:1] == "\n" else ([], " ", unit)
        m = _PLAIN.match(w)
        if not m or m[2]:
            return feed + self._plain(space + w).tolist()
        shown = codecs.charmap_decode(w.encode(), "strict", self.table)[0]
        return feed + [t.id for t in self.model.tokenize(self.space + shown if space else shown)]

    def _numbers(self, units: list[str]) -> np.ndarray:
        new = [u for u in units if u not in self.units]
        tokenize, space = self.model.tokenize, self.space
        self.units.learn(new, [[t.id for t in tokenize(space + u)] if u.isalpha() and u.isascii() else self._unit(u) for u in new])
        return np.fromiter(map(self.units.__getitem__, units), np.int64, len(units))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts (null: empty) one behind the other, and where each text's begin and the last one's end."""
        parts, ends = [np.empty(0, self.dtype)], [np.zeros(1, np.int64)]
        texts = pc.fill_null(texts, "")
        sizes, start = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)), 0
        while start < len(texts):
            end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + SLICE, "right")))
            ids, upto = self._slice(texts.slice(start, end - start))
            parts.append(ids)
            ends.append(upto[1:] + ends[-1][-1])
            start = end
        return np.concatenate(parts), np.concatenate(ends)

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.units) > self.most_units:
            self.units = _Units(self.code)
        whole = pc.match_substring_regex(texts, _WHOLE)
        cut = pc.replace_substring(pc.if_else(whole, "", texts), "\n", " \n")
        cut = pc.replace_substring_regex(cut, _END_MARKS, r"\1 " + _MARKS + r"\2\3")
        units = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\n"), cut, ""), " ")
        words = units.flatten().dictionary_encode()
        slots = self._numbers(words.dictionary.to_pylist())[words.indices.to_numpy()]
        flat, begin, count = (np.frombuffer(x, np.dtype(x.typecode)) for x in (self.units.flat, self.units.begin, self.units.count))
        first = units.offsets.to_numpy()[:-1] - units.offsets[0].as_py()  # the first unit of a text begins with a line feed that is not there
        begin, count = begin[slots], count[slots]
        begin[first] += 1
        count[first] -= 1
        upto = np.cumsum(np.append(0, count))
        at = np.repeat(begin - upto[:-1], count)
        at += np.arange(upto[-1])
        ids = flat[at]
        ends = upto[np.append(first, len(slots))]
        if not pc.any(whole).as_py():
            return ids, ends
        own = [self._plain(t.as_py()) if w else ids[a:b] for t, w, a, b in zip(texts, whole.to_pylist(), ends, ends[1:])]
        return np.concatenate(own), np.cumsum([0, *map(len, own)])

    def packed(self, text: str) -> bytes:
        """The ids as little-endian bytes of ``self.dtype``."""
        if not text:
            return b""
        if _ADDED in text or _RUN.search(text):
            return self._plain(text).tobytes()
        inside, leading, out = self.inside.__getitem__, self.leading, []
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(leading[words[0]] + b"".join(map(inside, words[1:])))
        return self.feed.join(out)

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.packed(text or ""), dtype=self.dtype)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
