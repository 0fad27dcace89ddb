"""Token ids of many texts with one tokenizer, each distinct word encoded once.

The tokenizer merges bytes within a word only, and marks the last token of each
word. So the texts of a batch are cut into words on arrays, distinct words that
are not known yet go through the tokenizer as one string, and its ids are dealt
back. Ids equal those of encoding each text by itself; texts in which that
would not be sure (other scripts, control characters, texts that are not in
normal form C, the spelling of special tokens) are encoded by themselves.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa


_SPACE, _LETTER, _NUMBER, _OTHER, _UNSURE = 0, 1, 2, 3, 4
_SURE = 0x530  # Latin, Greek and Cyrillic with their marks; what lies beyond is encoded text by text
_BLANK = " ".encode("utf-16-le")
#: Words to remember at most; then a worker starts anew.
REMEMBERED = 500_000


def _classes() -> np.ndarray:
    out = np.full(0x110000, _UNSURE, np.uint8)
    for c in range(_SURE):
        kind = unicodedata.category(chr(c))
        out[c] = _LETTER if kind[0] == "L" else _NUMBER if kind[0] == "N" else _UNSURE if kind[0] in "CM" else _OTHER
    out[[0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x2022, 0x2026, 0x20AC]] = _OTHER
    out[[9, 10, 11, 12, 13, 32, 0xA0]] = _SPACE
    return out


class Encoder:
    """A tokenizer file whose words end in a token with the given suffix."""

    def __init__(self, path: str, suffix: str = "</w>"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._t = Tokenizer.from_file(path)
        vocabulary = self._t.get_vocab(with_added_tokens=True)
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self._classes = _classes()
        self._forget()

    def _forget(self) -> None:
        self._slot: dict[bytes, int] = {}
        self._flat, self._used = np.zeros(1 << 16, np.uint32), 0
        self._at, self._len = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        ids = np.array(self._t.encode(_BLANK.join(words).decode("utf-16-le"), add_special_tokens=False).ids, np.uint32)
        last = np.flatnonzero(self._ends[ids])
        if len(last) != len(words):
            raise ValueError("the tokenizer does not end words as expected")
        length = np.diff(last, prepend=-1)
        n, m = len(self._slot), len(words)
        if self._used + len(ids) > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros(max(len(self._flat), len(ids)), np.uint32)])
        if n + m > len(self._at):
            grow = np.zeros(max(len(self._at), m), np.int64)
            self._at, self._len = np.concatenate([self._at, grow]), np.concatenate([self._len, grow])
        self._flat[self._used : self._used + len(ids)] = ids
        self._at[n : n + m] = self._used + last + 1 - length
        self._len[n : n + m] = length
        self._used += len(ids)
        self._slot.update(zip(words, range(n, n + m), strict=True))

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        sure = []
        for i, text in enumerate(texts):
            if not text:
                out[i] = np.zeros(0, np.uint32)
            elif "<|" in text or "Σ" in text or "İ" in text or not unicodedata.is_normalized("NFC", text):
                out[i] = self._alone(text)
            else:
                sure.append(i)
        lowered = [texts[i].lower() for i in sure]
        joined = "\n".join([*lowered, ""])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self._classes[codes]
        at = np.zeros(len(sure) + 1, np.int64)
        np.cumsum([len(x) + 1 for x in lowered], out=at[1:])
        if (kinds == _UNSURE).any():
            bad = {int(b) for b in np.searchsorted(at, np.flatnonzero(kinds == _UNSURE), side="right") - 1}
            for b in bad:
                out[sure[b]] = self._alone(texts[sure[b]])
            rest = self([texts[i] for b, i in enumerate(sure) if b not in bad])
            for i, ids in zip([i for b, i in enumerate(sure) if b not in bad], rest, strict=True):
                out[i] = ids
            return out
        start, end = self._words(codes, kinds)
        # All codes left are below 2**16. Every one that is no space is in a word.
        spelled = codes[kinds != _SPACE].astype("<u2").tobytes()
        bounds = np.zeros(len(start) + 1, np.int32)
        np.cumsum(2 * (end - start), out=bounds[1:])
        coded = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(spelled)]).dictionary_encode()
        words, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self._slot) + len(words) > REMEMBERED:
            self._forget()
        if new := [w for w in words if w not in self._slot]:
            self._learn(new)
        slot = np.array([self._slot[w] for w in words], np.int64)[which]
        length = self._len[slot]
        done = np.zeros(len(slot) + 1, np.int64)
        np.cumsum(length, out=done[1:])
        ids = self._flat[np.repeat(self._at[slot] - done[:-1], length) + np.arange(done[-1])]
        cuts = done[np.searchsorted(start, at)]
        for i, a, b in zip(sure, cuts[:-1], cuts[1:], strict=True):
            out[i] = ids[a:b]
        return out

    def _alone(self, text: str) -> np.ndarray:
        return np.array(self._t.encode(text, add_special_tokens=False).ids, np.uint32)

    @staticmethod
    def _words(codes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of letters, single digits, runs of others; 's 't 're 've 'm 'll 'd are words of their own."""
        before = np.concatenate([[_SPACE], kinds[:-1]])
        begins = (kinds != _SPACE) & ((kinds != before) | (kinds == _NUMBER))
        quotes = np.flatnonzero((codes == 39) & (before != _OTHER))
        if len(quotes):
            tail = np.concatenate([codes, np.zeros(3, codes.dtype)])
            a, b = tail[quotes + 1], tail[quotes + 2]
            short = np.isin(a, [ord(c) for c in "stmd"])
            long = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            begins[quotes[short | long] + 1] = False
            begins[quotes[long] + 2] = False
            for at in (quotes[short] + 2, quotes[long] + 3):
                at = at[at < len(codes)]
                begins[at] = kinds[at] != _SPACE
        start = np.flatnonzero(begins)
        stops = np.flatnonzero(begins | (kinds == _SPACE))
        return start, stops[np.searchsorted(stops, start, side="right")] if len(start) else start


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, loaded once in a worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
