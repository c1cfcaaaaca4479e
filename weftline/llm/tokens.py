"""Word-end BPE over whole Arrow batches, equal to the tokenizer library id for id.

The library encodes about a megabyte of text a second.  Here a slice of text is
cut into pre-tokens by byte classes, the distinct pre-tokens are merged all at
once (one numpy step merges the best pair of every pre-token of a length), and
the slice's ids are gathered.  Only what the byte classes describe exactly takes
this way: ASCII letters, digits and signs, and the letters U+00C0 to U+00FF.  A
white-space delimited chunk with anything else (other scripts, control
characters, apostrophes, `<`) and any pre-token of over 64 bytes is encoded by
the library itself, so every text has the library's ids.
"""

from __future__ import annotations

import json

import numpy as np

from weftline.llm import textbytes as tb

_LONG = 64
_NONE = np.int32(1 << 30)
_WORD_END = "</w>"

_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = 0, 1, 2, 3, 9
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[0x21:0x7F] = _SIGN
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[[0x27, 0x3C]] = _OTHER


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    chars = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [chars[b] for b in range(256)]


class WordBPE:
    """Encodes slices of text with a vocabulary file of the kind `word_bpe_49k.json`."""

    def __init__(self, path: str, *, special_as_text: bool = False, cache: int = 600_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model.get("end_of_word_suffix") != _WORD_END or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path} is not a BPE vocabulary with word ends")
        vocab = model["vocab"]
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + _WORD_END] for c in chars], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        self.cache = cache
        self._reset()

    def _reset(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.len = np.empty(0, np.int64)
        self.store = np.empty(0, np.uint32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        k = np.searchsorted(self.keys, key)
        k[k == len(self.keys)] = 0
        return np.where(self.keys[k] == key, self.ranks[k], _NONE)

    def _merge(self, symbols: np.ndarray, index: np.ndarray, put) -> None:
        """Merge rows of equally many symbols; `put(rows, ids)` gets the finished ones."""
        ranks = self._rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(symbols), -1)
        while len(symbols):
            if symbols.shape[1] == 1:
                put(index, symbols)
                return
            best = np.argmin(ranks, axis=1)
            low = ranks[np.arange(len(ranks)), best]
            done = low == _NONE
            if done.any():
                put(index[done], symbols[done])
                symbols, ranks, index, best, low = symbols[~done], ranks[~done], index[~done], best[~done], low[~done]
                if not len(symbols):
                    return
            rows, cols = np.arange(len(symbols)), np.arange(symbols.shape[1] - 1)
            after = np.where(cols <= best[:, None], symbols[:, :-1], symbols[:, 1:])
            after[rows, best] = self.made[low]
            if after.shape[1] == 1:
                put(index, after)
                return
            gaps = cols[:-1]
            changed = np.where(gaps < best[:, None], ranks[:, :-1], ranks[:, 1:])
            for shift in (-1, 0):
                g = best + shift
                r = np.flatnonzero((g >= 0) & (g < after.shape[1] - 1))
                changed[r, g[r]] = self._rank(after[r, g[r]], after[r, g[r] + 1])
            symbols, ranks = after, changed

    def _learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> None:
        n = ends - starts
        out_len = np.zeros(len(keys), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def put(rows: np.ndarray, ids: np.ndarray) -> None:
            out_len[rows] = ids.shape[1]
            found.append((rows, ids))

        quick = plain & (n <= _LONG)
        for size in np.unique(n[quick]).tolist():
            rows = np.flatnonzero(quick & (n == size))
            raw = data[starts[rows][:, None] + np.arange(size)]
            symbols = self.inner[raw]
            symbols[:, -1] = self.final[raw[:, -1]]
            self._merge(symbols, rows, put) if size > 1 else put(rows, symbols)
        slow = np.flatnonzero(~quick)
        if len(slow):
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[slow].tolist(), ends[slow].tolist(), strict=True)]
            for r, e in zip(slow.tolist(), self.library.encode_batch(texts, add_special_tokens=False), strict=True):
                put(np.array([r]), np.array([e.ids], np.int64).reshape(1, -1))
        at = np.cumsum(out_len) - out_len
        ids = np.empty(int(out_len.sum()), np.uint32)
        for rows, made in found:
            ids[(at[rows][:, None] + np.arange(made.shape[1])).ravel()] = made.ravel()
        place = np.searchsorted(self.known, keys)
        self.known = np.insert(self.known, place, keys)
        self.at = np.insert(self.at, place, at + len(self.store))
        self.len = np.insert(self.len, place, out_len)
        self.store = np.concatenate([self.store, ids])

    def encode(self, part: tb.TextSlice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of the slice, and the offsets of the rows in them."""
        data, edges = part.data, part.offsets
        size = len(data)
        if not size:
            return np.empty(0, np.uint32), np.zeros(part.rows + 1, np.int64)
        kind = _CLASS[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        second = data[lead + 1]
        what = np.where((second == 0x97) | (second == 0xB7), _SIGN, _LETTER).astype(np.uint8)
        kind[lead], kind[lead + 1] = what, what
        first_of_row = np.zeros(size, bool)
        first_of_row[edges[:-1][edges[:-1] < size]] = True
        solid = kind != _SPACE
        chunk_start = solid.copy()
        chunk_start[1:] &= ~solid[:-1] | first_of_row[1:]
        chunk = np.cumsum(chunk_start) - 1
        odd = np.zeros(int(chunk[-1]) + 2, bool)
        odd[chunk[kind == _OTHER]] = True
        odd_byte = odd[chunk] & solid
        lower = data.copy()
        up = (data >= 65) & (data <= 90)
        up[lead + 1] = (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        lower[up & ~odd_byte] += 32
        char_start = np.ones(size, bool)
        char_start[lead + 1] = False
        begins = chunk_start.copy()
        begins[1:] |= solid[1:] & ~odd_byte[1:] & char_start[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
        starts = np.flatnonzero(begins)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(part.rows + 1, np.int64)
        stop = np.append(starts[1:], size)
        # a unit ends before the next one or at the first white space after it
        spaces = np.flatnonzero(~solid)
        k = np.searchsorted(spaces, starts)
        ends = np.minimum(stop, np.append(spaces, size)[k])
        plain = ~odd_byte[starts]
        keys = tb.span_hashes(lower, starts, ends)
        keys = np.where(plain, keys, tb.mix64(keys ^ np.uint64(0x5DEECE66D)))
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, distinct)
        place[place == len(self.known)] = 0
        new = self.known[place] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if new.any():
            if len(self.known) + int(new.sum()) > self.cache:
                self._reset()
                new = np.ones(len(distinct), bool)
            f = first[new]
            self._learn(lower, distinct[new], starts[f], ends[f], plain[f])
            place = np.searchsorted(self.known, distinct)
        at, n = self.at[place][back], self.len[place][back]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.store[np.repeat(at - total[:-1], n) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, edges)]
