"""Token ids of whole texts by the tokenizers library, each distinct stretch of text encoded once.

A byte-level BPE never joins characters over a single blank or line feed between two other characters, and
a word BPE never joins them over white space. Texts are cut there; a stretch is looked up among those that this
Python worker has seen, and new ones are encoded by the library. The key of a stretch of up to seven bytes is the bytes
themselves; a longer one is found by a hash and its bytes are compared with the remembered ones at every use, so
stretches of one hash never share ids. The memory of stretches is bounded; when it is full it starts anew. A tokenizer
of any other kind encodes whole texts.

The ids are those of the library's own call without special tokens added: a text that spells out a special token holds
that token's id, and such a text goes through the library whole. With ``special_as_text`` the strings are ordinary text.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from .wordbytes import _SPACE, hashes, runs, slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Stretches kept in a worker's memory, and bytes of them.
MAX_KEPT, MAX_KEPT_BYTES = 500_000, 64 << 20
_SHORT = 7
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(_SHORT + 1)], np.uint64)
_WIDE = ((0xC2, 0x85, None), (0xC2, 0xA0, None), (0xE1, 0x9A, (0x80,)), (0xE2, 0x80, (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0xE2, 0x81, (0x9F,)), (0xE3, 0x80, (0x80,)))


def white_space(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to Unicode white space."""
    found = _SPACE[data]
    if len(data) > 1 and (data >= 0xC2).any():
        lead = np.flatnonzero((data[:-1] == 0xC2) | (data[:-1] == 0xE1) | (data[:-1] == 0xE2) | (data[:-1] == 0xE3))
        for a, b, rest in _WIDE:
            at = lead[(data[lead] == a) & (data[lead + 1] == b)]
            if rest is not None:
                at = at[at + 2 < len(data)]
                at = at[np.isin(data[at + 2], rest)]
                found[at + 2] = True
            found[at] = found[at + 1] = True
    return found


def cut_spaces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of a byte-level BPE: a blank goes with what follows it, a line feed stands alone."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = white_space(data)
    heads = np.zeros(n + 1, bool)
    heads[offsets] = True
    lone = np.zeros(n, bool)
    lone[1:-1] = space[1:-1] & ~space[:-2] & ~space[2:] & ~heads[1:-2] & ~heads[2:-1]
    feed = lone & (data == 10)
    begins = heads[:n] | feed | (lone & (data == 32))
    begins[1:] |= feed[:-1]
    starts = np.flatnonzero(begins)
    return starts, np.append(starts[1:], n)


def cut_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return runs(~white_space(data), offsets)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number (beyond the end: zeros); a view, nothing is copied but the bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each span: its length (at most 8) above its bytes or, from eight bytes on, 56 bits of a hash."""
    lengths = ends - starts
    long = np.flatnonzero(lengths > _SHORT)
    keys = (eights(data)[starts] & _LOW_BYTES[np.minimum(lengths, _SHORT)]) | (np.minimum(lengths, _SHORT + 1).astype(np.uint64) << np.uint64(56))
    if len(long):
        keys[long] = (hashes(data, starts[long], ends[long]) & _LOW_BYTES[_SHORT]) | np.uint64((_SHORT + 1) << 56)
    return keys


def same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the spans of two byte arrays, each of eight bytes or more, are equal."""
    x, y = eights(a), eights(b)
    same = (x[a_at] == y[b_at]) & (x[a_at + lengths - 8] == y[b_at + lengths - 8])
    more = np.flatnonzero(same & (lengths > 16))
    if len(more):
        steps = (lengths[more] - 1) // 8 - 1  # the eights between the first and the last
        of, upto = np.repeat(more, steps), np.cumsum(steps)
        step = 8 * (np.arange(len(of)) - np.repeat(upto - steps, steps) + 1)
        same[of[x[a_at[of] + step] != y[b_at[of] + step]]] = False
    return same


class SpanEncoder:
    """Of one tokenizer file; keeps what it has encoded."""

    def __init__(self, path: str, special_as_text: bool = False):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        steps = [x["type"] for x in (norm or {}).get("normalizers", [])]
        self.kind, vocabulary = "whole", self.tokenizer.get_vocab(True)
        added = [x for x in spec.get("added_tokens") or [] if not (x.get("special") and special_as_text)]
        self.added = [x["content"].encode() for x in added]
        if any(x.get("normalized") for x in added):
            pre, norm = {}, None  # found in normalised text only, so whole texts go through the library
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and norm is None:
            self.kind = "byte"
            marked = [i for t, i in vocabulary.items() if t.startswith("Ġ")]
        elif pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("type") == "Split" and steps == ["NFC", "Replace", "Lowercase"]:
            split = pre["pretokenizers"][0]
            if split.get("invert") and split.get("behavior") == "Removed" and "\\s" in split["pattern"]["Regex"]:
                self.kind, self.pieces = "word", regex.compile(split["pattern"]["Regex"])
                marked = [i for t, i in vocabulary.items() if t.endswith("</w>")]
        if self.kind != "whole":
            self.marked = np.zeros(max(vocabulary.values()) + 1, bool)
            self.marked[marked] = True
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[int, int] = {}
        self.alike: dict[bytes, int] = {}
        self.n = 0
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.text, self.text_used = np.zeros(1 << 16, np.uint8), 0
        self.starts, self.lengths, self.text_at, self.text_len = (np.zeros(1 << 14, np.int64) for _ in range(4))

    def _single(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _several(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Joined stretches go through the library as one; marked tokens show where each begins or ends."""
        ids = np.array(self.tokenizer.encode_batch_fast([(b"" if self.kind == "byte" else b" ").join(parts).decode()], add_special_tokens=False)[0].ids, np.uint32)
        if self.kind == "byte":
            cuts = np.append(np.flatnonzero(self.marked[ids]), len(ids))
            if len(cuts) == len(parts) + 1 and cuts[0] == 0:
                return ids, np.diff(cuts)
        else:
            counts = np.cumsum([len(self.pieces.findall(unicodedata.normalize("NFC", t.decode()).lower())) for t in parts])
            ends = np.append(0, np.flatnonzero(self.marked[ids]) + 1)
            if len(ends) == counts[-1] + 1:
                return ids, np.diff(ends[np.append(0, counts)])
        return self._single([t.decode() for t in parts])

    def _learn(self, parts: list[bytes], easy: np.ndarray) -> np.ndarray:
        """A code for each of the parts. ``easy`` stretches are a blank and characters other than white space, or words."""
        out = np.zeros(len(parts), np.int64)
        todo = [(self._several, np.flatnonzero(easy)), (lambda x: self._single([t.decode() for t in x]), np.flatnonzero(~easy))]
        for encode, rows in todo:
            for at in range(0, len(rows), 2000):
                part = [parts[i] for i in rows[at : at + 2000].tolist()]
                ids, lengths = encode(part)
                raw, sizes = np.frombuffer(b"".join(part), np.uint8), np.fromiter(map(len, part), np.int64, len(part))
                first, last = self.n, self.n + len(part)
                self.flat, self.text = _room(self.flat, self.used + len(ids)), _room(self.text, self.text_used + len(raw))
                self.starts, self.lengths, self.text_at, self.text_len = (_room(x, last) for x in (self.starts, self.lengths, self.text_at, self.text_len))
                self.flat[self.used : self.used + len(ids)] = ids
                self.text[self.text_used : self.text_used + len(raw)] = raw
                self.starts[first:last], self.lengths[first:last] = self.used + np.cumsum(lengths) - lengths, lengths
                self.text_at[first:last], self.text_len[first:last] = self.text_used + np.cumsum(sizes) - sizes, sizes
                self.used, self.text_used, self.n = self.used + len(ids), self.text_used + len(raw), last
                out[rows[at : at + 2000]] = np.arange(first, last)
        return out

    def _easy(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.kind == "word":
            return np.ones(len(starts), bool)
        blanks = np.concatenate([[0], np.cumsum(white_space(data), dtype=np.int32)])
        return (data[starts] == 32) & (blanks[ends] - blanks[starts] == 1) & (ends - starts > 1)

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = (cut_spaces if self.kind == "byte" else cut_words)(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        back, keys = pd.factorize(span_keys(data, starts, ends))
        at = np.zeros(len(keys), np.int64)
        at[back[::-1]] = np.arange(len(back))[::-1]  # the first span of each key
        keys = keys.tolist()
        if self.n + len(keys) > MAX_KEPT or self.text_used > MAX_KEPT_BYTES:
            self._forget()
        known = np.fromiter((self.codes.get(k, -1) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(known < 0)
        if len(new):
            s, e = starts[at[new]], ends[at[new]]
            raw = data.tobytes()
            known[new] = self._learn([raw[a:b] for a, b in zip(s.tolist(), e.tolist())], self._easy(data, s, e))
            self.codes.update(zip([keys[i] for i in new.tolist()], known[new].tolist()))
        code = known[back]
        self._tell_apart(data, starts, ends, code)
        lengths = self.lengths[code]
        upto = np.zeros(len(code) + 1, np.int64)
        np.cumsum(lengths, out=upto[1:])
        place = np.repeat(self.starts[code] - upto[:-1], lengths)
        place += np.arange(len(place))
        return self.flat[place], upto[np.searchsorted(starts, offsets)]

    def _tell_apart(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray) -> None:
        """Gives spans whose bytes are not those of their code's stretch a code of their own."""
        long = np.flatnonzero(ends - starts > _SHORT)
        a, n, c = starts[long], ends[long] - starts[long], code[long]
        fits = n == self.text_len[c]
        fits[fits] = same_bytes(data, a[fits], self.text[: self.text_used], self.text_at[c[fits]], n[fits])
        for i in long[~fits].tolist():
            own = data[starts[i] : ends[i]].tobytes()
            if own not in self.alike:
                self.alike[own] = int(self._learn([own], self._easy(data, starts[i : i + 1], ends[i : i + 1]))[0])
            code[i] = self.alike[own]

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, offsets of each row's ids) of runs of rows; null texts are empty."""
        if self.kind == "whole":
            for i, text in enumerate(column):
                ids = self._single([text.as_py() or ""])[0]
                yield i, ids, np.array([0, len(ids)])
            return
        for first, data, offsets in slices(column):
            at = 0
            for row in [*self._spelled(data, offsets), len(offsets) - 1]:
                if row > at:
                    yield first + at, *self._slice(data[offsets[at] : offsets[row]], offsets[at : row + 1] - offsets[at])
                if row < len(offsets) - 1:
                    ids = self._single([data[offsets[row] : offsets[row + 1]].tobytes().decode()])[0]
                    yield first + row, ids, np.array([0, len(ids)])
                at = row + 1

    def _spelled(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Rows that spell out an added token."""
        raw, found = data.tobytes() if self.added else b"", set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(token) <= offsets[row + 1]:
                    found.add(row)
                    at = int(offsets[row + 1]) - 1
                at = raw.find(token, at + 1)
        return sorted(found)


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """``x``, or twice as long (or longer) with room for n."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(len(x), n - len(x)), x.dtype)])


_encoders: dict[tuple[str, bool], SpanEncoder] = {}


def encoder(path: str, special_as_text: bool = False) -> SpanEncoder:
    """This Python worker's encoder of the tokenizer file at ``path``."""
    if (path, special_as_text) not in _encoders:
        _encoders[path, special_as_text] = SpanEncoder(path, special_as_text)
    return _encoders[path, special_as_text]
