"""Token ids of whole texts by a byte-level BPE of the tokenizers library, a word at a time.

Such a tokenizer splits a text by the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

and encodes each piece alone. Here numpy finds the pieces of many texts at once, the library encodes each piece that isn't in a
bounded cache, and ids are gathered from the cache. Which class a character is of is asked of the library once for each
character that occurs, so all of Unicode is cut as it cuts it. Names of special tokens are pieces of their own. Only a text
with the noncharacter U+10FFFF, which stands between texts here, goes to the library whole. Other tokenizers are refused.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import numpy as np

from .common import _FACTOR, mix64, powers

OTHER, LETTER, NUMBER, BLANK, GAP, EDGE, SPECIAL, UNKNOWN = range(8)
_EDGE = "\U0010ffff"
_VALUE = mix64(np.arange(1, 0x110001, dtype=np.uint64))
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n bytes of eight


def piece_starts(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each code point. Texts stand between EDGEs, which count as pieces; what touches a SPECIAL ends there,
    as at an EDGE, and the caller marks where SPECIALs start."""
    before = np.empty_like(kinds)
    before[0], before[1:] = EDGE, kinds[:-1]
    gap = (kinds == BLANK) | (kinds == GAP)
    gap_before = (before == BLANK) | (before == GAP)
    hard = (kinds == EDGE) | (kinds == SPECIAL)
    starts = (kinds != before) & ~(gap & gap_before) & (before != BLANK) | hard | (gap & ~gap_before)
    # The last of several spaces before other characters stands alone or leads them.
    last = np.flatnonzero(gap[:-1] & gap_before[:-1] & ~gap[1:] & ~hard[1:])
    starts[last] = True
    marks = np.flatnonzero((points == 0x27) & starts & (kinds == OTHER))
    marks = marks[marks + 2 < len(points)]
    for ending in ("s", "t", "m", "d", "re", "ve", "ll"):
        if len(marks):
            fits = (points[marks + 1] == ord(ending[0])) & ~hard[marks + 1]
            if len(ending) == 2:
                fits &= (points[marks + 2] == ord(ending[1])) & ~hard[marks + 2]
            at = marks[fits]
            starts[at + 1] = False
            after = at + 1 + len(ending)
            starts[after[~hard[after]]] |= kinds[after[~hard[after]]] == LETTER
    return starts


def _flat(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the stretches of these lengths, one stretch after another."""
    stop = np.cumsum(lengths)
    return np.repeat(begins - (stop - lengths), lengths) + np.arange(int(stop[-1]) if len(stop) else 0)


class Words:
    """Encodes texts; one for each Python worker. The cache holds 2 ** bits pieces and about most ids."""

    def __init__(self, path: str, bits: int = 20, most: int = 3_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        form = json.loads(self.tokenizer.to_str())
        pre, added = form["pre_tokenizer"] or {}, form["added_tokens"]
        if form["normalizer"] or form["model"].get("dropout") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
            raise ValueError(f"{path}: not a byte-level tokenizer that splits by the pattern above")
        self.special = [x["content"] for x in added]
        self.named = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) or "(?!)")
        self.longest_name = max([0, *map(len, self.special)])
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.kinds[0x20], self.kinds[ord(_EDGE)] = BLANK, EDGE
        self.bits, self.most = bits, most
        self._clear()

    def _clear(self) -> None:
        n = 1 << self.bits
        self.keys, self.at, self.n = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int32)
        self.first, self.second = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.spelled, self.letters = np.zeros(n, np.int64), np.zeros(n, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.text, self.written = np.zeros(1 << 16, np.uint32), 0

    def _kind(self, character: str) -> int:
        """The class of a character: that of the letter, digit or mark that the library leaves it with."""
        for kind, beside in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(self.tokenizer.pre_tokenizer.pre_tokenize_str(beside + character)) == 1:
                return kind
        return GAP

    def _kinds_of(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kinds[points]
        if (unknown := kinds == UNKNOWN).any():
            for c in np.unique(points[unknown]).tolist():
                self.kinds[c] = self._kind(chr(c))
            kinds = self.kinds[points]
        return kinds

    def whole(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _add(self, words: list[str], spelling: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Where the ids of these pieces are in the pool from now on, and where their spelling begins."""
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(n.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.written + len(spelling) > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        at, begin = self.used + np.cumsum(n) - n, self.written
        self.pool[self.used : self.used + len(flat)] = flat
        self.text[begin : begin + len(spelling)] = spelling
        self.used += len(flat)
        self.written += len(spelling)
        return at, n, begin

    def pieces(self, texts: Sequence[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All texts between edges, its code points, each piece's begin and end there, its text's number, and whether each text is
        odd: it holds an edge itself, and has no pieces."""
        odd = np.array([_EDGE in t for t in texts], bool)
        joined = _EDGE + _EDGE.join("" if x else t for t, x in zip(texts, odd.tolist())) + _EDGE
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kinds = self._kinds_of(points)
        named = np.array([m.span() for m in self.named.finditer(joined)] if any(x in joined for x in self.special) else [], np.int64).reshape(-1, 2)
        inner = _flat(named[:, 0], named[:, 1] - named[:, 0])
        kinds[inner] = SPECIAL
        starts = piece_starts(points, kinds)
        starts[inner] = False
        starts[named[:, 0]] = starts[named[:, 1]] = True
        begins = np.flatnonzero(starts)
        ends = np.append(begins[1:], len(points))
        edge = kinds[begins] == EDGE
        text = np.cumsum(edge) - 1
        return joined, points, begins[~edge], ends[~edge], text[~edge], odd

    def _spelled(self, points: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A hash of each piece; its characters as two numbers and its length, which tell pieces of up to 16 characters below U+0100 apart;
        for other pieces these are 0 and the negative length."""
        narrow = np.append(points.astype(np.uint8), np.zeros(24, np.uint8))
        eights = np.ndarray(len(narrow) - 7, "<u8", narrow, strides=(1,))
        a, b, size = eights[begins] & _FIRST[np.minimum(lengths, 8)], eights[begins + 8] & _FIRST[np.clip(lengths - 8, 0, 8)], lengths.copy()
        wide = points > 255
        long = lengths > 16
        if wide.any():
            upto = np.append(0, np.cumsum(wide))
            long |= upto[begins + lengths] > upto[begins]
        large = np.flatnonzero(long)
        hashes = mix64(a ^ mix64(b ^ lengths.astype(np.uint64)))
        if len(large):
            own = lengths[large]
            first = np.cumsum(own) - own
            at = _flat(begins[large], own)
            sums = np.add.reduceat(_VALUE[points[at]] * powers(_FACTOR, int(own.max()))[np.arange(len(at)) - np.repeat(first, own)], first)
            hashes[large] = mix64(sums ^ own.astype(np.uint64))
            a[large] = b[large] = 0
            size[large] = -own
        return hashes, a, b, size

    def _same(self, points: np.ndarray, begins: np.ndarray, size: np.ndarray, other: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Whether each piece, its numbers being equal, is spelled as the one at others in other."""
        out = np.ones(len(begins), bool)
        large = np.flatnonzero(size < 0)
        differ = np.flatnonzero(points[_flat(begins[large], -size[large])] != other[_flat(others[large], -size[large])])
        out[large[np.searchsorted(np.cumsum(-size[large]), differ, "right")]] = False
        return out

    def located(self, joined: str, points: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece's ids are in the pool, and how many they are. A hash finds a cached piece; its spelling is compared."""
        if self.used > self.most or self.written > 4 * self.most:
            self._clear()
        lengths = ends - begins
        hashes, a, b, size = self._spelled(points, begins, lengths)
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        known = (self.letters[slot] == size) & (self.first[slot] == a) & (self.second[slot] == b) & (self.keys[slot] == hashes)
        at = np.flatnonzero(known & (size < 0))
        known[at] = self._same(points, begins[at], size[at], self.text, self.spelled[slot[at]])
        at, n = self.at[slot], self.n[slot].astype(np.int64)
        if not known.all():
            new = np.flatnonzero(~known)
            own, first, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            lead = new[first][back.reshape(-1)]
            same = (size[lead] == size[new]) & (a[lead] == a[new]) & (b[lead] == b[new])
            same[same] = self._same(points, begins[new[same]], size[new[same]], points, begins[lead[same]])
            fresh = np.append(new[first], new[~same])  # a hash of two spellings: those pieces are encoded each for itself
            new_at, new_n, spelled = self._add([joined[i:j] for i, j in zip(begins[fresh].tolist(), ends[fresh].tolist())], points[_flat(begins[fresh], lengths[fresh])])
            at[new], n[new] = new_at[back.reshape(-1)], new_n[back.reshape(-1)]
            at[new[~same]], n[new[~same]] = new_at[len(own) :], new_n[len(own) :]
            free = np.flatnonzero(self.letters[slot[new[first]]] == 0)  # rare pieces don't drive out those that came before them
            f = new[first][free]
            s = slot[f]
            self.keys[s], self.at[s], self.n[s], self.letters[s], self.first[s], self.second[s] = own[free], new_at[free], new_n[free], size[f], a[f], b[f]
            self.spelled[s] = spelled + (np.cumsum(lengths[fresh]) - lengths[fresh])[free]
        return at, n

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not len(texts):
            return []
        joined, points, begins, ends, text, odd = self.pieces(texts)
        at, n = self.located(joined, points, begins, ends)
        stop = np.cumsum(n)
        ids = self.pool[np.repeat(at - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]
        out = np.split(ids, np.cumsum(np.bincount(text, n, len(texts)).astype(np.int64))[:-1])
        which = np.flatnonzero(odd)
        for i, x in zip(which.tolist(), self.whole([texts[i] for i in which]) if len(which) else ()):
            out[i] = x
        return out


_words: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """This worker's Words for a tokenizer file."""
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]
