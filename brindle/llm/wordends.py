"""Token ids of whole texts by a lower-casing BPE with word ends, of the tokenizers library, a word at a time.

Such a tokenizer makes a text NFC, turns white space into spaces, lower-cases character by character, and splits by the pattern

    's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+

dropping white space. The pieces of many texts are found at once in numpy, as in pretokens, whose cache of encoded pieces is used. The
library is asked once for each character that occurs what it becomes and which class that has. A text goes to the library whole
where characters don't stand for themselves alone: it isn't NFC, has a character that becomes several or that this Python's Unicode
doesn't know, the name of a special token, or the noncharacter U+10FFFF. Other tokenizers are refused.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Sequence

import numpy as np

from .pretokens import _EDGE, BLANK, EDGE, GAP, LETTER, NUMBER, OTHER, UNKNOWN, Words, piece_starts

# Fixed value: the pattern that such a tokenizer splits by.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NONE = np.uint32(0xFFFFFFFF)


class WordEnds(Words):
    """Encodes texts; one for each Python worker."""

    def __init__(self, path: str, bits: int = 20, most: int = 3_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        form = json.loads(self.tokenizer.to_str())
        steps, added = (form["normalizer"] or {}).get("normalizers", []), form["added_tokens"]
        split, level = ((form["pre_tokenizer"] or {}).get("pretokenizers", []) + [{}, {}])[:2]
        fits = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
        fits &= split.get("type") == "Split" and split["pattern"] == {"Regex": _PATTERN} and split["behavior"] == "Removed" and split["invert"]
        fits &= level.get("type") == "ByteLevel" and not level["use_regex"] and not level["add_prefix_space"] and not form["model"].get("dropout")
        if not fits or any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
            raise ValueError(f"{path}: not a lower-casing tokenizer that splits by the pattern above")
        self.named = re.compile("|".join(re.escape(x["content"]) for x in added) or "(?!)")
        self.kinds, self.becomes = np.full(0x110000, UNKNOWN, np.uint8), np.zeros(0x110000, np.uint32)
        self.kinds[ord(_EDGE)], self.becomes[ord(_EDGE)] = EDGE, ord(_EDGE)
        self.bits, self.most = bits, most
        self._clear()

    def _kind(self, character: str) -> int:
        """The class of a character that needs no change."""
        pieces = lambda text: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(text))
        if pieces("a" + character) == 1 and pieces(character):
            return LETTER
        if not pieces(character):
            return GAP
        return OTHER if pieces("!" + character) == 1 else NUMBER

    def _learn(self, points: np.ndarray) -> None:
        """What the library turns these code points into, and the class of that."""
        for c in points.tolist():
            to = self.tokenizer.normalizer.normalize_str(chr(c)) if unicodedata.category(chr(c)) != "Cn" else ""
            self.becomes[c], self.kinds[c] = (ord(to), self._kind(to)) if len(to) == 1 else (_NONE, BLANK)

    def pieces(self, texts: Sequence[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All texts as they are encoded, between edges, their code points, each piece's begin and end there, its text's number, and whether
        each text is odd: it must go to the library whole, and has no pieces."""
        odd = np.array([_EDGE in t or "<" in t and self.named.search(t) is not None or not (t.isascii() or unicodedata.is_normalized("NFC", t)) for t in texts], bool)
        while True:
            joined = _EDGE + _EDGE.join("" if x else t for t, x in zip(texts, odd.tolist())) + _EDGE
            raw = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            kinds = self.kinds[raw]
            if (unknown := kinds == UNKNOWN).any():
                self._learn(np.unique(raw[unknown]))
                kinds = self.kinds[raw]
            points = self.becomes[raw]
            if not (several := points == _NONE).any():
                break
            odd[(np.cumsum(raw == ord(_EDGE)) - 1)[several]] = True
        starts = piece_starts(points, kinds) | (kinds == NUMBER)
        begins = np.flatnonzero(starts)
        ends = np.append(begins[1:], len(points))
        kind = kinds[begins]
        text, word = np.cumsum(kind == EDGE) - 1, (kind != EDGE) & (kind != GAP)
        return points.tobytes().decode("utf-32-le"), points, begins[word], ends[word], text[word], odd


_words: dict[str, WordEnds] = {}


def words_of(path: str) -> WordEnds:
    """This worker's WordEnds for a tokenizer file."""
    if path not in _words:
        _words[path] = WordEnds(path)
    return _words[path]
