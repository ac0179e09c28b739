"""Toxicity: learned terms, found misspelled too, and weighed by their context.

Terms are words, and stems of words with varying ends, that many different contexts of toxic training documents hold and clean ones
hardly do; they stand in a trie. A word is looked up by running its Levenshtein automaton (substitution, insertion, deletion,
transposed neighbours) along the trie: each trie node holds the automaton's states as a row of distances, a branch is left when no
state is within reach. Numpy does this for all new words of a batch at once. How many edits a term bears is learned from what
they would find in clean documents. Scripts that put no spaces between words have no words to look up: terms are learned from the
letters at every offset of their runs, and looked up at every offset; of hits that differ by an edit next to a nearer one the nearer stays.

A hit's context is the words around it and whether it stands in quotation marks. Which contexts speak for abuse and which for
quotation is learned, too: hits of clean documents (reports, quotations, other meanings) and of toxic ones have other words
around them, and each word's log odds count. A logistic layer over the sums of both kinds of hits scores the document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import blank_marks, drop, not_made, slices, span_hashes, spill, utf8, word_spans
from .quality import sample

#: Bound of the training sample: documents of each label.
SAMPLE_DOCS = 3000
#: Words on either side of a hit that its context takes in; the letters of a term's beginning that are looked at.
WINDOW, STEM = 8, (4, 16)

_JOINS = np.zeros(256, bool)  # bytes inside words: letters, digits, signs that stand for letters
_JOINS[128:] = True
_JOINS[[ord(c) for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ*@$!'"]] = True
_SOLID = _JOINS.copy()  # those that a word begins and ends with
_SOLID[[ord(c) for c in "*@$!'"]] = False
_FLAT = np.where(_JOINS, np.arange(256), 32).astype(np.uint8)
_FLAT[65:91] += 32

# Blocks of scripts without spaces between words (Thai, Lao, Myanmar, Khmer, kana, Han), first and last code points.
_UNSPACED = ((0x0E01, 0x0E4E), (0x0E81, 0x0EDF), (0x1000, 0x103F), (0x1780, 0x17D3), (0x3041, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFD))
#: The same as a class of Java's patterns; letters of a term in such a script that are looked at.
UNSPACED, GRAM = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in _UNSPACED), (2, 8)
# Blocks of wide punctuation, which ends words as a space does.
_WIDE_MARKS = ((0x3000, 0x3020), (0x3030, 0x3030), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))
_wide = np.zeros(0x110000, np.uint8)  # 1: a letter of such a script, 2: wide punctuation
for _kind, _blocks in ((1, _UNSPACED), (2, _WIDE_MARKS)):
    for _a, _b in _blocks:
        _wide[_a : _b + 1] = _kind


def wide_letters(whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each letter of a script without spaces in UTF-8, and the begins of wide punctuation, of three bytes each."""
    at = np.flatnonzero(whole >= 0xE0)
    if not len(at):
        return at, at, at
    b = [whole[np.minimum(at + k, len(whole) - 1)].astype(np.int64) & 0x3F for k in range(4)]
    four = whole[at] >= 0xF0
    point = np.where(four, (b[0] & 7) << 18 | b[1] << 12 | b[2] << 6 | b[3], (b[0] & 15) << 12 | b[1] << 6 | b[2])
    kind = _wide[np.minimum(point, 0x10FFFF)]
    return at[kind == 1], (at + 3 + four)[kind == 1], at[kind == 2]


def _unspaced(term: str) -> bool:
    return _wide[ord(term[0])] == 1


def longest_reach(term: str) -> int:
    """Edits at which a word may still count as the term."""
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


#: Bytes of words that the cache of lookups holds; masks of the first 0 to 8 bytes of a number.
KNOWN = 32
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Stands for quotation marks in a context.
QUOTED = np.uint64(1)


class Trie:
    """terms; stems: whether a word that only begins with the term counts; reach: edits that count."""

    def __init__(self, terms: Sequence[str], stems: Sequence[bool], reach: Sequence[int]):
        self.terms, self.stems, self.reach = list(terms), list(stems), list(reach)
        self.root: dict = {}
        for i, term in enumerate(self.terms):
            node = self.root
            for c in term:
                node = node.setdefault(ord(c), {})
            node[-1] = i
        self.most = max([0, *self.reach])
        self.wide = max([0, *map(len, self.terms)]) + self.most

    def find(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The nearest term within its reach for each word, -1 for none, and the distance. Ties go to the first term in the trie."""
        best, distance = np.full(len(words), -1, np.int32), np.full(len(words), 99, np.int32)
        fits = np.array([i for i, w in enumerate(words) if w], np.int64)
        if not len(fits) or not self.terms:
            return best, np.where(best < 0, 0, distance)
        wide = self.wide
        letters = np.full((wide, len(fits)), -2, np.int32)
        length = np.array([len(words[i]) for i in fits])
        long = np.minimum(length, wide)
        for k, i in enumerate(fits.tolist()):
            letters[: long[k], k] = np.frombuffer(words[i][:wide].encode("utf-32-le", "surrogatepass"), np.int32)

        def walk(node: dict, row: np.ndarray, above: np.ndarray | None, char: int, live: np.ndarray) -> None:
            own = letters[:, live]
            for c, child in node.items():
                if c == -1:
                    at = fits[live]
                    if self.stems[child]:
                        d = row.min(0)
                    else:
                        d = np.where(length[live] > wide, 99, row[long[live], np.arange(len(live))])
                    better = (d <= self.reach[child]) & (d < distance[at])
                    best[at[better]], distance[at[better]] = child, d[better]
                    continue
                new = np.empty_like(row)
                new[0] = row[0] + 1
                for j in range(1, wide + 1):
                    np.minimum(np.minimum(row[j], new[j - 1]) + 1, row[j - 1] + (own[j - 1] != c), out=new[j])
                    if above is not None and j > 1:
                        swap = (own[j - 1] == char) & (own[j - 2] == c)
                        new[j][swap] = np.minimum(new[j], above[j - 2] + 1)[swap]
                # An edit that swaps letters reaches over one row, so the row above counts too.
                near = np.flatnonzero(np.minimum(new.min(0), row.min(0)) <= self.most)
                if len(near):
                    walk(child, new[:, near], row[:, near], c, live[near])

        walk(self.root, np.tile(np.arange(wide + 1, dtype=np.int32)[:, None], (1, len(fits))), None, -1, np.arange(len(fits)))
        return best, np.where(best < 0, 0, distance)


@dataclass
class Context:
    """Log odds of abuse by the hash of a word near a hit (in order), and those of a hit without any."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    base: float = 2.0

    def abuse(self, words: np.ndarray, there: np.ndarray) -> np.ndarray:
        """How far each row of words (where there) speaks for abuse, 0 to 1."""
        total = np.full(len(words), self.base)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
            total += np.where(there & (self.keys[at] == words), self.odds[at], 0).sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -20, 20)))


@dataclass
class Lexicon:
    terms: list[str]
    stems: list[bool]
    reach: list[int]
    weights: np.ndarray
    context: Context = field(default_factory=Context)
    _trie: Trie | None = field(default=None, repr=False)
    _keys: np.ndarray | None = field(default=None, repr=False)
    _found: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> tuple:
        return self.terms, self.stems, self.reach, self.weights, self.context

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def _open(self) -> Trie:
        if self._trie is None:
            self._trie, self._keys, self._found = Trie(self.terms, self.stems, self.reach), np.zeros((1 << 18, KNOWN // 8 + 1), np.uint64), np.zeros((1 << 18, 2), np.int32)
        return self._trie

    def lookup(self, part: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term (-1: none) and distance of the words part[starts:ends], which have these hashes. A cache of 2 ** 18 words saves the walks of
        frequent ones; it holds the words of up to KNOWN bytes, which are compared, and longer ones are walked each time they are met."""
        trie = self._open()
        size, padded = ends - starts, np.append(part, np.zeros(KNOWN, np.uint8))
        eights = np.ndarray(len(part) + KNOWN - 7, "<u8", padded, strides=(1,))  # the eight bytes from each place on
        key = np.empty((len(starts), KNOWN // 8 + 1), np.uint64)
        for k in range(KNOWN // 8):
            key[:, k] = eights[np.minimum(starts + 8 * k, len(part))] & _FIRST[np.clip(size - 8 * k, 0, 8)]
        key[:, -1] = size
        slot = (hashes >> np.uint64(46)).astype(np.int64)
        out = self._found[slot]
        new = np.flatnonzero((self._keys[slot] != key).any(1) | (size > KNOWN))
        if len(new):
            raw, most = part.tobytes(), 4 * trie.wide + 4  # bytes that hold enough of a word
            number: dict[bytes, int] = {}
            back = np.array([number.setdefault(raw[i : min(j, i + most)], len(number)) for i, j in zip(starts[new].tolist(), ends[new].tolist())])
            found = np.stack(trie.find([w.decode("utf-8", "replace").lower() for w in number]), 1)
            out[new] = found[back]
            short = new[size[new] <= KNOWN]
            self._keys[slot[short]], self._found[slot[short]] = key[short], out[short]
        return out[:, 0], out[:, 1]


#: Per document: sums of weights in abuse and in quotation, of exact terms and of misspelled ones; the strongest abuse; its density.
FEATURES = 6


@dataclass
class Hits:
    """Row of its text, byte span in it, term and distance of each hit; the hashes of its context, and where there are any."""

    row: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    term: np.ndarray
    distance: np.ndarray
    words: np.ndarray
    there: np.ndarray


def hits(lexicon: Lexicon, data: np.ndarray, offsets: np.ndarray) -> tuple[Hits, np.ndarray]:
    """All hits in the texts, and the number of words of each text. In scripts without spaces each letter begins a word for the lookup, which
    goes on to the end of its run, and counts as half a word; in a context a letter and its next stand for a word."""
    base = offsets[0]
    whole = data[base : offsets[-1]]
    part = _FLAT[whole]
    blank_marks(whole, part)
    letter, stop, marks = wide_letters(whole)
    part[marks[:, None] + np.arange(3)] = 32
    spaced = part
    if len(letter):
        change = np.zeros(len(part) + 1, np.int64)
        change[letter] += 1
        change[stop] -= 1
        spaced = np.where(np.cumsum(change)[:-1] > 0, np.uint8(32), part)
    starts, ends, row = word_spans(spaced, offsets - base)
    solid = np.flatnonzero(_SOLID[spaced])
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
    keep = low <= high
    starts, ends, row = solid[low[keep]], solid[high[keep]] + 1, row[keep]
    count = np.bincount(row, minlength=len(offsets) - 1)
    hashes = span_hashes(part, starts, ends)
    term, distance = lexicon.lookup(part, starts, ends, hashes)
    if len(letter):
        own = np.searchsorted(offsets[1:] - base, letter, "right")
        count = count + (np.bincount(own, minlength=len(count)) + 1) // 2
        grams = _letter_hits(lexicon, part, letter, stop, own)
        order = np.argsort(np.append(starts, letter), kind="stable")
        starts, ends, row, hashes, term, distance = (np.append(a, b)[order] for a, b in zip((starts, ends, row, hashes, term, distance), (letter, grams[0], own, *grams[1:])))
    at = np.flatnonzero(term >= 0)
    near = at[:, None] + np.array([k for k in range(-WINDOW, WINDOW + 1) if k])
    inside = np.clip(near, 0, max(len(row) - 1, 0))
    there = (near == inside) & (row[inside] == row[at, None]) if len(at) else np.zeros(near.shape, bool)
    # In quotation marks: an odd number of straight ones before it in its text and one behind, or an open pair of others.
    marks, opened = np.append(0, np.cumsum(whole == 0x22)), np.append(0, _openings(whole))
    r = row[at]
    first, stop, b, e = offsets[r] - base, offsets[r + 1] - base, starts[at], ends[at]
    quoted = ((marks[b] - marks[first]) % 2 == 1) & (marks[stop] > marks[e]) | (opened[b] > opened[first])
    words = np.column_stack([hashes[inside] if len(at) else np.zeros(near.shape, np.uint64), np.full(len(at), QUOTED)])
    return Hits(r, b - first, e - first, term[at], distance[at], words, np.column_stack([there, quoted])), count


def _letter_hits(lexicon: Lexicon, part: np.ndarray, letter: np.ndarray, stop: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each letter of a script without spaces: where its hit ends (or the letter itself), its hash in contexts, term and distance."""
    n = len(letter)
    last = np.append(np.flatnonzero((stop[:-1] != letter[1:]) | (row[:-1] != row[1:])), n - 1)
    last = last[np.searchsorted(last, np.arange(n))]  # the last letter of each one's run
    reach = lambda k: stop[np.minimum(np.arange(n) + k, last)]
    longest = max([0, *(len(t) for t in lexicon.terms if _unspaced(t))])
    if not longest:
        return stop, span_hashes(part, letter, reach(1)), np.full(n, -1, np.int32), np.zeros(n, np.int32)
    wide = reach(longest + lexicon._open().most - 1)
    term, distance = lexicon.lookup(part, letter, wide, span_hashes(part, letter, wide))
    most = np.where(term >= 0, distance, 99)
    for k in range(1, lexicon._open().most + 1):  # an edit next to a hit: the nearer one stays, or the first
        worse = np.zeros(n, bool)
        joined = (last[:-k] == last[k:]) if n > k else np.zeros(0, bool)
        if len(joined):
            worse[k:] |= joined & (most[k:] > 0) & (most[:-k] <= most[k:])
            worse[:-k] |= joined & (most[:-k] > 0) & (most[k:] < most[:-k])
        term = np.where(worse, -1, term)
    ends = reach(np.maximum(np.array([*map(len, lexicon.terms), 1])[term], 1) - 1)
    return ends, span_hashes(part, letter, reach(1)), term, np.where(term >= 0, distance, 0)


def _openings(whole: np.ndarray) -> np.ndarray:
    """How many more opening quotation marks than closing ones stand up to each byte."""
    change = np.zeros(len(whole), np.int64)
    for signs, by in ((("“", "«", "「", "『"), 1), (("”", "»", "」", "』"), -1)):
        for sign in map(str.encode, signs):
            found = np.ones(max(0, len(whole) - len(sign) + 1), bool)
            for k, c in enumerate(sign):
                found &= whole[k : k + len(found)] == c
            change[: len(found)] += by * found
    return np.cumsum(change)


def features(lexicon: Lexicon, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Hits, np.ndarray]:
    """Features of the texts, their hits, and how far each hit's context speaks for abuse."""
    found, words = hits(lexicon, data, offsets)
    abuse, rows = lexicon.context.abuse(found.words, found.there), len(offsets) - 1
    x = np.zeros((rows, FEATURES))
    weight = lexicon.weights[found.term] / (1 + found.distance) if len(found.term) else np.zeros(0)
    for k, part in enumerate((abuse, 1 - abuse)):
        for near in (0, 1):
            own = (found.distance > 0) == near
            x[:, 2 * near + k] = np.bincount(found.row[own], (weight * part)[own], rows)
    np.maximum.at(x[:, 4], found.row, weight * abuse)
    x[:, 5] = (x[:, 0] + x[:, 2]) / np.sqrt(np.maximum(1, words))
    return np.log1p(x), found, abuse


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def learn_terms(texts: DataFrame, *, odds: float = 8.0, chance: float = 0.1, contexts: int = 3) -> Lexicon:
    """From texts(doc_id, text, label): words of two or three letters and beginnings of longer ones (STEM letters) whose rate in toxic
    documents is odds times that in clean ones, more often than chance gives: of all beginnings that are looked at, about chance would pass
    the likelihood ratio test if labels meant nothing. A document counts once for each different word before the term, at least contexts
    of them, so copies of one document don't make a term. The test alone decides how much is enough, for a sample of any size. Of
    beginnings of each other the one with most contexts and odds stays. It is a stem if it goes on in several ways, or in one beyond STEM.
    In scripts without spaces, the GRAM letters from each offset of a run are such beginnings, two letters before them the context; of
    those that lie in each other one stays, and each is a stem.
    There is no limit on terms: those of a bounded sample are bounded."""
    text = F.lower(F.coalesce("text", F.lit("")))
    words = F.filter(F.split(text, rf"(?:[^\p{{L}}\p{{M}}]|[{UNSPACED}])+"), lambda w: F.length(w) > 0)
    pairs = texts.select("doc_id", "label", F.explode(F.arrays_zip(words.alias("w"), F.concat(F.array(F.lit("")), words).alias("l"))).alias("x")).where(F.length("x.w") >= 2)
    per_doc = pairs.groupBy("doc_id", "label", F.col("x.w").alias("word")).agg(F.min("x.l").alias("left"))
    cuts = lambda least, most: F.transform(F.sequence(F.lit(least), F.least(F.length("word"), F.lit(most))), lambda n: F.substring("word", F.lit(1), n))
    begins = per_doc.select("*", F.explode(F.when(F.length("word") < STEM[0], F.array("word")).otherwise(cuts(*STEM))).alias("begin"))
    # At each offset of a run without spaces: two letters before it, and up to GRAM letters of it.
    offsets = F.explode(F.regexp_extract_all(F.concat(F.lit("  "), text), F.lit(rf"(?s)(?=(..[{UNSPACED}]{{{GRAM[0]},{GRAM[1]}}}))"), F.lit(1)))
    grams = texts.where(F.col("text").rlike(f"[{UNSPACED}]{{2}}")).select("doc_id", "label", offsets.alias("x"))
    grams = grams.select("doc_id", "label", F.expr("substring(x, 3)").alias("word"), F.substring("x", 1, 2).alias("left"))
    begins = begins.unionByName(grams.groupBy("doc_id", "label", "word").agg(F.min("left").alias("left")).select("*", F.explode(cuts(*GRAM)).alias("begin")))
    per_doc = begins.groupBy("doc_id", "label", "begin").agg(F.min("left").alias("left"), F.min("word").alias("word"))
    per_doc = spill(per_doc)
    counts = per_doc.groupBy("begin").agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("clean"), F.count_if((F.col("label") == 1) & (F.col("word") == F.col("begin"))).alias("alone"))
    counts = spill(counts.where(F.col("toxic") >= contexts))
    drawn = counts.count()
    sizes = {r.label: r["count"] for r in texts.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    rate = lambda n: F.log((n + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    likely = counts.where(rate(F.col("toxic")) > float(np.log(odds)))
    left = per_doc.where("label = 1").groupBy("begin").agg(F.count_distinct("left").alias("contexts"), F.count_distinct("word").alias("forms"))
    seen, share = F.least("toxic", "contexts"), toxic / max(1, toxic + clean)
    part = lambda n, p: F.when(n > 0, n * F.log(n / (p * (seen + F.col("clean"))))).otherwise(0.0)
    evidence = part(seen, share) + part(F.col("clean"), 1 - share)
    found = likely.join(left, "begin").where((F.col("contexts") >= contexts) & (evidence > float(np.log(max(1, drawn) / chance)))).withColumn("weight", rate(seen)).collect()
    drop(per_doc)
    drop(counts)
    chosen, begun = {}, set()
    for r in sorted(found, key=lambda r: (-r.contexts * r.weight**2, -len(r.begin), r.begin)):
        unspaced = _unspaced(r.begin)
        parts = [r.begin[m:n] for m in range(len(r.begin) if unspaced else 1) for n in range(m + 1, len(r.begin) + 1)]
        if r.begin not in begun and not any(p in chosen for p in parts):
            chosen[r.begin] = r
            begun.update(parts)
    stems = [_unspaced(t) or (r.forms > 2 or len(t) == STEM[1]) and r.alone < 0.8 * r.toxic for t, r in chosen.items()]
    return Lexicon(list(chosen), stems, [longest_reach(t) for t in chosen], np.array([r.weight for r in chosen.values()]))


def learn_reach(lexicon: Lexicon, texts: DataFrame, *, odds: float = 8.0) -> Lexicon:
    """The lexicon with edits only where the documents they find are toxic odds times as often as all; a term of which nothing is
    found that way keeps its edits, unless it is a stem."""
    sent = texts.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                label = part.column("label").to_pylist()
                h = hits(sent.value, *utf8(part.column("text")))[0]
                seen = np.unique(np.column_stack([h.row, h.term, h.distance])[h.distance > 0], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(seen[:, 1], pa.int32()), pa.array(seen[:, 2], pa.int32()), pa.array([label[i] for i in seen[:, 0]], pa.int32())], ["term", "distance", "label"])

    counts = texts.select("label", "text").mapInArrow(run, "term int, distance int, label int").groupBy("term", "distance").agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("clean")).collect()
    found = {(r.term, r.distance): r for r in counts}
    reach = []
    for i, most in enumerate(lexicon.reach):
        good = 0
        for d in range(1, most + 1):
            r = found.get((i, d))
            if not (r.toxic + 0.5 > odds * r.clean if r else not lexicon.stems[i]):
                break
            good = d
        reach.append(good)
    return Lexicon(lexicon.terms, lexicon.stems, reach, lexicon.weights, lexicon.context)


def learn_context(lexicon: Lexicon, texts: DataFrame, *, least: int = 5, doubt: float = 20.0) -> Lexicon:
    """The lexicon with its context learned: for each word (and quotation marks) near the hits of at least least documents, the log odds of
    standing near a hit in a toxic document against a clean one. doubt is how many documents of the common rate are added to both,
    so that rare words, or a label without hits, say little."""
    sent = texts.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                label = np.array(part.column("label").to_pylist(), np.int64)
                h = hits(sent.value, *utf8(part.column("text")))[0]
                rows = np.broadcast_to(h.row[:, None], h.words.shape)[h.there]
                pairs = np.unique(np.column_stack([np.append(rows, np.unique(h.row)), np.append(h.words[h.there], np.zeros(len(np.unique(h.row)), np.uint64)).view(np.int64)]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1]), pa.array(label[pairs[:, 0]])], ["word", "label"])

    near = texts.select("label", "text").mapInArrow(run, "word long, label long")  # word 0: a document with hits
    counts = near.groupBy("word").agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("clean")).where((F.col("toxic") + F.col("clean") >= least) | (F.col("word") == 0)).collect()
    word, toxic, clean = (np.array([r[k] for r in counts], np.int64) for k in range(3))
    all_toxic, all_clean = int(toxic[word == 0].sum()), int(clean[word == 0].sum())
    common = doubt * (toxic + clean + 1) / (all_toxic + all_clean + 2)
    odds = np.log((toxic + common) / (all_toxic + doubt)) - np.log((clean + common) / (all_clean + doubt))
    order = np.argsort(word.view(np.uint64))
    order = order[word[order] != 0]
    context = Context(word.view(np.uint64)[order], np.clip(odds[order], -2, 2), float(np.clip(np.log((all_toxic + 1) / (all_clean + 1)), -2, 2)))
    return Lexicon(lexicon.terms, lexicon.stems, lexicon.reach, lexicon.weights, context)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", *, per_label: int = SAMPLE_DOCS, seed: int = 0) -> Model:
    """Learns terms, contexts and the logistic layer from the documents that labels(doc_id, label) names, at most per_label of each label.

    Null ids and labels other than 0 and 1 are left out, as are ids with both; a repeated label counts once, a repeated document each
    time. Which documents are taken, and so the model, depends on ids and seed only. Null and empty texts are documents without
    words; texts of any length are read whole. Other columns are ignored. With no labels, or one, the score is constant.
    """
    texts = spill(sample(docs, labels, label, per_label, seed))
    lexicon = learn_context(learn_reach(learn_terms(texts), texts), texts)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = features(sent.value, *utf8(part.column("text")))[0]
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["label", "x"])

    rows = sorted((r.label, tuple(r.x)) for r in texts.select("label", "text").mapInArrow(run, "label int, x array<double>").collect())
    y, x = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows]).reshape(len(rows), FEATURES)
    if not len(y) or y.min() == y.max():
        return Model(lexicon, np.zeros(FEATURES), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    weights = np.zeros(FEATURES + 1)
    z = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag([0.1] * FEATURES + [1e-6])
    for _ in range(60):  # Newton's method with a ridge
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (p - y) + ridge @ weights)
        weights -= step / max(1, np.abs(step).max() / 2)
    return Model(lexicon, weights[:-1], float(weights[-1]))


_HIT = {"term": "string", "begin": "long", "end": "long", "distance": "int", "abuse": "double"}


def score(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of docs(text, ...), score (0 to 1) and hits: an array of term, begin and end (bytes of the text), distance, and how
    far the context speaks for abuse. A null or empty text has no hits and gets the score of such texts. One row for each row of
    docs, repeated ones too; of terms at equal distance the first in the trie is the hit. Texts of any length are one row of a task.
    Other columns are ignored; ValueError if keep names score or hits. Empty in, empty out."""
    not_made(keep, ("score", "hits", "_text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        terms = pa.array(m.lexicon.terms, pa.string())
        for batch in batches:
            for part in slices(batch, "_text"):
                x, h, abuse = features(m.lexicon, *utf8(part.column("_text")))
                values = [terms.take(pa.array(h.term)), pa.array(h.begin, pa.int64()), pa.array(h.end, pa.int64()), pa.array(h.distance, pa.int32()), pa.array(abuse, pa.float64())]
                ends = np.append(0, np.cumsum(np.bincount(h.row, minlength=part.num_rows))).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(values, list(_HIT)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(m.score(x), pa.float64()), listed], [*keep, "score", "hits"])

    schema = docs.select(*keep).schema.add("score", "double").add("hits", ArrayType(StructType.fromDDL(", ".join(f"{n} {t}" for n, t in _HIT.items()))))
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)
