"""Quality classifier: attention-based multiple-instance learning over a document's passages.

Every passage of WORDS words becomes a vector of shares of character classes and of repeated words. A hidden layer encodes it,
gated attention (tanh times sigmoid) weighs the passages of a document, and a logistic layer scores the weighted mean. Only
document labels are known; the weights of passages are learned from them. Numpy trains it on all passages of a bounded sample of
labelled documents, in batches of bounded size; scoring runs over whole texts in map tasks.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, drop, not_made, slices, span_hashes, spill, utf8, word_spans

WORDS = 64
#: Bound of the training sample: documents of each label.
SAMPLE_DOCS = 3000
#: Passages of a training batch (or one document's), steps of Adam, and bytes of features that the driver keeps between epochs; more
#: are read again from the shared folder in each.
BATCH, STEPS, KEPT = 16_384, 300, 64 << 20

_CLASS = np.full(256, 5, np.int64)  # bytes of characters beyond ASCII
_CLASS[:128] = 6
_CLASS[SPACE] = 0
_CLASS[10] = 1
for _i, _range in ((2, b"0123456789"), (3, bytes(range(97, 123))), (4, bytes(range(65, 91)))):
    _CLASS[list(_range)] = _i
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS[_MARKS] = 7 + np.arange(len(_MARKS))
CLASSES = 7 + len(_MARKS)
FEATURES = CLASSES + 6


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts data[offsets[i]:offsets[i + 1]], and the text of each. A text without words has one."""
    rows = len(offsets) - 1
    base = offsets[0]
    part = data[base : offsets[-1]]
    starts, ends, row = word_spans(data, offsets)
    per_row = np.bincount(row, minlength=rows)
    first = np.cumsum(per_row) - per_row
    n_passages = np.maximum(1, -(-per_row // WORDS))
    first_passage = np.cumsum(n_passages) - n_passages
    of_word = first_passage[row] + (np.arange(len(row)) - first[row]) // WORDS
    total = int(n_passages.sum())
    of = np.repeat(np.arange(rows), n_passages)
    # A passage's bytes run from its first word, or its text's begin, to the next passage's.
    begin = offsets[:-1][of] - base
    later = np.flatnonzero(np.diff(of_word, prepend=-1))
    later = later[of_word[later] != first_passage[row[later]]]
    begin[of_word[later]] = starts[later]
    length = np.diff(np.append(begin, len(part)))
    shares = np.bincount(np.repeat(np.arange(total) * CLASSES, length) + _CLASS[part], minlength=total * CLASSES).reshape(total, CLASSES)
    hashes = span_hashes(part, starts, ends)
    n = np.maximum(1, np.bincount(of_word, minlength=total))
    new = (np.diff(of_word, prepend=-1) != 0)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & ~new[1:]
    different = np.unique(hashes ^ (of_word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    long = ends - starts
    out = np.empty((total, FEATURES), np.float32)
    out[:, :CLASSES] = shares / np.maximum(1, length)[:, None]
    out[:, CLASSES] = np.bincount(of_word, again, total) / n
    out[:, CLASSES + 1] = np.bincount(of_word[different], minlength=total) / n
    out[:, CLASSES + 2] = np.bincount(of_word, long, total) / n / 10
    out[:, CLASSES + 3] = np.bincount(of_word, long <= 2, total) / n
    out[:, CLASSES + 4] = np.bincount(of_word, long > 20, total) / n
    out[:, CLASSES + 5] = np.minimum(1, np.bincount(of_word, minlength=total) / WORDS)
    return out, of


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    prior: float

    def forward(self, x: np.ndarray, bag: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        """x: features of instances in the order of their bags 0 .. bags - 1; every bag has one."""
        w = self.weights
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        hidden = np.tanh(x @ w["encode"] + w["encode_bias"])
        content, gate = np.tanh(hidden @ w["content"]), 1 / (1 + np.exp(-(hidden @ w["gate"])))
        raw = (content * gate) @ w["attend"]
        first = np.flatnonzero(np.diff(bag, prepend=-1))
        e = np.exp(raw - np.maximum.reduceat(raw, first)[bag])
        attention = e / np.add.reduceat(e, first)[bag]
        pooled = np.add.reduceat(attention[:, None] * hidden, first)
        logit = pooled @ w["out"] + w["bias"][0]
        return {"x": x, "hidden": hidden, "content": content, "gate": gate, "attention": attention, "pooled": pooled, "first": first, "score": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))}

    def score(self, x: np.ndarray, bag: np.ndarray, bags: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the bags and the attention of each instance."""
        if not self.weights:
            return np.full(bags, self.prior), 1 / np.bincount(bag, minlength=bags)[bag]
        out = self.forward(x, bag, bags)
        return out["score"], out["attention"]


Batch = tuple[np.ndarray, np.ndarray, np.ndarray]  # features, the bag of each instance, labels of the bags


def train(batches: Callable[[], Iterable[Batch]], *, hidden: int = 16, gates: int = 8, steps: int = STEPS, rate: float = 0.03, decay: float = 1e-3, seed: int = 0) -> Model:
    """Adam on the mean log loss, both labels weighing the same; batches() gives an epoch's batches, in the same order each time. A first
    epoch finds means, spreads and shares of labels. One label only, or no bags: a constant score."""
    n, sums, squares, bags, good, epoch = 0, 0.0, 0.0, 0, 0.0, 0
    for x, _, labels in batches():
        n, sums, squares = n + len(x), sums + x.sum(0, dtype=float), squares + (x.astype(float) ** 2).sum(0)
        bags, good, epoch = bags + len(labels), good + labels.sum(), epoch + 1
    prior = float(good / bags) if bags else 0.5
    if not bags or prior in (0.0, 1.0):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), {}, prior)
    mean = sums / n
    random = np.random.default_rng(seed)
    normal = lambda *shape: random.normal(0, 1 / np.sqrt(shape[0]), shape)
    weights = {"encode": normal(len(mean), hidden), "encode_bias": np.zeros(hidden), "content": normal(hidden, gates), "gate": normal(hidden, gates), "attend": normal(gates), "out": normal(hidden), "bias": np.zeros(1)}
    model = Model(mean, np.sqrt(np.maximum(0, squares / n - mean**2)) + 1e-3, weights, prior)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    step = 0
    for _ in range(-(-steps // epoch)):
        for x, bag, labels in batches():
            step += 1
            cost = np.where(labels == 1, 0.5 / prior, 0.5 / (1 - prior)) / len(labels)
            for k, g in slopes(model, x, bag, labels, cost).items():
                w, (m, v) = weights[k], moments[k]
                g = g + decay * w * (k != "bias")
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * min(1.0, 2 - 2 * step / (steps + epoch)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def slopes(model: Model, x: np.ndarray, bag: np.ndarray, labels: np.ndarray, cost: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the sum of cost times log loss of the bags."""
    f, w = model.forward(x, bag, len(labels)), model.weights
    error = (f["score"] - labels) * cost
    d_pooled = error[:, None] * w["out"]
    d_attention = (d_pooled[bag] * f["hidden"]).sum(1)
    inner = np.add.reduceat(f["attention"] * d_attention, f["first"])
    d_raw = f["attention"] * (d_attention - inner[bag])
    d_content = d_raw[:, None] * w["attend"] * f["gate"] * (1 - f["content"] ** 2)
    d_gate = d_raw[:, None] * w["attend"] * f["content"] * f["gate"] * (1 - f["gate"])
    d_hidden = f["attention"][:, None] * d_pooled[bag] + d_content @ w["content"].T + d_gate @ w["gate"].T
    d_before = d_hidden * (1 - f["hidden"] ** 2)
    return {"encode": f["x"].T @ d_before, "encode_bias": d_before.sum(0), "content": f["hidden"].T @ d_content, "gate": f["hidden"].T @ d_gate, "attend": (f["content"] * f["gate"]).T @ d_raw, "out": f["pooled"].T @ error, "bias": np.array([error.sum()])}


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            x, of = passages(*utf8(part.column("text")))
            split = np.split(x, np.flatnonzero(np.diff(of)) + 1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([v.tobytes() for v in split], pa.binary())], ["doc_id", "label", "x"])


def sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int, seed: int = 0) -> DataFrame:
    """doc_id, text, label of at most per_label labelled documents of each label 0 and 1, in the order of a hash of the id. The ids
    are so bounded that they can be broadcast. Labels that contradict each other or are neither 0 nor 1 are left out."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("_most")).where("label = _most").select("doc_id", "label")
    order = F.xxhash64(F.lit(seed), "doc_id")
    chosen = None
    for y in (0, 1):
        ids = known.where(F.col("label") == y).orderBy(order, "doc_id").limit(per_label)
        chosen = ids if chosen is None else chosen.unionByName(ids)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def _batches(rows: Iterable, size: int) -> Iterator[Batch]:
    """Documents in batches of about size passages."""
    held, n = [], 0
    for r in itertools.chain(rows, [None]):
        x = np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) if r is not None else None
        if held and (x is None or n + len(x) > size):
            yield np.concatenate([v for v, _ in held]), np.repeat(np.arange(len(held)), [len(v) for v, _ in held]), np.array([y for _, y in held], float)
            held, n = [], 0
        if x is not None:
            held.append((x, r.label))
            n += len(x)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", *, per_label: int = SAMPLE_DOCS, seed: int = 0, kept: int = KEPT) -> Model:
    """Learns from all passages of the documents that labels(doc_id, label) names, at most per_label of each label.

    Null ids and labels other than 0 and 1 are left out, as are ids with both; a repeated label counts once, a repeated document each
    time. The order of documents is that of a hash, so that the model depends on ids, texts and seed only. Null and empty texts are one
    empty passage. Features wait in the shared folder; the driver holds a batch (a document, if that is longer), or all of them
    where they are at most kept bytes. Other columns are ignored. With no labels, or one, the score is constant.
    """
    made = spill(sample(docs, labels, label, per_label, seed).mapInArrow(_featurize, "doc_id long, label int, x binary"))
    rows = made.orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", F.md5("x")).select("label", "x")
    total = made.agg(F.sum(F.octet_length("x"))).first()[0] or 0
    held = rows.collect() if total <= kept else None
    model = train(lambda: _batches(held if held is not None else rows.toLocalIterator(), BATCH), seed=seed)
    drop(made)
    return model


def score(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of docs(text, ...), score (0 to 1), passages, best_passage (the one of most attention, from 0; the first of equal
    ones), its attention. A null, empty or blank text is one empty passage and is scored like any other. One row for each row of docs,
    repeated ones too; a text of any length is one row of a task. Other columns are ignored; ValueError if keep names a column that is
    made here. Empty in, empty out."""
    not_made(keep, ("score", "passages", "best_passage", "attention", "_text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                x, of = passages(*utf8(part.column("_text")))
                s, attention = sent.value.score(x, of, part.num_rows)
                n = np.bincount(of, minlength=part.num_rows)
                first = np.cumsum(n) - n
                best = np.array([int(a.argmax()) for a in np.split(attention, first[1:])], np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(s, pa.float64()), pa.array(n, pa.int64()), pa.array(best), pa.array(attention[first + best], pa.float64())], [*keep, "score", "passages", "best_passage", "attention"])

    schema = docs.select(*keep).schema
    for name, kind in (("score", "double"), ("passages", "long"), ("best_passage", "long"), ("attention", "double")):
        schema = schema.add(name, kind)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs(text, ...) that score least or more, with all their columns, whatever their names. Null and empty texts are scored as
    one empty passage; repeated rows stay or go together; a score of just least stays; empty in, empty out."""
    return score(docs.select("text", F.struct("*").alias("_row")), model, keep=("_row",)).where(F.col("score") >= least).select("_row.*")
