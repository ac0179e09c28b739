"""Vector bin packing of examples into training sequences, under limits on tokens, segments and loss-bearing tokens at once.

A task encodes its rows and packs them as they come, from a pool of POOL examples at most: nothing is shuffled, and a lost task is
run again alone. One sequence is filled at a time. Of the examples that fit into all that is left of it, the one goes in whose
demands have the largest dot product with what is left, both as shares of the limits; where none fits, the best one is cut to what
fits. A sequence that a limit other than that on tokens ends, or the end of the rows, gives back what is beyond a power of two, a
length that needs no padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .wordends import words_of

#: Examples that wait for a place in a task.
POOL = 1024


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits are 1 or more")


@dataclass
class Example:
    """ids, of which those before prompt bear no loss; only ids from start to end are to be placed."""

    id: object
    ids: np.ndarray
    prompt: int
    start: int
    end: int

    @property
    def loss(self) -> int:
        return max(0, self.end - max(self.start, self.prompt))

    def first(self, tokens: int, loss: int) -> int:
        """How many tokens from the start on fit both."""
        free = max(0, self.prompt - self.start)
        return min(self.end - self.start, tokens, free + loss)

    def cut(self, n: int) -> tuple["Example", "Example"]:
        at = self.start + n
        return Example(self.id, self.ids, self.prompt, self.start, at), Example(self.id, self.ids, self.prompt, at, self.end)


class Packer:
    """Fills sequences, lists of Examples. Those that wait fit into an empty one each."""

    def __init__(self, limits: Limits, cut: bool = True):
        self.limits, self.may_cut = limits, cut
        self.waiting: list[Example] = []

    def add(self, examples: list[Example]) -> Iterator[list[Example]]:
        """Lets examples wait; what is beyond a limit of a sequence is cut off them, and given out where it fills one."""
        for x in examples:
            rest: Example | None = x
            while rest is not None:
                n = rest.first(self.limits.tokens, self.limits.loss)
                head, rest = (rest, None) if n == rest.end - rest.start else rest.cut(n)
                if n == self.limits.tokens:
                    yield [head]
                else:
                    self.waiting.append(head)

    def pack(self, leave: int) -> Iterator[list[Example]]:
        """Fills sequences until leave examples or fewer wait."""
        pool = self.waiting
        demand = lambda x: (x.end - x.start, 1, x.loss)
        demands = np.array([demand(x) for x in pool], float).reshape(-1, 3)
        alive = np.ones(len(pool), bool)
        capacity = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], float)
        while alive.sum() > leave:
            left, placed = capacity.copy(), []
            while left[0] and left[1]:
                scores = np.where(alive, demands @ (left / capacity**2), -1.0)  # shares of the limits on both sides
                whole = np.where((demands <= left).all(1), scores, -1.0)
                at = int(whole.argmax())
                if whole[at] >= 0:
                    head, alive[at] = pool[at], False
                elif not self.may_cut:
                    break
                else:
                    at = int(np.where((left[2] > 0) | (demands[:, 0] > demands[:, 2]), scores, -1.0).argmax())
                    n = pool[at].first(int(left[0]), int(left[2]))
                    if not alive[at] or not n:
                        break
                    head, pool[at] = pool[at].cut(n)
                    demands[at] = demand(pool[at])
                placed.append(head)
                left -= demand(head)
            if self.may_cut and (back := self._shed(placed)):
                pool += back
                demands, alive = np.append(demands, [demand(x) for x in back], 0), np.append(alive, np.ones(len(back), bool))
            yield placed
        self.waiting = [x for x, a in zip(pool, alive.tolist()) if a]

    def _shed(self, placed: list[Example]) -> list[Example]:
        """Takes from the end of a sequence what is beyond a power of two, unless it is full."""
        length = sum(x.end - x.start for x in placed)
        over, back = (0 if length == self.limits.tokens else length - (1 << length.bit_length() - 1)), []
        while over:
            x = placed.pop()
            keep = max(0, x.end - x.start - over)
            over -= x.end - x.start - keep
            head, tail = x.cut(keep)
            if keep:
                placed.append(head)
            back.append(tail)
        return back


def _packed(path: str, end_id: int | None, limits: Limits, cut: bool, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer, number = words_of(path), Packer(limits, cut), TaskContext.get().partitionId() << 40

        def rows(sequences: list[list[Example]]) -> pa.RecordBatch:
            nonlocal number
            out: list[tuple] = []
            for sequence in sequences:
                offset = 0
                for x in sequence:
                    out.append((x.id, x.start, x.end - x.start, x.ids[x.start : x.end].astype("<u4").tobytes(), x.end - x.start - x.loss, len(x.ids), number, offset))
                    offset += x.end - x.start
                number += 1
            of = list(zip(*out)) or [()] * 8
            return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(of, (kind, *[pa.int64()] * 2, pa.binary(), *[pa.int64()] * 4))], ["_id", "start", "length", "ids", "loss_start", "doc_tokens", "sequence_id", "offset"])

        def encoded(part: pa.RecordBatch) -> Iterator[Example]:
            texts, prompts = ([t or "" for t in part.column(c).to_pylist()] for c in ("_text", "_prompt"))
            before = words.encode(prompts) if any(prompts) else [np.zeros(0, np.uint32)] * len(prompts)
            end = np.array([] if end_id is None else [end_id], np.uint32)
            for id, first, ids in zip(part.column("_id").to_pylist(), before, words.encode(texts)):
                ids = np.concatenate([first, ids, end])
                yield Example(id, ids, len(first), 0, len(ids))

        for batch in batches:
            for of_prompts in slices(batch, "_prompt"):
                for part in slices(of_prompts, "_text"):
                    examples = [x for x in encoded(part) if x.end]
                    for i in range(0, len(examples), POOL):
                        done = list(packer.add(examples[i : i + POOL]))
                        if len(packer.waiting) > POOL:
                            done += packer.pack(POOL // 2)
                        if done:
                            yield rows(done)
        yield rows(list(packer.pack(0)))

    return run


def pack(docs: DataFrame, *, tokenizer: str, end_id: int | None = None, limits: Limits = Limits(), cut: bool = True, id: str = "doc_id", text: str = "text", prompt: str | None = None) -> DataFrame:
    """Pieces of docs(id, text[, prompt]): id, start (ids of the row before the piece), length, ids (little-endian unsigned 32-bit), loss_start
    (how many of them bear no loss), doc_tokens (ids of the row), sequence_id, and offset in the sequence, gapless from 0.

    A row is an example: the ids of its prompt, which bear no loss, those of its text, and end_id. Each id is in one piece. No sequence is
    beyond a limit; with cut, each is full or a power of two long, and examples are cut as that asks. Without it only
    examples beyond a limit are cut. Null texts and prompts are empty; a row without ids, which none is with an end_id, has no
    piece. Repeated rows and null ids are examples each for itself; a text of any length is one row of a task. Ties go to the example that
    waits first. Other columns are ignored, whatever their names. An empty table gives an empty result.

    sequence_id counts within a partition of docs, so docs should be a table that was written: rows whose order differs between two runs
    of a task are packed differently.
    """
    kind = docs.schema[id].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"), (F.lit(None).cast("string") if prompt is None else F.col(prompt)).alias("_prompt"))
    made = rows.mapInArrow(_packed(tokenizer, end_id, limits, cut, to_arrow_type(kind)), f"_id {kind.simpleString()}, start long, length long, ids binary, loss_start long, doc_tokens long, sequence_id long, offset long")
    return made.withColumnRenamed("_id", id)


def sequences(pieces: DataFrame, *, id: str = "doc_id", limits: Limits = Limits()) -> DataFrame:
    """sequence_id, n_tokens, ids, segments (id, start, length, loss_start, offset of each piece, in order), loss_tokens and padding of the
    sequences of pack(); padding is what a batch of limits.tokens columns lacks, none for a length that is a power of two."""
    piece = F.struct("offset", F.col(id).alias("id"), "start", "length", "loss_start", "ids")
    one = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("x"), F.sum("length").alias("n_tokens"), F.sum(F.col("length") - F.col("loss_start")).alias("loss_tokens"))
    ids = F.aggregate("x", F.lit(b""), lambda all, p: F.concat(all, p["ids"]))
    segments = F.transform("x", lambda p: F.struct(p["id"].alias(id), p["start"].alias("start"), p["length"].alias("length"), p["loss_start"].alias("loss_start"), p["offset"].alias("offset")))
    n = F.col("n_tokens")
    padding = F.when(n.bitwiseAND(n - 1) == 0, F.lit(0)).otherwise(F.lit(limits.tokens) - n).cast("long")
    return one.select("sequence_id", "n_tokens", ids.alias("ids"), segments.alias("segments"), "loss_tokens", padding.alias("padding"))
