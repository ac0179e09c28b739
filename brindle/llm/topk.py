"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Candidates fall into strips by a hash of their id, queries into blocks, and a task takes one block through one strip, a piece of
PIECE rows at a time. A piece has a sorted list for each dimension, and one of lengths. A query reads its lists from their better
ends, the same depth in each; a row seen for the first time is scored by random access. An unseen row lies below all list ends and
is no longer than the list of lengths allows; the largest product within both bounds it. The query leaves the piece when that is
below its kth score, which it carries from piece to piece: the more it has seen, the less deep it reads. Depths are powers of two, and the bound at each is known before a row is scored, so a query whose bound can't fall
below its kth score before its lists have named about every row of the piece has the whole piece scored at once. The best k of a
block are merged in the task, and those of the strips by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a block, rows of a piece, and rows of a strip where there are more than STRIPS of them.
BLOCK, PIECE, STRIP, STRIPS, K = 2048, 16_384, 1 << 20, 8, 20
_FIRST, _LEAST = 16, np.iinfo(np.int64).min
_EXACT, _LONG = 2.0**53, 2.0**63


def scaled(column: str, factor: int = 64) -> Column:
    """floor(factor * x) of each component as double; null unless all components are finite numbers."""
    x = F.col(column).cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))) & ~F.isnan(v))
    return F.when(whole, F.transform(x, lambda v: F.floor(v * F.lit(float(factor)))))


class Piece:
    """Candidates with their lists. rows: integers, as float where products are exact that way."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        n = len(ids)
        self.depths = np.unique(np.minimum(_FIRST << np.arange(max(1, n.bit_length())), n))
        self.lists = np.argsort(rows, axis=0, kind="stable").astype(np.int32)
        ordered = np.take_along_axis(rows, self.lists, 0)
        self.high, self.low = ordered[n - self.depths], ordered[self.depths - 1]
        squares = (rows**2).sum(1)
        self.by_length = np.argsort(squares, kind="stable").astype(np.int32)
        self.longest = squares[self.by_length[n - self.depths]]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """What no row that is unseen at each depth can exceed, for each query: the sum of the list ends, or less where rows can't be so
        long. For any price p of length, max(q x - p x x) over each dimension and p times the longest square is a bound, too."""
        out = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        size, signs = np.sqrt((queries**2).sum(1)), np.sign(queries)
        for g in range(len(self.depths)):
            end = np.where(signs > 0, self.high[g], np.where(signs < 0, self.low[g], 0))
            fair = size / (2 * np.sqrt(max(self.longest[g], 1.0)))
            for share in (1.0, 0.7, 0.4, 0.2, 0.1):
                price = np.maximum(fair * share, 1e-12)[:, None]
                x = queries / (2 * price)
                x = np.where(signs > 0, np.minimum(x, end), np.where(signs < 0, np.maximum(x, end), 0))
                bound = (queries * x - price * x * x).sum(1) + price[:, 0] * self.longest[g]
                out[:, g] = np.minimum(out[:, g], bound + 1e-9 * np.abs(bound) + 0.01)
        return out

    def named(self, query: np.ndarray, before: int, depth: int) -> np.ndarray:
        """The rows that the lists name between two depths."""
        n, up, down = len(self.ids), np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        return np.unique(np.concatenate([self.lists[n - depth : n - before, up].ravel(), self.lists[before:depth, down].ravel(), self.by_length[n - depth : n - before]]))


class Block:
    """Queries and the best k of each so far; scored counts the rows they met."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        self.ids, self.rows, self.k, self.scored = ids, rows, k, 0
        self.best = np.full((len(ids), k), _LEAST)
        self.best_id = np.zeros((len(ids), k), np.int64)
        self.filled = np.zeros(len(ids), np.int64)

    def floor(self) -> np.ndarray:
        """The kth score of each query, none where it has met fewer than k rows."""
        return np.where(self.filled == self.k, self.best[:, -1].astype(float), -np.inf) if self.k else np.full(len(self.ids), np.inf)

    def take(self, of: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scored rows of queries; a query's own row doesn't count."""
        keep = ids != self.ids[of]
        touched = np.unique(of[keep])
        held = np.arange(self.k) < self.filled[touched, None]
        q = np.concatenate([np.repeat(touched, self.filled[touched]), of[keep]])
        i = np.concatenate([self.best_id[touched][held], ids[keep]])
        s = np.concatenate([self.best[touched][held], scores[keep].astype(np.int64)])
        order = np.lexsort((i, ~s, q))  # ~s falls as s grows
        q, i, s = q[order], i[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < self.k
        self.best[q[top], place[top]], self.best_id[q[top], place[top]] = s[top], i[top]
        self.filled[touched] = np.minimum(self.k, np.bincount(q, minlength=len(self.ids))[touched])

    def whole(self, piece_ids: np.ndarray, piece_rows: np.ndarray, at: np.ndarray, seen: dict[int, np.ndarray]) -> None:
        """Scores all rows not seen yet for the queries at these places; of each only those that can be among its k best are merged."""
        n = len(piece_ids)
        self.scored += n * len(at) - sum(int(seen[q].sum()) for q in at.tolist() if q in seen)
        for own in np.array_split(at, max(1, -(-len(at) * n // (1 << 22)))):
            scores = product(self.rows[own], piece_rows)
            for j, q in enumerate(own.tolist()):
                if q in seen:
                    scores[j, seen[q]] = -np.inf
            least = self.floor()[own]
            if n > self.k + 1:  # one more, as a row may be the query's own
                least = np.maximum(least, np.partition(scores, n - self.k - 1, 1)[:, n - self.k - 1])
            q, r = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
            self.take(own[q], piece_ids[r], scores[q, r])

    def read(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Takes the queries through one piece."""
        if not len(ids) or not len(self.ids) or not self.k:
            return
        if magnitude(self.rows, rows) >= _EXACT:
            return self.whole(ids, rows, np.arange(len(self.ids)), {})
        if len(ids) > 8 * self.k and np.isinf(self.floor()).any():  # an eighth gives new queries a kth score to begin with
            first = len(ids) // 8
            self.whole(ids[:first], rows[:first], np.arange(len(self.ids)), {})
            ids, rows = ids[first:], rows[first:]
        piece = Piece(ids, rows.astype(float))
        bounds, depths = piece.bounds(self.rows.astype(float)), piece.depths
        used = np.count_nonzero(self.rows, axis=1) + 1
        live, step, n = np.arange(len(self.ids)), 0, len(ids)
        seen: dict[int, np.ndarray] = {}
        while len(live):
            live = live[~(bounds[live, step - 1] < self.floor()[live])] if step else live
            need = (bounds[live] >= self.floor()[live, None]).sum(1)  # the step at which the bound is below the kth score of now
            wide = (need >= len(depths)) | (depths[np.minimum(need, len(depths) - 1)] * used[live] >= n)
            self.whole(ids, piece.rows, live[wide], seen)
            live = live[~wide]
            for q in live.tolist():
                named = piece.named(self.rows[q], int(depths[step - 1]) if step else 0, int(depths[step]))
                mark = seen.setdefault(q, np.zeros(n, bool))
                new = named[~mark[named]]
                mark[new] = True
                self.scored += len(new)
                self.take(np.full(len(new), q), ids[new], piece.rows[new] @ self.rows[q])
            step += 1


def magnitude(a: np.ndarray, b: np.ndarray) -> float:
    """What no partial sum of a product of rows exceeds."""
    return float(np.abs(a.astype(float)).sum(1).max(initial=0) * np.abs(b.astype(float)).max(initial=0))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: as doubles below 2 ** 53, as longs below 2 ** 63, else with integers of any size, which
    must end up as longs."""
    most = magnitude(a, b)
    if most < _EXACT:
        return a.astype(float) @ b.astype(float).T
    if most < _LONG:
        return a.astype(np.int64) @ b.astype(np.int64).T
    wide = a.astype(np.int64).astype(object) @ b.astype(np.int64).astype(object).T
    if max(map(abs, wide.ravel().tolist()), default=0) >= 1 << 63:
        raise OverflowError("an inner product doesn't fit a long")
    return wide.astype(np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows padded with zeros to width."""
    out = np.zeros((len(column), width), np.int64)
    offsets = column.offsets.to_numpy()
    out[np.arange(width) < np.diff(offsets)[:, None]] = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return out


def _widened(rows: np.ndarray, width: int) -> np.ndarray:
    return rows if rows.shape[1] == width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def _search(k: int, piece: int):
    """Rows in the order of their cells, a cell's queries before its candidates, equal rows next to each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, block, queries, held, last = None, None, [], [], None

        def searched() -> None:
            nonlocal block, queries, held
            width = max(x.shape[1] for _, x in [*queries, *held]) if queries or held else 0
            if block is None:
                block = Block(np.concatenate([np.zeros(0, np.int64), *(i for i, _ in queries)]), np.concatenate([np.zeros((0, width), np.int64), *(_widened(x, width) for _, x in queries)]), k)
            width = max(width, block.rows.shape[1])
            block.rows = _widened(block.rows, width)
            if held:
                block.read(np.concatenate([i for i, _ in held]), np.concatenate([_widened(x, width) for _, x in held]))
            queries, held = [], []

        def found() -> Iterator[pa.RecordBatch]:
            searched()
            at = np.arange(k) < block.filled[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(block.ids, block.filled)), pa.array(block.best_id[at]), pa.array(block.best[at])], ["query_id", "vec_id", "score"])

        for batch in batches:
            cells, ids, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "id", "is_query"))
            size = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            rows = _matrix(batch.column("vector"), int(size.max(initial=0)))
            edges = np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1]))) if len(cells) else []
            for b, e in zip(edges, [*edges[1:], len(cells)]):
                if cells[b] != cell:
                    if cell is not None:
                        yield from found()
                    cell, block, queries, held, last = cells[b], None, [], [], None
                own_ids, own, long = ids[b:e], rows[b:e], size[b:e]
                own = own[:, : int(long.max())]
                before = (own_ids[1:] == own_ids[:-1]) & (long[1:] == long[:-1]) & (own[1:] == own[:-1]).all(1)
                first = (int(own_ids[0]), bool(asks[b]), own[0, : long[0]].tolist())
                new = np.append(first != last, ~before)
                last = (int(own_ids[-1]), bool(asks[b]), own[-1, : long[-1]].tolist())
                (queries if asks[b] else held).append((own_ids[new], own[new]))
                if sum(len(i) for i, _ in held) >= piece:
                    searched()
        if cell is not None:
            yield from found()

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, *, block: int = BLOCK, piece: int = PIECE, strip: int = STRIP, strips: int = STRIPS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best candidates for each query, by integer inner product, ties to smaller ids.

    Both tables have id (long) and vector (array of long). A row of the query's own id is no candidate. Rows with a null id or vector
    take no part; a shorter vector counts as padded with zeros. Equal rows are one; an id with several vectors is several
    candidates, and as a query gets the best over all of them. Fewer than k candidates: all of them. Scores are exact; one that
    doesn't fit a long is an error. Other columns are ignored; empty tables give an empty result.

    Each candidate is sent to every block of queries and each query to every strip, which is the stated work: all queries against
    all rows. A task holds a block and a piece. There are strips strips, more only where they would have over strip rows, so the rows
    before the merge are about k * strips for each query.
    """
    clean = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<long>").alias("vector")).where("id is not null and vector is not null")
    queries, candidates = clean(queries), clean(candidates)
    n_queries, n = queries.count(), candidates.count()
    blocks, strips = max(1, -(-n_queries // block)), max(1, min(strips, n), -(-n // strip))
    place = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = candidates.select("*", F.lit(False).alias("is_query"), place(strips, 1).alias("s"), every(blocks).alias("b"))
    cells = cells.unionByName(queries.select("*", F.lit(True).alias("is_query"), every(strips).alias("s"), place(blocks, 2).alias("b")))
    cells = cells.select((F.col("b") * F.lit(strips) + F.col("s")).cast("long").alias("cell"), "is_query", "id", "vector")
    dealt = cells.repartition(blocks * strips, "cell").sortWithinPartitions("cell", F.desc("is_query"), "id", "vector")
    found = dealt.mapInArrow(_search(k, piece), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
