"""Hard negatives: for each anchor, wrong-label rows whose score lies in a window below that of a right one.

Scores are inner products of vectors of whole numbers. A table of anchors against all rows is cut into a grid:
anchors are dealt to blocks and rows to cells, both by hash and both of bounded size, and every (block, cell)
is one group of a cogrouped job. In a group, tiles of anchors and rows are multiplied by Strassen's recursion:
seven products of half-size matrices instead of eight, odd sides filled with a row or column of zeros. Its
additions wrap modulo 2**64, a ring, so the results are exact whenever the true scores fit 64 bits; where that
is not sure, Python integers are multiplied instead.

What a tile yields goes into heaps of (anchor, score, id) that hold the first k of each anchor. Two heaps merge
by concatenation, one sort and a cut at k, in any order with the same result; the heaps of an anchor's cells are
merged by a rank that Spark cuts before the shuffle as well as after. The first pass finds each anchor's
positives, the second fills one heap for the window of each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedweave.llm.common import stored

#: Anchors of a tile, rows of a tile, and the side from which on matrices are multiplied as they are.
ANCHOR_TILE, ROW_TILE, LEAF = 256, 1024, 32
#: Numbers in the vectors of a cell, and in those of a block: what a task holds at once.
CELL_VALUES, BLOCK_VALUES = 1 << 19, 1 << 16


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b for whole numbers, by Strassen's seven products; int64 results are exact modulo 2**64."""
    m, k, n = *a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = (side // 2 for side in (*a.shape, b.shape[1]))
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), a.dtype)
    out[:i, :l], out[:i, l:] = p1 + p4 - p5 + p7, p3 + p5
    out[i:, :l], out[i:, l:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, given as doubles of whole numbers; an error if one exceeds 64 bits."""
    if not (a.size and b.size):
        return np.zeros((len(a), len(b)), np.int64)
    largest = [int(np.abs(x).max()) for x in (a, b)]
    if max(largest) < 2**62 and largest[0] * largest[1] * a.shape[1] < 2**63:
        return strassen(a.astype(np.int64), b.astype(np.int64).T)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    return strassen(whole(a), whole(b).T).astype(np.int64)


def merged(heaps: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, score, id) of the first k entries of each slot: higher scores first, then smaller ids."""
    slot, score, name = (np.concatenate([h[c] for h in heaps]) if heaps else np.empty(0, np.int64) for c in range(3))
    order = np.lexsort((name, ~score, slot))
    slot, score, name = slot[order], score[order], name[order]
    place = np.arange(len(slot)) - np.searchsorted(slot, slot)
    first = place < k
    return slot[first], score[first], name[first]


def entries(score: np.ndarray, valid: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k valid entries of each row of a tile of scores, as a heap."""
    if score.shape[1] > k:
        masked = np.where(valid, score, np.iinfo(np.int64).min)
        valid = valid & (score >= np.partition(masked, -k, axis=1)[:, -k, None])  # with all ties of the k-th
    slot, at = np.nonzero(valid)
    return merged([(slot, score[slot, at], names[at])], k)


def _vectors(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of numbers, rounded down, shorter ones filled with zeros."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    out[np.arange(width) < sizes[:, None]] = np.floor(lists.flatten().to_numpy(zero_copy_only=False))
    return out


def _sides(anchors: pa.Table, rows: pa.Table) -> tuple[np.ndarray, ...]:
    width = max((int(np.diff(t["x"].combine_chunks().offsets.to_numpy()).max(initial=0)) for t in (anchors, rows)), default=0)
    numbers = [t[c].to_numpy() for t in (anchors, rows) for c in ("vec_id", "label")]
    return *numbers, _vectors(anchors["x"], width), _vectors(rows["x"], width)


def _tiles(n: int, size: int) -> list[slice]:
    return [slice(i, i + size) for i in range(0, n, size)]


def best_positives(anchors: pa.Table, rows: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's vec_id, score, vec_id) of each anchor's first k other rows of its label; labels are multiplied apart."""
    name, label, row_name, row_label, x, y = _sides(anchors, rows)
    found = []
    for one in np.unique(label):
        mine, theirs = np.flatnonzero(label == one), np.flatnonzero(row_label == one)
        for i in _tiles(len(mine), ANCHOR_TILE):
            a, heap = mine[i], []
            for j in _tiles(len(theirs), ROW_TILE):
                b = theirs[j]
                slot, score, other = entries(scores(x[a], y[b]), name[a][:, None] != row_name[b], row_name[b], k)
                heap = [merged([*heap, (a[slot], score, other)], k)]
            found += heap
    slot, score, other = merged(found, k)
    return name[slot], score, other


def window_negatives(anchors: pa.Table, rows: pa.Table, k: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, positive, its score, score, vec_id): the first k rows of other labels in each positive's window."""
    name, label, row_name, row_label, x, y = _sides(anchors, rows)
    lists = anchors["positives"].combine_chunks()
    owner = np.repeat(np.arange(len(name)), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten()
    positive, reached = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("positive_id", "positive_score"))
    least = np.array([-(-low * int(p) // 100) for p in reached], np.int64)
    most = np.array([high * int(p) // 100 for p in reached], np.int64)
    heap: list = []
    for i in _tiles(len(owner), ANCHOR_TILE):
        used, place = np.unique(owner[i], return_inverse=True)
        windows = np.arange(len(owner))[i]
        own: list = []
        for j in _tiles(len(row_name), ROW_TILE):
            s = scores(x[used], y[j])[place]
            valid = (label[owner[i]][:, None] != row_label[j]) & (s >= least[i][:, None]) & (s <= most[i][:, None])
            slot, score, other = entries(s, valid, row_name[j], k)
            own = [merged([*own, (windows[slot], score, other)], k)]
        heap += own
    slot, score, other = merged(heap, k)
    return name[owner[slot]], positive[slot], reached[slot], score, other


def hard_negatives(
    embeddings: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    cell_values: int = CELL_VALUES, block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    embeddings: vec_id, embedding, label; other columns are not looked at. A component x counts as
    floor(scale * x). Rows without vec_id, label or vector, or with a component that is null or not finite, take
    no part; an empty vector does, with score 0. Shorter vectors are filled with zeros. Rows that repeat a vec_id
    are one row: the one of the smallest label, then vector. A positive without any row in its window gives no
    row, and neither does an anchor without positives; an empty table gives an empty result. A score that
    exceeds a long ends the job with an error.
    """
    spark = embeddings.sparkSession
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    vector = F.transform("embedding", lambda v: v.cast("double") * scale)
    rows = (
        embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
        .filter(F.coalesce(finite, F.lit(False)))
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("label"), vector.alias("x")).alias("row"), is_anchor.alias("anchor"))
        .groupBy("vec_id").agg(F.min("row").alias("row"), F.max("anchor").alias("anchor")).select("vec_id", "row.*", "anchor")
    )
    rows = stored(rows, "negatives-rows")
    sizes = rows.agg(F.count(F.lit(1)), F.count_if("anchor"), F.max(F.size("x"))).first()
    width = max(1, sizes[2] or 0)
    cells, blocks = (max(1, math.ceil(n * width / most)) for n, most in ((sizes[0], cell_values), (sizes[1], block_values)))
    number = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    others = [F.col(c).alias(c) for c in ("vec_id", "label", "x")]  # names of their own, as both sides come from one table
    dealt = rows.select(*others, number(cells, 1).alias("cell")).withColumn("block", every(blocks))

    def grid(anchors: DataFrame, work, schema: str) -> DataFrame:
        copies = anchors.withColumn("block", number(blocks, 2)).withColumn("cell", every(cells))
        return copies.groupBy("block", "cell").cogroup(dealt.groupBy("block", "cell")).applyInArrow(work, schema)

    def first_pass(anchors: pa.Table, others: pa.Table) -> pa.Table:
        return pa.table(list(best_positives(anchors, others, positives)), names=["anchor_id", "positive_score", "positive_id"])

    def second_pass(anchors: pa.Table, others: pa.Table) -> pa.Table:
        found = window_negatives(anchors, others, negatives, low, high)
        return pa.table(list(found), names=["anchor_id", "positive_id", "positive_score", "negative_score", "negative_id"])

    chosen = rows.filter("anchor").select("vec_id", "label", "x")
    best = W.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    right = (
        grid(chosen, first_pass, "anchor_id long, positive_score long, positive_id long")
        .withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives)
        .groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    )
    chosen = chosen.join(right, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "x", "positives")
    wrong = grid(chosen, second_pass, "anchor_id long, positive_id long, positive_score long, negative_score long, negative_id long")
    best = W.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = wrong.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
