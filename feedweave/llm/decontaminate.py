"""Benchmark items found in training documents: rare n-gram seeds, then Smith-Waterman alignment on words.

1. The document frequency of every n-gram of the items is counted over the whole corpus.
2. Of each SEED_WINDOW neighbouring n-grams of an item the rarest is a seed. So a document that shares
   SEED_WORDS + SEED_WINDOW - 1 words in a row with an item holds a seed of it, however common the item is.
3. Documents and items are joined on the seeds; each hit tells where in the document the item would lie, and
   overlapping places are one window.
4. Item and window are aligned locally (equal words 2, others and gaps -1). The best score over that of the
   whole item is the similarity, so edited, cut and paraphrased copies count by what is left of them.

The items are the query set: they are taken through the driver and to the tasks in blocks of BLOCK_WORDS words
at most (16 MB), and each block is sought in all documents. Documents never leave their task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.llm.common import plain_text
from feedweave.llm.words import runs_of, text_slices, word_hashes

SEED_WORDS = 3
SEED_WINDOW = 2
SIMILARITY = 0.5
BLOCK_WORDS = 2_000_000
EQUAL, OTHER, GAP = 2, -1, 1
CELLS = 200_000  # alignment cells of a row that are worked on at once


@dataclass
class Block:
    """Items with an index of n-grams: gram k is grams[k] (sorted) of `size` words; its places are entries
    first[k] : first[k + 1] of (item, offset)."""

    ids: list[int]
    words: list[np.ndarray]
    size: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, ids: list[int], words: list[np.ndarray], n: int, chosen: set[int] | None = None) -> Block:
        """An item of fewer than n words is one gram. `chosen`: places (number in the order of items and offsets) to keep."""
        runs = [runs_of(w, min(n, len(w))) if len(w) else np.empty(0, np.uint64) for w in words]
        grams = np.concatenate([*runs, np.empty(0, np.uint64)])
        item = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        offset = np.concatenate([*(np.arange(len(r)) for r in runs), np.empty(0, int)]).astype(int)
        sizes = np.array([min(n, len(w)) for w in words], int)[item] if len(item) else np.empty(0, int)
        if chosen is not None:
            keep = np.array(sorted(chosen), int)
            grams, item, offset, sizes = grams[keep], item[keep], offset[keep], sizes[keep]
        order = np.lexsort((offset, item, sizes, grams))
        grams, item, offset, sizes = grams[order], item[order], offset[order], sizes[order]
        new = np.concatenate((np.ones(min(1, len(grams)), bool), (np.diff(grams) != 0) | (np.diff(sizes) != 0)))
        starts = np.flatnonzero(new)
        return cls(ids, words, sizes[starts], grams[starts], np.append(starts, len(grams)), item, offset)

    def hits(self, words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word position, gram) of every gram of the block in the texts; `owner` is each word's text."""
        at, which = [np.empty(0, int)], [np.empty(0, int)]
        for size in np.unique(self.size).tolist():
            mine = np.flatnonzero(self.size == size)
            maybe = np.zeros(1 << 20, bool)
            maybe[(self.grams[mine] >> np.uint64(44)).astype(int)] = True
            runs = runs_of(words, size)
            p = np.flatnonzero(maybe[(runs >> np.uint64(44)).astype(int)])
            p = p[owner[p] == owner[p + size - 1]]
            k = np.minimum(np.searchsorted(self.grams[mine], runs[p]), len(mine) - 1)
            same = self.grams[mine][k] == runs[p]
            at.append(p[same])
            which.append(mine[k[same]])
        return np.concatenate(at), np.concatenate(which)


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each item in its window, and the window position where that alignment ends (first of equal ones)."""
    best, end = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    order = np.lexsort(([len(w) for w in windows], [len(i) for i in items]))
    start = 0
    while start < len(order):
        wide, stop = len(windows[order[start]]), start
        while stop < len(order) and (stop == start or max(wide, len(windows[order[stop]])) * (stop - start + 1) <= CELLS):
            wide, stop = max(wide, len(windows[order[stop]])), stop + 1
        part = order[start:stop]
        long = max(len(items[k]) for k in part)
        window, item = np.zeros((len(part), wide), np.uint64), np.full((len(part), long), np.uint64(1))
        for row, k in enumerate(part):  # padding of 0 and 1 equals no word, as those are hashes of words
            window[row, : len(windows[k])] = windows[k]
            item[row, : len(items[k])] = items[k]
        lane = np.arange(wide, dtype=np.int32) * GAP
        row, top, where = np.zeros((len(part), wide + 1), np.int32), np.zeros(len(part), np.int32), np.zeros(len(part), np.int64)
        for i in range(long):
            step = row[:, :-1] + np.where(window == item[:, i : i + 1], np.int32(EQUAL), np.int32(OTHER))
            np.maximum(step, row[:, 1:] - GAP, out=step)
            np.maximum(step, 0, out=step)
            step = np.maximum.accumulate(step + lane, axis=1) - lane
            row[:, 1:] = step
            high = step.max(axis=1)
            better = high > top
            top[better], where[better] = high[better], step[better].argmax(axis=1)
        best[part], end[part] = top, where
        start = stop
    return best, end


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    ids, words, held = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), plain_text("text").alias("text")).orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        w, _ = word_hashes(pa.array([r.text]))
        if held and held + len(w) > block_words:
            yield ids, words
            ids, words, held = [], [], 0
        ids, words, held = [*ids, r.item_id], [*words, w], held + len(w)
    if ids:
        yield ids, words


def _seeds(docs: DataFrame, ids: list[int], words: list[np.ndarray]) -> Block:
    """The block's index of seeds, after a count over all documents."""
    every = docs.sparkSession.sparkContext.broadcast(Block.of(ids, words, SEED_WORDS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = every.value
        total = np.zeros(len(block.grams), np.int64)
        for batch in batches:
            for a, b in text_slices(batch.column(0)):
                w, at = word_hashes(batch.column(0).slice(a, b - a))
                owner = np.repeat(np.arange(b - a), np.diff(at))
                p, gram = block.hits(w, owner)
                total += np.bincount(np.unique(owner[p] * len(total) + gram) % max(1, len(total)), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch({"gram": pa.array(some, pa.int64()), "docs": pa.array(total[some], pa.int64())})

    block = every.value
    times = np.zeros(len(block.grams), np.int64)
    counted = docs.select(plain_text("text").alias("text")).mapInArrow(count, "gram long, docs long").groupBy("gram").agg(F.sum("docs").alias("docs"))
    for r in counted.toLocalIterator():  # a row for each gram of the block at most
        times[r.gram] = r.docs
    every.destroy()
    gram_of = {g: k for k, g in enumerate(zip(block.size.tolist(), block.grams.tolist(), strict=True))}
    chosen, base = set(), 0
    for w in words:
        runs = runs_of(w, min(SEED_WORDS, len(w))).tolist() if len(w) else []
        rank = [(times[gram_of[min(SEED_WORDS, len(w)), g]], g, k) for k, g in enumerate(runs)]
        for k in range(max(1, len(rank) - SEED_WINDOW + 1) if rank else 0):
            chosen.add(base + min(rank[k : k + SEED_WINDOW])[2])
        base += len(runs)
    return Block.of(ids, words, SEED_WORDS, chosen)


def find(block: Block, texts: pa.Array, similarity: float) -> dict[str, np.ndarray]:
    """Matches in a batch of texts: text (its number), item (its number), score, start and end word of the alignment."""
    words, at = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    p, gram = block.hits(words, owner)
    places = block.first[gram + 1] - block.first[gram]
    entry = np.repeat(block.first[gram], places) + np.arange(places.sum()) - np.repeat(np.cumsum(places) - places, places)
    p = np.repeat(p, places)
    text, item = owner[p], block.item[entry]
    size = np.array([len(w) for w in block.words], int)[item] if len(item) else np.empty(0, int)
    low = p - block.offset[entry] - size // 2
    order = np.lexsort((low, item, text))
    text, item, size, low = text[order], item[order], size[order], low[order]
    new = np.ones(len(low), bool)
    new[1:] = (np.diff(text) != 0) | (np.diff(item) != 0) | (low[1:] > low[:-1] + size[1:] + 2 * (size[1:] // 2))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(low)) - 1 if len(first) else first
    text, item, size = text[first], item[first], size[first]
    start = np.maximum(low[first], at[text])
    stop = np.minimum(low[last] + size + 2 * (size // 2), at[text + 1])
    score, end = align([block.words[i] for i in item], [words[a:b] for a, b in zip(start, stop, strict=True)])
    good = score >= similarity * EQUAL * size
    # Of the windows of one text and item the best stays, the first of equal ones.
    order = np.lexsort((start[good], -score[good], item[good], text[good]))
    text, item, score, start, end = (v[good][order] for v in (text, item, score, start, end))
    keep = np.concatenate((np.ones(min(1, len(text)), bool), (np.diff(text) != 0) | (np.diff(item) != 0)))
    text, item, score, start, end = (v[keep] for v in (text, item, score, start, end))
    _, back = align([block.words[i][::-1] for i in item], [words[a : a + e + 1][::-1] for a, e in zip(start, end, strict=True)])
    return {"text": text, "item": item, "score": score, "start": start + end - back - at[text], "end": start + end + 1 - at[text]}


MATCHES = "doc_id long, item_id long, score long, similarity double, item_words long, start_word long, end_word long"


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each document and item aligned well enough: doc_id, item_id, score, similarity, item_words, and the
    document's words start_word to end_word (exclusive, counted from 0) of the best alignment.

    Words are cut at ASCII white space and lower-cased (A-Z). An item of fewer than SEED_WORDS words is sought as
    a whole; one without words, or null, is found nowhere. Repeated rows of either table give repeated rows;
    missing ids stay null. Other columns are not looked at; without documents or items there are no rows.
    """
    session = docs.sparkSession
    found = session.createDataFrame([], MATCHES)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text("text").alias("text"))
    for ids, words in _blocks(benchmark, block_words):
        sent = session.sparkContext.broadcast(_seeds(docs, ids, words))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for batch in batches:
                for a, b in text_slices(batch.column(1)):
                    m = find(block, batch.column(1).slice(a, b - a), similarity)
                    size = np.array([len(block.words[i]) for i in m["item"]], np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(a, b - a).take(pa.array(m["text"])), pa.array([block.ids[i] for i in m["item"]], pa.int64()),
                            pa.array(m["score"], pa.int64()), pa.array(m["score"] / np.maximum(1, EQUAL * size), pa.float64()), pa.array(size),
                            pa.array(m["start"], pa.int64()), pa.array(m["end"], pa.int64()),
                        ],
                        names=["doc_id", "item_id", "score", "similarity", "item_words", "start_word", "end_word"],
                    )

        found = found.unionByName(source.mapInArrow(run, MATCHES))
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of `docs`, all columns as they are, that no item is aligned with; rows are looked at where they are, none is moved."""
    text_column, schema = docs.columns.index("text"), docs.schema
    for ids, words in _blocks(benchmark, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(_seeds(docs, ids, words))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for a, b in text_slices(batch.column(text_column)):
                    clean[a + find(sent.value, batch.column(text_column).slice(a, b - a), similarity)["text"]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
    return docs
