"""Text quality by a generalised additive model with pairwise interactions.

Each feature is cut into bins at quantiles. Boosting goes round the features in turn; each step fits a tree of
two levels on one feature alone to the gradient of the logistic loss and adds its leaves to that feature's
table, at a small rate. Then the pairs whose tables promise most are boosted the same way on two features at
once. What is left is one table per feature and per pair; a score is the sum of the bins' entries, so it can
be read, and adding up bins of whole batches is all the work of scoring.

The features are shares and means over the bytes, words and lines of the whole text; nothing but the text is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.llm.common import plain_text
from feedweave.llm.words import IS_SPACE, text_bytes, text_slices, word_hashes

FEATURES = (
    "log_chars", "log_words", "word_length", "space", "upper", "digit", "stop_marks", "bars", "shouts", "signs", "quotes",
    "wide", "words_per_line", "log_lines", "distinct_words", "repeated_neighbours", "repeated_pairs", "one_byte_words",
    "capital_words", "sign_words", "longest_run", "distinct_bytes",
)
#: Documents that the model is fitted on at most; a fit costs the driver about 200 bytes each.
TRAIN_ROWS = 20_000


@dataclass(frozen=True)
class Settings:
    bins: int = 48
    pair_bins: int = 8
    pairs: int = 8
    rounds: int = 120
    pair_rounds: int = 60
    rate: float = 0.1
    smoothing: float = 2.0
    leaf_rows: int = 20


@dataclass(frozen=True)
class Model:
    bias: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_cuts: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features."""
        total = np.full(len(x), self.bias)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[k], x[:, k], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            a, b = (np.searchsorted(self.pair_cuts[f], x[:, f], side="right") for f in (i, j))
            total += table[a, b]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


BYTE_CLASSES = {
    "upper": list(range(65, 91)), "digit": list(range(48, 58)), "stop_marks": [33, 44, 46, 58, 59, 63], "bars": [124], "shouts": [33],
    "signs": [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"-|"], "quotes": [34, 39], "wide": list(range(0xC0, 0x100)),
}
_CLASS_OF = np.array([[c in set(v) for c in range(256)] for v in BYTE_CLASSES.values()])


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; all zeros for an empty one."""
    out = [_features(texts.slice(a, b - a)) for a, b in text_slices(texts)]
    return np.concatenate(out) if out else np.empty((0, len(FEATURES)))


def _features(texts: pa.Array) -> np.ndarray:
    data, at = text_bytes(texts)
    n, sizes = len(texts), np.diff(at) - 1
    words, word_at = word_hashes(texts)
    count = np.diff(word_at)
    by_text = lambda values: np.diff(np.concatenate(([0], np.cumsum(values)))[at])
    per = lambda part, whole: np.divide(part, whole, out=np.zeros(n), where=whole > 0)
    space = IS_SPACE[data]
    x = {name: per(by_text(member[data]), sizes) for name, member in zip(BYTE_CLASSES, _CLASS_OF, strict=True)}
    spaces = by_text(space) - 1  # one joins the texts
    lines = by_text(data == 10) + 1
    edges = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edges[0::2], edges[1::2]
    first, last = data[starts], data[ends - 1]
    owner = np.repeat(np.arange(n), count)
    by_word = lambda values: np.bincount(owner, values, n)
    same_text = np.diff(owner) == 0 if len(owner) else np.empty(0, bool)
    neighbours = np.bincount(owner[1:], (words[1:] == words[:-1]) & same_text, n) if len(owner) else np.zeros(n)
    distinct, pairs, run, letters = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        w = words[word_at[i] : word_at[i + 1]]
        if len(w):
            distinct[i] = len(np.unique(w))
            pairs[i] = len(w) - 1 - len(np.unique(w[1:] * np.uint64(3) + w[:-1])) if len(w) > 1 else 0
            changes = np.flatnonzero(np.diff(w, prepend=w[0] ^ np.uint64(1), append=w[-1] ^ np.uint64(1)))
            run[i] = np.diff(changes).max()
            letters[i] = np.count_nonzero(np.bincount(data[at[i] : at[i + 1] - 1], minlength=256))
    sign = _CLASS_OF[list(BYTE_CLASSES).index("signs")]
    x |= {
        "log_chars": np.log1p(sizes), "log_words": np.log1p(count), "word_length": per(sizes - spaces, count), "space": per(spaces, sizes),
        "words_per_line": per(count, lines), "log_lines": np.where(sizes > 0, np.log(lines), 0), "distinct_words": per(distinct, np.sqrt(count)),
        "repeated_neighbours": per(neighbours, count), "repeated_pairs": per(pairs, count), "one_byte_words": per(by_word(ends - starts == 1), count),
        "capital_words": per(by_word((first >= 65) & (first <= 90)), count), "sign_words": per(by_word(sign[first] | sign[last]), count),
        "longest_run": per(run, np.sqrt(count)), "distinct_bytes": per(letters, np.sqrt(sizes)),
    }
    return np.stack([np.where(sizes > 0, x[name], 0.0) for name in FEATURES], axis=1)


def fit(x: np.ndarray, y: np.ndarray, settings: Settings = Settings()) -> Model:
    """Fits the tables; without rows, or with one label only, every score is the share of label 1 (smoothed)."""
    share = (np.sum(y) + 1) / (len(y) + 2)
    n = x.shape[1]
    cuts = [_quantiles(x[:, k], settings.bins) for k in range(n)]
    pair_cuts = [_quantiles(x[:, k], settings.pair_bins) for k in range(n)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    model = Model(float(np.log(share / (1 - share))), cuts, tables, [], pair_cuts, [])
    if len(np.unique(y)) < 2:
        return model
    bins = [np.searchsorted(cuts[k], x[:, k], side="right") for k in range(n)]
    total = np.full(len(y), model.bias)
    for _ in range(settings.rounds):
        for k in range(n):
            g, h = _gradient(total, y)
            step = _tree(*(np.bincount(bins[k], v, len(tables[k])) for v in (g, h, np.ones(len(y)))), settings)
            tables[k] += step
            total += step[bins[k]]
    coarse = [np.searchsorted(pair_cuts[k], x[:, k], side="right") for k in range(n)]
    shape = [len(c) + 1 for c in pair_cuts]

    def grids(i: int, j: int) -> list[np.ndarray]:
        g, h = _gradient(total, y)
        cell = coarse[i] * shape[j] + coarse[j]
        return [np.bincount(cell, v, shape[i] * shape[j]).reshape(shape[i], shape[j]) for v in (g, h, np.ones(len(y)))]

    gains = sorted(((_pair_tree(*grids(i, j), settings)[1], i, j) for i, j in combinations(range(n), 2)), reverse=True)
    model.pairs.extend((i, j) for gain, i, j in gains[: settings.pairs] if gain > 0)
    model.pair_tables.extend(np.zeros((shape[i], shape[j])) for i, j in model.pairs)
    for _ in range(settings.pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            step = _pair_tree(*grids(i, j), settings)[0]
            table += step
            total += step[coarse[i], coarse[j]]
    return model


def _quantiles(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.empty(0)


def _gradient(total: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-total))
    return y - p, p * (1 - p)


def _best_cut(g: np.ndarray, h: np.ndarray, rows: np.ndarray, s: Settings) -> tuple[int, float]:
    """Where to cut ordered bins in two, and what it gains; 0 for nowhere."""
    left = [np.cumsum(v)[:-1] for v in (g, h, rows)]
    if not len(left[0]):
        return 0, 0.0
    gain = left[0] ** 2 / (left[1] + s.smoothing) + (g.sum() - left[0]) ** 2 / (h.sum() - left[1] + s.smoothing) - g.sum() ** 2 / (h.sum() + s.smoothing)
    gain[(left[2] < s.leaf_rows) | (rows.sum() - left[2] < s.leaf_rows)] = 0
    at = int(np.argmax(gain))
    return (at + 1, float(gain[at])) if gain[at] > 0 else (0, 0.0)


def _tree(g: np.ndarray, h: np.ndarray, rows: np.ndarray, s: Settings) -> np.ndarray:
    """The leaves of a tree of two levels, written to the bins."""
    cut, _ = _best_cut(g, h, rows, s)
    edges = {0, len(g)}
    for a, b in ((0, cut), (cut, len(g))) if cut else ():
        inner, _ = _best_cut(g[a:b], h[a:b], rows[a:b], s)
        edges |= {a, a + inner}
    out, edges = np.zeros(len(g)), sorted(edges)
    for a, b in zip(edges, edges[1:], strict=False) if cut else ():
        out[a:b] = s.rate * g[a:b].sum() / (h[a:b].sum() + s.smoothing)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, rows: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """One cut on each axis: the four quarters that gain most over a single leaf."""
    sums = [np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (g, h, rows)]

    def quarters(c: np.ndarray) -> list[np.ndarray]:
        a, top, left, whole = c[1:-1, 1:-1], c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        return [a, top - a, left - a, whole - top - left + a]

    parts = [quarters(c) for c in sums]
    if not parts[0][0].size:
        return np.zeros_like(g), 0.0
    gain = sum(pg**2 / (ph + s.smoothing) for pg, ph in zip(parts[0], parts[1], strict=True)) - g.sum() ** 2 / (h.sum() + s.smoothing)
    gain = np.where(np.minimum.reduce(parts[2]) < s.leaf_rows, 0, gain)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if gain[i, j] <= 0:
        return np.zeros_like(g), 0.0
    out = np.empty_like(g)
    for k, at in enumerate((np.s_[: i + 1, : j + 1], np.s_[: i + 1, j + 1 :], np.s_[i + 1 :, : j + 1], np.s_[i + 1 :, j + 1 :])):
        out[at] = s.rate * parts[0][k][i, j] / (parts[1][k][i, j] + s.smoothing)
    return out, float(gain[i, j])


def is_held_out(doc_id: str = "doc_id"):
    """Rows that no label is learned from: crc32 of the doc_id as text leaves 1 modulo 3 (never a missing doc_id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = TRAIN_ROWS, settings: Settings = Settings()) -> Model:
    """Fits on at most `rows` labelled documents that are not held out: those with the smallest hashes of doc_id."""
    chosen = (
        labels.filter(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out())
        .groupBy("doc_id").agg(F.max(target).cast("double").alias("wanted"))  # repeated labels count once
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    schema = "doc_id long, wanted double, x array<double>"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(2))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "wanted", "x"])

    # At most `rows` rows of two numbers are broadcast, and come back with their features.
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    table = found.select("doc_id", "wanted", "text").mapInArrow(measure, schema).orderBy("doc_id", "x").limit(rows).toArrow()
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    return fit(x, table["wanted"].to_numpy(), settings)


def score_documents(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and score, 0 to 1; null texts are scored as empty ones. Columns not in `keep` are dropped."""
    fields = docs.select(*keep).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(features(batch.column(len(keep))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score)], names=[*keep, "score"])

    return docs.select(*keep, plain_text("text").alias("scored text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns as they are, that score `least` or more; none is moved."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(features(batch.column(at))) >= least))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5) of every document, by a model of labels.quality."""
    scored = score_documents(docs, train(docs, labels, "quality", rows, settings))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
