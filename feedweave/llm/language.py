"""The language of a text: averaged hashed subword embeddings with a linear softmax (Joulin et al., 2017).

A text is lower-cased and cut into words at all ASCII bytes but letters. A word's subwords are itself and its runs of
GRAMS bytes, with a mark at both ends; each is hashed to one of BUCKETS embeddings. The mean of the embeddings
of all subwords of the text goes through a linear map and a softmax. Embeddings and map are trained together by
stochastic gradient descent, one text a step, at a rate that falls to zero.

As mean and map are linear, scoring needs only each bucket's part in the logits: every distinct word of a batch is
looked up once, and a text adds up the parts of its words. Some of the training texts are kept from the training:
on them the softmax gets its temperature, so that scores are shares of right answers, and a rejection bound, the
least score from which on answers are right as often as wanted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedweave.llm.common import plain_text
from feedweave.llm.words import BASE, BASE_INVERSE, mix, powers, text_slices

GRAMS = (2, 3, 4)
BUCKETS = 1 << 14
#: Texts that the model is fitted on at most, in all and for a language: a fit costs the driver 128 kB each at most.
TRAIN_ROWS, TRAIN_ROWS_OF_LANG = 4000, 1000
UNKNOWN = "und"
_IS_WORD = np.isin(np.arange(256), [*range(97, 123), *range(128, 256)])
_VALUES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


@dataclass(frozen=True)
class Settings:
    dim: int = 16
    epochs: int = 6
    rate: float = 0.5
    embedding_rate: float = 20.0  # times the rate: an embedding's gradient is a small share of the mean's
    calibration: float = 0.2
    wanted: float = 0.99
    seed: int = 5


@dataclass(frozen=True)
class Model:
    langs: list[str]
    parts: np.ndarray  # what each bucket adds to the logits
    temperature: float
    least_score: float

    def probabilities(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(one row of probabilities for each text, in the order of langs; number of its subwords)."""
        return self.scaled(*logits(texts, self.parts))

    def scaled(self, sums: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _softmax(sums / np.maximum(count, 1)[:, None] / self.temperature), count


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of all texts in order: each word's text, its number in the array of distinct words, that array."""
    values = [t.as_buffer() if t.is_valid else b"" for t in pc.utf8_lower(texts).cast(pa.large_binary())]
    data = np.frombuffer(b" ".join([*values, b""]), np.uint8)
    ends_of_texts = np.cumsum(np.fromiter((len(v) + 1 for v in values), np.int64, len(values)))
    inside = _IS_WORD[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[0::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    coded = words.dictionary_encode()
    return np.searchsorted(ends_of_texts, starts, side="right"), coded.indices.to_numpy().astype(np.int64), coded.dictionary


def subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of every subword of each word: itself and its runs of GRAMS bytes between two marks."""
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # A blank before and after each word is its mark; the blank between two words serves both.
    data = np.frombuffer(b" " + b" ".join([*words.to_pylist(), b""]), np.uint8)
    sizes = pc.binary_length(words).to_numpy().astype(np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1  # of the mark before each word
    owner_at = np.repeat(np.arange(len(words)), sizes + 1)
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * powers(BASE, len(data)), dtype=np.uint64)))
    back = powers(BASE_INVERSE, len(data) + 1)
    owners, hashes = [np.arange(len(words))], [(running[starts + sizes + 2] - running[starts]) * back[starts]]
    ends = starts + sizes + 2
    for n in GRAMS:
        at = np.arange(len(owner_at))
        at = at[at + n <= ends[owner_at]]
        owners.append(owner_at[at])
        hashes.append((running[at + n] - running[at]) * back[at] + np.uint64(n))
    return np.concatenate(owners), (mix(np.concatenate(hashes)) % np.uint64(BUCKETS)).astype(np.int64)


def logits(texts: pa.Array, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the parts of each text's subwords, number of them); texts one after the other, so no other row matters."""
    sums, counts = [np.empty((0, parts.shape[1]))], [np.empty(0)]
    for a, b in text_slices(texts):
        text, code, words = distinct_words(texts.slice(a, b - a))
        owner, bucket = subwords(words)
        by_word = np.stack([np.bincount(owner, parts[bucket, c], len(words)) for c in range(parts.shape[1])], axis=1)
        sums.append(np.stack([np.bincount(text, by_word[code, c], b - a) for c in range(parts.shape[1])], axis=1))
        counts.append(np.bincount(text, np.bincount(owner, minlength=len(words))[code], b - a))
    return np.concatenate(sums), np.concatenate(counts)


def histograms(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, occurrences) of the subwords of each text."""
    out = []
    for i in range(len(texts)):
        _, code, words = distinct_words(texts.slice(i, 1))
        owner, bucket = subwords(words)
        sums = np.bincount(bucket, np.bincount(code, minlength=len(words))[owner], BUCKETS)
        at = np.flatnonzero(sums)
        out.append((at, sums[at]))
    return out


def fit(bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str], settings: Settings = Settings()) -> Model:
    """Trains on one bag of buckets a text; texts without subwords teach nothing. Without any text no language is learned."""
    names = sorted(set(langs))
    use = [i for i, (at, _) in enumerate(bags) if len(at)]
    random = np.random.default_rng(settings.seed)
    if not use:
        return Model(names, np.zeros((BUCKETS, len(names))), 1.0, 0.0)
    label = np.array([names.index(lang) for lang in langs])
    order = random.permutation(use)
    held = order[: int(len(order) * settings.calibration)]
    taught = order[len(held) :]
    e = random.uniform(-1 / settings.dim, 1 / settings.dim, (BUCKETS, settings.dim))
    w = np.zeros((settings.dim, len(names)))
    steps, step = settings.epochs * len(taught), 0
    for _ in range(settings.epochs):
        for i in random.permutation(taught):
            rate = settings.rate * (1 - step / steps)
            at, times = bags[i]
            share = times / times.sum()
            mean = share @ e[at]
            g = _softmax(mean @ w)
            g[label[i]] -= 1
            back = w @ g
            w -= rate * np.outer(mean, g)
            e[at] -= rate * settings.embedding_rate * share[:, None] * back
            step += 1
    parts = e @ w
    held = held if len(held) else taught
    z = np.array([(bags[i][1] @ parts[bags[i][0]]) / bags[i][1].sum() for i in held])
    temperature = _temperature(z, label[held])
    p = _softmax(z / temperature)
    return Model(names, parts, temperature, _bound(p.max(axis=1), p.argmax(axis=1) == label[held], settings.wanted))


def _temperature(z: np.ndarray, label: np.ndarray) -> float:
    """The temperature of least log loss on a grid."""
    grid = np.geomspace(0.05, 20, 121)
    loss = [-np.mean(np.log(np.maximum(_softmax(z / t)[np.arange(len(z)), label], 1e-12))) for t in grid]
    return float(grid[int(np.argmin(loss))])


def _bound(score: np.ndarray, right: np.ndarray, wanted: float) -> float:
    """The least score from which on answers are right with the share `wanted`; above 1 if there is none."""
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    last = np.append(score[order][1:] != score[order][:-1], True)  # equal scores stand or fall together
    good = np.flatnonzero((share >= wanted) & last)
    return float(score[order][good[-1]]) if len(good) else 1.1


def is_held_out():
    """Rows that nothing is learned from: crc32 of the doc_id as text leaves 2 modulo 4 (never a missing doc_id)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, rows: int = TRAIN_ROWS, rows_of_lang: int = TRAIN_ROWS_OF_LANG, settings: Settings = Settings()) -> Model:
    """Fits on documents that are not held out and have text, lang and doc_id: rows_of_lang of each language, rows in all.

    They are those with the smallest hashes of doc_id. Texts are measured where they lie; the driver gets bags of
    buckets.
    """
    may = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out())
    draw = F.xxhash64("doc_id", F.lit("language"))
    by_draw = W.partitionBy("lang").orderBy("draw", "doc_id")
    ranked = may.select("doc_id", "lang", draw.alias("draw")).withColumn("place", F.row_number().over(by_draw)).filter(F.col("place") <= rows_of_lang)
    chosen = ranked.orderBy("place", "draw", "doc_id", "lang").limit(rows).select(F.col("doc_id").alias("id"), F.col("lang").alias("known")).distinct()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(2)):
                bags = histograms(batch.column(2).slice(a, b - a))
                packed = [pa.array([x[k].astype("<u4").tobytes() for x in bags], pa.binary()) for k in (0, 1)]
                yield pa.record_batch([*(batch.column(c).slice(a, b - a) for c in (0, 1)), *packed], names=["doc_id", "lang", "buckets", "times"])

    found = may.select("doc_id", "lang", "text").join(F.broadcast(chosen), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("known")))
    schema = docs.select("doc_id", "lang").schema
    bags = found.select("doc_id", "lang", "text").mapInArrow(measure, f"doc_id {schema[0].dataType.simpleString()}, lang string, buckets binary, times binary")
    table = bags.orderBy("doc_id", "lang", "buckets", "times").limit(rows).toArrow()
    read = [[np.frombuffer(v, "<u4").astype(np.int64) for v in table[c].to_pylist()] for c in ("buckets", "times")]
    return fit(list(zip(*read, strict=True)), table["lang"].to_pylist(), settings)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row.

    score is the calibrated probability of lang_pred. A null text, or one without a letter, has lang_pred UNKNOWN,
    score 0 and is rejected; so has every text if no language was learned. A text with letters always gets the
    likeliest language (the first by name of equal ones); rejected then says that its score is below the bound.
    Of a text with letters but without subwords (there is none in valid UTF-8) the score would be 1 / languages.
    """
    langs = pa.array(model.langs, pa.string())
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    fields = docs.select("doc_id").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(2).to_numpy(zero_copy_only=False) & (len(langs) > 0)
            if len(langs):
                p, _ = model.probabilities(batch.column(1))
                best, score = langs.take(pa.array(p.argmax(axis=1))), p.max(axis=1)
            else:
                best, score = pa.nulls(len(known), pa.string()), np.zeros(len(known))
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0), "lang_pred": pc.if_else(pa.array(known), best, UNKNOWN), "score": pa.array(np.where(known, score, 0.0)),
                    "rejected": pa.array(~known | (score < model.least_score)),
                }
            )

    source = docs.select("doc_id", plain_text("text").alias("text"), letter.alias("letter"))
    return source.mapInArrow(run, f"doc_id {fields[0].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, rows: int = TRAIN_ROWS, rows_of_lang: int = TRAIN_ROWS_OF_LANG, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document, by a model of documents that are not held out.

    Repeated rows are each predicted alike; a row without doc_id teaches nothing and is not held out; an empty
    table gives an empty result. Columns but doc_id, text and lang are not looked at.
    """
    found = predict(docs, train(docs, rows, rows_of_lang, settings))
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "rejected")
