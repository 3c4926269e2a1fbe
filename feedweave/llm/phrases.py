"""Phrases whose words stand together more often than they would alone, counted by direct-address tiling.

The words of a language are ranked by frequency; the rank of one of the first HEAD words is its id. A pair of
such ids is a cell of a square table, which is cut into tiles of SIDE * SIDE cells. A tile into which a slice of
text puts many pairs is counted densely, with one bincount of cell numbers; a tile with few, and every pair with
a rarer word, is kept as sorted coordinates with counts (COO). Both add up in any order.

Phrases of three words are pairs again, of a frequent pair and a word: frequent pairs are ranked anew by their own
frequency, get ids and go through the same tiles; longer phrases go on in the same way. A phrase can only be
frequent if both phrases of one word less in it are, so others are left out where that is sure: a bit table of the
frequent ones, of fixed size, says so. A bit set by chance costs a counted row and changes no result.

Nothing is cut off by rank: HEAD decides where a pair is counted, never whether. Sums run over whole texts and all
rows, and all arithmetic is on whole numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedweave.llm.common import stored
from feedweave.llm.words import text_slices
from feedweave.operators.skew import lookup_by_key

BREAKS = [*b".,;:!?", *range(0x0A, 0x0E)]
_IS_BREAK = np.isin(np.arange(256), BREAKS)
_IS_SEPARATOR = _IS_BREAK | np.isin(np.arange(256), [0x20, 0x09])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

SIDE = 512
HEAD = 4 * SIDE
#: Ranked entries handed to tasks in all languages together, and the longest of them in bytes: a broadcast of at most 4 MB.
HEAD_ROWS, HEAD_BYTES = 1 << 15, 128
DENSE_PAIRS = SIDE * SIDE // 64
OPEN_TILES = 32  # dense tiles that a task holds, 2 MB each
#: Bits of the table of frequent phrases (8 MB); beyond some 100 million phrases it rules out few, and changes nothing else.
FILTER_BITS = 1 << 26
SLICE_BYTES = 2 << 20
UNKNOWN_LANG = "und"


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of all texts in order: each word's number in the array of distinct words, that array, each word's piece."""
    values = [t.as_buffer() if t.is_valid else b"" for t in texts.cast(pa.large_binary())]
    data = _LOWER[np.frombuffer(b"\n".join([*values, b""]), np.uint8)]
    separator = _IS_SEPARATOR[data]
    edges = np.flatnonzero(np.diff(separator, prepend=True))
    starts, ends = edges[0::2], edges[1::2]
    piece = np.searchsorted(np.flatnonzero(_IS_BREAK[data]), starts)
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~separator])])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, piece


class Tiles:
    """Dense tiles of one task, by (language, tile)."""

    def __init__(self):
        self.open: dict[tuple[str, int], np.ndarray] = {}

    def add(self, lang: str, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts pairs of ids; gives those of sparse tiles and of ids without a tile back as (u, v, times), sorted."""
        direct = (u < HEAD) & (v < HEAD)
        tile = np.where(direct, u // SIDE * (HEAD // SIDE) + v // SIDE, -1)
        load = np.bincount(tile[direct], minlength=1)
        for t in np.flatnonzero(load >= DENSE_PAIRS):
            at = tile == t
            cells = self.open.setdefault((lang, int(t)), np.zeros(SIDE * SIDE, np.int64))
            cells += np.bincount(u[at] % SIDE * SIDE + v[at] % SIDE, minlength=SIDE * SIDE)
            direct = direct & ~at
            tile[at] = -2
        rest = tile != -2
        code, times = np.unique((u[rest] << 32) | v[rest], return_counts=True)
        return code >> 32, code & 0xFFFFFFFF, times

    def drain(self) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        """(language, u, v, times) of each dense tile; the tiles are empty then."""
        for (lang, t), cells in self.open.items():
            at = np.flatnonzero(cells)
            yield lang, t // (HEAD // SIDE) * SIDE + at // SIDE, t % (HEAD // SIDE) * SIDE + at % SIDE, cells[at]
        self.open.clear()


class Known:
    """Frequent phrases of one length, as tasks see them: the first ranks by language, and the bits of all."""

    def __init__(self, head: dict[str, list[bytes]], bits: np.ndarray):
        self.bits = bits
        self.head = {lang: pa.array(texts, pa.large_binary()) for lang, texts in head.items()}

    def ranks(self, lang: str, phrases: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (the rank, or HEAD + its place in `phrases`), and which may be frequent."""
        ids = HEAD + np.arange(len(phrases), dtype=np.int64)
        if lang in self.head:
            rank = pc.index_in(phrases, value_set=self.head[lang])
            found = rank.is_valid().to_numpy(zero_copy_only=False)
            ids[found] = rank.drop_null().to_numpy()
        rare = np.flatnonzero(ids >= HEAD)
        bit = np.fromiter((zlib.crc32(p) % FILTER_BITS for p in phrases.take(pa.array(rare)).to_pylist()), np.int64, len(rare))
        may = np.ones(len(ids), bool)
        may[rare] = (self.bits[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) > 0
        return ids, may

    def texts(self, lang: str, phrases: pa.Array) -> pa.Array:
        """The phrase of each id that ranks() gives out."""
        head = self.head.get(lang, pa.array([], pa.large_binary()))
        fill = pa.nulls(HEAD - len(head), pa.large_binary())
        return pa.concat_arrays([head, fill, phrases])


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """(language, texts) of a batch of (lang, text), SLICE_BYTES of text at a time."""
    langs = pc.fill_null(batch.column(0), UNKNOWN_LANG)
    for lang in pc.unique(langs).to_pylist():
        texts = batch.column(1).filter(pc.equal(langs, lang))
        for a, b in text_slices(texts, SLICE_BYTES):
            yield lang, texts.slice(a, b - a)


def _rows(lang: str, phrases: pa.Array, times: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"lang": pa.array([lang], pa.string()).take(pa.array(np.zeros(len(times), np.int64))), "phrase": phrases.cast(pa.string()), "times": pa.array(times.astype(np.int64))})


def _joined(first: pa.Array, second: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(first, second, pa.scalar(b" ", pa.large_binary()))


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, phrase, times) of every word; a row with a null phrase has the number of all words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in _by_language(batch):
                codes, words, _ = words_of(texts)
                yield _rows(lang, words, np.bincount(codes, minlength=len(words)))
                yield _rows(lang, pa.nulls(1, pa.string()), np.array([len(codes)]))

    parts = docs.select("lang", "text").mapInArrow(run, "lang string, phrase string, times long")
    return parts.groupBy("lang", "phrase").agg(F.sum("times").alias("times"))


def count_longer(docs: DataFrame, known: list[Known], size: int) -> DataFrame:
    """(lang, phrase, times) of phrases of `size` words; known: frequent phrases of 1 ... size - 1 words.

    All phrases of which every part may be frequent are counted; others may be missing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, levels = Tiles(), shared.value

        def dense() -> Iterator[pa.RecordBatch]:
            for lang, u, v, times in tiles.drain():
                unit, word = (level.texts(lang, pa.array([], pa.large_binary())) for level in (levels[-1], levels[0]))
                yield _rows(lang, _joined(unit.take(pa.array(u)), word.take(pa.array(v))), times)

        for batch in batches:
            for lang, texts in _by_language(batch):
                codes, distinct, piece = words_of(texts)
                if not len(codes):
                    continue
                ids, may = levels[0].ranks(lang, distinct)
                words, word_texts = ids[codes], levels[0].texts(lang, distinct)
                unit, good, unit_texts = words, may[codes], word_texts
                for k, level in enumerate(levels[1:], 1):
                    at = _starts(good, piece, k)
                    code, place = np.unique((unit[at] << 32) | words[at + k], return_inverse=True)
                    phrases = _joined(unit_texts.take(pa.array(code >> 32)), word_texts.take(pa.array(code & 0xFFFFFFFF)))
                    ids, may = level.ranks(lang, phrases)
                    unit, good = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
                    unit[at], good[at], unit_texts = ids[place], may[place], level.texts(lang, phrases)
                at = _starts(good, piece, len(levels))
                u, v, times = tiles.add(lang, unit[at], words[at + len(levels)])
                yield _rows(lang, _joined(unit_texts.take(pa.array(u)), word_texts.take(pa.array(v))), times)
                if len(tiles.open) >= OPEN_TILES:
                    yield from dense()
        yield from dense()

    parts = docs.select("lang", "text").mapInArrow(run, "lang string, phrase string, times long")
    # Each slice has summed up its own pairs, and most of a task's are seen once: they are moved as they come.
    return parts.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("times").alias("times"))


def _starts(good: np.ndarray, piece: np.ndarray, k: int) -> np.ndarray:
    """Where phrases of k + 1 words begin: both phrases of k words in them are good, and all is one piece.

    good: whether the phrase of k words at each place may be frequent (all of it in one piece).
    """
    n = len(piece) - k
    return np.flatnonzero(good[:n] & good[1 : n + 1] & (piece[:n] == piece[k:])) if n > 0 else np.empty(0, np.int64)


def known_phrases(counts: DataFrame) -> Known:
    """What tasks need of the frequent phrases of one length; its size is fixed by HEAD_ROWS, HEAD_BYTES and FILTER_BITS."""
    by_rank = W.partitionBy("lang").orderBy(F.col("times").desc(), "phrase")
    short = counts.filter(F.octet_length("phrase") <= HEAD_BYTES)
    ranked = short.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= HEAD)
    head: dict[str, list[bytes]] = {}
    for row in ranked.orderBy(F.col("times").desc(), "lang", "rank").limit(HEAD_ROWS).select("lang", "phrase").toArrow().to_pylist():
        head.setdefault(row["lang"], []).append(row["phrase"].encode())
    bit = F.crc32(F.col("phrase").cast("binary")) % FILTER_BITS
    words = counts.select(F.shiftright(bit, 6).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast(crc32(cast(phrase as binary)) % {FILTER_BITS} & 63 as int))").alias("bit"))
    table = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[table["at"].to_numpy()] = table["bits"].to_numpy()
    return Known(head, bits.view(np.uint64))


def phrase_counts(docs: DataFrame, max_words: int = 3, min_count: int = 10) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of all phrases of up to max_words words found min_count times; (lang, n) of all words."""
    enough = F.col("phrase").isNull() | (F.col("times") >= min_count)
    first = stored(count_words(docs).filter(enough), "phrases-1")
    tables, known = [first.filter("phrase is not null")], []
    for size in range(2, max_words + 1):
        known.append(known_phrases(tables[-1]))
        tables.append(stored(count_longer(docs, known, size).filter(enough), f"phrases-{size}"))
    sized = [t.select("lang", F.lit(k).alias("words"), "phrase", F.col("times").alias("f")) for k, t in enumerate(tables, 1)]
    total = first.filter("phrase is null").select("lang", F.col("times").alias("n"))
    out = sized[0]
    for table in sized[1:]:
        out = out.unionByName(table)
    return out, total


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, held_percent: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first `top` phrases of each language.

    A text is lower-cased (A-Z) and cut into pieces at . , ; : ! ? and line ends, a piece into words at blanks and
    tabs; phrases of 2 to max_words words found a >= min_count times are candidates. Cut after k words a phrase
    has l and r occurrences of its parts and the score floor(1,000,000 a a / (l r)); its lowest cut counts. A
    candidate inside a longer one that has held_percent of its occurrences or more is dropped.

    Null texts count as empty, a null lang as UNKNOWN_LANG; repeated rows count as often as they stand there. Other
    columns, doc_id too, are not looked at. Texts without words give nothing, an empty table an empty result.
    """
    counts, total = phrase_counts(docs, max_words, min_count)
    found = counts.filter("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"))
    scored = _scored(found, counts)
    parts = F.split("phrase", " ", -1)
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.array_join(F.slice(parts, i, k), " "))))
    holders = found.filter("words > 2").select("lang", F.col("a").alias("held"), F.explode(F.array_distinct(spans)).alias("phrase"))
    held = holders.groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    free = scored.join(held, ["lang", "phrase"], "left").filter(F.col("held").isNull() | (100 * F.col("held") < held_percent * F.col("a")))
    best = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = free.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _scored(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds l, r and score of the lowest-scoring cut, the first of equal ones."""
    key = lambda phrase: F.concat(F.col("lang"), F.lit("\n"), phrase)
    parts = F.split("phrase", " ", -1)
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    ends = F.array_join(F.slice(parts, 1, F.col("k")), " "), F.array_join(F.slice(parts, F.col("k") + 1, F.col("words") - F.col("k")), " ")
    table = counts.select(key(F.col("phrase")).alias("key"), "f")
    # A frequent word begins many candidates, at most a tenth as many as it has occurrences: the counts tell the hot keys.
    left = lookup_by_key(cuts.withColumn("key", key(ends[0])).withColumn("rest", key(ends[1])), table, "key", "f", "phrase")
    left = left.withColumnRenamed("f", "l").drop("key").withColumnRenamed("rest", "key")
    both = lookup_by_key(left, table, "key", "f", "phrase").withColumnRenamed("f", "r")
    # a is below 1e13 and so is f: the products fit 38 digits, and the score 1,000,000, as a is the least of the three.
    big = lambda c: F.col(c).cast("decimal(13,0)")
    cut = both.withColumns({"top": F.lit(1_000_000).cast("decimal(7,0)") * big("a") * big("a"), "below": big("l") * big("r")}).withColumn("score", F.expr("top div below"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return cut.groupBy("lang", "phrase", "words", "a").agg(lowest).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")
