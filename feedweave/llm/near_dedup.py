"""Near-duplicate documents by MinHash with tensored banding, every link confirmed on the full shingle sets.

Tensoring (Christiani, 2019): instead of bands * bands tables with keys of their own, two collections of
`bands` half keys (ROWS minhashes each) are computed, and table (i, j) is keyed by the pair of the i-th half
key of one and the j-th of the other. So bands**2 tables cost 2 * bands * ROWS minhashes. Two documents of
similarity s meet in some table with probability (1 - (1 - s**ROWS)**bands)**2; `bands` is chosen so that this
fails for a pair at the threshold less than once in 1 / MISS.

The links of a bucket are found without all pairs of it:
1. Documents with equal sets are one node from the start.
2. Each bucket's most connected member is its centre; the others are compared with it.
3. Members that stand apart from others of their bucket after that are joined by an exact set-similarity join
   among all such documents: tokens in order of rarity, prefixes that any linked pair must share, and a bound
   on the overlap by position (Xiao et al., 2008), for pairs of different components only. Links inside a
   component would change nothing.
Components are found by alternating large-star and small-star steps (Kiveris et al., 2014).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedweave.llm.common import by_merge, by_shuffle, plain_text, stored
from feedweave.llm.exact_dedup import FILTER_BITS, filter_of, maybe_in
from feedweave.llm.words import shingle_set, text_slices, word_hashes

SHINGLE_WORDS = 5
ROWS = 3
MISS = 1e-4
CENTRE_PAIRS = 256
SHARED = 1 << 62  # nodes from here on are further sets of a doc_id that has one already
_RANDOM = np.random.default_rng(7)
_XOR = _RANDOM.integers(0, 2**32, 4096, dtype=np.uint32)
_TIMES = _RANDOM.integers(0, 2**32, 4096, dtype=np.uint32) | np.uint32(1)


def band_count(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Half keys of each collection, so that a pair at the threshold is missed with probability `miss` at most."""
    half = 1 - math.sqrt(1 - miss)
    return max(1, math.ceil(math.log(half) / math.log(1 - threshold**rows))) if threshold < 1 else 1


def half_keys(shingles: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """The 2 * bands half keys of a set: the first collection, then the second."""
    n = 2 * bands * rows
    low = np.full(n, 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 4096):
        values = (short[at : at + 4096] ^ _XOR[:n, None]) * _TIMES[:n, None]
        np.minimum(low, values.min(axis=1), out=low)
    keys = np.zeros(2 * bands, np.uint64)
    for r in range(rows):
        keys = (keys ^ low.reshape(2 * bands, rows)[:, r].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def near_duplicates(docs: DataFrame, threshold: Fraction = Fraction(85, 100), shingle_words: int = SHINGLE_WORDS, miss: float = MISS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    Two documents are linked if their sets' intersection is `threshold` of the union or more. A text without
    words, or a null one, has no shingles and no link. A row without doc_id has a null component_id, links
    nothing and is kept. Rows that share a doc_id but not the set of shingles are told apart: each has the
    component of its own text. Other columns are not looked at; an empty table gives an empty result.
    """
    return verdicts(docs, threshold, shingle_words, miss).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def without_near_copies(docs: DataFrame, threshold: Fraction, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows of `docs`, all columns as they are, without those linked to a document that stays.

    Of each component the text of the smallest doc_id stays (of several texts of that doc_id the one whose text hash is
    least). Rows without doc_id or words stay. Rows that repeat doc_id and text stay or go together. A row goes by its
    doc_id and text, so another text of the same doc_id is judged by its own links. Only rows that a Bloom filter
    of fixed size does not clear are moved; the filter's false alarms are moved too, and stay.
    """
    bit = F.xxhash64("__id", "__hash", F.lit(0)).alias("__bit")
    gone = stored(verdicts(docs, threshold).filter("not chosen").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).select("*", bit), "near-gone")
    hashed = docs.select("*", F.col("doc_id").cast("long").alias("__id"), F.xxhash64(plain_text("text")).alias("__hash")).select("*", bit)
    marked = maybe_in(hashed, "__bit", filter_of(gone, "__bit", filter_bits, 1), filter_bits)
    clear = marked.filter("not __maybe").select(*docs.columns)
    met = marked.filter("__maybe").join(by_shuffle(gone.drop("__bit")), ["__id", "__hash"], "left_anti")
    return clear.unionByName(met.select(*docs.columns))


def verdicts(docs: DataFrame, threshold: Fraction, shingle_words: int = SHINGLE_WORDS, miss: float = MISS) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and `chosen` of every row: whether it stands for its component."""
    bands = band_count(float(threshold), miss=miss)
    sketches = stored(_sketches(docs, shingle_words, bands), "near-sketches")
    nodes = stored(_nodes(sketches), "near-nodes")
    buckets = stored(_shared_buckets(nodes, bands), "near-buckets")
    sets = stored(_sets_of(docs, nodes, buckets.select("node").distinct(), shingle_words), "near-sets")
    links = stored(_confirmed(stored(_centre_pairs(buckets), "near-centres"), sets, threshold), "near-links")
    labels = components(links)
    apart = stored(_apart(buckets, labels), "near-apart")
    more = stored(_confirmed(stored(_prefix_pairs(sets, apart, threshold), "near-candidates"), sets, threshold), "near-links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    return _labelled(sketches, nodes.drop("keys", "n"), labels)


def _sketches(docs: DataFrame, shingle_words: int, bands: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, a 128-bit fingerprint of the set, half keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                words, at = word_hashes(batch.column(1).slice(a, b - a))
                sizes, prints, keys = [], [], []
                for i in range(b - a):
                    s = shingle_set(words[at[i] : at[i + 1]], shingle_words)
                    sizes.append(len(s))
                    prints.append(_fingerprint(s))
                    keys.append(half_keys(s, bands) if len(s) else None)
                prints = np.array(prints, np.uint64).view(np.int64)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column(0).slice(a, b - a), "text_hash": batch.column(2).slice(a, b - a), "n_shingles": pa.array(sizes, pa.int64()),
                        "set_a": pa.array(prints[:, 0]), "set_b": pa.array(prints[:, 1]), "keys": pa.array(keys, pa.list_(pa.int64())),
                    }
                )

    source = _hashed(docs).select("doc_id", "text", "text_hash")
    return source.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, keys array<bigint>")


def _fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    turned = (shingles << np.uint64(31)) | (shingles >> np.uint64(33))
    mixed = turned * np.uint64(0xD6E8FEB86659FD93)
    return int(np.add.reduce(shingles, dtype=np.uint64)), int(np.add.reduce(mixed ^ (mixed >> np.uint64(32)), dtype=np.uint64))


def _nodes(sketches: DataFrame) -> DataFrame:
    """One row per distinct set: set_a, set_b, doc_id and text_hash of its first document, n, keys, node.

    A node goes by its doc_id; the second set and later ones of one doc_id get numbers from 2**62 on.
    """
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    sets = sketches.filter("doc_id is not null and n_shingles > 0").groupBy("set_a", "set_b").agg(first, F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("set_a", "set_b"))
    other = F.xxhash64("doc_id", "set_a", "set_b").bitwiseAND(SHARED - 1).bitwiseOR(SHARED)
    return sets.select("set_a", "set_b", "first.*", "n", "keys").withColumn("node", F.when(place == 1, F.col("doc_id")).otherwise(other))


def _shared_buckets(nodes: DataFrame, bands: int) -> DataFrame:
    """(key, node, size) of the buckets of all bands * bands tables that hold two nodes or more.

    Counted before the shuffle, then joined back: a bucket of any size is spread, as only counts meet.
    """
    firsts, seconds = f"sequence(0, {bands - 1})", f"sequence({bands}, {2 * bands - 1})"
    pairs = f"flatten(transform({firsts}, i -> transform({seconds}, j -> xxhash64(i, j, keys[i], keys[j]))))"
    # Each node becomes bands * bands rows: they are dealt to as many tasks as a shuffle has, not to the few that the nodes fill.
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.repartition(tasks, "node").select(F.explode(F.expr(pairs)).alias("key"), "node")
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return rows.join(by_shuffle(shared), "key").select("key", "node", "size")


def _centre_pairs(buckets: DataFrame) -> DataFrame:
    """(a, b): each bucket's centre, the node with most bucket mates over all tables, with each other member."""
    weight = buckets.groupBy("node").agg(F.sum("size").alias("weight"))
    centres = buckets.join(by_shuffle(weight), "node").groupBy("key").agg(F.max(F.struct("weight", -F.col("node"))).alias("c"))
    pairs = buckets.join(by_shuffle(centres.select("key", (-F.col("c.col2")).alias("a"))), "key").filter("a != node")
    return pairs.select("a", F.col("node").alias("b")).distinct()


def _sets_of(docs: DataFrame, nodes: DataFrame, near: DataFrame, shingle_words: int, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(node, n, shingles sorted) of the nodes named in `near`.

    A Bloom filter of fixed size tells most other rows where they lie; no text is moved, only the sets of the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(2)):
                words, at = word_hashes(batch.column(2).slice(a, b - a))
                sets = [shingle_set(words[at[i] : at[i + 1]], shingle_words).view(np.int64) for i in range(b - a)]
                sizes = pa.array([len(s) for s in sets], pa.int32())
                ids = [batch.column(c).slice(a, b - a) for c in (0, 1)]
                yield pa.record_batch([*ids, sizes, pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "n", "shingles"])

    wanted = nodes.join(by_shuffle(near), "node", "left_semi").select("node", "doc_id", "text_hash", F.xxhash64("doc_id", "text_hash", F.lit(0)).alias("bit"))
    wanted = stored(wanted, "near-wanted")
    texts = _hashed(docs).select("doc_id", "text_hash", "text", F.xxhash64("doc_id", "text_hash", F.lit(0)).alias("bit"))
    likely = maybe_in(texts, "bit", filter_of(wanted, "bit", filter_bits, 1), filter_bits).filter("__maybe").select("doc_id", "text_hash", "text")
    sets = likely.mapInArrow(run, "doc_id long, text_hash long, n int, shingles array<bigint>").filter("n > 0")
    return sets.join(by_shuffle(wanted), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("node", "n", "shingles")


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(plain_text("text")).alias("text_hash"), "text")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The distinct pairs (a, b) whose full sets are similar enough; sizes alone rule many out before a set is moved.

    `a` may be the centre of any number of pairs: its set is copied once for every CENTRE_PAIRS of them, and
    the pairs are dealt to the copies.
    """
    sized = sets.select("node", "n")
    p, q = threshold.numerator, threshold.denominator
    possible = (
        pairs.join(by_shuffle(sized.select(F.col("node").alias("a"), F.col("n").alias("na"))), "a")
        .join(by_shuffle(sized.select(F.col("node").alias("b"), F.col("n").alias("nb"))), "b")
        .filter(q * F.least("na", "nb") >= p * F.greatest("na", "nb")).select("a", "b")
    )
    possible = stored(possible, "near-pairs")
    copies = possible.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CENTRE_PAIRS).alias("copies"))
    dealt = possible.join(by_shuffle(copies), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("copies")).alias("copy"))
    centres = sets.join(by_shuffle(copies), F.col("node") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), F.col("shingles").alias("set_a"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - both
    others = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    return dealt.join(by_merge(others), "b").join(by_merge(centres), ["a", "copy"]).filter(q * both >= p * union).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of a link.

    Rounds of large-star and small-star steps; their number grows with the logarithm of a component's size.
    Minima are combined before the shuffle; the edges of a hub then meet its minimum in a join whose hot keys adaptive
    execution splits.
    """
    edges = links.select("a", "b").filter("a != b")
    before = None
    while True:
        edges = stored(_small_star(_large_star(edges)), "near-stars")
        # Every edge is of a node to a smaller one; when nothing changes, all are of members to the smallest.
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    members = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component").distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins each node's larger neighbours to the smallest node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(by_shuffle(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins each node's smaller neighbours, and itself, to the smallest of them; edges are (larger, smaller)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(by_shuffle(least), "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _apart(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, component) of the members of buckets that hold more than one component."""
    named = buckets.join(by_shuffle(labels), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("key")
    return named.join(by_shuffle(mixed), "key", "left_semi").select("node", "component").distinct()


def _prefix_pairs(sets: DataFrame, apart: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs (a, b) of different components among `apart` that may be similar enough; none that is, is left out.

    Tokens found in one set only come first in the order and match nothing, so a set with too many of them has
    no partner at all.
    """
    p, q = threshold.numerator, threshold.denominator
    tokens = sets.join(by_shuffle(apart), "node").select("node", "component", "n", F.explode("shingles").alias("token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    found = tokens.join(by_shuffle(common), "token")
    in_set = W.partitionBy("node", "n").orderBy("times", "token")
    placed = (
        found.withColumn("at", F.row_number().over(in_set) - 1 + F.col("n") - F.count(F.lit(1)).over(W.partitionBy("node", "n")))
        .filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * p / q))
        .select("node", "component", "n", "token", "at")
    )
    left, right = (placed.select(*(F.col(c).alias(f"{c}_{s}") if c != "token" else F.col(c) for c in placed.columns)) for s in "ab")
    overlap = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))  # if this is their first common token
    fits = (
        (F.col("component_a") != F.col("component_b")) & (F.col("node_a") < F.col("node_b"))
        & (q * F.least("n_a", "n_b") >= p * F.greatest("n_a", "n_b"))
        & ((p + q) * overlap >= p * (F.col("n_a") + F.col("n_b")))
    )
    return left.join(by_merge(right), "token").filter(fits).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _labelled(sketches: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    named = nodes.join(by_shuffle(labels), "node", "left").select(
        "set_a", "set_b", F.col("doc_id").alias("first_id"), F.col("text_hash").alias("first_hash"),
        (F.coalesce("component", "node") == F.col("node")).alias("stands"), F.coalesce("component", "node").alias("found"),
    )
    # A component whose least node has no number of a document's own: its least doc_id is looked up.
    unnamed = named.filter(F.col("found") >= SHARED)
    least = unnamed.groupBy("found").agg(F.min("first_id").alias("least"))
    named = named.filter(F.col("found") < SHARED).withColumn("least", F.col("found")).unionByName(unnamed.join(by_shuffle(least), "found"))
    rows = sketches.select("doc_id", "text_hash", "n_shingles", "set_a", "set_b")
    joined = rows.join(by_shuffle(named), ["set_a", "set_b"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")))
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    first = F.col("stands") & (F.col("doc_id") == F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    return joined.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.when(linked, first).otherwise(True).alias("chosen"))
