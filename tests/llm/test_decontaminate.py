import random

import numpy as np
import pyarrow as pa
import pytest

from feedweave.llm import decontaminate as dc
from tests.llm.fixtures import AWKWARD, docs


def plain_align(item, window):
    """Smith-Waterman with a full matrix."""
    h = [[0] * (len(window) + 1) for _ in range(len(item) + 1)]
    for i, x in enumerate(item, 1):
        for j, y in enumerate(window, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def words_of(text):
    return (text or "").lower().split()


def plain_matches(rows, items, similarity=dc.SIMILARITY):
    """Scores of all pairs that share four words in a row (or a whole shorter item), over the whole text."""
    out = {}
    for d, t in rows:
        w = words_of(t)
        for i, text in items:
            q = words_of(text)
            n = min(len(q), dc.SEED_WORDS + dc.SEED_WINDOW - 1 if len(q) > dc.SEED_WORDS else len(q))
            runs = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
            if any(tuple(q[k : k + n]) in runs for k in range(len(q) - n + 1)) and n:
                score = plain_align(q, w)
                if score >= similarity * 2 * len(q):
                    out[d, i] = score
    return out


def table(spark, items):
    return spark.createDataFrame([(i, t, 0.0, "x") for i, t in items], "item_id long, text string, score double, doc_id string")


def make(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(say(rng.randint(12, 60)))) for k in range(25)] + [(90, "two words"), (91, "Single"), (92, ""), (93, None), (94, "a b c d")]
    rows = []
    for d in range(160):
        text = say(rng.randint(0, 150))
        if d % 2:
            copy = items[rng.randrange(25)][1].split()
            for _ in range(rng.randint(0, len(copy) // 3)):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], ["changed"], ["put", copy[at]], [copy[at].upper()]])
                copy = copy or ["x"]
            if d % 6 == 1:
                copy = copy[: len(copy) * 2 // 3]
            at = rng.randint(0, len(text))
            text[at:at] = copy * rng.choice([1, 1, 1, 3])
        rows.append((d, " \n".join(text)))
    return rows + [(300, "here are TWO words"), (301, "a  b c d"), (302, "single")], items


@pytest.mark.parametrize("block_words", [dc.BLOCK_WORDS, 100])
def test_all_pairs(spark, block_words):
    rows, items = make()
    got = {(r.doc_id, r.item_id): r for r in dc.matches(docs(spark, rows), table(spark, items), block_words=block_words).collect()}
    want = plain_matches(rows, items)
    assert len(want) > 60 and set(want) <= set(got)
    texts, sought = dict(rows), dict(items)
    for (d, i), r in got.items():
        full = plain_align(words_of(sought[i]), words_of(texts[d]))
        inside = words_of(texts[d])[r.start_word : r.end_word]
        assert r.score == full == plain_align(words_of(sought[i]), inside)  # also of pairs found by a shorter seed
        assert r.similarity == full / (2 * r.item_words) >= dc.SIMILARITY
    clean = {r.doc_id for r in dc.decontaminate(docs(spark, rows), table(spark, items), block_words=block_words).collect()}
    assert clean == {d for d, _ in rows} - {d for d, _ in got}


def test_item_in_most_documents_is_still_found(spark):
    item = " ".join(f"common{i}" for i in range(20))
    rows = [(i, f"intro {i} {item} end {i}") for i in range(500)]
    assert dc.matches(docs(spark, rows), table(spark, [(1, item)])).count() == 500


def test_awkward_rows(spark):
    items = [(1, "quick brown fox jumps over"), (2, None), (None, "no id"), (1, "quick brown fox jumps over")]
    got = sorted((r.doc_id, r.item_id) for r in dc.matches(docs(spark, AWKWARD), table(spark, items)).filter("item_id = 1").collect())
    assert got == [(1, 1), (1, 1)] + [(5, 1)] * 4
    assert dc.matches(docs(spark, AWKWARD), table(spark, items)).filter("item_id is null and doc_id is null").count() == 1
    left = dc.decontaminate(docs(spark, AWKWARD), table(spark, items))
    assert left.columns == docs(spark, AWKWARD).columns and left.count() == len(AWKWARD) - 4
    for d, b in ((docs(spark, []), table(spark, items)), (docs(spark, AWKWARD), table(spark, []))):
        assert dc.matches(d, b).count() == 0
        assert dc.decontaminate(d, b).count() == d.count()


def test_alignment_in_batches():
    rng = np.random.default_rng(1)
    items = [rng.integers(2, 9, rng.integers(1, 30)).astype(np.uint64) for _ in range(200)]
    windows = [rng.integers(2, 9, rng.integers(1, 60)).astype(np.uint64) for _ in range(200)]
    score, end = dc.align(items, windows)
    for i, w, s, e in zip(items, windows, score, end, strict=True):
        assert s == plain_align(i.tolist(), w.tolist()) == plain_align(i.tolist(), w[: e + 1].tolist())


def test_no_texts():
    block = dc.Block.of([1], [np.array([5, 6, 7], np.uint64)], 3)
    assert len(dc.find(block, pa.array([], pa.string()), 0.5)["text"]) == 0
