import math
import re
import zlib

import numpy as np
import pyarrow as pa

from feedweave.llm import gam
from tests.llm.fixtures import AWKWARD, docs

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    d, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in gam.classify(d, labels).collect()}
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(got) == d.count() and all(r.held_out for r, _ in held)
    assert np.mean([r.predicted == q for r, q in held]) > 0.95
    assert np.mean([r.predicted for r, q in held if q == 1]) > 0.97


def test_held_out_labels_and_other_columns_change_nothing(spark):
    rows = [(i, ("fine words here " * 5 if i % 2 else "### | | ###") + str(i)) for i in range(400)]
    flip = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    label = lambda wrong: spark.createDataFrame([(i, (i % 2) ^ (wrong and flip(i)), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    score = lambda d, l: sorted((r.doc_id, r.score) for r in gam.classify(d, l).collect())
    one = score(docs(spark, rows), label(False))
    assert one == score(docs(spark, rows).selectExpr("doc_id", "text", "'fr' as lang", "1 as score", "2 as wanted"), label(True))
    assert all((s >= 0.5) == (i % 2 == 1) for i, s in one)


def test_interaction_needs_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    with_pairs = gam.fit(x, y)
    without = gam.fit(x, y, gam.Settings(pairs=0))
    right = lambda m: np.mean((m.score(x) >= 0.5) == y)
    assert right(with_pairs) > 0.9 > 0.75 > right(without)
    assert with_pairs.pairs[0] == (0, 1)


def test_awkward_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = gam.classify(docs(spark, AWKWARD), none).collect()
    assert len(got) == len(AWKWARD) and {r.score for r in got} == {0.5}
    strange = spark.createDataFrame([(1, None, 0), (None, 1, 0), (9, 1, 1), (9, 1, 1), (10, 0, 0)], "doc_id long, quality int, toxic int")
    assert len(gam.classify(docs(spark, AWKWARD), strange).collect()) == len(AWKWARD)
    assert gam.classify(docs(spark, []), none).count() == 0


def test_features_are_those_of_each_text_alone():
    texts = [t for _, t in AWKWARD]
    together = gam.features(pa.array(texts, pa.string()))
    apart = np.concatenate([gam.features(pa.array([t], pa.string())) for t in texts])
    np.testing.assert_allclose(together, apart, rtol=1e-9, atol=1e-12)
    x = dict(zip(gam.FEATURES, gam.features(pa.array(["Ab ab ab c | 1!"]))[0], strict=True))
    assert (x["upper"], x["bars"], x["digit"], x["repeated_neighbours"], x["one_byte_words"]) == (1 / 15, 1 / 15, 1 / 15, 2 / 6, 2 / 6)


def plain_features(text):
    """The features by definition, one text, word and byte at a time."""
    data = (text or "").encode()
    n = len(data)
    if not n:
        return [0.0] * len(gam.FEATURES)
    words = [w for w in re.split(rb"[ \t-\r]+", data) if w]
    lower = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    spaces, lines, w = sum(c == 32 or 9 <= c <= 13 for c in data), data.count(b"\n") + 1, len(words)
    signs = set(gam.BYTE_CLASSES["signs"])
    run = most = 0
    for i, word in enumerate(lower):
        run = run + 1 if i and word == lower[i - 1] else 1
        most = max(most, run)
    share = lambda part, whole: part / whole if whole > 0 else 0.0
    x = {name: sum(c in set(members) for c in data) / n for name, members in gam.BYTE_CLASSES.items()} | {
        "log_chars": math.log1p(n), "log_words": math.log1p(w), "word_length": share(n - spaces, w), "space": spaces / n, "words_per_line": w / lines, "log_lines": math.log(lines),
        "distinct_words": share(len(set(lower)), math.sqrt(w)), "repeated_neighbours": share(sum(a == b for a, b in zip(lower, lower[1:])), w),
        "repeated_pairs": share(max(0, w - 1) - len(set(zip(lower, lower[1:]))), w), "one_byte_words": share(sum(len(a) == 1 for a in words), w),
        "capital_words": share(sum(65 <= a[0] <= 90 for a in words), w), "sign_words": share(sum(a[0] in signs or a[-1] in signs for a in words), w),
        "longest_run": share(most, math.sqrt(w)), "distinct_bytes": len(set(data)) / math.sqrt(n) if w else 0.0,
    }
    return [x[name] for name in gam.FEATURES]


def test_features_and_scores_by_plain_code(spark):
    texts = [t for _, t in AWKWARD if len(t or "") < 1000] + ["a a a b a b", "ONE one\nTwo | !! \"q\" x1 #z é", "\n\n", "the the"]
    texts += [r.text[:2000] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()[:60]]
    got = gam.features(pa.array(texts, pa.string()))
    assert np.allclose(got, [plain_features(t) for t in texts], atol=1e-9)
    rng = np.random.default_rng(5)
    x = rng.random((3000, 4))
    model = gam.fit(x, ((x[:, 0] > 0.4) ^ (x[:, 2] > 0.7)).astype(float))
    for row, score in zip(x[:200], model.score(x[:200])):
        total = model.bias + sum(table[sum(row[k] >= c for c in model.cuts[k])] for k, table in enumerate(model.tables))
        for (i, j), table in zip(model.pairs, model.pair_tables):
            total += table[sum(row[i] >= c for c in model.pair_cuts[i]), sum(row[j] >= c for c in model.pair_cuts[j])]
        assert math.isclose(score, 1 / (1 + math.exp(-total)), rel_tol=1e-9)
