import numpy as np
import pytest
from pyspark.sql import functions as F

from feedweave.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, score long, cell string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], SCHEMA)


def plain(rows, every, positives=5, negatives=10):
    """The same by definition, with Python integers."""
    seen = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v):
            one = (label, [float(np.float32(x)) for x in v])
            seen[i] = min(seen.get(i, one), one)
    whole = {i: (label, [int(np.floor(256 * x)) for x in v]) for i, (label, v) in seen.items()}
    out = []
    for a, (label, v) in whole.items():
        if a % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, (other, w) in whole.items() if i != a))
        for p, positive, _ in [s for s in scored if s[2]][:positives]:
            fits = [s for s in scored if not s[2] and 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives]
            out += [(a, positive, rank, i, -p, -s) for rank, (s, i, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, every=7, **sizes):
    return sorted(map(tuple, hn.hard_negatives(table(spark, rows), F.col("vec_id") % every == 0, **sizes).collect()))


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 64, 5), (65, 33, 130), (40, 47, 40), (0, 3, 2)])
def test_strassen_equals_product(shape):
    m, k, n = shape
    rng = np.random.default_rng(m)
    a, b = rng.integers(-(2**20), 2**20, (m, k)), rng.integers(-(2**20), 2**20, (k, n))
    assert (hn.strassen(a, b, leaf=4) == a @ b).all()
    wide = rng.integers(-(2**62), 2**62, (m, k))
    assert (hn.strassen(wide, b, leaf=4) == wide @ b).all()  # modulo 2**64


def test_scores_beyond_64_bits_on_the_way():
    a, b = np.array([[2.0**40, 2.0**40, 3.0]]), np.array([[2.0**40, -(2.0**40), 5.0]])
    assert hn.scores(a, b).tolist() == [[15]]
    with pytest.raises(OverflowError):
        hn.scores(a, a)


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(3)
    parts = [(rng.integers(0, 4, 30), rng.integers(-3, 3, 30), rng.integers(0, 9, 30)) for _ in range(4)]
    one = [x.tolist() for x in hn.merged(parts, 5)]
    two = hn.merged([hn.merged(parts[2:], 5), hn.merged(parts[:2], 5)], 5)
    assert one == [x.tolist() for x in two]


def test_equals_brute_force_in_many_cells_and_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(0.1, 0.3, 9).tolist(), int(rng.integers(0, 3))) for i in range(230)]
    got = mined(spark, rows, cell_values=200, block_values=60)
    assert got == plain(rows, 7) and got == mined(spark, rows)


def test_ties_and_a_hot_vector(spark):
    rows = [(i, [0.5, 0.25], i % 2) for i in range(300)] + [(1000 + i, [0.25, 0.2], i % 2) for i in range(40)]
    assert mined(spark, rows, every=50, cell_values=100) == plain(rows, 50)


def test_awkward_rows(spark):
    good = [(i, [0.1 * i, -0.2, 0.3], i % 2) for i in range(20)]
    odd = [
        (None, [1.0, 1.0, 1.0], 1), (21, None, 0), (22, [1.0, None, 0.0], 0), (23, [float("nan")], 0), (24, [float("inf"), 1.0], 1), (25, [1.0], None),
        (28, [], 0), (35, [0.4], 1), (-7, [0.3, 0.3, 0.3], 1), (7, [0.9, 0.1, 0.2], 1), (7, [0.9, 0.1, 0.2], 1), (14, [0.2, 0.2, 0.2], 1),
    ]
    assert mined(spark, good + odd) == plain(good + odd, 7)
    assert mined(spark, []) == [] and mined(spark, odd[:6]) == []
    assert mined(spark, [(7, [1.0], 1), (8, [1.0], 2)]) == []
