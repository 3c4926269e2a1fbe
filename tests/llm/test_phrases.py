import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from feedweave.llm import phrases
from tests.llm.fixtures import AWKWARD

SCHEMA = "doc_id long, text string, lang string, phrase string, n long, score int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, 1) for i, t, lang in rows], SCHEMA)


def plain(rows, max_words=3, min_count=10, held_percent=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n["und" if lang is None else lang] += len(words)
            for k in range(1, max_words + 1):
                f["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        held = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    held[p[i : i + k]] = max(held[p[i : i + k]], a)
        kept = []
        for p, a in found.items():
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if not (p in held and 100 * held[p] >= held_percent * a):
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        kept.sort()
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(kept[:top], 1)]
    return sorted(out)


def mined(spark, rows, **limits):
    return sorted(map(tuple, phrases.collocations(table(spark, rows), **limits).collect()))


def sentences(seed, n, words):
    rng = np.random.default_rng(seed)
    names = np.array([f"w{i}" for i in range(words)])
    return [" ".join(names[np.minimum(rng.geometric(0.2, int(rng.integers(1, 60))), words) - 1]) + rng.choice([".", ", x", "\n", " "]) for _ in range(n)]


def test_equals_plain_counts(spark):
    rows = [(i, t, ["en", "de", None, "und"][i % 4]) for i, t in enumerate(sentences(0, 400, 90))]
    got = mined(spark, rows)
    assert len(got) > 300 and got == plain(rows)
    assert mined(spark, rows, max_words=5, min_count=3, top=50) == plain(rows, max_words=5, min_count=3, top=50)
    assert mined(spark, rows, max_words=2) == plain(rows, max_words=2)


def test_dense_and_sparse_tiles_agree(spark, monkeypatch):
    rows = [(i, t, "en") for i, t in enumerate(sentences(1, 300, 50))]
    want = mined(spark, rows)
    tiles, u = phrases.Tiles(), np.random.default_rng(2).integers(0, phrases.HEAD + 9, 60_000)
    v = u[::-1].copy()
    u[:20_000], v[:20_000] = u[:20_000] % 7, 3
    a, b, times = tiles.add("en", u, v)
    found = Counter(dict(zip(zip(a.tolist(), b.tolist()), times.tolist())))
    assert tiles.open
    for _, x, y, n in tiles.drain():
        found.update(dict(zip(zip(x.tolist(), y.tolist()), n.tolist())))
    assert found == Counter(zip(u.tolist(), v.tolist())) and not tiles.open
    monkeypatch.setattr(phrases, "SLICE_BYTES", 200)
    assert mined(spark, rows) == want == plain(rows)


def test_one_pair_in_a_third_of_all_words(spark):
    rows = [(i, "hot pair " * 50 + t, "en") for i, t in enumerate(sentences(3, 60, 40))]
    assert mined(spark, rows) == plain(rows)


def test_awkward_rows(spark):
    rows = [(i, t, "en") for i, t in AWKWARD] + [(i, "ÄB c D\tä b É\x0b, c d.. c d;c d", None) for i in range(12)]
    rows += [(90 + i, " ".join("x" * 200 + str(k) for k in range(3)), "long") for i in range(11)] + [(1, "a b", "")] * 10
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, []) == [] and mined(spark, [(1, None, None), (2, "", "en")]) == []


def test_words_and_pieces():
    codes, words, piece = phrases.words_of(pa.array(["A b, a", None, "a\tB"]))
    assert [words[c].as_py() for c in codes] == [b"a", b"b", b"a", b"a", b"b"]
    assert [piece[i] == piece[i + 1] for i in range(4)] == [True, False, False, True]
