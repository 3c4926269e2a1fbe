import re
from fractions import Fraction
from itertools import combinations

import pyarrow as pa

from feedweave.llm import near_dedup, words
from tests.llm.fixtures import AWKWARD, docs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, n=5):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, threshold):
    """component by doc_id over all pairs that share a shingle."""
    sets = {}
    for i, t in rows:
        sets.setdefault(frozenset(plain_set(t)), []).append(i)
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)

    posts = {}
    for s, ids in sets.items():
        if s:
            for i in ids[1:]:
                join(ids[0], i)
            for x in s:
                posts.setdefault(x, []).append(s)
    seen = set()
    for group in posts.values():
        for a, b in combinations(group, 2):
            pair = frozenset((id(a), id(b)))
            if pair not in seen:
                seen.add(pair)
                if len(a & b) >= threshold * len(a | b):
                    join(sets[a][0], sets[b][0])
    return {i: root(i) for i in parent}


def check(spark, rows, threshold=Fraction(85, 100)):
    got = near_dedup.near_duplicates(docs(spark, rows), threshold).collect()
    want = brute([(i, t) for i, t in rows if i is not None], threshold)
    texts = {i: t for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == len(plain_set(texts[r.doc_id]))
        assert (r.component_id, r.kept) == ((want[r.doc_id], want[r.doc_id] == r.doc_id) if r.doc_id is not None else (None, True))


def test_awkward_rows(spark):
    check(spark, AWKWARD)
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_whole_table_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    check(spark, rows)


def test_crowd_of_near_copies_below_and_above_the_threshold(spark):
    """A base with copies of 0 to 7 changed words: pairs of copies are mostly below, some only linked through others."""
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(160):
        w = list(base)
        for j in range(k % 8):
            w[(k * 37 + j * 41) % 150] = f"x{k}_{j}"
        rows.append((1000 - k, " ".join(w)))
    rows += [(2000 + k, " ".join(f"{k}y{i}" for i in range(60)) + " " + " ".join(base[:40])) for k in range(60)]  # share a passage
    check(spark, rows[1:])  # without the untouched base
    check(spark, rows, Fraction(8, 10))


def test_chain_is_one_component(spark):
    text = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(40):
        rows.append((500 - k * 3, " ".join(text)))
        text[k * 5] = f"changed{k}"
    check(spark, rows)


def test_tables_are_found_as_often_as_stated():
    bands = near_dedup.band_count(0.85)
    assert bands == 11 and (1 - (1 - 0.85**3) ** bands) ** 2 > 1 - near_dedup.MISS


def test_word_hashes_follow_the_definition():
    texts = ["A b\x0bC\x1cD É\x85x", "", None, "one", " lead and trail \n", "a\x00b a\x00b"]
    h, at = words.word_hashes(pa.array(texts, pa.string()))
    flat = [w for t in texts for w in re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))]
    assert len(h) == len(flat) == at[-1]
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))
