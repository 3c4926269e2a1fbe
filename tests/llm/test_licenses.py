import math
import random

import pytest
import regex

from feedweave.llm import licenses as lic
from tests.llm.fixtures import AWKWARD, docs


def words_of(text):
    return regex.split(lic.SEPARATORS, (text or "").lower())


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows, statements):
    """Every window of every document against every template."""
    out = {}
    for name, statement in statements.items():
        want = [w for w in words_of(statement) if w]
        width, step = lic.window_of(len(want))
        for d, t in rows:
            w = words_of(t)
            for start in range(0, max(1, len(w)), step):
                share = len(shingles(w[start : start + width]) & shingles(want)) / len(shingles(want))
                if share >= lic.CONTAINMENT:
                    out.setdefault((d, name), {})[start] = share
    return {k: (max(v.values()), min(s for s, x in v.items() if x == max(v.values())), len(v)) for k, v in out.items()}


def got(spark, rows, statements):
    found = lic.find_licenses(docs(spark, rows), lic.template_table(spark, statements)).collect()
    return {(r.doc_id, r.template): (r.containment, r.first_word, r.windows) for r in found}


def test_statements_whole_edited_and_cut(spark):
    rng = random.Random(2)
    names = list(lic.STATEMENTS)
    rows = []
    for d in range(400):
        text = [rng.choice(["the", "licensed", "under", "license", "of", "w1", "w2", "version"]) for _ in range(rng.randint(0, 80))]
        if d % 2:
            s = lic.STATEMENTS[rng.choice(names)].split()
            for _ in range(rng.randint(0, 2)):
                s[rng.randrange(len(s))] = rng.choice(["changed", "...", "THE"])
            s = s[rng.choice([0, 0, 2]) :]
            at = rng.randint(0, len(text))
            text[at:at] = s * rng.choice([1, 1, 2])
        rows.append((d, rng.choice([" ", "\n", " - "]).join(text)))
    want = brute(rows, lic.STATEMENTS)
    assert len(want) > 50 and got(spark, rows, lic.STATEMENTS) == want


def test_awkward_rows(spark):
    statements = {"a": "The QUICK brown fox jumps", "b": "word word word word word word", "c": "no id at all here"}
    rows = [r for r in AWKWARD if r[0] != 5]
    assert got(spark, rows, statements) == brute(rows, statements)
    assert got(spark, [], statements) == {} == got(spark, rows, {"z": "never said in any of these"})
    for bad in ({"short": "too few words"}, {"": "..."}):
        with pytest.raises(ValueError):
            got(spark, rows, bad)


def test_bands_keep_the_promise():
    for n in (5, 7, 12, 30, 200):
        bands = lic.band_count([n])
        t, w = n - 4, lic.window_of(n)[0] - 4
        have = math.ceil(0.8 * t)
        assert (1 - have / (t + w - have)) ** bands <= lic.MISS
