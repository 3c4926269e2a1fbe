import zlib

import numpy as np
import pyarrow as pa

from feedweave.llm import language
from tests.llm.fixtures import AWKWARD

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string, score string, known int"
held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1) for i, t, lang in rows], SCHEMA)


def samples(n, wrong=False):
    words = {"aa": ["kata", "moko", "tikapo", "naka"], "bb": ["schwer", "strumpf", "zwischt", "grunz"], "cc": ["éclairé", "voilà", "garçon", "âgé"]}
    rng = np.random.default_rng(4)
    out = []
    for i in range(n):
        lang = ["aa", "bb", "cc"][i % 3]
        out.append((i, " ".join(rng.choice(words[lang], 12)), "aa" if wrong and held(i) else lang))
    return out


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    truth = [(got[r.doc_id], r.lang) for r in docs.select("doc_id", "lang").collect() if held(r.doc_id)]
    assert len(got) == docs.count() and all(r.held_out for r, _ in truth)
    assert np.mean([r.lang_pred == lang for r, lang in truth]) > 0.99
    sure = [(r, lang) for r, lang in truth if not r.rejected]
    assert len(sure) > 0.95 * len(truth) and np.mean([r.lang_pred == lang for r, lang in sure]) >= 0.99
    # Calibrated: the scores' mean is about the share of right answers.
    assert abs(np.mean([r.score for r, _ in truth]) - np.mean([r.lang_pred == lang for r, lang in truth])) < 0.02


def test_nothing_is_learned_from_held_out_rows(spark):
    one, two = (sorted(map(tuple, language.identify(table(spark, samples(300, wrong))).collect())) for wrong in (False, True))
    assert one == two and all(r[2] == ["aa", "bb", "cc"][r[0] % 3] for r in one)


def test_subwords_by_plain_code():
    words = [b"ab", b"x", "né".encode()]
    owner, bucket = language.subwords(pa.array(words, pa.large_binary()))
    want = []
    for i, w in enumerate(words):
        marked = b" " + w + b" "
        want += [(i, marked, 0)] + [(i, marked[k : k + n], n) for n in language.GRAMS for k in range(len(marked) - n + 1)]

    def plain(text, n):
        total = sum(int(language._VALUES[c]) * pow(int(language.BASE), k, 2**64) for k, c in enumerate(text)) % 2**64
        return int(language.mix(np.array([(total + n) % 2**64], np.uint64))[0] % language.BUCKETS)

    assert sorted(zip(owner.tolist(), bucket.tolist())) == sorted((i, plain(t, n)) for i, t, n in want)


def test_score_of_a_text_does_not_depend_on_its_batch():
    texts = [t for _, t, _ in samples(30)] + ["", None, "Éa b", "1 2 3"]
    parts = np.random.default_rng(0).normal(size=(language.BUCKETS, 3))
    together, n = language.logits(pa.array(texts), parts)
    for i, t in enumerate(texts):
        alone, m = language.logits(pa.array([t], pa.string()), parts)
        assert np.allclose(alone[0], together[i], atol=1e-9) and m[0] == n[i]
    bags = language.histograms(pa.array(texts))
    assert all(np.allclose(times @ parts[at] if len(at) else np.zeros(3), together[i], atol=1e-9) for i, (at, times) in enumerate(bags))


def test_awkward_rows(spark):
    rows = samples(120) + [(1000 + (i or 0), t, None) for i, t in AWKWARD[:-1]] + [(None, "kata moko", "aa"), (5000, "123 ... !", "bb"), (5001, "ß", None), (5001, "ß", None)]
    got = language.identify(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].lang_pred == "aa" and not by_id[None].held_out
    for i in (5000, 1002, 1003, 1004):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].rejected) == ("und", 0.0, True)
    assert by_id[5001].lang_pred in ("aa", "bb", "cc") and all(0 <= r.score <= 1 for r in got)
    assert language.identify(table(spark, [])).collect() == []
    untaught = language.identify(table(spark, [(1, "some text", None), (2, None, "en")])).collect()
    assert {(r.lang_pred, r.score) for r in untaught} == {("und", 0.0)} or all(r.lang_pred == "en" for r in untaught if r.doc_id == 1)


def test_bound_on_scores():
    score, right = np.array([0.9, 0.8, 0.8, 0.7, 0.6]), np.array([1, 1, 0, 1, 1], bool)
    assert language._bound(score, right, 0.99) == 0.9 and language._bound(score, right, 0.8) == 0.6
    assert language._bound(score, ~right, 0.99) > 1
