from fractions import Fraction

import corpus_pipeline
import pyarrow as pa

from feedweave.llm import gam, near_dedup, queries
from tests.llm.fixtures import AWKWARD, docs
from tests.llm.test_decontaminate import plain_matches
from tests.llm.test_near_dedup import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_plain_code(spark):
    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r.text for r in docs_.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stage = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact dedup", "near dedup", "decontamination", "bpe"]

    def step(name, frame, want):
        out = stage[name](spark, frame, SF)
        assert out.columns == COLUMNS
        out = spark.createDataFrame(out.collect(), docs_.schema)
        assert {r.doc_id for r in out.collect()} == want
        return out, {i: rows[i] for i in want}

    model = gam.train(docs_, labels)
    good = {i for i, s in zip(rows, model.score(gam.features(pa.array(rows.values()))), strict=True) if s >= 0.5}
    frame, left = step("quality", docs_, good)
    last = {}
    for i, t in left.items():
        last[t] = max(i, last.get(t, i))
    frame, left = step("exact dedup", frame, set(last.values()))
    frame, left = step("near dedup", frame, {i for i, c in brute(list(left.items()), Fraction(8, 10)).items() if i == c})
    frame, left = step("decontamination", frame, set(left) - {d for d, _ in plain_matches(list(left.items()), items)})
    got = {r.doc_id: r for r in stage["bpe"](spark, frame, SF).collect()}
    encode = queries.BYTE_BPE.encoder().encode_ordinary
    assert set(got) == set(left)
    assert all(r.round_trip and r.ids == encode(left[i]) and r.n_tokens == len(r.ids) for i, r in got.items())
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(left)


def test_awkward_rows_pass_every_stage(spark):
    frame = docs(spark, AWKWARD)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, SF)
        assert out.columns == frame.columns, name
        assert out.count() <= frame.count()
        assert stage(spark, frame.limit(0), SF).count() == 0
    assert corpus_pipeline.tokens(spark, frame, SF).filter("not round_trip").count() == 0


def test_dedup_stages_judge_rows_by_id_and_text(spark):
    one, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    edited = one.replace("w39", "x39")
    rows = [(6, "copied text here"), (6, "unique text kept nowhere else"), (9, "copied text here"), (None, "copied text here"), (None, "two without id"), (None, "two without id"), (5, None), (7, "")]
    left = lambda stage, given: sorted(((r.doc_id, r.text) for r in stage(spark, docs(spark, given), SF).collect()), key=repr)
    want = [(6, "unique text kept nowhere else"), (7, ""), (9, "copied text here"), (None, "two without id")]
    assert left(corpus_pipeline.exact, rows) == sorted(want, key=repr)
    assert left(corpus_pipeline.exact, [(1, "a"), (1, "a"), (1, "b"), (2, "b")]) == [(1, "a"), (2, "b")]
    # The other text of document 6 is no copy of anything; the edited one is.
    near = [(3, one), (6, edited), (6, other), (8, other.replace("v0", "y0")), (None, one + " x"), (2, ""), (2, None)]
    assert left(corpus_pipeline.near, near) == sorted([(3, one), (6, other), (None, one + " x"), (2, ""), (2, None)], key=repr)
    # One of two texts of the smallest doc_id stays, and one of texts with equal words.
    assert len(left(corpus_pipeline.near, [(4, one), (4, edited), (9, edited)])) == 1
    assert len(left(corpus_pipeline.near, [(4, one), (4, one.upper()), (4, one + " ")])) == 1
    found = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs(spark, near)).collect()}
    assert found == {(3, 3), (6, 3), (6, 6), (8, 6), (None, None), (2, 2)}
