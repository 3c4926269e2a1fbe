import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from feedweave.llm import bpe, exact_dedup, queries, sharding, token_files
from tests.llm.fixtures import AWKWARD, docs


def test_exact_groups_awkward_rows(spark):
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_groups(docs(spark, AWKWARD), filter_bits=1 << 16).collect()}
    for i, t in AWKWARD:
        r = got[i, hashlib.sha256((t or "").encode()).hexdigest()]
        same = [j for j, u in AWKWARD if (u or "") == (t or "")]
        keep = max((j for j in same if j is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(same), i == keep)


@pytest.mark.parametrize("bits", [1 << 16, 1 << 25])
def test_exact_groups_crowded_filter_is_still_exact(spark, bits):
    rows = [(i, f"text {i % 3000}" if i % 3 else "hot") for i in range(20_000)]
    got = exact_dedup.exact_groups(docs(spark, rows), filter_bits=bits).collect()
    want = {}
    for i, t in rows:
        want.setdefault(t, []).append(i)
    assert len(got) == len(rows)
    assert all((r.keep_id, r.group_size) == (max(want[t]), len(want[t])) for r, t in ((r, dict(rows)[r.doc_id]) for r in got))


def test_every_repeated_hash_is_seen(spark):
    h = spark.range(5000).selectExpr("xxhash64(id % 4000) as print")
    blocks = {r.block: r.words for r in exact_dedup.filter_of(h, "print", 1 << 20, 2).collect()}
    first, second = exact_dedup.bit_positions(np.array([r[0] for r in spark.range(1000).selectExpr("xxhash64(id)").collect()]), 1 << 20)
    for at in np.concatenate((first, second)).tolist():
        assert blocks[at // 1024][at % 1024 // 64] >> (at % 64) & 1


def test_empty_tables(spark):
    none = docs(spark, [])
    assert exact_dedup.exact_groups(none).count() == 0
    assert sharding.shard_documents(none, 4).count() == 0
    assert bpe.digests(none, queries.BYTE_BPE).count() == 0
    assert token_files.read_token_files(*token_files.write_token_files(none, queries.WORD_BPE, 1)).count() == 0


def jump(key, n):
    """The published algorithm."""
    key, b, j = (key or 0) % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards(spark):
    rows = AWKWARD + [(i * 7919, f"text {i}") for i in range(-2000, 2000)]
    got = sharding.shard_documents(docs(spark, rows), 16).collect()
    assert sorted((r.doc_id or 0, r.text_crc32, r.size) for r in got) == sorted((i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows)
    for r in got:
        assert (r.shard, r.grown_shard, r.law) == (jump(r.doc_id, 16), jump(r.doc_id, 17), "key")
        assert r.grown_shard in (r.shard, 16)
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_one_shard(spark):
    assert {r.shard for r in sharding.shard_documents(docs(spark, AWKWARD), 1).collect()} == {0}


def test_tree_joins_equal_one_call():
    tree_of = lambda leaf, window: bpe.TreeEncoder(queries.BYTE_BPE, leaf, window)
    whole = queries.BYTE_BPE.encoder().encode_ordinary
    random.seed(5)
    letters = "ab c'  \n\t é1２'s,.!日 \x1c ll're"
    trees = [tree_of(1, 1), tree_of(3, 2), tree_of(7, 4)]
    for _ in range(1500):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 70)))
        for tree in trees:
            ids = tree.encode(text)
            assert ids == whole(text)
            assert tree.decode(ids) == text.encode()


def test_bpe_documents(spark):
    enc = queries.BYTE_BPE.encoder()
    got = {(r.doc_id, r.decoded_sha256): r for r in bpe.digests(docs(spark, AWKWARD), queries.BYTE_BPE).collect()}
    full = {(r.doc_id, bytes(r.decoded)): r.ids for r in bpe.encode_documents(docs(spark, AWKWARD), queries.BYTE_BPE).collect()}
    for i, t in AWKWARD:
        ids = enc.encode_ordinary(t or "")
        r = got[i, hashlib.sha256((t or "").encode()).hexdigest()]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert full[i, (t or "").encode()] == ids


def test_token_files(spark):
    k = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    special = ["<|endoftext|>", "a <|startoftext|> b", "<|ENDOFTEXT|>", "x<|endoftext|>y.", "<|endoftext|>,", "<|endoftext", "é<|StartOfText|> <|startoftext|><|endoftext|>"]
    rows = AWKWARD + [(200 + i, t) for i, t in enumerate(special)] + [(100 + i, f"Some, words. here's  {i} Ünïcode İstanbul Σας ﬁ éa no-op,,. A.B.") for i in range(50)]
    folder, parts = token_files.write_token_files(docs(spark, rows), queries.WORD_BPE, 1)
    got = sorted(token_files.read_token_files(folder, parts).collect(), key=lambda r: r.start)
    start = 0
    for (i, t), r in zip(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), got, strict=True):
        ids = [*k.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_cache_overflow_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_WORDS", 20)
    encoder = token_files.WordEncoder(queries.WORD_BPE, "<u2")
    encoder.known = {}
    texts = [" ".join(f"word{i}, Abc{j}." for i in range(15)) for j in range(6)]
    ids, at = encoder.encode(pa.array(texts))
    for i, t in enumerate(texts):
        one, _ = encoder.encode(pa.array([t]))
        assert one.tolist() == ids[at[i] : at[i + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids
