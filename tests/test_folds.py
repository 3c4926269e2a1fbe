"""Distributed operators against plain sequential code on random data, hot keys included."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedweave.functions import text
from feedweave.operators import merge, ordering, related, search, throttle
from feedweave.operators.skew import lookup_by_key

T0 = datetime(2026, 1, 1)


@pytest.fixture(autouse=True)
def many_pieces(spark):
    """Small data would be merged into one partition; keep them apart so the cuts are exercised."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def fold(events, gap, key):
    last, kept = {}, []
    for e in sorted(events, key=lambda e: (e[1], e[0])):
        k = key(e)
        if k in last and (e[1] - last[k]).total_seconds() * 1000 < gap:
            continue
        last[k] = e[1]
        kept.append(e[0])
    return kept


def random_events(seed, n, dense):
    rnd = random.Random(seed)
    out, at = [], 0
    for i in range(n):
        at += rnd.randint(0, 40) if dense else rnd.choice([0, 5, 900, 5000, 400_000])
        out.append((i, T0 + timedelta(milliseconds=at), rnd.choice(["hot", "hot", "hot", "a", None])))
    return out


@pytest.mark.parametrize("seed,dense", [(1, True), (2, False), (3, True)])
def test_throttle_equals_fold(spark, seed, dense):
    ev = random_events(seed, 3000, dense)
    df = spark.createDataFrame(ev, "event_id bigint, at timestamp, kind string").repartition(5)
    for gap, keys, key in ((100, ["kind"], lambda e: e[2]), (37, [], lambda e: 0), (5000, ["kind"], lambda e: e[2])):
        got = sorted(r.event_id for r in throttle.throttle_events(df, keys, gap).select("event_id").collect())
        assert got == sorted(fold(ev, gap, key)), (gap, keys)


def test_piece_exits_cover_every_entry():
    rnd = np.random.default_rng(0)
    for _ in range(50):
        ms = np.unique(rnd.integers(1000, 1900, 60))
        exits = throttle.piece_exits(ms, 100)
        for anchor in range(int(ms[0]) - 100, int(ms[0])):
            need, last = anchor + 100, None
            for t in ms:
                if t >= (need if last is None else last + 100):
                    last = int(t)
            found = next((e for s, e in exits if s >= need), None)
            assert found == last
            kept = throttle.kept_in_piece(ms, anchor, 100)
            assert (ms[kept[-1]] if len(kept) else None) == last


def test_one_key_holds_all_rows_without_a_pause(spark):
    """Gaps shorter and longer than a piece; every piece is entered through a kept event of an earlier one."""
    ev = [(i, T0 + timedelta(milliseconds=i * 3 + i % 2), "hot") for i in range(12_000)]
    df = spark.createDataFrame(ev, "event_id bigint, at timestamp, kind string").repartition(7)
    for gap in (10, 997, 20_000):
        got = sorted(r.event_id for r in throttle.throttle_events(df, ["kind"], gap).select("event_id").collect())
        assert got == sorted(fold(ev, gap, lambda e: 0))


def test_neighbouring_tables_compose(spark):
    """One key, 16 pieces: every level equals the table of the joined pieces, and no group reads more than two tables."""
    rnd = np.random.default_rng(2)
    ms = np.unique(rnd.integers(0, 40_000, 1600))
    for gap in (30, 700):
        tables = {i: throttle.piece_exits(p, gap) for i, p in enumerate(np.array_split(ms, 16))}
        begins = {i: int(p[0]) for i, p in enumerate(np.array_split(ms, 16))}
        level = spark.createDataFrame([("k", i, begins[i], s, e) for i, t in tables.items() for s, e in t], "_k0 string, node long, begin long, start long, leave long")
        for wide in (8, 4, 2):
            most = max(r["count"] for r in level.groupBy("node").count().collect())
            assert max(r["count"] for r in level.groupBy((F.col("node") / 2).cast("long")).count().collect()) <= 2 * most
            level = throttle.compose_pairs(level, ["_k0"], gap)
            found = {}
            for r in level.collect():
                found.setdefault(r.node, []).append((r.start, r.leave))
            pieces = np.array_split(np.arange(16), wide)
            for node, parts in enumerate(pieces):
                joined = np.concatenate([np.array_split(ms, 16)[i] for i in parts])
                for anchor in range(int(joined[0]) - gap, int(joined[0]), 7):
                    want = throttle.kept_in_piece(joined, anchor, gap)
                    leave = next((e for s, e in sorted(found[node]) if s >= anchor + gap), None)
                    assert leave == (int(joined[want[-1]]) if len(want) else None)


def test_collapse_repeated_errors(spark):
    rnd = random.Random(7)
    at, rows = 0, []
    for i in range(1500):
        at += rnd.choice([1, 20, 60])
        rows.append((i, T0 + timedelta(milliseconds=at), rnd.choice(["s", "s", "t"]), rnd.choice(["x", "x", "y", None])))
    last, want = {}, []
    for i, t, s, k in rows:
        if s in last and last[s][0] == k and (t - last[s][1]).total_seconds() * 1000 < 100:
            continue
        last[s] = (k, t)
        want.append(i)
    df = spark.createDataFrame(rows, "event_id bigint, at timestamp, session string, code string").repartition(4)
    got = sorted(r.event_id for r in throttle.collapse_repeated_errors(df, ["session"], ["code"], 100).select("event_id").collect())
    assert got == want


def test_dedupe_by_url_equals_fold(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["http://A/x", "http://a/X", "http://b/y", "http://c"]), "s" * rnd.randint(0, 4), rnd.choice([None, "", "c"]), T0 + timedelta(hours=rnd.randint(0, 9))) for i in range(300)]
    best, first = {}, {}
    for r in rows:
        k, score = r[1].lower(), len(r[2]) + (20 if r[3] else 0)
        first.setdefault(k, r[0])
        if k not in best or score >= best[k][0]:
            best[k] = (score, r[0])
    df = spark.createDataFrame(rows, "arrival int, url string, summary string, cover string, published_at timestamp").repartition(6)
    got = {r.url.lower(): (r.arrival, r.first_arrival) for r in merge.dedupe_by_url(df).collect()}
    assert got == {k: (v[1], first[k]) for k, v in best.items()}


def test_related_and_adjacent_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(related, "BLOCK", 90)
    rnd = random.Random(5)
    now = T0 + timedelta(days=20)
    rows = [
        (f"p{i}", i, "hot" if rnd.random() < 0.8 else "cold", T0 + timedelta(hours=rnd.randint(0, 400)), rnd.choice("abc"), rnd.choice([None, "c"]), rnd.choice([None, "s"]), rnd.sample(["X", "y", "z", "w"], rnd.randint(0, 3)))
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, "id string, arrival int, category string, published_at timestamp, source_id string, cover string, summary string, tags array<string>").repartition(4)
    got = {}
    for r in related.related_posts(df, F.lit(now).cast("timestamp")).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.related_id
    adjacent = {r.id: (r.newer_id, r.older_id) for r in related.adjacent_posts(df).collect()}
    for cat in ("hot", "cold"):
        lst = sorted((r for r in rows if r[2] == cat), key=lambda r: (-r[3].timestamp(), r[1]))
        for i, p in enumerate(lst):
            assert adjacent[p[0]] == (lst[i - 1][0] if i else None, lst[i + 1][0] if i + 1 < len(lst) else None)
            tags = {t.lower() for t in p[7]}
            scored = []
            for j in range(max(0, i - 40), min(len(lst), i + 41)):
                c = lst[j]
                if c[0] == p[0]:
                    continue
                s = 4 * (c[4] == p[4]) + 0.8 * bool(c[5]) + 0.2 * bool(c[6]) + sum(t.lower() in tags for t in c[7])
                s += max(0, 1.2 - max(0, (now - c[3]).total_seconds() / 86400) / 10)
                scored.append((-round(s, 9), -c[3].timestamp(), j, c[0]))
            assert [got[p[0]][k] for k in sorted(got[p[0]])] == [x[3] for x in sorted(scored)[:6]]


def test_running_values_across_pieces(spark):
    rnd = random.Random(9)
    rows = [(i, "hot" if rnd.random() < 0.7 else f"g{i % 5}", rnd.randint(-3, 3)) for i in range(2000)]
    df = spark.createDataFrame(rows, "n int, g string, v int").repartition(8)
    cut = ordering.pieces(df, ["g"], [F.col("n")])
    assert cut.select(ordering.PIECE).distinct().count() > 1
    out = ordering.running(ordering.positions(cut, ["g"]), ["g"], {"s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))})
    got = {r.n: (r.pos, r.s, r.lo, r.hi) for r in out.collect()}
    state = {}
    for n, g, v in rows:
        pos, s, lo, hi = state.get(g, (-1, 0, 99, -99))
        state[g] = (pos + 1, s + v, min(lo, v), max(hi, v))
        assert got[n] == state[g]


def test_lookup_by_key_with_one_hot_key(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    counts = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = lookup_by_key(df, counts, "k", "n", "id")
    assert out.count() == 5000
    assert {(r.k == "hot", r.n) for r in out.collect()} == {(True, 2500), (False, 1)}


def test_match_words_equals_brute_force(spark):
    rnd = random.Random(2)
    hays = [(str(i), "".join(rnd.choice("ab 漢x") for _ in range(rnd.randint(1, 30)))) for i in range(200)]
    words = ["".join(rnd.choice("ab漢X  ") for _ in range(rnd.randint(1, 5))) for _ in range(90)]
    index = spark.createDataFrame(hays, "id string, hay string")
    rows = search.match_words(index, spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert len(rows) == len(set(rows))
    wanted = {" ".join(w.lower().split()) for w in words} - {""}
    assert any(" " in w for w in wanted)
    assert {(r.word, r.id) for r in rows} == {(w, i) for w in wanted for i, h in hays if w in h}


def chunks(t, n):
    import re

    t = t.replace("\r\n", "\n").strip()
    if len(t) <= n:
        return [t]
    out, cur = [], ""
    for p in (p.strip() for p in re.split(r"\n{2,}", t)):
        if not p:
            continue
        joined = f"{cur}\n\n{p}" if cur else p
        if len(joined) <= n:
            cur = joined
            continue
        out += [cur.strip()] if cur.strip() else []
        cur = ""
        if len(p) > n:
            out += [p[i:i + n] for i in range(0, len(p), n)]
        else:
            cur = p
    return out + ([cur.strip()] if cur.strip() else [])


def test_chunk_text_equals_brute_force(spark):
    rnd = random.Random(4)
    docs = [("".join(rnd.choice(["word ", "x", "\n\n", "\n", "漢字", "\r\n\r\n"]) for _ in range(rnd.randint(0, 120))),) for _ in range(150)]
    df = spark.createDataFrame(docs, "t string").select("t", text.chunk_text(F.col("t"), 40).alias("c"))
    for r in df.collect():
        assert r.c == chunks(r.t, 40)


def test_chunk_text_on_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", text.chunk_text(F.col("text"), 1200).alias("c"))
    for r in d.collect():
        assert r.c == chunks(r.text, 1200)
