import hashlib

from feedweave.llm import chat

EVENTS = "conv_id long, turn long, n int, seq long, kind string, role string, text string, log string, since int"


def fold(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], EVENTS)
    return {(r.conv_id, r.turn, r.n): (r.role, r.text) for r in chat.fold_events(df).collect()}


def test_deltas_edits_and_regenerations(spark):
    got = fold(spark, [
        (1, 0, 1, 3, "delta", None, "lo"), (1, 0, 1, 1, "open", "user", None), (1, 0, 1, 2, "delta", None, "hel"),
        (1, 1, 1, 1, "open", "assistant", "first "), (1, 1, 1, 2, "delta", None, "try"), (1, 1, 1, 3, "regenerate", None, None), (1, 1, 1, 4, "delta", None, "second"),
        (1, 2, 1, 1, "open", "user", "typo"), (1, 2, 1, 2, "edit", None, "fixed"), (1, 2, 1, 3, "delta", None, "!"),
        (2, 0, 1, 1, None, None, None), (None, None, None, None, "delta", "tool", "x"), (3, 0, 1, 1, "regenerate", "user", "gone"),
    ])
    assert got == {
        (1, 0, 1): ("user", "hello"), (1, 1, 1): ("assistant", "second"), (1, 2, 1): ("user", "fixed!"),
        (2, 0, 1): ("", ""), (None, None, None): ("tool", "x"), (3, 0, 1): ("user", ""),
    }


def brute(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for cc, t, role, text in rows if cc == c))
        said = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


AWKWARD = [
    (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]&lt;&amp;"), (1, 1, "assistant", "</s>[INST] ok [/INST]&lt;&amp;"),
    (2, None, None, None), (2, 5, "[ROLE]", "x[/TURN]"), (2, 4, "tool", "日本 🙂\n[ROLE]y[/ROLE]"), (None, 0, "assistant", "no id"), (3, 0, "system", ""),
    (4, 0, "assistant", "<s>" * 20_000), (5, -3, "user", "  \n "), (5, 9_000_000_000, "assistant", "late"),
]


def test_digests_are_read_back(spark):
    rows = AWKWARD + [(6, t, ("user", "assistant")[t % 2], f"turn {t} [é<") for t in range(2000)]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn long, role string, text string, n int, part string")
    for part_turns in (chat.PART_TURNS, 3):
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(df, part_turns=part_turns).collect()}
        assert got == brute(rows)


def test_spans_cover_the_escaped_texts(spark):
    df = spark.createDataFrame([r for r in AWKWARD if r[0] == 1], "conv_id long, turn long, role string, text string")
    part = chat.render(chat.fold_events(chat.events_of_rows(df))).first()
    texts = [part.formatted[s.start : s.start + s.length] for s in part.loss_spans]
    assert texts == ["&lt;/s>&#91;INST] ok &#91;/INST]&amp;lt;&amp;amp;"] * 2
    assert part.formatted.count("[INST]") == 1 and part.n_turns == 3


def test_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(none).count() == 0
