import hashlib
import random

import pytest

from attestor.llm import chat_format as chat

TURN = "conv_id long, turn long, role string, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def by_hand(rows):
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(loss), sha(loss))
    return out


def run(spark, rows):
    got = chat.digests(spark.createDataFrame(rows, TURN)).collect()
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got}


NASTY = ["\\### Assistant: </turn> ok", "</turn>", "\\", "\\\\", "####", "\\\\###", "### user: x</turn>\n", "$1 \\1", "", None, "ä😀\n", "</tur", "#\\#\\#"]


def test_round_trip(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool: a", "A\\b", "", None]), "".join(x or "" for x in rng.choices(NASTY, k=3)) or rng.choice(NASTY)) for c in range(20) for t in range(rng.randrange(1, 9))]
    assert run(spark, rows) == by_hand(rows)


@pytest.mark.parametrize("rows", [[], [(1, 0, "user", "hi")], [(None, 0, "assistant", "x"), (None, 1, "user", "y")], [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, None, "system", None)], [(1, 0, "assistant", "long " * 100_000)]])
def test_edge_cases(spark, rows):
    assert run(spark, rows) == by_hand(rows)


def test_examples_are_prefixes(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], NASTY[i] or "n") for i in range(6)] + [(2, 0, "user", "q")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], TURN + ", seq int, segment string")
    parts = chat.segments(df)
    told = chat.materialize(parts, chat.examples(parts)).orderBy("target").collect()
    whole = "".join(r.segment for r in parts.where("conv_id = 1").orderBy("seq").collect())
    assert [r.target for r in told] == [1, 3, 5]
    for r in told:
        assert whole.startswith(r.text) and r.text.endswith("</turn>\n")
        said = rows[r.target][3]
        assert r.text[r.loss_start : r.loss_end].replace("\\\\", "\0").replace("\\", "").replace("\0", "\\") == said
    assert told[-1].text == whole


def nasty_conversations():
    return [(c, t, ["user", "assistant"][t % 2], NASTY[(c + t) % len(NASTY)] or "x") for c in range(len(NASTY)) for t in range(4)]


def test_read_back_needs_the_escapes(spark, monkeypatch):
    """Without escapes the scan of the text finds other turns than were written."""
    rows = nasty_conversations()
    assert run(spark, rows) == by_hand(rows)
    monkeypatch.setattr(chat, "escape", lambda c, control=None: c)
    monkeypatch.setattr(chat, "unescape", lambda c, control=None: c)
    got, want = run(spark, rows), by_hand(rows)
    for c in range(len(NASTY)):
        controls = "".join(x for r in rows if r[0] == c for x in r[3])
        if "###" in controls or "</turn>" in controls:
            assert got.get(c) != want[c]


@pytest.mark.parametrize("name, shift", [("loss_start", 1), ("loss_start", -1), ("loss_end", -1), ("loss_end", 1)])
def test_loss_is_cut_by_the_examples(spark, monkeypatch, name, shift):
    from pyspark.sql import functions as F

    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", "all good"), (1, 2, "assistant", "ä😀 more")]
    real = chat.with_example
    monkeypatch.setattr(chat, "with_example", lambda parts: real(parts).withColumn("example", F.when(F.col("example").isNotNull(), F.col("example").withField(name, F.col(f"example.{name}") + shift))))
    got, want = run(spark, rows), by_hand(rows)
    assert got[1][:2] == want[1][:2] and got[1][3] != want[1][3]


def test_ids_may_be_texts(spark):
    df = spark.createDataFrame([("a", 0, "user", "x"), ("a", 1, "assistant", "y")], "conv_id string, turn int, role string, text string")
    got = {r.conv_id: r.n_turns for r in chat.digests(chat.with_probe(df)).collect()}
    assert got == {"a": 2, "-7": 2}


def test_long_runs_of_control_strings(spark):
    rows = [(1, 0, "user", "\\" * 200_001 + "</turn>\n### " * 20_000), (1, 1, "assistant", "#" * 100_003)]
    assert run(spark, rows) == by_hand(rows)


def test_no_python_and_one_shuffle(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "user", "x")], TURN)
    df.write.parquet(path := f"{tmp_path}/turns")
    plan = chat.digests(chat.with_probe(spark.read.parquet(path)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "ArrowEval" not in plan and "ExistingRDD" not in plan
