"""Chat turns with state, against the same in plain Python."""

import random

import pytest

from passagelake.streaming import chat


def expected(rows, keep):
    """(conv_id, turn, role, text, chars, recent) of the turns that follow on one another from 0."""
    first = {}
    for conv, turn, role, text in rows:
        if conv is not None and turn is not None and turn >= 0:
            first.setdefault((conv, turn), (role or "", text or ""))
    out = []
    for conv in {c for c, _ in first}:
        turn, said = 0, []
        while (conv, turn) in first:
            role, text = first[conv, turn]
            out.append((conv, turn, role, text, sum(len(t) for _, t in said), "\n".join(f"{r}: {t}" for r, t in said[-keep:])))
            turn, said = turn + 1, [*said, (role, text)]
    return sorted(out)


def run(spark, tmp_path, batches, keep=3):
    """The output after the stream has run once for each batch."""
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for rows in batches:
        spark.createDataFrame(rows, chat.TURNS).write.mode("append").parquet(source)
        turns = spark.readStream.schema(chat.TURNS).option("maxFilesPerTrigger", 4).parquet(source)
        query = chat.chat_stream(turns, out, mark, keep)
        assert query.awaitTermination(60)
    return sorted(map(tuple, spark.read.schema(chat.HISTORY).parquet(out).collect()))


def test_turns_in_any_order(spark, tmp_path):
    rng = random.Random(5)
    rows = [(c, i, ("user", "assistant")[i % 2], f"é {c} {i} " * rng.randint(0, 3)) for c in range(6) for i in range(rng.randint(1, 9))]
    rows += [(7, i, "user", f"long {i}") for i in range(120)]  # most rows are of one conversation
    again = rng.sample(rows, 20)
    rng.shuffle(rows)
    batches = [rows[:60], rows[60:] + again]
    got = run(spark, tmp_path, batches)
    assert got == expected(rows, 3)


def test_gaps_nulls_and_reruns(spark, tmp_path):
    rows = [(1, 0, None, None), (1, 2, "user", "waits"), (None, 0, "user", "x"), (2, None, "user", "x"), (3, -1, "user", "x"), (4, 1, "user", "never due")]
    assert run(spark, tmp_path, [rows]) == [(1, 0, "", "", 0, "")]
    assert run(spark, tmp_path, [[(1, 1, "assistant", "fills the gap")]]) == [(1, 0, "", "", 0, ""), (1, 1, "assistant", "fills the gap", 0, ": "), (1, 2, "user", "waits", 13, ": \nassistant: fills the gap")]
    again = run(spark, tmp_path, [rows])  # rows that come again change nothing
    assert len(again) == 3


def test_settings_are_restored(spark, tmp_path):
    before = [spark.conf.get(name, None) for name in chat.SETTINGS]
    run(spark, tmp_path, [[(1, 0, "user", "a")]])
    assert [spark.conf.get(name, None) for name in chat.SETTINGS] == before
    with pytest.raises(ValueError):
        chat.histories(spark.readStream.schema(chat.TURNS).parquet(str(tmp_path / "in")), 0)
