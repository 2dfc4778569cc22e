"""Each prompt is called once: counted by a generator that writes down its calls."""

import os
import pathlib
import uuid

import pytest
from pyspark.sql import functions as F

from passagelake.operators import answer, responses


class Counting:
    """Writes every call to a folder; fails where it is told to."""

    name = "counting"

    def __init__(self, folder, fails=(), kills=(), limits=()):
        self.folder, self.fails, self.kills, self.limits = str(folder), fails, kills, limits

    def generate(self, prompt):
        (pathlib.Path(self.folder) / uuid.uuid4().hex).write_text(prompt, encoding="utf-8")
        once = pathlib.Path(self.folder).parent / "failed"
        if any(w in prompt for w in self.fails) and not once.exists():
            once.touch()
            raise RuntimeError("broken pipe")
        if any(w in prompt for w in self.kills) and not once.exists():
            once.touch()
            os._exit(9)
        if any(w in prompt for w in self.limits):
            raise answer.RateLimit("429")
        if "These passages bear" in prompt:
            return "Then it is so [2]"
        return "not found" if "q-retry" in prompt else f"Said {len(prompt)} [1]"


@pytest.fixture
def calls(tmp_path):
    (tmp_path / "calls").mkdir()
    return lambda: sorted(p.read_text(encoding="utf-8") for p in (tmp_path / "calls").iterdir())


def prompts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, prompt string")


TEXTS = ["a", "b", "c", "a", "b", "a", "", None, "d" * 50_000]


def test_one_call_a_prompt(spark, tmp_path, calls):
    log, g = f"{tmp_path}/log", Counting(tmp_path / "calls")
    out = responses.call_once(prompts(spark, TEXTS), g, log)
    for _ in range(3):  # reading again calls for nothing
        got = {r["id"]: r for r in out.collect()}
        assert [got[i]["raw"] for i in range(9)] == [f"Said {len(x or '')} [1]" for x in TEXTS]
    assert calls() == sorted(["a", "b", "c", "", "d" * 50_000])
    more = responses.call_once(prompts(spark, ["a", "e", "c"]), g, log)
    assert more.where("raw is not null").count() == 3 and len(calls()) == 6
    other = Counting(tmp_path / "calls")
    other.name = "another model"
    responses.call_once(prompts(spark, ["a"]), other, log)
    assert len(calls()) == 7


def test_a_failed_call_keeps_the_others(spark, tmp_path, calls):
    log, g = f"{tmp_path}/log", Counting(tmp_path / "calls", fails=["p3"])
    df = prompts(spark, [f"p{i}" for i in range(8)])
    with pytest.raises(RuntimeError, match="broken pipe"):
        responses.call_once(df, g, log)
    assert responses.call_once(df, g, log).where("raw is null").count() == 0
    assert calls() == sorted([*(f"p{i}" for i in range(8)), "p3"])  # only the failed one twice


def test_a_dead_worker_costs_one_round(spark, tmp_path, calls):
    log, g = f"{tmp_path}/log", Counting(tmp_path / "calls", kills=["p17"])
    df = prompts(spark, [f"p{i:02}" for i in range(40)])
    with pytest.raises(Exception):
        responses.call_once(df, g, log, per_task=1)
    kept = responses.read_log(spark, log).count()
    before = len(calls())
    assert responses.call_once(df, g, log, per_task=1).where("raw is null").count() == 0
    assert len(calls()) - before == 40 - kept and len(calls()) <= 40 + spark.sparkContext.defaultParallelism + 1


def test_rate_limits_are_values_and_tried_again(spark, tmp_path, calls):
    log = f"{tmp_path}/log"
    df = prompts(spark, ["x1", "x2", "y"])
    first = responses.call_once(df, Counting(tmp_path / "calls", limits=["x1"]), log)
    assert {r["prompt"]: r["error"] for r in first.collect()} == {"x1": responses.RATE_LIMITED, "x2": None, "y": None}
    again = responses.call_once(df, Counting(tmp_path / "calls"), log)
    assert again.where("error is not null").count() == 0 and calls() == ["x1", "x1", "x2", "y"]
    with pytest.raises(answer.RateLimit):
        responses.call_once(prompts(spark, ["z"]), Counting(tmp_path / "calls", limits=["z"]), log, catch=False)


def test_no_rows(spark, tmp_path, calls):
    out = responses.call_once(prompts(spark, []), Counting(tmp_path / "calls"), f"{tmp_path}/log")
    assert out.columns == ["id", "prompt", "raw", "error"] and out.count() == 0 and calls() == []


def test_twenty_questions_twenty_calls(spark, tmp_path, calls):
    """One call a question and one for each that is asked again, whatever is read of it."""
    names = [f"q-{'retry' if i % 5 == 0 else 'plain'}-{i:02} ka" for i in range(20)]
    qs = spark.createDataFrame(list(enumerate(names)), "q_id long, question string")
    found = [(i, r, f"{t}. More", f"c{r}", f"s{r}", "") for i, t in enumerate(names) for r in (1, 2)]
    retrieved = spark.createDataFrame(found, "q_id long, rank long, text string, chapter string, section string, source string")
    g, log = Counting(tmp_path / "calls", fails=["q-plain-07"]), f"{tmp_path}/log"
    with pytest.raises(RuntimeError, match="broken pipe"):
        answer.answer_questions(qs, retrieved, g, log=log)
    out = answer.answer_questions(qs, retrieved, g, log=log)
    for _ in range(2):
        rows = out.collect()
        assert len(rows) == 20 and all(r["found"] for r in rows)
        assert all(r["citations"] == ([2] if "retry" in r["question"] else [1]) and [s["citation"] for s in r["sources"]] == r["citations"] for r in rows)
    assert len(calls()) == 20 + 4 + 1  # and the one that failed
    answer.answer_questions(qs, retrieved, g, log=log).collect()
    assert len(calls()) == 25


# --- pace ---------------------------------------------------------------------------


class Clock:
    def __init__(self, at):
        self.at = at

    def now(self):
        return self.at

    def sleep(self, seconds):
        assert seconds > 0
        self.at += seconds


@pytest.mark.parametrize("lanes,slow", [(1, 0.0), (4, 0.3), (4, 9.0), (3, 100.0)])
def test_lanes_share_the_quota(lanes, slow):
    """No two calls closer than the delay, whenever the lanes begin and however long a call
    takes; every lane works."""
    delay, times = 2.0, []
    for lane in range(lanes):
        clock = Clock(1000.0 + 7.7 * lane)
        slots = responses.Pace(delay, lanes, 1003.0, clock.now, clock.sleep).slots(lane)
        mine = []
        for i in range(25):
            next(slots)
            mine.append(clock.now())
            clock.at += slow * (i % 3)
        if slow < delay * lanes / 2:
            assert all(b - a == pytest.approx(delay * lanes) for a, b in zip(mine, mine[1:]))
        times += mine
    times.sort()
    assert len(times) == 25 * lanes and all(b - a >= delay - 1e-6 for a, b in zip(times, times[1:]))


def test_paced_calls_use_every_lane(spark, tmp_path, calls):
    """Answers of a paced run: the log's times keep the distance, the work is spread."""

    class Stamped(Counting):
        def generate(self, prompt):
            import time

            from pyspark import TaskContext

            return f"{time.time()} {TaskContext.get().partitionId()}"

    out = responses.call_once(prompts(spark, [f"p{i}" for i in range(12)]), Stamped(tmp_path / "calls"), f"{tmp_path}/log", pace=responses.Pace(0.2, 3))
    said = sorted(tuple(map(float, r["raw"].split())) for r in out.collect())
    assert {lane for _, lane in said} == {0.0, 1.0, 2.0}
    assert all(b[0] - a[0] > 0.15 for a, b in zip(said, said[1:]))
    assert out.agg(F.count("raw")).first()[0] == 12
