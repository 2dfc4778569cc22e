"""Chats as a stream: what was said before each turn.

A conversation is a key with a little state: the turn that comes next, how much has been
said, and the last few messages, which a prompt may quote. The state does not grow with
the conversation. Turns may come in any order and more than once; a turn is given out when
all before it (0, 1, ...) have come, and waits in a state of its own until then, so one
task never holds a conversation. State that is not touched for the time of expiry goes; a
conversation that goes on after that waits for a turn 0 anew.

Rows without a conversation or a turn belong to none and are left out; null roles and texts
are empty; of rows that repeat a turn the first to come counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

TURNS = "conv_id bigint, turn bigint, role string, text string"
HISTORY = "conv_id bigint, turn bigint, role string, text string, chars_before bigint, recent string"
#: Settings of the query: state in tables of its own, and no batches without rows, of which
#: a stream with expiry would never have enough.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class ChatHistory(StatefulProcessor):
    """Per conversation: ``said`` (next turn, characters, last messages, how many turns wait)
    and ``early``, the turns that came before their turn."""

    def __init__(self, keep: int, expiry_ms: int):
        self.keep, self.expiry_ms = keep, expiry_ms

    def init(self, handle) -> None:
        self.said = handle.getValueState("said", "next bigint, chars bigint, recent array<string>, waiting bigint", self.expiry_ms)
        self.early = handle.getMapState("early", "turn bigint", "role string, text string", self.expiry_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due, chars, recent, waiting = self.said.get() or (0, 0, [], 0)
        recent, began = list(recent), (due, waiting)
        for chunk in rows:
            out = []
            for turn, role, text in chunk[["turn", "role", "text"]].sort_values("turn", kind="stable").itertuples(index=False):
                if turn > due:
                    if not waiting or not self.early.containsKey((turn,)):
                        self.early.updateValue((turn,), (role, text))
                        waiting += 1
                elif turn == due:
                    while True:
                        out.append((key[0], due, role, text, chars, "\n".join(recent)))
                        due, chars, recent = due + 1, chars + len(text), [*recent, f"{role}: {text}"][-self.keep :]
                        if not waiting or not self.early.containsKey((due,)):
                            break
                        role, text = self.early.getValue((due,))
                        self.early.removeKey((due,))
                        waiting -= 1
            if out:
                yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "text", "chars_before", "recent"])
        if (due, waiting) != began:
            self.said.update((due, chars, recent, waiting))

    def close(self) -> None:
        pass


def histories(turns: DataFrame, keep: int = 4, expiry_ms: int = 86_400_000) -> DataFrame:
    """A stream of :data:`TURNS` with the characters said before each and the ``keep``
    messages before it, a line each."""
    if keep < 1:
        raise ValueError("keep must be at least 1")
    named = turns.where("conv_id is not null and turn >= 0").selectExpr("conv_id", "turn", "coalesce(role, '') as role", "coalesce(text, '') as text")
    return named.groupBy("conv_id").transformWithStateInPandas(ChatHistory(keep, expiry_ms), HISTORY, "Append", "ProcessingTime")


def chat_stream(turns: DataFrame, path: str, checkpoint: str, keep: int = 4, expiry_ms: int = 86_400_000, **trigger) -> StreamingQuery:
    """Starts a query that appends the histories of ``turns`` to ``path``. ``trigger`` is that
    of ``writeStream``; by default what is there is processed and the query ends."""
    spark: SparkSession = turns.sparkSession
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    try:
        for name, value in SETTINGS.items():
            spark.conf.set(name, value)  # the query takes the settings of its start
        return histories(turns, keep, expiry_ms).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
