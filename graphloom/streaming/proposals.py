"""Proposals as a stream: a state machine per proposal, and once-only handling of approvals."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# --- fixed values ------------------------------------------------------------
FIRST_STATUS = "pending"
TRANSITIONS = {
    ("pending", "approve"): "approved",
    ("pending", "reject"): "rejected",
    ("approved", "auto_pass"): "completed_no_action",
    ("approved", "start"): "in_progress",
    ("in_progress", "finish"): "completed",
    ("in_progress", "fail"): "failed",
    ("in_progress", "restart"): "approved",
}
TIMEOUT_MS = 30 * 60 * 1000
LOG_LINES = 50
# widths of time slots, each a part of the one before, and the actions from which a slot is cut
SLOT_MS = [1 << 31, 1 << 26, 1 << 21, 1 << 16, 1 << 11, 1]
SLOT_ACTIONS = 4096
# groups of proposals that share their state calls and timers
PROPOSAL_GROUPS = 1024
# -----------------------------------------------------------------------------

OUTPUT = "id string, status string, changes int, log string, at timestamp"
STATE = "status string, log string, at timestamp, changes int"
CHANGE = "id string, status string, changes int, log string, micros long"


def proposal_states(actions: DataFrame, lateness: str | None = None) -> DataFrame:
    """Stream of ``(id, action, at, seq)`` to one row per proposal and batch: its status after the batch.

    Actions that do not fit the status are ignored. With ``lateness`` (a
    watermark delay) a proposal left in progress for 30 minutes of event time
    goes back to approved, as after a restart. State per proposal is one status
    and the last 50 log lines.
    """
    rows = actions.select("id", "action", "at", "seq")
    timeout = GroupStateTimeout.NoTimeout
    if lateness is not None:
        rows, timeout = rows.withWatermark("at", lateness), GroupStateTimeout.EventTimeTimeout
    timed = lateness is not None

    def advance(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, log, at, changes = state.get if state.exists else (FIRST_STATUS, "", None, 0)
        lines = log.split("\n") if log else []
        if state.hasTimedOut:
            if status == "in_progress":
                status, changes, lines = "approved", changes + 1, (lines + ["reset after timeout"])[-LOG_LINES:]
        else:
            # one proposal's actions of this micro-batch
            part = pd.concat([b[["at", "seq", "action"]] for b in batches], ignore_index=True)
            for row in part.sort_values(["at", "seq"]).itertuples(index=False):
                following = TRANSITIONS.get((status, row.action))
                if following:
                    status, at, changes = following, row.at.to_pydatetime(), changes + 1
                    lines = (lines + [f"{row.action} -> {following}"])[-LOG_LINES:]
        log = "\n".join(lines)
        state.update((status, log, at, changes))
        if timed and status == "in_progress":
            due = int(pd.Timestamp(at).timestamp() * 1000) + TIMEOUT_MS
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"id": [key[0]], "status": [status], "changes": [changes], "log": [log],
                            "at": [pd.NaT if at is None else at]})

    return rows.groupBy("id").applyInPandasWithState(advance, OUTPUT, STATE, "update", timeout)


class OrderedStates(StatefulProcessor):
    """Actions of a group of proposals held until the watermark passes them, then applied in order of event time.

    ``waiting`` holds actions in slots of time, with one timer a slot, at its
    earliest action; a slot of more than ``SLOT_ACTIONS`` is cut into narrower
    ones. A timer applies all of its slot that the watermark has passed, and
    timers of a group fire in order of time: whichever batch brings an action,
    it counts where it belongs. State is read and written by slot, not by action
    or proposal, as one text each, and no more than a slot of a group is held at
    a time. ``current`` has the status of each proposal, ``dues`` those to be
    reset at a moment.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getMapState("current", "id string", "status string, log string, micros long, due long, changes int")
        self.waiting = handle.getMapState("waiting", "level int, slot long", "actions string")
        self.dues = handle.getMapState("dues", "due long", "ids string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        fresh: list[list] = []
        for row in rows:
            fresh.append([-(-int(row.micros) // 1000), row.id, row.micros, row.seq, row.action])
            if len(fresh) >= SLOT_ACTIONS:
                self._hold(0, fresh)
                fresh = []
        self._hold(0, fresh)
        return iter(())

    def _held(self, place: tuple[int, int]) -> list[list] | None:
        """Actions of a slot, none where it has been cut, None where there is no such slot."""
        return json.loads(self.waiting.getValue(place)[0]) if self.waiting.containsKey(place) else None

    def _hold(self, level: int, fresh: list[list]) -> None:
        slots: dict[int, list[list]] = {}
        for action in fresh:
            slots.setdefault(action[0] // SLOT_MS[level], []).append(action)
        for slot, some in slots.items():
            held = self._held((level, slot))
            if held == []:
                self._hold(level + 1, some)
                continue
            both = [*(held or []), *some]
            if len(both) > SLOT_ACTIONS and level + 1 < len(SLOT_MS):
                self.waiting.updateValue((level, slot), ("[]",))
                self._hold(level + 1, both)
                continue
            self.waiting.updateValue((level, slot), (json.dumps(both),))
            self.handle.registerTimer(min(a[0] for a in both))

    def _passed(self, now: int, until: int) -> list[list]:
        """The actions up to ``until`` of the slot around ``now``, which are held no longer."""
        for level, width in enumerate(SLOT_MS):
            place = (level, now // width)
            held = self._held(place)
            if held is None:
                return []
            if held:
                left = [a for a in held if a[0] > until]
                if not left:
                    self.waiting.removeKey(place)
                elif len(left) < len(held):
                    self.waiting.updateValue(place, (json.dumps(left),))
                    self.handle.registerTimer(min(a[0] for a in left))
                return [a for a in held if a[0] <= until]
        return []

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        found: dict[str | None, list[list]] = {}
        for action in self._passed(now, max(now, timerValues.getCurrentWatermarkInMs())):
            found.setdefault(action[1], []).append(action)
        if self.dues.containsKey((now,)):
            for proposal in json.loads(self.dues.getValue((now,))[0]):
                found.setdefault(proposal, [])
            self.dues.removeKey((now,))
        dues: dict[int, list[str | None]] = {}
        for proposal, actions in found.items():
            yield from self._advance(proposal, actions, now, dues)
        for due, proposals in dues.items():
            before = json.loads(self.dues.getValue((due,))[0]) if self.dues.containsKey((due,)) else []
            self.dues.updateValue((due,), (json.dumps(before + proposals),))
            self.handle.registerTimer(due)

    def _advance(self, proposal: str | None, actions: list[list], now: int, dues: dict[int, list[str | None]]) -> Iterator[Row]:
        """Rows of a proposal's changes; a moment at which it is to be reset is added to ``dues``."""
        known = self.current.containsKey((proposal,))
        status, log, at, due, changes = self.current.getValue((proposal,)) if known else (FIRST_STATUS, "", None, None, 0)
        lines, asked = log.split("\n") if log else [], due
        steps: dict[int, list[list]] = {}
        for action in actions:
            steps.setdefault(action[0], []).append(action)
        if due is not None and due <= now:
            steps.setdefault(now, [])
        for ms in sorted(steps):
            before = changes
            if due is not None and due < ms:  # its own timer may come later, where the watermark has leapt
                status, due, changes = "approved", None, changes + 1
                lines.append("reset after timeout")
            for _, _, moment, _, action in sorted(steps[ms], key=lambda a: (a[2], a[3])):
                following = TRANSITIONS.get((status, action))
                if following:
                    status, at, changes = following, moment, changes + 1
                    lines.append(f"{action} -> {following}")
                    due = ms + TIMEOUT_MS if status == "in_progress" else None
            if due == ms:
                status, due, changes = "approved", None, changes + 1
                lines.append("reset after timeout")
            lines = lines[-LOG_LINES:]
            if changes > before or not before:
                yield Row(id=proposal, status=status, changes=changes, log="\n".join(lines), micros=at)
        if steps:
            self.current.updateValue((proposal,), (status, "\n".join(lines), at, due, changes))
            if due is not None and due != asked:
                dues.setdefault(due, []).append(proposal)


def ordered_states(actions: DataFrame, lateness: str) -> DataFrame:
    """Stream of ``(id, action, at, seq)`` to a row for every change of a proposal, actions applied in order of (at, seq).

    ``lateness`` is how far actions may be out of order; what comes later still is
    dropped, as the watermark has passed it. A proposal in progress for 30
    minutes of event time goes back to approved. Needs the RocksDB state store.
    """
    rows = actions.select("id", "action", "at", "seq", F.unix_micros("at").alias("micros"),
                          F.pmod(F.xxhash64("id"), F.lit(PROPOSAL_GROUPS)).alias("part")).withWatermark("at", lateness)
    changed = rows.groupBy("part").transformWithState(OrderedStates(), CHANGE, "Update", "EventTime")
    return changed.select("id", "status", "changes", "log", F.timestamp_micros("micros").alias("at"))


def latest_states(updates: DataFrame) -> DataFrame:
    """The newest row per proposal of the written updates."""
    return (updates.groupBy("id").agg(F.max_by(F.struct("status", "changes", "log"), "changes").alias("s"))
            .select("id", "s.status", "s.changes", "s.log"))


def run_to_folder(states: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write state updates of everything available now; each batch replaces its own folder on a retry."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return (states.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(write).start())


def handle_approved(actions: DataFrame, handler: Callable[[DataFrame], DataFrame], folder: str,
                    checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Run ``handler`` once over each micro-batch of approved proposals and keep its outcome rows.

    The handler gets distinct proposals that no earlier batch has handled, and
    returns ``(id, outcome, ...)``. What is handled is the stream's own state, so
    a batch costs its new rows whatever came before, and a repeated batch meets
    the state it first met. With ``interval`` the stream polls (10 seconds is
    usual); without, it drains what is there and stops.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        handler(batch).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    approved = actions.filter(F.col("action") == "approve").dropDuplicates(["id"])
    writer: Any = approved.writeStream.option("checkpointLocation", checkpoint).foreachBatch(process)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Processed, completed, failed and no-action proposals."""
    count = lambda name: F.count_if(F.col("outcome") == name)
    return outcomes.agg(F.count(F.lit(1)).alias("total_processed"), count("completed").alias("completed"),
                        count("failed").alias("failed"), count("no_action").alias("no_action"))


def reset_unfinished(questions: DataFrame) -> DataFrame:
    """Start-up repair: proposals in progress go back to approved with a log line."""
    stuck = F.col("status") == "in_progress"
    note = F.lit("[System] restarted, the task was reset")
    return (questions.withColumn("execution_log", F.when(stuck, F.concat_ws("\n", F.nullif("execution_log", F.lit("")), note))
                                 .otherwise(F.col("execution_log")))
            .withColumn("status", F.when(stuck, F.lit("approved")).otherwise(F.col("status"))))
