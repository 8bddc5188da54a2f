"""Requests for artifacts, decided as they arrive, with what is known of each dataset kept as state.

The log has one row per thing that happens: a ``request`` for an artifact, the ``start`` of a job by a worker, and
that a job is ``done`` or has ``failed``, or that an artifact has gone ``stale``. Per dataset and kind the stream
keeps whether there is a fresh artifact, the job that is open, and the lease of the worker that has it.

Rows are worked on in the order of their time (``at``, then ``id``), whatever order they arrive in: they wait until
the watermark has passed them. So the outcomes are those of the whole log sorted, as long as no row is later than
the lateness. A dataset's own rows form a sequence by their meaning, so one task works on them; it holds
those of one span of lateness.
"""

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfmark import constants as C

REQUEST, START, DONE, FAILED, STALE = "request", "start", "done", "failed", "stale"
LOG = "id string, dataset_id string, kind string, action string, at timestamp"
OUTCOMES = "dataset_id string, kind string, id string, at_us bigint, outcome string, job_id string"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_OUTCOME = Row(*(part.split()[0] for part in OUTCOMES.split(", ")))
_WAITING = "at_us bigint, id string, action string"
_KNOWN = "fresh boolean, job_id string, attempts int, start_id string, lease_us bigint"


class RequestProcessor(StatefulProcessor):
    """Decides requests and watches leases; a timer per dataset and kind stands at what is due next."""

    def __init__(self, timeout_s: float = C.LEASE_TIMEOUT_SECONDS, max_attempts: int = C.LEASE_MAX_ATTEMPTS):
        self.timeout_us = int(timeout_s * 1_000_000)
        self.max_attempts = max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.known = handle.getValueState("known", _KNOWN)

    def _wake_at(self, due_us: int) -> None:
        """Keep the earliest timer only."""
        due = -(-due_us // 1000)
        set_for = list(self.handle.listTimers())
        if not set_for or due < min(set_for):
            for timer in set_for:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        arrived = [(row.at_us, row.id, row.action) for row in rows]
        if arrived:
            self.waiting.appendList(arrived)
            self._wake_at(min(arrived)[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(row) for row in self.waiting.get())
        ready = [row for row in rows if row[0] <= passed]
        later = rows[len(ready) :]
        state = list(self.known.get()) if self.known.exists() else [False, None, 0, None, None]
        out = [_OUTCOME(*key, *found) for found in self._decide(state, ready, passed)]
        self.known.update(tuple(state))
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        due = [row[0] for row in later[:1]] + ([state[4]] if state[4] is not None else [])
        if due:
            self.handle.registerTimer(-(-min(due) // 1000))
        return iter(out)

    def _decide(self, state: list, ready: list[tuple], passed: int) -> Iterator[tuple]:
        """(id, at_us, outcome, job_id) of requests and lost leases; ``state`` is moved on."""
        for at, name, action in ready:
            yield from self._lost(state, at - 1)
            fresh, job, attempts, _, _ = state
            if action == REQUEST:
                if fresh:
                    yield name, at, "cached", None
                elif job is None:
                    state[:] = [False, name, 0, None, None]
                    yield name, at, "queued", name
                else:
                    yield name, at, "joined", job
            elif action == START and job is not None:
                state[2:] = [attempts + 1, name, at + self.timeout_us]
            elif action == STALE:
                state[0] = False
            elif action in (DONE, FAILED):
                state[:] = [fresh or action == DONE, None, 0, None, None]
        yield from self._lost(state, passed)

    def _lost(self, state: list, until: int) -> Iterator[tuple]:
        _, job, attempts, start, lease = state
        if lease is not None and lease <= until:
            state[3:] = [None, None]
            yield start, lease, "requeued" if attempts < self.max_attempts else "given up", job


def decide_stream(
    log: DataFrame, lateness: str = "1 day", timeout_s: float = C.LEASE_TIMEOUT_SECONDS, max_attempts: int = C.LEASE_MAX_ATTEMPTS
) -> DataFrame:
    """Outcomes (OUTCOMES) of a streamed log (LOG).

    A request is ``cached`` if there is a fresh artifact, ``joined`` if a job for it is open, else ``queued`` as a new job under
    its own id. A start whose job is neither done, failed nor started again within the timeout is ``requeued``,
    or ``given up`` from the last attempt on. Rows without a dataset, a time or a known action are passed over; rows of
    equal id are rows each. The session's state store has to be ROCKS_DB.
    """
    usable = log.filter(F.col("dataset_id").isNotNull() & F.col("at").isNotNull() & F.col("action").isin(REQUEST, START, DONE, FAILED, STALE))
    timed = usable.withWatermark("at", lateness).select("dataset_id", "kind", F.coalesce("id", F.lit("")).alias("id"), "action", "at", F.unix_micros("at").alias("at_us"))
    return timed.groupBy("dataset_id", "kind").transformWithState(
        RequestProcessor(timeout_s, max_attempts), outputStructType=OUTCOMES, outputMode="Append", timeMode="EventTime"
    )


def run_decisions(outcomes: DataFrame, path: str, checkpoint: str, partitions: int | None = None) -> None:
    """Write the outcomes of all rows that have arrived since the last run; each outcome is written once.

    State lies in ``partitions``, by default two per core, as many as the first run on a checkpoint had: each costs a
    store and a worker in every batch, and they are not coalesced.
    """
    spark = outcomes.sparkSession
    partitions = partitions or 2 * spark.sparkContext.defaultParallelism
    settings = {STATE_STORE: ROCKS_DB, "spark.sql.shuffle.partitions": str(partitions)}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)  # a query keeps the settings it was started with
        sink = outcomes.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
        query = sink.trigger(availableNow=True).start(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    query.awaitTermination()
