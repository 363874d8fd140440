"""Routing of ``say`` requests without a record of what was played.

A request during a speech becomes its nested child and never enters the queue; otherwise it is enqueued and plays when the
queue before it is done. Replies always enqueue. So each decision depends on the earlier ones. The rows of a session come in order
to one task as a stream of Arrow batches (sorted on disk where they don't fit), and one pass over them keeps only the speeches
that aren't finished yet.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLAN_SCHEMA = "session_id long, speech_id long, t_us long, route string, parent_id long, depth int, start_us long"
_FIELDS = pa.schema([("session_id", pa.int64()), ("speech_id", pa.int64()), ("t_us", pa.int64()), ("route", pa.string()),
                     ("parent_id", pa.int64()), ("depth", pa.int32()), ("start_us", pa.int64())])


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests in the order of sessions and times to their routes. State: the unfinished speeches of the current session,
    first the playing one (a queue has no gaps)."""
    session, begun, queue = None, False, deque()
    for batch in batches:
        names = ("session_id", "speech_id", "t_us", "is_say", "dur_us")
        sid, ids, times, says, durs = (batch.column(c).to_pylist() for c in names)
        route, parent, start = [], [], []
        for s, i, t, say, d in zip(sid, ids, times, says, durs):
            if not begun or s != session:
                session, begun = s, True
                queue.clear()
            while queue and queue[0][0] <= t:
                queue.popleft()
            if say and queue:
                route.append("nested")
                parent.append(queue[0][1])
                start.append(None)
                continue
            at = max(t, queue[-1][0]) if queue else t
            if d > 0:
                queue.append((at + d, i))
            route.append("enqueue")
            parent.append(None)
            start.append(at)
        depth = [0 if x is None else 1 for x in parent]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((sid, ids, times, route, parent, depth, start), _FIELDS)], schema=_FIELDS)


def plan_requests(requests: DataFrame) -> DataFrame:
    """``requests``: session_id, speech_id, t_us, is_say, dur_us (null: 0, such a speech is over at once). A speech that ends at ``t`` is
    not playing at ``t``. Rows without a time come first in their session and are routed like rows at the least time."""
    r = requests.select("session_id", "speech_id", F.coalesce("t_us", F.lit(-(1 << 62))).alias("t_us"),
                        F.coalesce("is_say", F.lit(False)).alias("is_say"), F.coalesce("dur_us", F.lit(0)).cast("long").alias("dur_us"))
    ordered = r.repartition("session_id").sortWithinPartitions("session_id", "t_us", "speech_id")
    out = ordered.mapInArrow(fold, PLAN_SCHEMA)
    return out.withColumn("t_us", F.nullif("t_us", F.lit(-(1 << 62))))
