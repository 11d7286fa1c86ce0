"""The limiter as a stateful stream: the same state as in batch, kept between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.operators.gates import Limiter


def limit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Decides a key's requests of one micro-batch in order of time."""
    limiter = Limiter("authenticated", list(state.get[0]) if state.exists else [])
    rows = pd.concat(batches).sort_values(["ts", "event_id"])
    decisions = [limiter.decide(ts.timestamp()) for ts in rows["ts"]]
    state.update((limiter.accepted,))
    yield pd.DataFrame({"event_id": rows["event_id"], "user_id": rows["user_id"], "decision": decisions})


def stream_limiter(events: DataFrame) -> DataFrame:
    slim = events.select("event_id", "user_id", "ts")
    return slim.groupBy("user_id").applyInPandasWithState(limit, "event_id long, user_id long, decision string", "accepted array<double>", "append", GroupStateTimeout.NoTimeout)
