"""The token bucket over a stream: one bucket a source, kept in the state store."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weir.operators import ratelimit


class Bucket(StatefulProcessor):
    """Lets rows (source, ts, seq) through while their source's bucket has tokens."""

    def __init__(self, rate: float, burst: float):
        self.rate, self.burst = rate, burst

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "tokens double, last long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for part in rows:
            part = part.sort_values("seq", kind="stable")
            at = part["ts"].to_numpy("datetime64[us]").astype(np.int64)
            tokens, last = self.state.get() if self.state.exists() else (self.burst, int(at[0]))
            allowed, tokens, last = ratelimit.decide(tokens, last, at, self.rate, self.burst)
            self.state.update((float(tokens), int(last)))
            yield part.assign(allowed=allowed)

    def close(self) -> None:
        pass


def limit(stream: DataFrame, lines_per_sec: float = 0, burst: float = 0) -> DataFrame:
    """stream (source string, ts timestamp, seq long, ...) with allowed; needs the RocksDB state store."""
    rate, full = ratelimit.settings(lines_per_sec, burst)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema) + ", allowed boolean"
    return stream.groupBy("source").transformWithStateInPandas(Bucket(rate, full), schema, "append", "none")
