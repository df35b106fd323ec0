"""Streaming twins: requests served line by line, and debounced signals with state by key."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenpair.operators.sequence import step
from lumenpair.sources.requests import request_error


def debounce_stream(ticks: DataFrame, key: str, signal: str, tick: str) -> DataFrame:
    """(key, tick, decision, shown): operators.sequence.debounce() over a stream; state is what is shown and pending for a key, in the state store, so it
    survives executors. Within a micro-batch ticks count in their order by `tick`."""
    import pandas as pd

    def run(keys, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        shown, pending, streak = state.get if state.exists else ("", "", 0)
        got = pd.concat(list(frames)).sort_values(tick)
        out = []
        for t, new in zip(got[tick], got[signal].fillna("")):
            decision, shown, pending, streak = step(shown, pending, streak, new)
            out.append((keys[0], t, decision, shown))
        state.update((shown, pending, streak))
        yield pd.DataFrame(out, columns=[key, tick, "decision", "shown"])

    types = dict(ticks.dtypes)
    schema = f"{key} {types[key]}, {tick} {types[tick]}, decision string, shown string"
    return ticks.select(key, tick, signal).groupBy(key).applyInPandasWithState(run, schema, "shown string, pending string, streak int", "append", "NoTimeout")


def served(lines: DataFrame) -> DataFrame:
    """(id, error) of each request line of a stream or table; blank lines go. A bad line is a row with its error, and stops nothing."""
    line = F.col("value")
    return lines.filter(F.trim(line) != "").select(F.get_json_object(line, "$.id").alias("id"), request_error(line).alias("error"))


def hover_stream(samples: DataFrame, key: str, order: str, threshold: int = 250) -> DataFrame:
    """(key, order, action): signals.dwell() over a stream of samples(over, spot, elapsed, down, dialog); the spot, its time and what is shown are the state of a key, with whether
    the button was down. Within a micro-batch samples count in their order."""
    import pandas as pd

    from lumenpair.operators.signals import hover_step

    def run(keys, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, time, shown, down = state.get if state.exists else (None, 0, False, False)
        out = []
        for s in pd.concat(list(frames)).sort_values(order).itertuples(index=False):
            click = bool(s.over and s.down and not down and not s.dialog)
            action, (at, time, shown) = hover_step((at, time, shown), bool(s.over), int(s.spot), int(s.elapsed), click, threshold)
            down = bool(s.down)
            out.append((keys[0], getattr(s, order), action))
        state.update((at, int(time), bool(shown), down))
        yield pd.DataFrame(out, columns=[key, order, "action"])

    types = dict(samples.dtypes)
    rows = samples.select(key, order, "over", "spot", "elapsed", "down", "dialog").groupBy(key)
    return rows.applyInPandasWithState(run, f"{key} {types[key]}, {order} {types[order]}, action string", "at long, time long, shown boolean, down boolean", "append", "NoTimeout")


def changed_stream(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, order, value): sequence.changes() over a stream; a key's last value is its state."""
    import pandas as pd

    def run(keys, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, last = state.get if state.exists else (False, None)
        out = []
        for t, v in pd.concat(list(frames)).sort_values(order)[[order, value]].itertuples(index=False):
            v = None if pd.isna(v) else v
            if not seen or v != last:
                out.append((keys[0], t, v))
            seen, last = True, v
        state.update((seen, last))
        yield pd.DataFrame(out, columns=[key, order, value])

    types = dict(rows.dtypes)
    return rows.select(key, order, value).groupBy(key).applyInPandasWithState(run, f"{key} {types[key]}, {order} {types[order]}, {value} string", "seen boolean, last string", "append", "NoTimeout")
