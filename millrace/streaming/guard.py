"""The guard over metric logs as a stateful stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from millrace.operators.health import Guard, Rules

METRICS = ("length", "flat", "reward", "kl", "clipped", "errors", "rollouts")


def _plain(value) -> float | None:
    return None if value is None or value != value else float(value)


def guard_stream(logs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The same over a stream: one row (run, step, reason) when a run halts; later rows of the run are ignored.

    Within a micro-batch rows are taken in step order; batches must come in that order."""

    def advance(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        own, halted = Guard(rules), False
        if state.exists:
            kept = json.loads(state.get[0])
            halted = kept.pop("halted")
            own = Guard(rules, **kept)
        out = []
        for row in pd.concat(list(batches)).sort_values("step").itertuples():
            if halted:
                break
            values = {m: _plain(getattr(row, m)) for m in METRICS}
            values |= {m: values[m] or 0 for m in ("errors", "rollouts")}
            reason = own.observe(**values)
            if reason:
                halted = True
                out.append((key[0], row.step, reason))
        state.update((json.dumps({"halted": halted, "lengths": own.lengths, "streak": own.streak, "early": own.early, "late": own.late, "seen": own.seen}),))
        yield pd.DataFrame(out, columns=["run", "step", "reason"])

    kind = logs.schema["run"].dataType.simpleString()
    return logs.groupBy("run").applyInPandasWithState(advance, f"run {kind}, step long, reason string", "state string", "append", "NoTimeout")
