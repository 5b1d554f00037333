"""The look-back check on a stream of lines: state of a bounded number of rows per document."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paleoline.functions.text import FOLD_DIAG

OUTPUT = "id string, preceding_id string, last_src_token string, last_trg_token string"
_STATE = "rows string"
_FOLD = str.maketrans(*FOLD_DIAG)


def _last(t: str) -> str:
    w = t.split()
    return w[-1] if w else ""


def _step(reach: int):  # noqa: ANN202
    import json

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        out = []
        rows = pd.concat(list(batches)).sort_values("file_pos", kind="stable").fillna("")
        for r in rows.itertuples(index=False):
            if r.source_sic and r.target_sic and r.source_sic[0].translate(_FOLD) != r.target_sic[0].translate(_FOLD):
                near = next((h for h in reversed(held) if h[1] == r.id), None)
                if near:
                    out.append((r.id, near[0], near[2], near[3]))
            held = [*held[1 - reach :], (r.id, r.nonbreaking_next_line, _last(r.source_sic), _last(r.target_sic))] if reach > 1 else [(r.id, r.nonbreaking_next_line, _last(r.source_sic), _last(r.target_sic))]
        state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return run


def lookback_stream(lines: DataFrame, reach: int = 25) -> DataFrame:
    """Streaming twin of the batch look-back, per document: lines whose source and target begin with different letters, with the nearest of the ``reach`` rows before that links to them.

    Rows of a micro-batch are put in file order; a row that arrives in a later batch than its followers counts as later.
    State is ``reach`` rows a document.
    """
    cols = lines.select("doc_id", "id", "nonbreaking_next_line", "source_sic", "target_sic", "file_pos").where(F.col("doc_id").isNotNull())
    return cols.groupBy("doc_id").applyInPandasWithState(_step(reach), OUTPUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Extension without counterpart in the line pipeline: events and their value per type and window, late ones up to ``late``."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return ts.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")
