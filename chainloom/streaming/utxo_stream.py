"""Live outputs from a stream of events: one state for each outpoint, the last event that made or spent it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "height bigint, tx_index bigint, made int"
CHANGES = "txid string, index_out bigint, height bigint, tx_index bigint, live boolean, value decimal(20,0), address string"


ORDER = ["height", "tx_index", "made"]


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches), ignore_index=True)
    newest = rows.iloc[rows.sort_values(ORDER, kind="stable").index[-1]]
    at = tuple(int(newest[c]) for c in ORDER)
    if not state.exists or at >= tuple(state.get):
        state.update(at)
        yield pd.DataFrame([{"txid": key[0], "index_out": key[1], "height": at[0], "tx_index": at[1], "live": at[2] == 1, "value": newest["value"], "address": newest["address"]}])


def utxo_changes(events: DataFrame) -> DataFrame:
    """Changes of outpoints from a stream of operators.utxo.events: the newest row of an outpoint tells whether it lives.

    Events may come late and in any order between micro-batches; one that is older than the state changes nothing. Null outpoints are left out.
    """
    known = events.where("txid IS NOT NULL AND index_out IS NOT NULL")
    return known.groupBy("txid", "index_out").applyInPandasWithState(_step, CHANGES, STATE, "update", GroupStateTimeout.NoTimeout)
