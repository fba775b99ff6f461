"""Analytics by name: functions from the chain's tables to named DataFrames, and what the command line does with the result.

The command line has a subcommand for each registered analytic; `--plugin MODULE` imports a module that registers more:

    @analytic("tips", help="the highest block")
    def tips(t):
        return {"tips": t["blocks"].orderBy(F.desc("height")).limit(1)}
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from chainloom import sinks
from chainloom.operators import stats, utxo

ChainTables = dict[str, DataFrame]


@dataclass(frozen=True)
class Analytic:
    """`emit` takes (result, folder, first height, last height) and returns counts for the log; `folder` tells that it needs a folder."""

    name: str
    run: Callable[[ChainTables], ChainTables]
    emit: Callable[[ChainTables, str | None, int, int], dict[str, int]]
    folder: bool = False
    help: str = ""


ANALYTICS: dict[str, Analytic] = {}


def show(result: ChainTables, folder: str | None, start: int, last: int) -> dict[str, int]:
    """Prints rows, fields between tabs, as they come from the executors; or with a folder writes them as CSV with a header."""
    counts = {}
    for name, df in result.items():
        if folder:
            counts[name] = sinks.write_csv(df, f"{folder}/{name}-{start}-{last}.csv", header=True)
            continue
        n = 0
        for row in df.toLocalIterator():
            print(*row, sep="\t")
            n += 1
        counts[name] = n
    return counts


def analytic(name: str, emit: Callable = show, folder: bool = False, help: str = ""):
    """Registers a function as an analytic."""

    def add(f: Callable[[ChainTables], ChainTables]):
        ANALYTICS[name] = Analytic(name, f, emit, folder, help or (f.__doc__ or "").strip().split("\n")[0])
        return f

    return add


def _print_report(t: ChainTables, folder: str | None, start: int, last: int) -> dict[str, int]:
    print(sinks.report(t))
    return {}


@analytic("simplestats", _print_report)
def simplestats(t: ChainTables) -> ChainTables:
    """Statistics of the chain as text."""
    return t


@analytic("csvdump", sinks.dump_csv, folder=True)
def csvdump(t: ChainTables) -> ChainTables:
    """The four relations as CSV files."""
    return t


@analytic("unspentcsvdump", lambda t, *where: sinks.dump_utxo(t["unspent"], *where), folder=True)
def unspent(t: ChainTables) -> ChainTables:
    """The unspent outputs as a CSV file."""
    return {"unspent": utxo.utxo_set(t["tx_out"], t["tx_in"])}


@analytic("balances", lambda t, *where: sinks.dump_balances(t["balances"], *where), folder=True)
def balances(t: ChainTables) -> ChainTables:
    """The balance of each address as a CSV file."""
    return {"balances": utxo.balances(unspent(t)["unspent"])}


@analytic("opreturn")
def opreturn(t: ChainTables) -> ChainTables:
    """The embedded texts, one on a line."""
    return {"opreturn": stats.text_lines(stats.embedded_text(t["tx_out"]).orderBy("height"))}
