"""Command line: python -m chainloom.cli [options] ANALYTIC [DIR], the analytics being those of chainloom.plugins and of --plugin modules."""

from __future__ import annotations

import argparse
import importlib
import logging
import os
import sys
import time
import uuid

from pyspark.sql import functions as F

from chainloom.coins import COINS, coin
from chainloom.operators.heights import check_range, show_range, until_gap, with_heights
from chainloom.operators.verify import verify
from chainloom.plugins import ANALYTICS
from chainloom.progress import Progress
from chainloom.session import Saved, build_session, delete_on_exit, shared_dir
from chainloom.sources.tables import flatten, load, read_blocks, save

log = logging.getLogger("chainloom")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chainloom")
    p.add_argument("--verify", action="store_true", help="check merkle roots, links and the first block")
    p.add_argument("-v", action="count", default=0, dest="verbose", help="more log, twice for debugging")
    p.add_argument("-c", "--coin", default="bitcoin", choices=sorted(COINS))
    p.add_argument("-d", "--blockchain-dir", help="folder of the block files; by default the coin's folder in the home")
    p.add_argument("-s", "--start", type=int, default=0, help="first height")
    p.add_argument("-e", "--end", type=int, help="last height, inclusive; by default the tip")
    p.add_argument("--index", help="folder of the block index; by default `index` in the block folder, if it exists")
    p.add_argument("--literal-pushdata", action="store_true", help="read the lengths of PUSHDATA from the opcode on, as some older parsers do")
    p.add_argument("--plugin", action="append", default=[], metavar="MODULE", help="a module that registers more analytics")
    p.add_argument("--master", help="Spark master, if none is configured")
    sub = p.add_subparsers(dest="command", required=True)
    for a in ANALYTICS.values():
        own = sub.add_parser(a.name, help=a.help)
        if a.folder:
            own.add_argument("dump_folder")
    return p


def load_plugins(argv: list[str]) -> None:
    """Imports the modules named by --plugin, so that their analytics are subcommands."""
    early = argparse.ArgumentParser(add_help=False, allow_abbrev=False)
    early.add_argument("--plugin", action="append", default=[])
    for name in early.parse_known_args(argv)[0].plugin:
        importlib.import_module(name)


def setup_log(verbose: int) -> None:
    level = (logging.INFO, logging.DEBUG)[min(verbose, 1)]
    logging.Formatter.converter = time.gmtime
    logging.basicConfig(level=level, format="[%(asctime)s] %(levelname)s - %(name)s: %(message)s", stream=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    load_plugins(argv)
    a = parser().parse_args(argv)
    setup_log(a.verbose)
    try:
        check_range(a.start, a.end)
        chosen = coin(a.coin)
        folder = a.blockchain_dir or os.path.join(os.path.expanduser("~"), chosen.folder)
        if not os.path.isdir(folder):
            raise FileNotFoundError(f"no such folder: {folder}")
        spark = build_session("chainloom", a.master)
        run(spark, a, chosen, folder)
    except (ValueError, OSError) as e:
        log.error("%s", e)
        return 1
    return 0


def run(spark, a: argparse.Namespace, chosen, folder: str) -> None:
    index = a.index or (os.path.join(folder, "index") if os.path.isdir(os.path.join(folder, "index")) else None)
    log.info("reading %s heights %s from %s", chosen.name, show_range(a.start, a.end), folder)
    first = max(a.start - 1, 0) if a.verify else a.start  # the block below the first one verifies its link
    blocks = read_blocks(spark, folder, chosen, index, first, a.end)
    if index is None:
        blocks = until_gap(with_heights(Saved(blocks.drop("height"), "decoded").df), 0)
        blocks = blocks.where(F.col("height") >= first)
        blocks = blocks if a.end is None else blocks.where(F.col("height") <= a.end)
    with Progress(spark) as progress:
        decoded = Saved(blocks, "decoded")
        relations = f"{shared_dir(spark)}/chainloom/relations-{uuid.uuid4().hex}"
        delete_on_exit(spark, relations)
        save(flatten(decoded.df, chosen, a.literal_pushdata), relations)
        progress.done(decoded.count(), "blocks")
        decoded.drop()
        if a.verify:
            whole = load(spark, relations, first)
            verify(whole["blocks"], whole["transactions"], chosen.genesis)
        tables = load(spark, relations, a.start)
        last = tables["blocks"].agg(F.max("height")).first()[0]
        if last is None:
            raise ValueError("no block in the range of heights")
        chosen_analytic = ANALYTICS[a.command]
        counts = chosen_analytic.emit(chosen_analytic.run(tables), getattr(a, "dump_folder", None), a.start, last)
    for name, n in (counts or {}).items():
        log.info("%s: %d", name, n)
    log.info("done at height %s", last)


if __name__ == "__main__":
    sys.exit(main())
