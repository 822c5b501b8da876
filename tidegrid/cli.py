"""Command line: query, repl, ingest and config over a warehouse folder of Parquet tables."""

from __future__ import annotations

import argparse
import datetime as dt
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from . import config, render
from .functions.text import parse_rate
from .operators import datasets, iql
from .plans.lexer import StatementBuffer, duration_ns
from .session import Session
from .sources import lineproto
from .sources.catalog import Catalog
from .sources.history import Store
from .streaming.watch import DEFAULT_SECONDS, Watch

HISTORY = Path.home() / ".local/state/tidegrid/history.jsonl"
CONFIG = Path.home() / ".config/tidegrid/config.yaml"


def spark_session(c: config.Effective) -> SparkSession:
    builder = SparkSession.builder.appName("tidegrid").master(c.master).config("spark.sql.shuffle.partitions", str(c.shuffle_partitions))
    return builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def warehouse_catalog(spark: SparkSession, root: str) -> Catalog:
    """Tables root/<database>/<policy>/<measurement>.parquet with a timestamp column; strings are tags, the rest are fields."""
    out = Catalog(spark)
    for path in sorted(Path(root).glob("*/*/*.parquet")) if root else []:
        df = spark.read.parquet(str(path))
        kinds = dict(df.dtypes)
        times = [c for c, k in kinds.items() if k.startswith("timestamp")]
        if times:
            tags = [c for c, k in kinds.items() if k == "string"]
            out.register(path.parts[-3], path.parts[-2], path.stem, df, times[0], tags, [c for c in kinds if c not in (*tags, times[0])])
    return out


def repl(session: Session, lines, write, fmt: str = "table", store: Store | None = None) -> None:
    """Statements from lines until they end or :q; what succeeds goes to the history, commands don't."""
    buffer = StatementBuffer()
    for line in lines:
        text = line.strip()
        if not buffer.active and text in (":q", "q"):
            return
        if text in (":cancel", ":clear"):
            buffer.reset()
            continue
        if not buffer.active and text.split(" ")[0] in (":format", ":fmt"):
            fmt = render.normalize_format(text.partition(" ")[2])
            continue
        if not buffer.active and text.split(" ")[0] in (":history", ":hist"):
            for e in store.search(text.partition(" ")[2].strip()) if store else []:
                write(f"{e['id']}  {e['query']}")
            continue
        if text and (statement := buffer.add(line.rstrip("\n"))) is not None:
            try:
                out = session.execute(statement)
                write(render.render(out.df, fmt, out.series))
                if store is not None and not statement.startswith(":"):
                    store.append(statement, session.database, session.policy)
            except Exception as e:
                write(f"error: {e}")
            write(render.status_line(session.snapshot()))


def ingest(spark: SparkSession, args: argparse.Namespace, c: config.Effective, write) -> None:
    if args.dataset == "iql":
        settings = iql.Settings(database=c.database, forced=frozenset({"database"} if c.database else ()))
        run = iql.run(spark, Path(args.file).read_text(encoding="utf-8"), settings, args.dry_run)
        lines, unit, database, policy = run.lines, settings.precision, settings.database, settings.retention_policy
        summary = {"dataset": "iql", **run.measured(), "batches": run.batches, "skipped_queries": run.skipped_queries, "raw": run.raw, "ignored": ",".join(settings.ignored)}
    else:
        start = int(dt.datetime.fromisoformat(args.start).replace(tzinfo=dt.UTC).timestamp()) * 10**9 if args.start else None
        p = datasets.plan(datasets.Options(args.dataset, start, parse_rate(args.rate), duration_ns(args.duration), args.hosts, args.pids, args.points, args.series, duration_ns(args.tick), args.ratio, args.batch_size, args.precision))
        lines, unit, database, policy, summary = datasets.lines(datasets.generate(spark, p), p), args.precision, c.database, c.retention_policy, p.summary()
    if args.dry_run:
        for r in lines.orderBy("seq").toLocalIterator():
            write(r["line"])
    else:
        lineproto.write(lines.select("line"), args.out, database, policy or "autogen", unit)
    for k, v in summary.items():
        print(f"{k}: {v}", file=sys.stderr)


def watch(session: Session, args: argparse.Namespace, c: config.Effective, write) -> int:
    """Run a statement again and again: `times` times, or until interrupted. A failure is told and the last good result stays."""
    w = Watch(session.spark, lambda: session.execute(args.text), lambda out: render.render(out.df, c.format, out.series, max_rows=c.max_rows, max_series=c.max_series), args.every)
    done = 0
    try:
        while not args.times or done < args.times:
            began = time.monotonic()
            good = w.refresh()
            write(w.result if good else f"error: {w.error}")
            done += 1
            if done != args.times:
                time.sleep(max(0.0, w.seconds - (time.monotonic() - began)))
    except KeyboardInterrupt:
        w.cancel()
    return 0 if w.error is None else 1


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidegrid")
    for flag in ("profile", "database", "retention-policy", "precision", "format", "master", "warehouse", "max-rows", "max-series"):
        p.add_argument(f"--{flag}", dest=flag.replace("-", "_"))
    sub = p.add_subparsers(dest="command")
    sub.add_parser("query").add_argument("text")
    sub.add_parser("repl")
    w = sub.add_parser("watch")
    w.add_argument("text")
    w.add_argument("--every", type=float, default=DEFAULT_SECONDS)
    w.add_argument("--times", type=int, default=0)
    g = sub.add_parser("ingest")
    g.add_argument("dataset", choices=[*datasets.MEASUREMENTS, "iql"])
    for flag, default in {"file": "", "start": "", "rate": "100/s", "duration": "1m", "tick": "10s", "out": "warehouse"}.items():
        g.add_argument(f"--{flag}", default=default)
    for flag, n in {"hosts": 10, "pids": 1000, "points": 100, "series": 100_000, "batch-size": 5000}.items():
        g.add_argument(f"--{flag}", type=int, default=n)
    g.add_argument("--ratio", type=float, default=0.1)
    g.add_argument("--dry-run", action="store_true")
    sub.add_parser("config").add_argument("what", choices=["path", "show"])
    return p


def main(argv: list[str] | None = None, write=print) -> int:
    args = parser().parse_args(argv)
    c = config.resolve(vars(args), os.environ, CONFIG)
    if args.command == "config":
        write(str(CONFIG) if args.what == "path" else "\n".join(c.redacted()))
        return 0
    spark = spark_session(c)
    if args.command == "ingest":
        args.precision = args.precision or "ns"
        ingest(spark, args, c, write)
        return 0
    session = Session(spark, warehouse_catalog(spark, c.warehouse), c.database, c.retention_policy, c.precision)
    if args.command == "query":
        try:
            out = session.execute(args.text)
        except Exception as e:
            write(f"error: {e}")
            return 1
        write(render.render(out.df, c.format, out.series, max_rows=c.max_rows, max_series=c.max_series))
        return 0
    if args.command == "watch":
        return watch(session, args, c, write)
    repl(session, sys.stdin, write, c.format, Store(HISTORY))
    return 0


if __name__ == "__main__":
    sys.exit(main())
