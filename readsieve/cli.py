"""Command line: set up and run the directory watch.

The order of flags does not matter: stop, then settings, then start. The run
stays in the foreground; a supervisor or ``spark-submit`` keeps it alive.
"""

from __future__ import annotations

import argparse
import os
import signal
import sys

from pyspark.sql import SparkSession

from readsieve import __version__, logs
from readsieve.config import CONFIG_LOCATION, WATCH_DIRECTORY, Config, load_or_create, save
from readsieve.plans.screen import prepare
from readsieve.session import scratch
from readsieve.sources.fastx import ANY, FASTA, FOUR_LINE, read_fastx
from readsieve.streaming.watch import MAX_FILES, watch

STALE = -2


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="readsieve", description="Screen sequencing reads against a white list.")
    add = p.add_argument
    add("--setWatchDir", nargs="?", const=WATCH_DIRECTORY, metavar="PATH", help="set the watch directory")
    add("--setWhiteList", metavar="FILE", help="set the white list (multi-FASTA)")
    add("--setLog", nargs="?", const="", metavar="FILE", help="set the log file")
    add("--start", action="store_true", help="start watching")
    add("--stop", action="store_true", help="stop the running watch")
    add("--getPID", action="store_true", help="print the PID of the running watch and exit")
    add("--config", default=CONFIG_LOCATION, metavar="FILE", help="configuration file (default: %(default)s)")
    add("--out", default="./readsieve-results", metavar="DIR", help="result table (default: %(default)s)")
    add("--includeExisting", action="store_true", help="also screen files that are already there")
    add("--drain", action="store_true", help="stop once the files present are screened")
    add("--layout", default=ANY, choices=[ANY, FOUR_LINE], help="layout of the read files; four_line lets large ones be cut")
    add("--maxFiles", type=int, default=MAX_FILES, metavar="N", help="most files in a batch (default: %(default)s)")
    add("-v", "--version", action="version", version=__version__)
    return p


def check_pid(config: Config) -> int:
    """PID of the running watch, -1 if there is none, -2 if the one noted is gone."""
    if config.pid < 0:
        return -1
    try:
        os.kill(config.pid, 0)
    except ProcessLookupError:
        return STALE
    except PermissionError:
        pass
    return config.pid


def stop(config: Config, path: str) -> None:
    os.kill(config.pid, signal.SIGTERM)
    config.pid = -1
    save(config, path)


def exists(spark: SparkSession, path: str, folder: bool = False) -> bool:
    """Is there such a file or folder in the file system that the path belongs to?"""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(at) and (not folder or system.getFileStatus(at).isDirectory())


def run(
    spark: SparkSession,
    config: Config,
    *,
    out: str,
    include_existing: bool = False,
    drain: bool = False,
    layout: str = ANY,
    max_files: int = MAX_FILES,
) -> None:
    """Load the white list and watch until SIGTERM (or, with ``drain``, until done)."""
    spec = config.screen_spec()
    white_list = read_fastx(spark, config.white_list, columns=("seq", "status"), layout=FASTA).where("status = 'ok'")
    prepared = prepare(white_list, spec)
    logs.live("white list: %d bases", prepared.ref_length)
    query = watch(
        spark,
        config.watch_directory,
        prepared,
        spec,
        out=out,
        checkpoint=f"{out.rstrip('/')}-checkpoint",
        include_existing=include_existing,
        drain=drain,
        layout=layout,
        max_files=max_files,
    )
    asked_to_stop, reported = [], -1
    before = signal.signal(signal.SIGTERM, lambda *_: asked_to_stop.append(True))
    try:
        while query.isActive and not asked_to_stop:
            query.awaitTermination(1)
            progress = query.lastProgress
            if progress and progress["batchId"] > reported:
                reported = progress["batchId"]
                logs.live("batch %d: %d files", reported, progress["numInputRows"])
    finally:
        query.stop()
        signal.signal(signal.SIGTERM, before)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    changes = args.setWatchDir is not None or args.setWhiteList is not None or args.setLog is not None
    if not (args.start or args.stop or args.getPID or changes):
        p.print_usage(sys.stderr)
        print("nothing to do: no flags set", file=sys.stderr)
        return 1
    path = args.config
    try:
        config = load_or_create(path)
    except (OSError, ValueError) as e:
        print(f"error: failed to load config file: {e}", file=sys.stderr)
        return 1
    pid = check_pid(config)
    if pid == STALE:
        print(f"the registered pid {config.pid} is not running; config updated", file=sys.stderr)
        config.pid = -1
        save(config, path)
        return 1
    if args.getPID:
        print(pid)
        return 0

    own = spark is None

    def there(at: str, local, folder: bool = False) -> bool:
        """Plain paths are looked up here; those of other file systems need a session."""
        nonlocal spark
        if "://" not in at:
            return local(at)
        spark = spark or SparkSession.builder.appName("readsieve").getOrCreate()
        return exists(spark, at, folder)

    log_file = args.setLog if args.setLog else None
    if args.setLog == "" or (config.current_log_file is None and log_file is None):
        log_file = logs.default_file()
    log = logs.start(config.current_log_file or log_file)

    if args.stop and pid == -1:
        log.error("nothing is running, nothing to stop")
        return 1
    restart = False
    if pid >= 0 and (args.stop or changes):
        log.info("stopping PID %d", pid)
        stop(config, path)
        restart = not args.stop
    if args.setWatchDir is not None:
        if not there(args.setWatchDir, os.path.isdir, folder=True):
            log.error("specified directory does not exist: %s", args.setWatchDir)
            return 1
        config.watch_directory = args.setWatchDir
    if args.setWhiteList is not None:
        if not there(args.setWhiteList, os.path.exists):
            log.error("can't access white list file: %s", args.setWhiteList)
            return 1
        config.white_list = args.setWhiteList
    if log_file is not None:
        config.current_log_file = log_file
    save(config, path)

    if args.start or restart:
        if config.pid != -1:
            log.error("already running as PID %d", config.pid)
            return 1
        if config.white_list is None or config.watch_directory is None:
            log.error("a white list and a watch directory are needed; see --setWhiteList, --setWatchDir")
            return 1
        config.pid = os.getpid()
        save(config, path)
        try:
            spark = spark or SparkSession.builder.appName("readsieve").getOrCreate()
            with scratch(spark):
                run(
                    spark,
                    config,
                    out=args.out,
                    include_existing=args.includeExisting,
                    drain=args.drain,
                    layout=args.layout,
                    max_files=args.maxFiles,
                )
        finally:
            latest = load_or_create(path)
            if latest.pid == os.getpid():
                latest.pid = -1
                save(latest, path)
            if own and spark is not None:
                spark.stop()
    log.info("done")
    return 0


if __name__ == "__main__":
    sys.exit(main())
