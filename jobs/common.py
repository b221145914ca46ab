"""What both jobs share: settings from a file and the command line, and a session that only the command line makes and stops."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import SparkSession

from seqlens.session import session

log = logging.getLogger("seqlens.jobs")


def settings_of(kind: type, path: str | None, given: dict[str, str | None]):
    """A job's settings: those of the file, over them those given; unknown names are errors."""
    values: dict = {}
    if path:
        with open(path, encoding="utf-8") as f:  # the command line's own small file, beside the code
            values = json.load(f)
    values |= {k: v for k, v in given.items() if v is not None}
    if unknown := set(values) - {f.name for f in fields(kind)}:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return kind(**values)


def main(name: str, kind: type, paths: list[str], run: Callable[[SparkSession, object], dict]) -> None:
    """The command line of a job: --config FILE, and each path as an argument of its own."""
    parser = argparse.ArgumentParser(prog=name, description=run.__doc__)
    parser.add_argument("--config", default=os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.json"))
    parser.add_argument("--master")
    for p in paths:
        parser.add_argument(f"--{p}")
    args = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s %(message)s")
    config, master = args.pop("config"), args.pop("master")
    spark = session(name, master)
    try:
        log.info("%s: %s", name, run(spark, settings_of(kind, config, args)))
    finally:
        spark.stop()
