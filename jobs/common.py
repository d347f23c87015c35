"""What the command lines share."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession


def settings(job: str) -> dict:
    """The configuration that lies beside a job's file."""
    return json.loads((Path(__file__).parent / f"{job}.json").read_text())


def main(job: str, run: Callable, paths: dict[str, str]) -> None:
    """Parse the command line, start a session, run the job with its paths and configuration, and stop the session."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{job}", description=run.__doc__)
    for name, what in paths.items():
        parser.add_argument(f"--{name}", required=True, help=what)
    parser.add_argument("--config", help=f"JSON file, jobs/{job}.json if none is given")
    given = vars(parser.parse_args())
    config = given.pop("config")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(job).getOrCreate()
    try:
        run(spark, **given, config=json.loads(Path(config).read_text()) if config else settings(job))
    finally:
        spark.stop()
