"""Spark jobs that do not need each other, started side by side from the driver."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def at_once(spark: SparkSession, jobs: list[Callable[[], Any]], parallelism: int) -> list:
    """The jobs' results in their order; at most ``parallelism`` of them run at a time."""
    if len(jobs) < 2 or parallelism < 2:
        return [job() for job in jobs]
    with ThreadPoolExecutor(min(parallelism, len(jobs))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]
