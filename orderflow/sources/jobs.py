"""Independent Spark jobs submitted side by side."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

Result = TypeVar("Result")

MAX_JOBS = 4


def run_together(spark: SparkSession, jobs: Mapping[str, Callable[[], Result]]) -> dict[str, Result]:
    """Run the jobs, a few at a time, and return their results by name.

    The first failure is raised once the jobs already submitted have ended.
    """
    with ThreadPoolExecutor(MAX_JOBS) as pool:
        running = {n: pool.submit(inheritable_thread_target(spark)(job)) for n, job in jobs.items()}
        return {name: job.result() for name, job in running.items()}
