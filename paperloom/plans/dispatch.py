"""Jobs run beside the caller: handed in, waited for, given up."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any

from pyspark.sql import SparkSession


class Dispatcher:
    """Runs jobs of one session in threads of their own, each as a Spark job group, so that one can be cancelled alone."""

    def __init__(self, spark: SparkSession, workers: int = 4):
        self.spark, self.pool = spark, ThreadPoolExecutor(workers, thread_name_prefix="paperloom")

    def submit(self, job: Callable[..., Any], *args: Any, **options: Any) -> Future:
        """The job's future result; its ``group`` names the Spark jobs that it starts."""
        group = f"paperloom-{uuid.uuid4().hex}"

        def run() -> Any:
            self.spark.sparkContext.setJobGroup(group, getattr(job, "__name__", "job"), interruptOnCancel=True)
            return job(*args, **options)

        future = self.pool.submit(run)
        future.group = group
        return future

    def wait(self, future: Future, timeout: float | None = 60) -> Any:
        """The result; after ``timeout`` seconds the job is cancelled and TimeoutError is raised."""
        try:
            return future.result(timeout)
        except TimeoutError:
            future.cancel()
            self.spark.sparkContext.cancelJobGroup(future.group)
            raise

    def close(self) -> None:
        self.pool.shutdown(cancel_futures=True)
