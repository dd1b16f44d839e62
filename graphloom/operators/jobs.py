"""Cancelling what runs too long."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Cancelled(Exception):
    """What was run inside `cancelling` has been stopped."""


@contextmanager
def cancelling(spark: SparkSession, needed: Callable[[], bool], every: float = 0.2) -> Iterator[None]:
    """Spark jobs that this thread starts inside are cancelled as soon as needed() is true, which is asked every so many seconds.

    Other threads' jobs go on.  What is inside then ends with Cancelled; if needed() fails, its error counts as true.  A DataFrame whose job was
    cancelled keeps that failure: to run it again, build it again.
    """
    tag, over, stopped = f"graphloom-{uuid.uuid4().hex}", threading.Event(), threading.Event()
    errors: list[Exception] = []

    def asked() -> bool:
        try:
            return needed()
        except Exception as e:
            errors.append(e)
            return True

    def watch() -> None:
        while not over.wait(every):
            # again as long as it lasts, as one query may start several jobs
            if stopped.is_set() or asked():
                stopped.set()
                spark.sparkContext.cancelJobsWithTag(tag)

    watcher = threading.Thread(target=watch, daemon=True)
    spark.sparkContext.addJobTag(tag)
    watcher.start()
    try:
        yield
    except Exception as e:
        if stopped.is_set():
            raise Cancelled(*errors) from e
        raise
    finally:
        over.set()
        watcher.join()
        spark.sparkContext.removeJobTag(tag)
