"""Cancelling operations, and a bounded record of what ran."""

from __future__ import annotations

import threading
import time
import uuid
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from ..errors import CancelledError

_RECORD: deque = deque(maxlen=256)


class CancellationToken:
    """Cancels all Spark jobs started under it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tag, self.reason = spark, f"tidewright-{uuid.uuid4().hex}", None

    @property
    def cancelled(self) -> bool:
        return self.reason is not None

    def cancel(self, reason: str = "cancelled") -> None:
        self.reason = self.reason or reason
        self.spark.sparkContext.cancelJobsWithTag(self.tag)


@contextmanager
def operation_cancellation(spark: SparkSession, timeout_seconds: float | None = None) -> Iterator[CancellationToken]:
    """Jobs started inside can be cancelled by the token, and are after the timeout."""
    token = CancellationToken(spark)
    sc = spark.sparkContext
    over = threading.Event()

    def watch():
        wait = timeout_seconds
        while not over.wait(wait):  # a job that starts late is cancelled too
            token.cancel("timeout")
            wait = 0.5

    begin, outcome = time.time(), "done"
    sc.addJobTag(token.tag)
    try:
        if timeout_seconds is not None:
            threading.Thread(target=watch, daemon=True).start()
        yield token
        if token.cancelled:
            raise CancelledError(f"the operation ended early: {token.reason}")
    except CancelledError:
        outcome = token.reason or "cancelled"
        raise
    except Exception as e:
        outcome = type(e).__name__
        if token.cancelled:
            outcome = token.reason
            raise CancelledError(f"the operation ended early: {token.reason}") from e
        raise
    finally:
        over.set()
        sc.removeJobTag(token.tag)
        _RECORD.append({"started": begin, "seconds": time.time() - begin, "outcome": outcome})


def process_operation_diagnostics() -> dict:
    """The last operations of this process, without any of their data."""
    own = list(_RECORD)
    return {"operations": own, "cancellations": sum(o["outcome"] in ("cancelled", "timeout") for o in own)}
