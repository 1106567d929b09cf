"""Settings that an operator needs while it runs, and puts back."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_HASHED_BYTES = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _while_running(key: str, value: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    def changed(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(build)
        def run(docs: DataFrame, *args, **named) -> DataFrame:
            conf = docs.sparkSession.conf
            before = conf.get(key, None)
            conf.set(key, value)
            try:
                return build(docs, *args, **named)
            finally:
                conf.unset(key) if before is None else conf.set(key, before)

        return run

    return changed


#: Run an operator's jobs with shuffle files deleted as soon as their job is done; the session is left as it was.
dropping_shuffles = _while_running(_CLEANUP, "true")
#: Send texts to Python workers in batches of few MB, as a batch lies in the executor and in the worker at once.
small_batches = _while_running(_BATCH_BYTES, str(4 << 20))
#: Join shuffled tables by hashing instead of sorting them, if no part of the smaller one is beyond the advised size.
hashing_parts = _while_running(_HASHED_BYTES, "64MB")
