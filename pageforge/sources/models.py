"""Models as files that Spark ships to its workers.

A model is a file and a function that loads it.  Each Python worker loads it once, when a page first asks for it; a load
that failed is remembered, and every page gets none from then on.  Nothing is downloaded.
"""

from __future__ import annotations

import hashlib
import logging
import shutil
import tempfile
import threading
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark import SparkFiles
from pyspark.sql import SparkSession

_lock = threading.Lock()
_held: dict[str, Any] = {}
_log = logging.getLogger(__name__)


class Shipped:
    """A model on every worker, called like the function that `load` gives; None where it cannot be loaded or fails."""

    def __init__(self, spark: SparkSession, path: str, load: Callable[[str], Callable]) -> None:
        """path: a file on the driver.  It is shipped under a name from its content, so that versions do not meet."""
        digest = hashlib.sha256(Path(path).read_bytes()).hexdigest()[:16]
        self.name, self.load = f"{digest}-{Path(path).name}", load
        copy = Path(tempfile.mkdtemp(prefix="model-")) / self.name
        shutil.copyfile(path, copy)
        spark.sparkContext.addFile(str(copy))

    def instance(self) -> Callable | None:
        """The loaded model of this worker."""
        key = f"{self.name} {getattr(self.load, '__module__', '')}.{getattr(self.load, '__qualname__', '')}"
        with _lock:
            if key not in _held:
                try:
                    _held[key] = self.load(SparkFiles.get(self.name))
                except Exception as fault:  # whatever it is, pages go on without the model
                    _log.warning("model %s cannot be loaded: %s", self.name, fault)
                    _held[key] = None
            return _held[key]

    def __call__(self, *inputs):
        model = self.instance()
        if model is None:
            return None
        try:
            return model(*inputs)
        except Exception as fault:
            _log.warning("model %s failed: %s", self.name, fault)
            return None
