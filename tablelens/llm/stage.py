"""Steps of a job that are written to the shared folder and read back."""

from __future__ import annotations

import atexit
import hashlib
import os
import tempfile
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tablelens.session import materialize, release

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffle_cleanup(spark: SparkSession):
    """Shuffle files of the queries run inside go when each query ends (what a
    step needs later is in its written table)."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package (as ``--py-files`` would), once a session."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    files = sorted(root.rglob("*.py"))
    digest = hashlib.sha256(b"".join(f.read_bytes() for f in files)).hexdigest()[:12]
    path = os.path.join(tempfile.mkdtemp(prefix="tablelens-ship-"), f"tablelens-{digest}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in files:
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


_left: dict[str, set[str]] = {}


def release_steps(spark: SparkSession) -> int:
    """Delete every step that operators of this application have written and not
    dropped; results that still read them can't be read afterwards. Also done
    when the driver program ends."""
    paths = _left.pop(spark.sparkContext.applicationId, set())
    for path in paths:
        release(spark, path)
    return len(paths)


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession() if _left else None
    if spark is not None and spark.sparkContext._jsc is not None:
        release_steps(spark)


class Steps:
    """Written steps of one operator; ``drop`` deletes those no longer read, and
    ``release_steps`` what is left."""

    def __init__(self, spark: SparkSession):
        ship_package(spark)
        self.spark = spark
        self._paths: dict[str, str] = {}

    def write(self, name: str, df: DataFrame, *parts: str) -> DataFrame:
        """``parts``: columns that the step is written in folders by, see ``drop_part``."""
        with shuffle_cleanup(self.spark):
            out, path = materialize(df, *parts)
        self._paths[name] = path
        _left.setdefault(self.spark.sparkContext.applicationId, set()).add(path)
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            path = self._paths.pop(name, None)
            release(self.spark, path)
            _left.get(self.spark.sparkContext.applicationId, set()).discard(path)

    def drop_part(self, name: str, folder: str) -> None:
        """Delete one folder of a step, as "column=value"; nothing may read it any more."""
        release(self.spark, f"{self._paths[name]}/{folder}")
