"""This package on a cluster: an archive that executors import from."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).parent
#: Applications that have the archive.
_done: set[str] = set()


def archive(path: str | Path) -> Path:
    """Write the package, with its texts, as a zip archive (for ``--py-files``, or ``ship``); same files, same bytes."""
    path = Path(path)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(PACKAGE.rglob("*")):
            if f.is_file() and f.suffix in (".py", ".txt"):
                out.writestr(zipfile.ZipInfo(f"{PACKAGE.name}/{f.relative_to(PACKAGE).as_posix()}"), f.read_bytes())
    return path


def ship(spark: SparkSession) -> None:
    """Let all Python workers of this application import the package; once, however often it is called.

    Spark's own file server hands the archive to executors, those that come
    later too. Needed where the package is installed on the driver only.
    """
    app = spark.sparkContext.applicationId
    if app not in _done:
        spark.sparkContext.addPyFile(str(archive(Path(tempfile.mkdtemp(prefix="tidemark-ship-")) / "tidemark.zip")))
        _done.add(app)
