"""Tables and folders that every executor can see.

``spark.checkpoint.dir`` names the shared folder of the cluster. Only a single-JVM session that leaves it unset (tests,
notebooks) gets a temporary folder of its own. Intermediate tables are deleted when what was made of them is written
(``settle``, ``release``), the rest when the application ends.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path
from weakref import WeakKeyDictionary

from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_SHIPPED: dict[str, str] = {}
_TABLES: dict[str, object] = {}
_PATH_OF: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per application, however the driver found it."""
    app = spark.sparkContext.applicationId
    if _SHIPPED.get("app") != app:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="tidemark-")) / f"{root.name}.zip"
        atexit.register(shutil.rmtree, archive.parent, ignore_errors=True)
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED["app"] = app


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder, without a trailing slash."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        full = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
        return re.sub("^file:/+", "file:///", full).rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
    return f"file://{_LOCAL['dir']}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    ship(spark)
    path = new_path(spark, label)
    if not _TABLES:
        atexit.register(_delete_all)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    _TABLES[path] = (at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATH_OF[out] = path
    return out


def _delete(path: str) -> None:
    at, fs = _TABLES.pop(path)
    fs.delete(at, True)


def _delete_all() -> None:
    try:
        for path in list(_TABLES):
            _delete(path)
    except Exception:  # the JVM may be gone by now, and its file systems with it
        _TABLES.clear()


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read any more; other frames stay as they are."""
    for df in tables:
        if (path := _PATH_OF.pop(df, None)) in _TABLES:
            _delete(path)


def settle(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """``materialize`` what ``make`` gives, then delete the tables that it made on the way."""
    before = set(_TABLES)
    out = materialize(make(), label)
    for path in set(_TABLES) - before - {_PATH_OF[out]}:
        _delete(path)
    return out


def store(uri: str) -> tuple[FileSystem, str]:
    """The file system of a URI and the path in it, for binary files that Spark has no writer for."""
    return FileSystem.from_uri(uri)


def write_bytes(uri: str, data: bytes) -> None:
    """Write a file that appears whole or not at all."""
    fs, path = store(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(f"{path}.part") as f:
        f.write(data)
    fs.move(f"{path}.part", path)


def read_bytes(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    """A file, or a range of it."""
    fs, path = store(uri)
    with fs.open_input_file(path) as f:
        return f.read() if length is None else f.read_at(length, offset)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by a path that only Spark opens."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, mod 4; fold 2 is held out of all training. A null id has no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def trainable(doc_id: Column) -> Column:
    """True for the rows that a model may learn from."""
    return F.coalesce(fold_of(doc_id) != 2, F.lit(False))


def held_out(doc_id: Column) -> Column:
    """True for the rows of the held-out fold."""
    return F.coalesce(fold_of(doc_id) == 2, F.lit(False))
