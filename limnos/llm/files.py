"""Files that tasks write into the shared folder and read back by range, on any store that pyarrow knows."""

from __future__ import annotations

import io
import os
import uuid
import zipfile

from pyarrow import fs
from pyspark.sql import SparkSession

from limnos.session import new_path


def folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one, as a URI."""
    path = new_path(spark, label)
    return path if "://" in path or not path.startswith("/") else f"file://{path}"


def opened(uri: str):
    """File system and path of a URI such as file:///x, file:/x or s3://bucket/x."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def write(base: str, name: str, suffix: str):
    """An output stream to a new file, and its name. Every attempt of a task writes a file of its own; readers learn names from committed rows,
    so what a lost attempt left is never read."""
    system, root = opened(base)
    system.create_dir(root, recursive=True)
    own = f"{name}-{uuid.uuid4().hex}{suffix}"
    return system.open_output_stream(f"{root}/{own}", compression=None), own


def read(base: str, name: str):
    """A seekable input file."""
    system, root = opened(base)
    return system.open_input_file(f"{root}/{name}")


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per application: they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_limnos_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for where, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(where, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(top)))
    base = folder(spark, "package")
    out, name = write(base, "limnos", ".zip")
    with out:
        out.write(packed.getvalue())
    context.addPyFile(f"{base}/{name}")
    context._limnos_shipped = True
