"""Files by the URIs that Spark uses, opened from Python tasks."""

from __future__ import annotations

from pyarrow import fs

# Schemes of Hadoop connectors, and what the file system library calls the same store.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it). A path without a scheme is local. Credentials come from the environment of the
    task, as the store's own library reads them; a region or endpoint can be given as in `s3a://bucket/x?region=r`."""
    scheme, mark, rest = path.partition("://")
    uri = f"{SCHEMES.get(scheme, scheme)}://{rest}" if mark else path
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = f"file://{uri[5:]}"
    try:
        return fs.FileSystem.from_uri(uri)
    except Exception as error:
        raise ValueError(f"cannot open {path}: tasks reach local, file, hdfs, s3a, gs and abfs paths ({error})") from error
