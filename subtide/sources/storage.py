"""Files by URI, for code that runs in tasks and in the commit of a sink."""

from __future__ import annotations

import pyarrow.fs as pa_fs


def located(uri: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system and path of a URI, of a path with Hadoop's ``file:`` or of a plain path."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = uri[len("file:") :]
    return pa_fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def exists(fs: pa_fs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type != pa_fs.FileType.NotFound


def safe_name(name: str) -> bool:
    """A relative path that stays where it is put."""
    parts = name.split("/")
    return bool(name) and not name.startswith("/") and all(p not in ("", ".", "..") for p in parts) and "\\" not in name and "\0" not in name


def scratch(spark) -> str:
    """A new folder name in ``spark.checkpoint.dir``; in a temporary folder only where none is set and the master is local (tests)."""
    import tempfile
    import uuid

    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="subtide-")
    return f"{named.rstrip('/')}/files-{uuid.uuid4().hex}"
