"""Files in the folder that all executors share, opened from tasks.

The folder is a URI that Spark names (spark.checkpoint.dir); pyarrow opens local and
mounted folders, HDFS and object stores by the same call.
"""

from __future__ import annotations

import os

from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    if "://" not in uri:
        uri = os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)
