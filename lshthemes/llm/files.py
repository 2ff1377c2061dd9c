"""Binary files in the shared folder, from within tasks.

Every attempt of a task writes a file of its own name, and the rows it returns name that file. Only files named in the
rows that Spark kept count, so a lost executor or a second attempt leaves at most a file that nothing refers to.
"""

from __future__ import annotations

import re
import uuid

from pyarrow import fs
from pyspark import TaskContext


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    local = re.match(r"file:/*(?=/)", uri)
    if local or "://" not in uri:
        return fs.LocalFileSystem(), uri[local.end() :] if local else uri
    return fs.FileSystem.from_uri(uri)


def new_part(folder: str, suffix: str) -> tuple[int, str]:
    """This task's place among the partitions and the name of its file."""
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    return part, f"{folder.rstrip('/')}/part-{part:06d}-{uuid.uuid4().hex}{suffix}"


def create(uri: str):
    where, path = locate(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    return where.open_output_stream(path, compression=None)  # names ending in .gz hold members made here


def open_random(uri: str):
    where, path = locate(uri)
    return where.open_input_file(path)
