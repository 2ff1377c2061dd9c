"""Files in the shared folder, from within tasks."""

from __future__ import annotations

import re

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    local = re.match(r"file:/*(?=/)", uri)
    if local or "://" not in uri:
        return fs.LocalFileSystem(), uri[local.end() :] if local else uri
    return fs.FileSystem.from_uri(uri)
