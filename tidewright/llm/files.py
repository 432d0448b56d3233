"""Files in the folder that driver and executors share, opened inside tasks."""

from __future__ import annotations

import os
from urllib.parse import urlparse

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    """A local path for file: and no scheme; any other store through the file system that its scheme names."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)


def write_once(uri: str, write) -> None:
    """write(sink) into a name that nobody reads, which then becomes uri: a task that dies leaves no half file there."""
    system, path = _at(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    with system.open_output_stream(path + ".part") as sink:
        write(sink)
    system.move(path + ".part", path)


def open_file(uri: str):
    """A file to seek and read in."""
    system, path = _at(uri)
    return system.open_input_file(path)
