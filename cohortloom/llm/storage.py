"""Files that tasks write to and read from the shared folder, by any file system Arrow knows."""

from __future__ import annotations

from typing import BinaryIO
from urllib.parse import urlparse

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it; a path without a scheme is local to every machine that shares it."""
    if not urlparse(path).scheme:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def make_folder(path: str) -> None:
    system, inner = opened(path)
    system.create_dir(inner, recursive=True)


def writer(path: str) -> BinaryIO:
    system, inner = opened(path)
    return system.open_output_stream(inner, compression=None)


def reader(path: str) -> BinaryIO:
    system, inner = opened(path)
    return system.open_input_stream(inner, compression=None)


def random_reader(path: str):
    system, inner = opened(path)
    return system.open_input_file(inner)
