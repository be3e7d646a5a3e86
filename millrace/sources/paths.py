"""Files that are written one by one, on any file system that Arrow knows (a plain path is a shared local folder)."""

from __future__ import annotations

import os

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path within it)."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


class Replaced:
    """A file that appears under its name only when it is whole: written beside it, then moved, so a retry replaces it."""

    def __init__(self, path: str) -> None:
        self.system, self.path = located(path)
        self.system.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.system.open_output_stream(self.path + ".part")

    def __enter__(self) -> Replaced:
        return self

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def __exit__(self, kind, *_) -> None:
        self.out.close()
        if kind is None:
            self.system.move(self.path + ".part", self.path)


def read(path: str) -> bytes | None:
    """A file's bytes, None if it isn't there."""
    system, inner = located(path)
    if system.get_file_info(inner).type != fs.FileType.File:
        return None
    with system.open_input_stream(inner) as file:
        return file.read()
