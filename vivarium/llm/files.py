"""Files in the shared folder, by any file system that pyarrow knows."""

from __future__ import annotations

import contextlib
from collections import OrderedDict

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def open_output(uri: str):
    system, path = resolve(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_input(uri: str):
    system, path = resolve(uri)
    return system.open_input_file(path)


def exists(uri: str) -> bool:
    system, path = resolve(uri)
    return system.get_file_info(path).type != fs.FileType.NotFound


def move(source: str, to: str) -> None:
    system, path = resolve(source)
    system.move(path, resolve(to)[1])


def remove(uri: str) -> None:
    system, path = resolve(uri)
    with contextlib.suppress(FileNotFoundError):
        system.delete_file(path)


def remove_folder(uri: str) -> None:
    system, path = resolve(uri)
    with contextlib.suppress(FileNotFoundError):
        system.delete_dir(path)


class Handles:
    """Open input files, the least recently used closed first."""

    def __init__(self, most: int = 32):
        self.most, self.open = most, OrderedDict()

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri not in self.open:
            if len(self.open) >= self.most:
                self.open.popitem(last=False)[1].close()
            self.open[uri] = open_input(uri)
        self.open.move_to_end(uri)
        return self.open[uri].read_at(length, offset)

    def close(self) -> None:
        for f in self.open.values():
            f.close()
        self.open.clear()
