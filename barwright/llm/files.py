"""Files in the shared folder, written and read by ranges inside tasks.

A task writes under a name of its own, and its rows carry that name: when a task is run again, the rows that count name the files that
count, and files of lost attempts are never read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder, given as a path or a URI."""
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder[len("file:"):])


class Writer:
    """A new file in ``folder`` with a unique name."""

    def __init__(self, folder: str, suffix: str):
        self.files, base = store(folder)
        self.files.create_dir(base, recursive=True)
        self.name = f"{uuid.uuid4().hex}{suffix}"
        self.out = self.files.open_output_stream(f"{base}/{self.name}", compression=None)
        self.size = 0

    def write(self, data: bytes) -> int:
        """Append; the offset of what was written."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.out.close()


class Reader:
    """Ranges of files in ``folder``; keeps the last file open."""

    def __init__(self, folder: str):
        self.files, self.base = store(folder)
        self.name, self.file = None, None

    def open(self, name: str):
        if name != self.name:
            if self.file is not None:
                self.file.close()
            self.file, self.name = self.files.open_input_file(f"{self.base}/{name}"), name
        return self.file

    def read(self, name: str, offset: int, length: int) -> bytes:
        return self.open(name).read_at(length, offset)
