"""Files of a shared folder, by path or URI, as data sources read and write them inside tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a URI (file, hdfs, s3, gs) or an absolute path."""
    system, inner = pafs.FileSystem.from_uri(path)
    return system, inner.rstrip("/")


def get(system: pafs.FileSystem, path: str) -> bytes | None:
    """A file's bytes; None where there is none."""
    try:
        with system.open_input_stream(path, compression=None) as f:
            return f.read()
    except FileNotFoundError:
        return None


def put(system: pafs.FileSystem, path: str, data: bytes) -> None:
    """Write a whole file under a name of its own, then move it: others see the old file or the new one, never a part."""
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    waiting = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(waiting, compression=None) as f:
        f.write(data)
    moved(system, waiting, path)


def moved(system: pafs.FileSystem, source: str, target: str) -> None:
    try:
        system.move(source, target)
    except OSError:  # some file systems don't move onto a file that is there
        if system.get_file_info(target).type == pafs.FileType.NotFound:
            raise
        system.delete_file(target)
        system.move(source, target)


def removed(system: pafs.FileSystem, folder: str) -> None:
    if system.get_file_info(folder).type == pafs.FileType.Directory:
        system.delete_dir(folder)
