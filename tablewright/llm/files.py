"""Binary files in the shared folder, through pyarrow's file systems (local, HDFS, object stores)."""

from __future__ import annotations

import io
import uuid
from contextlib import contextmanager

import numpy as np
from pyarrow import fs


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@contextmanager
def writing(path: str):
    """A stream to a file that appears under its name only when complete; a repeated task, which has the same bytes, leaves a complete file."""
    system, place = open_fs(path)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    part = f"{place}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        yield out
    if system.get_file_info(place).type == fs.FileType.File:
        system.delete_file(part)
    else:
        system.move(part, place)


def reading(path: str):
    system, place = open_fs(path)
    return system.open_input_file(place)


def save_arrays(path: str, **arrays: np.ndarray) -> None:
    data = io.BytesIO()
    np.savez(data, **arrays)
    with writing(path) as out:
        out.write(data.getvalue())


def read_arrays(path: str) -> dict[str, np.ndarray]:
    with reading(path) as f:
        return dict(np.load(io.BytesIO(f.read())))
