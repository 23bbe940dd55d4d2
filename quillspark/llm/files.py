"""Binary files that tasks write to the shared folder, on any file system that Arrow knows."""

from __future__ import annotations

import uuid

from pyarrow import fs


def write_file(folder: str, name: str, data: bytes) -> None:
    """``data`` under its name all at once: a task that is run again, or twice, leaves the same file."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    draft = f"{path}/_{name}.{uuid.uuid4().hex}"
    try:
        with system.open_output_stream(draft) as out:
            out.write(data)
        system.move(draft, f"{path}/{name}")
    except BaseException:
        if system.get_file_info(draft).type != fs.FileType.NotFound:
            system.delete_file(draft)
        raise
