"""Whole-file writes and reads on the shared file system, from inside tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_whole(uri: str, content: bytes) -> None:
    """The file appears at once and whole; a second attempt of a lost task replaces it with the same bytes."""
    system, path = open_system(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(content)
    system.move(draft, path)


def read_whole(uri: str) -> bytes:
    system, path = open_system(uri)
    with system.open_input_file(path) as source:
        return source.read()
