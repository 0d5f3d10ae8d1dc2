"""Files that tasks write and read themselves, in the shared folder, wherever that is."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system that a folder's address names, and the folder's path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?=[^/])", "file:///", folder))


def make_folder(folder: str) -> None:
    """So that the folder is there though no task writes to it."""
    store, path = open_folder(folder)
    store.create_dir(path, recursive=True)


def put(folder: str, name: str, parts) -> int:
    """Write ``parts`` (bytes) as one file, which appears when it is whole; a task that runs again replaces it."""
    store, path = open_folder(folder)
    store.create_dir(path, recursive=True)
    unready, n = f"{path}/_unready-{name}-{uuid.uuid4().hex}", 0
    with store.open_output_stream(unready) as out:
        for part in parts:
            out.write(part)
            n += len(part)
    store.move(unready, f"{path}/{name}")
    return n


def there(folder: str, name: str) -> bool:
    store, path = open_folder(folder)
    return store.get_file_info(f"{path}/{name}").type == fs.FileType.File


def reading(folder: str, name: str):
    """The file, open for reading from its beginning on."""
    store, path = open_folder(folder)
    return store.open_input_stream(f"{path}/{name}", buffer_size=1 << 20)


def remove(folder: str, name: str) -> None:
    store, path = open_folder(folder)
    if store.get_file_info(f"{path}/{name}").type == fs.FileType.File:
        store.delete_file(f"{path}/{name}")
