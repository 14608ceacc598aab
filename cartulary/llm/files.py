"""Files that tasks write to and read from shared storage, by URI."""

from __future__ import annotations

from contextlib import contextmanager

from pyarrow import fs
from pyspark import TaskContext


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; plain paths are local."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@contextmanager
def whole_file(uri: str):
    """A stream whose file appears under its name only when it is complete.

    Each attempt of a task writes to a name of its own, so retries and speculative
    copies never mix; a later attempt puts the same content in the same place.
    """
    where, path = place(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    context = TaskContext.get()
    own = f"{path}.attempt-{context.taskAttemptId() if context else 0}"
    with where.open_output_stream(own, compression=None) as out:
        yield out
    where.move(own, path)


def read_bytes(uri: str) -> bytes:
    """All bytes of a file."""
    where, path = place(uri)
    with where.open_input_stream(path, compression=None) as stream:
        return stream.read()


@contextmanager
def ranged(uri: str):
    """A function of (place, length) that reads so many bytes of a file."""
    where, path = place(uri)
    with where.open_input_file(path) as file:
        yield lambda at, n: file.read_at(n, at)


def task_number() -> int:
    """The index of the partition that this task works on."""
    context = TaskContext.get()
    return context.partitionId() if context else 0
