"""Files in the shared folder, written and read inside tasks."""

from __future__ import annotations


def place(folder: str):
    """(filesystem, path) of a folder URI; its scheme says which store it is."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def attempt_name(stem: str, ending: str) -> str:
    """A file name that no other partition or attempt uses, so a task that runs again never meets its first file."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return f"{stem}-{task.partitionId():06d}-{task.taskAttemptId()}{ending}"
