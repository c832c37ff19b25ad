"""One copy of large arrays per executor, mapped into memory by all its workers.

A copy lies in the executor's own folder of Spark files, which goes when the
executor goes. It is only ever a copy of a table in shared storage: a new
executor builds its own, so nothing is lost with it.
"""

from __future__ import annotations

import fcntl
import os
import shutil
from collections.abc import Callable
from contextlib import contextmanager
from pathlib import Path

import numpy as np
from pyspark import SparkFiles

#: Copies that stay beside the one in use; older ones are deleted.
KEPT_COPIES = 2

Build = Callable[[dict[str, np.ndarray]], None]


def own_folder() -> Path:
    return Path(SparkFiles.getRootDirectory()).resolve()


def mapped(
    key: str, shapes: dict[str, tuple[int, ...]], dtype: np.dtype, build: Build, root: Path | None = None
) -> dict[str, np.ndarray]:
    """Arrays of the copy ``key``, read-only; ``build`` fills those that are not there yet.

    ``build`` gets the missing arrays as zeros in writable files. It runs under
    the copy's lock, so of several workers one builds and the others wait for
    it. Files get their names when they are whole: a worker that is killed
    leaves nothing that would be taken for a copy.
    """
    root = root or own_folder()
    folder = root / f"copy-{key}"
    with held_lock(folder):
        missing = {name: shape for name, shape in shapes.items() if not (folder / f"{name}.npy").exists()}
        if missing:
            make_room(root, folder)
            parts = {
                name: np.lib.format.open_memmap(folder / f"{name}.part", "w+", dtype, shape) for name, shape in missing.items()
            }
            build(parts)
            for name, part in parts.items():
                part.flush()
                os.replace(folder / f"{name}.part", folder / f"{name}.npy")
        os.utime(folder)
        return {name: np.load(folder / f"{name}.npy", mmap_mode="r") for name in shapes}


@contextmanager
def held_lock(folder: Path):
    """The folder's lock; one that was deleted while we waited for it is left for the new one."""
    while True:
        folder.mkdir(parents=True, exist_ok=True)
        try:
            lock = open(folder / "lock", "a")
        except FileNotFoundError:
            continue
        with lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            try:
                same = os.path.samestat(os.fstat(lock.fileno()), os.stat(folder / "lock"))
            except FileNotFoundError:
                same = False
            if same:
                yield
                return


def make_room(root: Path, but: Path) -> None:
    """Deletes the oldest copies; what workers have mapped stays readable for them."""
    others = sorted((path for path in root.glob("copy-*") if path != but), key=modified, reverse=True)
    for path in others[KEPT_COPIES:]:
        try:
            with open(path / "lock", "a") as lock:
                fcntl.flock(lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
                shutil.rmtree(path, ignore_errors=True)
        except OSError:
            continue  # in use, or already gone


def modified(path: Path) -> float:
    try:
        return path.stat().st_mtime
    except OSError:
        return 0.0

