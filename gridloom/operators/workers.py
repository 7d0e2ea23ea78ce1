"""Workers: functions that turn a model's file into a predictor, registered under the model's version.

A worker is a function of a file's path and of the number of fine cells a coarse one has, decorated with
``worker(version)``; the predictor it returns may run at another scale, its own. Modules that register workers are named
as entry points of the group ``gridloom.workers`` by installed packages, or lie in folders. On a cluster they must reach
the executors too (``SparkContext.addPyFile``).
"""

from __future__ import annotations

import contextlib
import importlib.metadata
import os
import runpy
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

from .predict import OnnxPredictor, Predictor

Maker = Callable[[str, int], Predictor]

#: Group of entry points, and the environment's list of folders.
ENTRY_POINTS, FOLDERS = "gridloom.workers", "GRIDLOOM_WORKERS"

_made: dict[str, Maker] = {}


def worker(version: str) -> Callable[[Maker], Maker]:
    """Registers the decorated function for a model's version; a later one for the same version replaces it."""
    if not version.strip():
        raise ValueError("a worker needs a model's version")

    def add(make: Maker) -> Maker:
        if not callable(make):
            raise TypeError(f"the worker of {version} can't be called")
        _made[version] = make
        return make

    return add


def known(folders: Iterable[str | os.PathLike] | None = None) -> dict[str, Maker]:
    """All registered workers by version, those of entry points and of modules in ``folders`` (default: the environment's) included."""
    for point in importlib.metadata.entry_points(group=ENTRY_POINTS):
        point.load()
    given = os.environ.get(FOLDERS, "").split(os.pathsep) if folders is None else folders
    for folder in filter(None, given):
        for module in sorted(Path(folder).glob("*.py")):
            runpy.run_path(str(module), run_name=module.stem)
    return dict(_made)


def onnx(path: str, scale: int) -> Predictor:
    """The worker of models without one: an ONNX network with two inputs, at its own scale."""
    return OnnxPredictor.of(path)


@contextlib.contextmanager
def predictor(path: str | os.PathLike, scale: int, version: str | None = None, workers: dict[str, Maker] | None = None) -> Iterator[Predictor]:
    """The predictor of a model's file; its ``close``, if it has one, is called in the end."""
    file = Path(path).expanduser()
    if not file.is_file():
        raise FileNotFoundError(f"no model file at {file}")
    made = (workers or {}).get(version or "", onnx)(str(file.resolve()), scale)
    with contextlib.ExitStack() as stack:
        if hasattr(made, "close"):
            stack.callback(made.close)
        yield made
