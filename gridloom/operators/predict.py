"""Models over tiles: a predictor is loaded once in each Python worker and fed Arrow batches of tiles."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Predictor(Protocol):
    """``load`` runs once in a worker; ``run`` maps coarse depths and fine elevations of tiles to fine depths, all 0 to 1."""

    scale: int

    def load(self) -> None: ...

    def run(self, depth: np.ndarray, dem: np.ndarray) -> np.ndarray: ...


@dataclass
class BilinearPredictor:
    """The deterministic baseline: bilinear interpolation of the coarse depths, blind to the terrain."""

    scale: int

    def load(self) -> None:
        pass

    def run(self, depth: np.ndarray, dem: np.ndarray) -> np.ndarray:
        n = depth.shape[1]
        place = np.clip((np.arange(n * self.scale) + 0.5) / self.scale - 0.5, 0, n - 1)
        low = np.minimum(np.floor(place).astype(int), max(n - 2, 0))
        part = place - low
        high = np.minimum(low + 1, n - 1)
        rows = depth[:, low] * (1 - part)[None, :, None] + depth[:, high] * part[None, :, None]
        return rows[:, :, low] * (1 - part) + rows[:, :, high] * part


@dataclass
class OnnxPredictor:
    """An ONNX network with two inputs (coarse depth, fine elevation; NHWC, one channel) and one output.

    The file must be readable on every executor (``SparkContext.addFile`` or a shared path).
    """

    path: str
    scale: int
    providers: tuple[str, ...] = ("CPUExecutionProvider",)
    _session: object = field(default=None, repr=False)

    @classmethod
    def of(cls, path: str, **more) -> OnnxPredictor:
        """The predictor of a file at the file's own scale."""
        from ..sources.onnx import scale_of

        return cls(path, scale_of(path)[1], **more)

    @property
    def tile(self) -> int:
        """Side of the coarse input."""
        from ..sources.onnx import scale_of

        return scale_of(self.path)[0]

    def load(self) -> None:
        import onnxruntime

        if missing := set(self.providers) - set(onnxruntime.get_available_providers()):
            raise ValueError(f"no such provider here: {', '.join(sorted(missing))}")
        self._session = onnxruntime.InferenceSession(self.path, providers=list(self.providers))
        inputs = sorted(self._session.get_inputs(), key=lambda i: i.shape[1])
        if len(inputs) != 2 or any(len(i.shape) != 4 or i.shape[3] != 1 for i in inputs):
            raise ValueError("a model takes two tensors of rank 4 with one channel")
        low, high = (i.shape[1] for i in inputs)
        if high % low or high // low != self.scale:
            raise ValueError(f"the model's scale is {high / low}, not {self.scale}")
        self._names = [i.name for i in inputs]

    def run(self, depth: np.ndarray, dem: np.ndarray) -> np.ndarray:
        feed = dict(zip(self._names, (depth[..., None].astype(np.float32), dem[..., None].astype(np.float32)), strict=True))
        return self._session.run(None, feed)[0][..., 0]


def gather_tiles(cells: DataFrame, value: str, side: int, keys: tuple[str, ...] = ("y0", "x0")) -> DataFrame:
    """Window cells (keys, i, j, value) as tiles with flat row-major pixels; a tile must be whole."""
    pixels = F.transform(F.array_sort(F.collect_list(F.struct((F.col("i") * side + F.col("j")).alias("k"), F.col(value).alias("v")))), lambda x: x["v"])
    grouped = cells.groupBy(*keys).agg(pixels.alias(value))
    whole = F.assert_true(F.size(value) == side * side, F.lit(f"a tile of {side} x {side} has gaps"))
    return grouped.where(whole.isNull())


def predict_tiles(tiles: DataFrame, predictor: Predictor, depth: str, dem: str, side: int) -> DataFrame:
    """``tiles`` (any keys, coarse ``depth`` of side x side, fine ``dem``) with the flat prediction ``px`` instead.

    Values must be finite and 0 to 1; a tile that isn't fails the job, as do tiles of another size.
    """
    keys = [f for f in tiles.schema if f.name not in (depth, dem)]
    fine = side * predictor.scale

    def run(batches):
        predictor.load()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            low, high = (np.stack([np.asarray(x, np.float64) for x in batch[c].to_pylist()]) for c in (depth, dem))
            if low.shape[1] != side * side or high.shape[1] != fine * fine:
                raise ValueError(f"tiles of {low.shape[1]} and {high.shape[1]} pixels; the model takes {side * side} and {fine * fine}")
            for x in (low, high):
                if not np.isfinite(x).all() or x.min() < 0 or x.max() > 1:
                    raise ValueError("tile values must be finite and from 0 to 1")
            out = predictor.run(low.reshape(n, side, side), high.reshape(n, fine, fine)).reshape(n, -1)
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in keys), pa.array(list(out.astype(np.float64)), pa.list_(pa.float64()))], [*(f.name for f in keys), "px"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keys) + "px array<double>"
    return tiles.mapInArrow(run, schema)
