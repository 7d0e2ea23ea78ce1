"""Cases: folders with coarse depths, elevations, true depths and what errors a run of a model should have."""

from __future__ import annotations

import contextlib
import logging
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arrays, metrics, workers
from ..operators.predict import BilinearPredictor
from . import scenes

log = logging.getLogger("gridloom")

#: Fixed: the file that describes a case, and its fields.
SPEC = "case_spec.json"
_SHAPE = "inputs struct<lowres_fp: string, dem_fp: string, truth_fp: string>, expected map<string, struct<params: map<string, string>, metrics: map<string, double>>>, flags map<string, boolean>"
#: Digits after the point to which errors are compared, unless a case says otherwise.
PRECISION = 3


class Outcome(NamedTuple):
    case: str
    run: str
    metrics: dict[str, float]
    agrees: bool | None  # None: nothing is expected


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """case, lowres, dem, truth (paths), flags, run, params and metrics of every run of the cases below a folder.

    A case without inputs or runs raises; one whose run expects no metrics has an empty map.
    """
    text = spark.read.text(f"{folder.rstrip('/')}/*/{SPEC}", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", _SHAPE).alias("spec"))
    home = F.regexp_replace("path", r"/[^/]*$", "")
    whole = F.col("spec.inputs.lowres_fp").isNotNull() & F.col("spec.inputs.dem_fp").isNotNull() & F.col("spec.inputs.truth_fp").isNotNull() & (F.size("spec.expected") > 0)
    sound = text.where(F.assert_true(F.coalesce(whole, F.lit(False)), F.concat(F.col("path"), F.lit(" lacks inputs or runs"))).isNull())
    named = sound.select(F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("case"), *(F.concat_ws("/", home, f"spec.inputs.{k}_fp").alias(k) for k in ("lowres", "dem", "truth")), F.coalesce("spec.flags", F.create_map().cast("map<string, boolean>")).alias("flags"), F.explode("spec.expected").alias("run", "x"))
    empty = lambda kind: F.create_map().cast(f"map<string, {kind}>")
    return named.select("case", "lowres", "dem", "truth", "flags", "run", F.coalesce("x.params", empty("string")).alias("params"), F.coalesce("x.metrics", empty("double")).alias("metrics"))


def agrees(found: dict[str, float], wanted: dict[str, float]) -> bool | None:
    """Whether all wanted errors are met to the digits that ``precision`` among them states."""
    digits = int(wanted.get("precision", PRECISION))
    names = [k for k in wanted if k != "precision"]
    return all(k in found and found[k] is not None and round(found[k], digits) == round(wanted[k], digits) for k in names) if names else None


def run_case(spark: SparkSession, low: str, dem: str, truth: str, params: dict[str, str], model: str | None = None, tile: int | None = None) -> dict[str, float]:
    """Errors of a run against the true depths, which must lie on the elevations' grid, cut to the depths' bounds."""
    number = lambda k: float(params[k]) if params.get(k) else None
    said = scenes.options(model, number("max_depth"), number("dem_pct_clip"))
    placed = scenes.place(spark, scenes.header(spark, low), scenes.header(spark, dem))
    right = scenes.header(spark, truth)
    if (right["height"], right["width"]) != placed.fine[:2] or max(abs(right["c"] - placed.fine.columns.origin), abs(right["f"] - placed.fine.rows.origin)) > scenes.BOUNDS:
        raise ValueError("the true depths don't lie on the elevations' grid within the depths' bounds")
    nominal = max(1, round(placed.ratio))
    with workers.predictor(model, said.scale or nominal, params.get("model_version"), workers.known()) if model else contextlib.nullcontext(BilinearPredictor(nominal)) as predictor:
        side = getattr(predictor, "tile", None) or tile or said.tile or scenes.TILE
        overlap = 0 if params.get("window_method") == "hard" else int(params.get("tile_overlap") or side // 4)
        scene = scenes.super_resolve(spark, low, dem, placed, predictor, side, overlap, said.max_depth, said.percent)
        est = arrays.cells_of(scene, "est")
        ref = scenes.read(spark, truth, 0, 0, *placed.fine[:2]).select("r", "c", F.coalesce("value", F.lit(0.0)).alias("ref"))
        row = metrics.error_metrics(ref.join(est, ["r", "c"]), "ref", "est", said.max_depth).first()
    return row.asDict()


def run_all(spark: SparkSession, folder: str, model: str | None = None, tile: int | None = None) -> list[Outcome]:
    """Every run of the cases below a folder, one after the other; each is a Spark job over its whole rasters."""
    out = []
    for x in catalogue(spark, folder).orderBy("case", "run").toLocalIterator():
        found = run_case(spark, x.lowres, x.dem, x.truth, x.params, model, tile)
        out.append(Outcome(x.case, x.run, found, agrees(found, x.metrics)))
    return out
