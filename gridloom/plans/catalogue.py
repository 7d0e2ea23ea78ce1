"""Every registered raster query and its oracle."""

from . import control, depths, growths, places, scales, streams, windows
from .relations import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "control", "depths", "growths", "places", "scales", "streams", "windows"]
