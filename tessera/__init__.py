"""Multiscale raster analytics on PySpark."""

import logging

from .grid import GridError, Raster, detect
from .plans.levels import Level, Plan, build_plan
from .store import Pyramid, Result, open_pyramid, read_config, to_pyramid
from .serve import serve_page, serve_viewer
from .validate import is_valid, validate
from .viewer import check_store

__all__ = ["GridError", "Level", "Plan", "Pyramid", "Raster", "Result", "build_plan", "check_store", "configure_logging", "detect", "is_valid", "open_pyramid", "read_config", "serve_page", "serve_viewer", "to_pyramid", "validate"]


def configure_logging(level: str = "INFO") -> None:
    """Shows the package's messages from ``level`` on; without it only warnings are seen."""
    logger = logging.getLogger("tessera")
    logger.setLevel(level)
    if not logger.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        logger.addHandler(handler)
