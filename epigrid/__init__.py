"""Spatiotemporal surveillance analytics on PySpark DataFrames."""

from __future__ import annotations

import os
from pathlib import Path


def importable(spark) -> None:
    """Lets Python workers find this package where the driver has it, whatever folder they
    start in. On a cluster without that folder, --py-files ships the package as usual."""
    root, environment = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    have = environment.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
