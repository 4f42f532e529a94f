"""Configuration as nested dictionaries: defaults, overrides, run contracts."""

from __future__ import annotations

import json
from pathlib import Path

DEFAULTS: dict = {
    "study": {"start": "2024-01-01", "end": "2024-12-31"},
    "thinning": {"enabled": True, "seed": 1},
    "censoring": {"cutoff_year": 9999, "cutoff_week": 1},
    "holdout": {"fraction": 0.1, "seed": 1},
    "zero_count_policy": "retain",
    "bins": 22,
    "extraction": {"radius_km": 75.0},
    "mask": {"temperature": 16.0},
    "persistence": {"quantile": 0.10, "days_per_layer": 7, "generation_days": 21},
}


def merged(base: dict, over: dict) -> dict:
    """base with over on top, nested dictionaries merged key by key."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def configured(over: dict | None = None) -> dict:
    """Defaults with overrides; unknown sections and impossible values are errors."""
    cfg = merged(DEFAULTS, over or {})
    unknown = set(cfg) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown sections {sorted(unknown)}")
    if not 0 < cfg["holdout"]["fraction"] <= 1 or cfg["zero_count_policy"] not in ("retain", "exclude") or cfg["study"]["start"] > cfg["study"]["end"]:
        raise ValueError("holdout.fraction, zero_count_policy or study is out of range")
    return cfg


def read_config(path: str) -> dict:
    """A JSON file (or YAML, where its reader is installed), over the defaults."""
    text = Path(path).read_text()
    if path.endswith((".yml", ".yaml")):
        import yaml

        return configured(yaml.safe_load(text) or {})
    return configured(json.loads(text))


def contract_differences(old: dict, new: dict, keys: tuple[str, ...]) -> list[str]:
    """Which of the keys differ between two run contracts, missing ones included."""
    return [k for k in keys if old.get(k) != new.get(k)]


def resume_stage(done: dict[str, bool], order: tuple[str, ...]) -> str | None:
    """The first stage that is not done; none when all are."""
    return next((s for s in order if not done.get(s)), None)


def dimension_contract(grid, temporal, groups: tuple[str, ...] = ("timestep_2wk", "quarter_index", "sixmo_index", "year_index")):
    """One row of what a run's tables are made of: weeks, cells, rows, rows expected, first and
    last week, levels of each group, and whether all of it adds up."""
    from pyspark.sql import functions as F

    from ..functions.timeidx import week_label

    label = week_label("epiyear", "epiweek")
    one = grid.agg(F.count_distinct("epiyear", "epiweek").alias("modeled_weeks"), F.count_distinct("cell_id").alias("supported_cells"), F.count(F.lit(1)).alias("prediction_rows"), F.min(label).alias("horizon_start"), F.max(label).alias("horizon_end"))
    levels = temporal.agg(*[F.count_distinct(g).alias(g) for g in groups], *[F.max(g).alias(f"_max_{g}") for g in groups], *[F.min(g).alias(f"_min_{g}") for g in groups])
    out = one.crossJoin(F.broadcast(levels)).withColumn("expected_prediction_rows", F.col("modeled_weeks") * F.col("supported_cells"))
    good = F.col("expected_prediction_rows") == F.col("prediction_rows")
    for g in groups:
        good = good & (F.col(f"_min_{g}") == 1) & (F.col(f"_max_{g}") == F.col(g))
    return out.select("modeled_weeks", "supported_cells", "prediction_rows", "expected_prediction_rows", "horizon_start", "horizon_end", *groups, good.alias("reconciled"))


def support_summary(predictions, policy: str, level: str = "admin", flag: str = "unseen"):
    """One row: levels, rows, cells and weeks whose level has no effect, under a policy
    ("fail" raises when there are any, "zero_mean" gave them zero)."""
    from pyspark.sql import functions as F

    if policy not in ("fail", "zero_mean"):
        raise ValueError(f"unknown policy {policy}")
    hit = F.col(flag)
    when = lambda *c: [F.when(hit, F.col(x)) for x in c]
    out = predictions.agg(F.count_distinct(*when(level)).alias("levels"), F.count(F.when(hit, 1)).alias("rows"), F.count_distinct(*when("cell_id")).alias("cells"), F.count_distinct(F.when(hit, F.struct("epiyear", "epiweek"))).alias("weeks"))
    if policy == "fail" and out.first()["levels"]:
        raise ValueError("levels without an effect")
    return out.withColumn("policy", F.lit(policy))


def run_id(stored: str | None, supplied: str | None) -> tuple[str | None, bool]:
    """The execution id of a resumed run, and whether it was only now bound; two that differ
    are an error."""
    clean = lambda x: (x or "").strip() or None
    stored, supplied = clean(stored), clean(supplied)
    if stored and supplied and stored != supplied:
        raise ValueError(f"the run has id {stored}, not {supplied}")
    return stored or supplied, not stored and supplied is not None
