"""Settings of a run, from a mapping or a YAML file."""

from __future__ import annotations

import multiprocessing
import os
import time
from pathlib import Path
from typing import Any

import yaml
from pydantic import BaseModel, ConfigDict, Field, NonNegativeFloat, NonNegativeInt, PositiveInt, ValidationError

from wobble.errors import ConfigError
from wobble.operators.embed import OutlierRule
from wobble.types import AnalysisMode, EmbeddingAlgorithm, FileFormat

#: Settings of the external program that are done natively, with what they may be; others are refused rather than ignored.
NATIVE_SETTINGS = {"numoutlieriter": lambda v: int(v) == float(v) >= 0, "numoutlierevec": lambda v: int(v) == float(v) >= 1, "outliersigmathresh": lambda v: float(v) > 0}


class RunConfig(BaseModel):
    """Unknown keys are errors. Times and processor counts are read when a config is made. convertf and smartpca are accepted and unused: conversion and embedding are native."""

    model_config = ConfigDict(extra="forbid")

    dataset_prefix: str
    result_dir: str
    file_format: FileFormat = FileFormat.EIGENSTRAT
    convertf: str = "convertf"
    n_replicates: NonNegativeInt = 100
    keep_replicates: bool = False
    bootstrap_convergence_check: bool = True
    bootstrap_convergence_tolerance: NonNegativeFloat = 0.05
    n_components: NonNegativeInt = 10
    embedding_algorithm: EmbeddingAlgorithm = EmbeddingAlgorithm.PCA
    smartpca: str = "smartpca"
    smartpca_optional_settings: dict[str, Any] | None = None
    embedding_populations: str | None = None
    support_value_rogue_cutoff: float = 0.5
    kmeans_k: int | None = None
    analysis_mode: AnalysisMode = AnalysisMode.BOOTSTRAP
    redo: bool = False
    seed: int = Field(default_factory=lambda: int(time.time()))
    threads: PositiveInt = Field(default_factory=multiprocessing.cpu_count)
    result_decimals: NonNegativeInt = 2
    verbosity: int = 1
    plot_results: bool = False
    plot_dim_x: NonNegativeInt = 0
    plot_dim_y: NonNegativeInt = 1

    def path(self, name: str) -> str:
        return os.path.join(self.result_dir, name)

    def as_mapping(self) -> dict[str, Any]:
        """Plain values, paths absolute."""
        out = self.model_dump(mode="json")
        for k in ("dataset_prefix", "result_dir", "embedding_populations"):
            if out[k] is not None and "://" not in out[k]:
                out[k] = os.path.abspath(out[k])
        return out

    def check_settings(self) -> None:
        for k, v in (self.smartpca_optional_settings or {}).items():
            try:
                fits = k in NATIVE_SETTINGS and not isinstance(v, bool) and NATIVE_SETTINGS[k](v)
            except (TypeError, ValueError):
                fits = False
            if not fits:
                raise ConfigError(f"The setting {k}: {v} isn't supported.")

    def outlier_rule(self) -> OutlierRule:
        """Outlier removal of the PCA: on, with its usual numbers, unless settings say otherwise."""
        given = self.smartpca_optional_settings or {}
        usual = OutlierRule()
        return OutlierRule(int(given.get("numoutlieriter", usual.rounds)), int(given.get("numoutlierevec", usual.axes)), float(given.get("outliersigmathresh", usual.sigma)))


def load_config(path: str | Path) -> RunConfig:
    """A YAML file; enum values in any case."""
    try:
        raw = yaml.safe_load(Path(path).read_text())
    except (OSError, yaml.YAMLError) as e:
        raise ConfigError(f"{path} can't be read: {e}") from e
    if not isinstance(raw, dict):
        raise ConfigError(f"{path} holds no settings.")
    for k in ("dataset_prefix", "result_dir"):
        if not raw.get(k):
            raise ConfigError(f"No {k} set.")
    for k in ("file_format", "embedding_algorithm", "analysis_mode"):
        if isinstance(raw.get(k), str):
            raw[k] = raw[k].upper()
    try:
        return RunConfig(**raw)
    except ValidationError as e:
        raise ConfigError("; ".join(f"{'.'.join(map(str, x['loc']))}: {x['msg']}" for x in e.errors())) from e
