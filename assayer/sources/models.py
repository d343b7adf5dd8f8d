"""Trained models as tables: IO-MODEL, IO-SCORES and the bundle of A-BUNDLE."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.operators.features import Scaler
from assayer.operators.forest import ForestModel
from assayer.operators.reconstruct import AutoencoderConfig, AutoencoderModel
from assayer.session import file_system, read_text, small_table, write_text

_PARAMETERS = "part string, settings string, numbers array<double>"


_MANIFEST = "manifest.json"


class ModelMissing(FileNotFoundError):
    """No trained model in the folder."""


class ModelDamaged(ValueError):
    """A part of a saved model is missing or was changed."""


@dataclass
class ModelBundle:
    """What it takes to score a new batch the way the models were trained."""

    scaler: Scaler
    autoencoder: AutoencoderModel
    forest: ForestModel | None = None
    calibration: DataFrame | None = None  # model, score


def _parts(bundle: ModelBundle) -> dict[str, tuple[list[tuple], str]]:
    """The model's tables, as rows and schema."""
    ae = bundle.autoencoder
    rows = [
        ("scaler", json.dumps(asdict(bundle.scaler)), []),
        ("autoencoder", json.dumps(ae.settings()), [float(v) for v in ae.flat]),
    ]
    parts = {}
    if bundle.forest is not None:
        f = bundle.forest
        rows.append(("forest", json.dumps({"sample": f.sample, "depth": f.depth}), []))
        trees = [(i, bytes(a.tobytes()), bytes(b.tobytes()), bytes(c.tobytes()))
                 for i, (a, b, c) in enumerate(zip(f.feature, f.threshold, f.path))]
        parts["trees"] = trees, "tree int, feature binary, threshold binary, path binary"
    return parts | {"parameters": (rows, _PARAMETERS)}


def _digest(rows: list[tuple]) -> str:
    held = hashlib.sha256()
    for row in sorted(rows, key=lambda r: r[0]):
        for cell in row:
            held.update(bytes(cell) if isinstance(cell, (bytes, bytearray)) else repr(cell).encode())
    return held.hexdigest()


def save_bundle(spark: SparkSession, bundle: ModelBundle, folder: str) -> str:
    """Write a new version beside earlier ones and return its folder.

    A version counts once its manifest is there, which is written last: a reader sees a
    whole model or the one before, also while a save is under way or after it failed.
    """
    version = f"{folder}/version-{max(_versions(spark, folder), default=0) + 1:06d}"
    manifest: dict[str, dict] = {}
    for name, (rows, schema) in _parts(bundle).items():
        small_table(spark, rows, schema).write.parquet(f"{version}/{name}")
        manifest[name] = {"rows": len(rows), "digest": _digest(rows)}
    if bundle.calibration is not None:
        write_scores(bundle.calibration, f"{version}/calibration_scores")
        manifest["calibration_scores"] = {"rows": spark.read.parquet(f"{version}/calibration_scores").count()}
    write_text(spark, f"{version}/{_MANIFEST}", json.dumps({"format": 1, "parts": manifest}, indent=2))
    return version


def _versions(spark: SparkSession, folder: str, whole: bool = False) -> list[int]:
    """Version numbers in a model folder, on request only those with a manifest."""
    system, path = file_system(spark, folder)
    if not system.exists(path):
        return []
    found = [re.fullmatch(r"version-(\d+)", s.getPath().getName()) for s in system.listStatus(path)]
    numbers = [int(m.group(1)) for m in found if m]
    return [n for n in numbers if not whole or system.exists(file_system(spark, f"{folder}/version-{n:06d}/{_MANIFEST}")[1])]


def bundle_available(spark: SparkSession, folder: str) -> bool:
    return bool(_versions(spark, folder, whole=True))


def _checked(spark: SparkSession, version: str, name: str, stated: dict) -> list:
    rows = spark.read.parquet(f"{version}/{name}").collect()  # a model's parameters, not data
    if len(rows) != stated["rows"] or _digest([tuple(r) for r in rows]) != stated["digest"]:
        raise ModelDamaged(f"{version}/{name} is not what its manifest says")
    return rows


def load_bundle(spark: SparkSession, folder: str) -> ModelBundle:
    """The latest whole version in a folder, its parts checked against the manifest."""
    versions = _versions(spark, folder, whole=True)
    if not versions:
        raise ModelMissing(f"No trained model found in {folder}; train one and save it there first.")
    version = f"{folder}/version-{max(versions):06d}"
    stated = json.loads(read_text(spark, f"{version}/{_MANIFEST}"))["parts"]
    parts = {r["part"]: r for r in _checked(spark, version, "parameters", stated["parameters"])}
    scaler = Scaler(**{k: tuple(v) for k, v in json.loads(parts["scaler"]["settings"]).items()})
    settings = json.loads(parts["autoencoder"]["settings"])
    width, best = settings.pop("width"), settings.pop("best_epoch")
    settings["hidden"] = tuple(settings["hidden"])
    ae = AutoencoderModel(np.array(parts["autoencoder"]["numbers"]), width, AutoencoderConfig(**settings), best)
    forest = None
    if "forest" in parts:
        trees = sorted(_checked(spark, version, "trees", stated["trees"]), key=lambda t: t["tree"])
        shape = json.loads(parts["forest"]["settings"])
        forest = ForestModel(*[np.stack([np.frombuffer(t[n], dtype=d) for t in trees]) for n, d in (
            ("feature", np.int16), ("threshold", np.float64), ("path", np.float32))], shape["sample"], shape["depth"])
    calibration = None
    if "calibration_scores" in stated:
        calibration = spark.read.parquet(f"{version}/calibration_scores")
        if calibration.count() != stated["calibration_scores"]["rows"]:
            raise ModelDamaged(f"{version}/calibration_scores is not what its manifest says")
    return ModelBundle(scaler, ae, forest, calibration)


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").parquet(path)


def calibration_scores(bundle: ModelBundle, model: str) -> DataFrame | None:
    """The saved calibration scores of one model, or nothing when there are none."""
    if bundle.calibration is None:
        return None
    mine = bundle.calibration.filter(F.col("model") == model).select("score")
    return None if mine.isEmpty() else mine
