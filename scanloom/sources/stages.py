"""Stage folders of a run: tables as Parquet, small documents as JSON, archives; found again by stage name."""

from __future__ import annotations

import json
import os
import zipfile

from pyspark.sql import DataFrame, SparkSession

from ..plans.config import Config

# Names of stages and their documents.
STAGES = ("stage1_occupancy", "stage2_watershed", "stage3_walls", "stage4_sam_refined", "stage5_walls_sam_refined", "stage_sam_auto", "stage_sam_walls", "stage_wall_seg", "stage_wall_proc", "stage_ifc")
CONFIG_JSON, BUILDING_JSON, MODEL = "config.json", "building.json", "model.ifc"


def stage_dir(root: str, stage: str) -> str:
    return os.path.join(root, stage)


def save_table(df: DataFrame, root: str, stage: str, name: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(os.path.join(stage_dir(root, stage), name))


def load_table(spark: SparkSession, root: str, stage: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(find_stage(root, stage), name))


def save_config(root: str, stage: str, config: Config) -> None:
    os.makedirs(stage_dir(root, stage), exist_ok=True)
    with open(os.path.join(stage_dir(root, stage), CONFIG_JSON), "w", encoding="utf-8") as f:
        json.dump(config.to_dict(), f, indent=2)


def stage_config(root: str, stage: str) -> dict:
    with open(os.path.join(find_stage(root, stage), CONFIG_JSON), encoding="utf-8") as f:
        return json.load(f)


def package_stage(root: str, stage: str) -> str:
    """A zip of a stage's folder beside it."""
    path = f"{stage_dir(root, stage)}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in sorted(os.walk(stage_dir(root, stage))):
            for n in sorted(names):
                full = os.path.join(folder, n)
                out.write(full, os.path.relpath(full, stage_dir(root, stage)))
    return path


def find_stage(root: str, stage: str) -> str:
    """The stage's folder if it holds anything, else its unpacked archive, else FileNotFoundError."""
    folder = stage_dir(root, stage)
    if os.path.isdir(folder) and os.listdir(folder):
        return folder
    if os.path.isfile(f"{folder}.zip"):
        with zipfile.ZipFile(f"{folder}.zip") as f:
            f.extractall(folder)
        return folder
    raise FileNotFoundError(f"no stage {stage} in {root}")
