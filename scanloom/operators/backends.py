"""Segmentation models behind the protocols of `segmenters`, loaded on first use in the process that runs them.

Neither the models' packages nor weights come with this one. A `Lazy...` object carries the settings only, so it is
pickled to the executors, and each Python worker there loads the model once.
"""

from __future__ import annotations

import importlib
import importlib.util
from dataclasses import dataclass

import numpy as np

from ..plans.config import Config

#: Packages of the back ends, and the classes for prompts and for whole pictures, as module:name.
BACKENDS = {
    "sam1": ("segment_anything", "segment_anything:SamPredictor", "segment_anything:SamAutomaticMaskGenerator"),
    "sam2": ("sam2", "sam2.sam2_image_predictor:SAM2ImagePredictor", "sam2.automatic_mask_generator:SAM2AutomaticMaskGenerator"),
    "sam3": ("sam3", "sam3.sam3_image_predictor:SAM3ImagePredictor", "sam3.automatic_mask_generator:SAM3AutomaticMaskGenerator"),
}
_loaded: dict = {}


def package_of(config: Config) -> str:
    """The configured back end's package; ValueError for an unknown name, ModuleNotFoundError if it is not installed."""
    if config.sam_backend not in BACKENDS:
        raise ValueError(f"unknown segmenter {config.sam_backend!r}; known: {sorted(BACKENDS)}")
    package = BACKENDS[config.sam_backend][0]
    if importlib.util.find_spec(package) is None:
        raise ModuleNotFoundError(f"the segmenter {config.sam_backend!r} needs the package {package!r}", name=package)
    return package


def _named(place: str):
    module, name = place.split(":")
    return getattr(importlib.import_module(module), name)


def _weights(config: Config, checkpoint: str, architecture: str):
    """The bare model on the GPU if there is one."""
    package_of(config)
    import torch

    device = "cuda" if torch.cuda.is_available() else "cpu"
    if config.sam_backend == "sam1":
        return _named("segment_anything:sam_model_registry")[architecture](checkpoint=checkpoint).to(device)
    build = _named(f"{config.sam_backend}.build_sam:build_{config.sam_backend}")
    return build(config.sam_model_cfg, checkpoint, device=device)


def generator_settings(config: Config, points_per_side: int | None = None) -> dict:
    """Keyword arguments of an automatic generator."""
    whole = ("points_per_side", "crop_n_layers", "crop_n_points_downscale_factor", "min_mask_region_area")
    shares = ("pred_iou_thresh", "stability_score_thresh")
    out = {n: int(getattr(config, f"sam_{n}")) for n in whole} | {n: float(getattr(config, f"sam_{n}")) for n in shares}
    return out if points_per_side is None else out | {"points_per_side": points_per_side}


class PromptAdapter:
    """A prompted predictor that returns (masks, scores, low-resolution masks), as a `PromptedSegmenter`."""

    def __init__(self, predictor, name: str = "sam"):
        self.predictor, self.name = predictor, name

    def set_image(self, image: np.ndarray) -> None:
        self.predictor.set_image(np.asarray(image))

    def predict(self, point_coords=None, point_labels=None, box=None, multimask_output=True):
        typed = lambda v, kind: None if v is None else np.asarray(v, kind)
        masks, scores, *_ = self.predictor.predict(point_coords=typed(point_coords, float), point_labels=typed(point_labels, int), box=typed(box, float), multimask_output=multimask_output)
        return np.asarray(masks, bool), np.asarray(scores, float)


class AutomaticAdapter:
    """A generator of masks for whole pictures as an `AutomaticSegmenter`."""

    def __init__(self, generator, name: str = "sam-auto"):
        self.generator, self.name = generator, name

    def generate(self, image: np.ndarray) -> list[dict]:
        return self.generator.generate(np.asarray(image))


@dataclass(frozen=True)
class LazyPrompted:
    """The configured prompted segmenter; `walls` takes the weights that are set for wall pictures."""

    config: Config
    walls: bool = False

    def _model(self) -> PromptAdapter:
        c = self.config
        checkpoint, architecture = (c.wproc_sam_checkpoint, c.wproc_sam_model_type) if self.walls else (c.sam_ckpt, c.sam_arch)
        key = ("prompted", c.sam_backend, checkpoint, architecture)
        if key not in _loaded:
            _loaded[key] = PromptAdapter(_named(BACKENDS[c.sam_backend][1])(_weights(c, checkpoint, architecture)), c.sam_backend)
        return _loaded[key]

    def set_image(self, image: np.ndarray) -> None:
        self._model().set_image(image)

    def predict(self, *args, **settings):
        return self._model().predict(*args, **settings)


@dataclass(frozen=True)
class LazyAutomatic:
    config: Config
    points_per_side: int | None = None

    def generate(self, image: np.ndarray) -> list[dict]:
        c = self.config
        key = ("automatic", c.sam_backend, c.sam_ckpt, self.points_per_side)
        if key not in _loaded:
            model = _weights(c, c.sam_ckpt, c.sam_arch)
            _loaded[key] = AutomaticAdapter(_named(BACKENDS[c.sam_backend][2])(model, **generator_settings(c, self.points_per_side)), f"{c.sam_backend}-auto")
        return _loaded[key].generate(image)


def prompted(config: Config, *, walls: bool = False) -> LazyPrompted:
    """The configured prompted segmenter; raises at once if it is unknown or not installed."""
    package_of(config)
    return LazyPrompted(config, walls)


def automatic(config: Config) -> tuple[LazyAutomatic, LazyAutomatic]:
    """The configured automatic segmenter, and that of the residual with its own density of points."""
    package_of(config)
    return LazyAutomatic(config), LazyAutomatic(config, config.sam_residual_points_per_side)
