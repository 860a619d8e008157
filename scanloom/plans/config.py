"""Engine settings: defaults, YAML overrides and the checks that stages of one run agree."""

from __future__ import annotations

import dataclasses
import os
import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Settings of a run; flat, so that a YAML section is only a heading."""

    # Names and defaults that runs elsewhere share.
    file_path: str = "data/penthouse_merged.ply"
    gt_dir: str = "data/Area_1"
    units_per_meter: float = 1.0
    up_axis: int = 2
    voxel_m: float = 0.02
    slab_relative_to: str = "ceiling"
    slab_lo_m: float = 0.125
    slab_hi_m: float = 0.5
    ceiling_mode: str = "local_perpoint"
    ceiling_cell_size_m: float = 0.1
    ceiling_min_pts_per_cell: int = 5
    ceiling_smooth_cells: int = 3
    pixel_m: float = 0.03
    min_points_per_cell: int = 3
    thicken_px: int = 1
    use_wallness: bool = False
    wallness_min_span_frac: float = 0.5
    min_wall_area_px: int = 60
    marker_h_m: float = 0.30
    footprint_close_m: float = 1.00
    merge_ridge_m: float = 0.70
    min_room_area_m2: float = 1.0
    drop_empty_rooms: bool = True
    coverage_ceiling_margin_m: float = 0.30
    coverage_min_pts: int = 1
    coverage_close_px: int = 2
    min_coverage_frac: float = 0.25
    use_sam_recall: bool = True
    sam_arch: str = "vit_h"
    sam_ckpt: str = "/content/sam2.1_hiera_large.pt"
    sam_model_cfg: str = "configs/sam2.1/sam2.1_hiera_l.yaml"
    do_buffer_m: float = 0.1
    wall_floor_margin_m: float = 0.10
    wall_ceiling_margin_m: float = 0.10
    ransac_dist_thresh_m: float = 0.02
    ransac_normal_tol_deg: float = 10.0
    ransac_min_inliers: int = 400
    ransac_max_planes: int = 20
    room_erode_m: float | None = 0.125
    wall_dilate_m: float | None = 0.15
    wall_source: str = "wallness"
    sam_backend: str = "sam2"
    sam_image_mode: str = "stack"
    sam_pos_points: int = 8
    sam_use_neg_points: bool = True
    sam_neg_points: int = 4
    sam_conf_thresh: float = 0.88
    sam_wall_frac_max: float = 0.20
    sam_open_ridge_m: float = 0.40
    sam_merge_cover_frac: float = 0.60
    sam_split_min_frac: float = 0.25
    sam_min_sanity_margin: float = -0.02
    sam_refine_qa_cloud: bool = False
    sam_points_per_side: int = 15
    sam_pred_iou_thresh: float = 0.85
    sam_stability_score_thresh: float = 0.95
    sam_crop_n_layers: int = 1
    sam_crop_n_points_downscale_factor: int = 2
    sam_min_mask_region_area: int = 100
    sam_auto_min_room_area_m2: float = 1.5
    sam_auto_min_coverage_frac: float = 0.5
    sam_auto_buffer_rooms: bool = False
    sam_reprocess_residual: bool = False
    sam_residual_points_per_side: int = 5
    normal_radius_m: float = 0.10
    normal_max_nn: int = 30
    normal_tol_deg: float = 15.0
    wseg_angle_tol_deg: float = 10.0
    offset_tol_m: float = 0.20
    min_wall_points: int = 200
    flat_pixel_m: float = 0.04
    flat_min_pts_per_cell: int = 1
    morph_close_px: int = 5
    morph_open_px: int = 3
    density_filter_radius: int = 0
    density_filter_threshold: int = 2
    sor_neighbours: int = 20
    sor_std_ratio: float = 2.0
    wproc_sam_checkpoint: str = "sam_vit_b_01ec64.pth"
    wproc_sam_model_type: str = "vit_b"
    wproc_sam_upscale: int = 4
    wproc_sam_points_per_void: int = 5
    min_void_px: int = 40
    min_rectangularity: float = 0.55
    door_min_width_m: float = 0.50
    door_max_width_m: float = 1.80
    door_min_height_m: float = 1.80
    door_max_height_m: float = 2.80
    door_floor_margin_px: int = 3
    door_max_wall_width_frac: float = 0.85
    window_min_width_m: float = 0.30
    window_max_width_m: float = 2.50
    window_min_height_m: float = 0.30
    window_max_height_m: float = 2.00
    window_min_sill_m: float = 0.30
    ifc_min_directions: int = 2
    ifc_min_wall_length_m: float = 0.3
    ifc_max_wall_length_m: float = 15.0
    ifc_min_wall_aspect_ratio: float = 0.15
    ifc_max_wall_thickness_m: float = 0.40
    ifc_min_wall_fill_ratio: float = 0.15
    ifc_default_thickness: float = 0.15
    ifc_exterior_thickness: float = 0.30
    ifc_max_merge_thickness: float = 0.45
    ifc_dedup_offset_tol: float = 0.45
    ifc_snap_tolerance_m: float = 0.15
    ifc_project_name: str = "Scanned Building"
    ifc_floor_elevation: float = 0.0
    ifc_add_floor_slabs: bool = True
    ifc_slab_thickness: float = 0.2
    bsdd_enrich: bool = False
    bsdd_server_path: str = ""
    bsdd_add_psets: bool = True
    bsdd_add_qtos: bool = True
    bsdd_add_classifications: bool = True
    bsdd_validate_geometry: bool = True
    out_root: str = "scanloom_out"
    out_dir: str = "scanloom_out"

    @property
    def seal_gap_px(self) -> int:
        return 0

    @property
    def min_room_area_px(self) -> int:
        return round(self.min_room_area_m2 / self.pixel_m**2)

    @property
    def do_buffer_px(self) -> int:
        return max(1, round(self.do_buffer_m / self.pixel_m))

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> Config:
        names = {f.name for f in dataclasses.fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in names})


#: Fields on which the stages of a run must agree.
GEOMETRY = ("file_path", "units_per_meter", "up_axis", "voxel_m", "pixel_m", "slab_relative_to", "slab_lo_m", "slab_hi_m")
_PATHS = ("file_path", "gt_dir", "out_root")


def project_root(start: str | None = None, markers: tuple[str, ...] = ("pyproject.toml", "scanloom/__init__.py")) -> str:
    """The nearest folder upwards that holds a marker; the starting folder if none does."""
    here = os.path.abspath(start or os.getcwd())
    at = here
    while not any(os.path.isfile(os.path.join(at, m)) for m in markers):
        if os.path.dirname(at) == at:
            return here
        at = os.path.dirname(at)
    return at


def flattened(tree: dict, where: str = "") -> dict:
    """Leaves of a nested mapping by their last key; KeyError for a leaf that is no setting."""
    known, out = {f.name for f in dataclasses.fields(Config)}, {}
    for key, value in tree.items():
        if isinstance(value, dict):
            out.update(flattened(value, f"{where}{key}."))
        elif key in known:
            out[key] = value
        else:
            raise KeyError(f"unknown setting {where}{key}")
    return out


def load_config(params: str | None = "params.yaml", start: str | None = None, **overrides) -> Config:
    """Defaults, then the YAML file if it exists, then keyword overrides; paths become absolute below the root."""
    root = project_root(start)
    values: dict = {}
    file = params if params is None or os.path.isabs(params) else os.path.join(root, params)
    if file and os.path.isfile(file):
        import yaml

        with open(file, encoding="utf-8") as f:
            values = flattened(yaml.safe_load(f) or {})
    values.update(flattened(overrides))
    config = Config(**values)
    paths = {p: getattr(config, p) for p in _PATHS}
    return dataclasses.replace(config, **{p: os.path.normpath(os.path.join(root, v)) for p, v in paths.items() if v})


def check_upstream(config: Config, upstream: dict, fields: tuple[str, ...] = GEOMETRY) -> None:
    """ValueError if an earlier stage ran with another geometry; of file paths only the file's name counts."""
    name = lambda p: re.split(r"[\\/]", str(p))[-1]
    wrong = []
    for f in fields:
        if f not in upstream:
            continue
        mine, theirs = getattr(config, f), upstream[f]
        if f == "file_path":
            same = name(mine) == name(theirs)
        elif isinstance(mine, (int, float)) and isinstance(theirs, (int, float)):
            same = abs(mine - theirs) <= 1e-9
        else:
            same = mine == theirs
        if not same:
            wrong.append(f"{f}: {theirs!r} upstream, {mine!r} here")
    if wrong:
        raise ValueError("stages disagree: " + "; ".join(wrong))
