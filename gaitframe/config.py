"""Configuration of a run: fixed defaults, checked overrides, and a digest of what decides results."""

from __future__ import annotations

import copy
import hashlib
import json

from .errors import ConfigError

#: The sections and their defaults. Names and values are what a digest is taken over.
DEFAULTS: dict = {
    "species_profile": None, "species_profile_version": None, "dataset_name": None, "dataset_version": None, "models": {}, "seed": 0, "feature_set_version": "0",
    "event_schema_version": "1",
    "ingest": {"frame_stride": 1, "max_frames": None, "unreliable_timestamp_policy": "flag", "decode_backend": "opencv"},
    "perception": {
        "detection_threshold": 0.25, "detection_low_confidence_threshold": 0.50, "pose_low_confidence_threshold": 0.50, "keypoint_visibility_threshold": 0.30,
        "detector_backend": "ultralytics", "pose_backend": "ultralytics", "max_track_gap_frames": 15, "min_track_iou": 0.20, "occlusion_gap_frames": 3, "device": "auto", "batch_size": 8,
    },
    "identity": {
        "confidence_floor": 0.60, "anchor_window_tolerance_seconds": 2.0, "reid_similarity_floor": 0.55, "reid_margin_floor": 0.0, "region_agreement_ratio": 0.90, "reid_embedding_dim": 128,
    },
    "phenotype": {
        "boundary_axis": "y", "entry_boundary": 0.20, "exit_boundary": 0.80, "min_pass_frames": 8, "max_reduced_quality_fraction": 0.40, "min_usable_features": 3, "accept_partial_passes": False,
    },
    "baseline": {"lookback_days": 21, "min_observations": 5, "herd_window_days": 3, "herd_min_animals": 3, "risk_scale": "robust_z"},
    "events": {
        "threshold_policy_name": "p0-default", "threshold_policy_version": "1", "alert_threshold": 3.0, "watch_threshold": 2.0, "clip_seconds_before": 3.0, "clip_seconds_after": 3.0,
        "masking_mode": "blur", "export_adapter": "file",
    },
    "evaluation": {"split_kind": "animal", "test_fraction": 0.30, "detection_iou_threshold": 0.50, "keypoint_distance_threshold": 0.10},
    "run": {"output_root": "data/runs", "weights_root": "weights", "workers": 1, "log_level": "INFO"},
    "notes": "",
}
REQUIRED = ("species_profile", "species_profile_version", "dataset_name", "dataset_version")
#: What does not decide results.
IMMATERIAL = {("perception", "device"), ("perception", "batch_size"), ("run", "output_root"), ("run", "weights_root"), ("run", "workers"), ("run", "log_level"), ("notes",)}
MODEL = {"name": None, "version": None, "task": None, "weights_uri": "", "weights_sha256": "", "licence": "unknown", "placeholder": False, "placeholder_reason": ""}
BACKENDS = {"detector_backend": ("ultralytics", "intensity-blob", "injected"), "pose_backend": ("ultralytics", "none", "injected")}


def resolved(overrides: dict) -> dict:
    """All values of a configuration; unknown names, missing models' fields and unknown back-ends are refused."""
    out = copy.deepcopy(DEFAULTS)
    for name, value in overrides.items():
        if name not in DEFAULTS:
            raise ConfigError(f"malformed configuration: unknown {name!r}")
        if name == "models":
            for role, spec in (value or {}).items():
                if set(spec) - set(MODEL) or any(k not in spec for k in ("name", "version", "task")):
                    raise ConfigError(f"malformed model identity of {role!r}")
                out["models"][role] = MODEL | spec
        elif isinstance(DEFAULTS[name], dict):
            if unknown := sorted(set(value or {}) - set(DEFAULTS[name])):
                raise ConfigError(f"malformed configuration: unknown {name}.{unknown[0]}")
            out[name] |= value or {}
        else:
            out[name] = value
    for name in REQUIRED:
        if out[name] in (None, ""):
            raise ConfigError(f"malformed configuration: {name} is missing")
    for name, known in BACKENDS.items():
        if out["perception"][name] not in known:
            raise ConfigError(f"unknown {name} {out['perception'][name]!r}; expected one of {', '.join(known)}")
    return out


def from_yaml(text: str) -> dict:
    import yaml

    loaded = yaml.safe_load(text) or {}
    if not isinstance(loaded, dict):
        raise ConfigError("expected a mapping at the top level")
    return resolved(loaded)


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; sets become sorted lists."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=lambda x: sorted(x) if isinstance(x, (set, frozenset)) else str(x))


def material(config: dict) -> dict:
    """The part of a configuration that decides results; an empty section stays as one."""

    def kept(value, path: tuple):
        return {k: kept(v, (*path, k)) for k, v in value.items() if (*path, k) not in IMMATERIAL} if isinstance(value, dict) else value

    return kept(config, ())


def digest(config: dict) -> str:
    """SHA-256 of the canonical material part."""
    return hashlib.sha256(canonical(material(config)).encode()).hexdigest()
