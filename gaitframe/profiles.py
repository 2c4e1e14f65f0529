"""Species profiles: a skeleton, a feature set, weights; loading, checks and audits. Profiles are few and stay on the driver."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .errors import ProfileError, UndeclaredFeatureError, UnimplementedFeatureError, ViewMismatchError

#: Features with an implementation (see operators.passes), by the function that computes them.
IMPLEMENTED = {
    "speed": "motion_features", "speed_variability": "motion_features", "lateral_sway": "motion_features", "tracking_jitter": "motion_features", "head_lateral_offset": "motion_features",
    "head_bob": "motion_features", "spine_lateral_curvature": "curvature", "stride_length": "stride_features", "stride_length_front": "stride_features",
    "stride_length_back": "stride_features", "step_asymmetry_front": "stride_features", "step_asymmetry_back": "stride_features", "stride_frequency_front": "stride_frequency",
    "stride_frequency_back": "stride_frequency",
}
FEATURE = {"unit": "", "description": "", "depends_on": [], "higher_is_worse": True, "view": "", "available": True, "unavailable_reason": "", "requires_sampling_hz": 0.0}
RUNTIMES = ("ultralytics",)


def checked(data: dict, where: str = "profile") -> dict:
    """A profile with all defaults; refused where a key is missing or a feature depends on a point the skeleton lacks."""

    def need(part: dict, key: str, at: str):
        if key not in part:
            raise ProfileError(f"{at}: missing required key {key!r}")
        return part[key]

    skeleton, features = need(data, "skeleton", where), need(data, "feature_set", where)
    points = [{"index": i, **p} for i, p in enumerate(need(skeleton, "keypoints", f"{where}.skeleton"))]
    points = sorted(points, key=lambda p: p["index"])
    names = [need(p, "name", f"{where}.skeleton.keypoints") for p in points]
    out = {
        "species": need(data, "species", where), "version": str(need(data, "version", where)), "default": bool(data.get("default", False)),
        "skeleton": {
            "identifier": need(skeleton, "identifier", f"{where}.skeleton"), "version": str(need(skeleton, "version", f"{where}.skeleton")), "view": skeleton.get("view", "unspecified"),
            "roles": dict(skeleton.get("roles") or {}), "keypoints": points, "names": names,
        },
        "feature_set": {"version": str(need(features, "version", f"{where}.feature_set")), "features": [FEATURE | f for f in need(features, "features", f"{where}.feature_set")]},
        "weights": {role: {"licence": "", "runtime": "ultralytics", "placeholder": False, "placeholder_reason": "", **w} for role, w in (need(data, "weights", where) or {}).items()},
        "priors": dict(data.get("priors") or {}), "anchors": dict(data.get("anchors") or {}),
    }
    lost = sorted({d for f in out["feature_set"]["features"] for d in f["depends_on"]} - set(names))
    if lost:
        raise ProfileError(f"{where}: features depend on points the skeleton lacks: {', '.join(lost)}")
    return out


def load(directory: str, name: str) -> dict:
    import yaml

    path = Path(directory) / f"{name}.yaml"
    if not path.exists():
        raise ProfileError(f"no profile named {name!r} (available: {', '.join(available(directory)) or 'none'})")
    return checked(yaml.safe_load(path.read_text(encoding="utf-8")) or {}, str(path))


def available(directory: str) -> list[str]:
    return sorted(p.stem for p in Path(directory).glob("*.yaml"))


def default_name(directory: str) -> str:
    """The only profile there is, or the only one that declares itself the default."""
    import yaml

    names = available(directory)
    if not names:
        raise ProfileError("no profile is available")
    if len(names) == 1:
        return names[0]
    chosen = [n for n in names if (yaml.safe_load((Path(directory) / f"{n}.yaml").read_text(encoding="utf-8")) or {}).get("default", False)]
    if len(chosen) != 1:
        raise ProfileError(f"{len(names)} profiles ({', '.join(names)}) and {len(chosen) or 'none'} of them the default; exactly one may be")
    return chosen[0]


def role(profile: dict, name: str) -> str:
    """The point that fills a structural role, such as an end of the body axis."""
    if name not in profile["skeleton"]["roles"]:
        raise ProfileError(f"skeleton {profile['skeleton']['identifier']} declares no role {name!r}")
    return profile["skeleton"]["roles"][name]


def check_views(profile: dict, source_view: str | None = None) -> None:
    """Every feature's view, and the source's, must be the skeleton's; an undeclared source view is refused too."""
    view = profile["skeleton"]["view"]
    for f in profile["feature_set"]["features"]:
        if f["view"] and f["view"] != view:
            raise ViewMismatchError(f"feature {f['name']!r} is defined for view {f['view']!r}, the skeleton for {view!r}")
    if source_view is not None and source_view != view:
        raise ViewMismatchError(f"the source's view is {source_view or 'not declared'!r}, the skeleton's {view!r}")


def check_features(profile: dict, computed: list[str] = ()) -> None:
    """Every available feature has an implementation, and every computed value a declaration."""
    declared = {f["name"]: f for f in profile["feature_set"]["features"]}
    for name, f in declared.items():
        if f["available"] and name not in IMPLEMENTED:
            raise UnimplementedFeatureError(f"feature {name!r} of set {profile['feature_set']['version']} is declared available and not implemented")
    for name in computed:
        if name not in declared:
            raise UndeclaredFeatureError(f"feature {name!r} is not declared in set {profile['feature_set']['version']}")


def unlicensed(profile: dict) -> list[str]:
    return [r for r, w in profile["weights"].items() if str(w["licence"]).lower() in ("", "unknown")]


def placeholders(profile: dict) -> dict[str, str]:
    return {r: w["placeholder_reason"] for r, w in profile["weights"].items() if w["placeholder"]}


def check_runtime(profile: dict, name: str) -> None:
    """The weights of a role must be for a runtime that can load them."""
    w = profile["weights"].get(name)
    if w is None:
        raise ProfileError(f"profile {profile['species']} declares no weights for role {name!r}")
    if w["runtime"] not in RUNTIMES:
        raise ProfileError(f"the {name} weights need the runtime {w['runtime']!r}, which is not implemented")


def dimension(spark: SparkSession, profile: dict) -> DataFrame:
    """The feature set as a table: position, feature, unit, higher_is_worse, available, requires_sampling_hz, depends_on."""
    rows = [(i, f["name"], f["unit"], f["higher_is_worse"], f["available"], float(f["requires_sampling_hz"]), list(f["depends_on"])) for i, f in enumerate(profile["feature_set"]["features"])]
    return spark.createDataFrame(rows, "position int, feature string, unit string, higher_is_worse boolean, available boolean, requires_sampling_hz double, depends_on array<string>")
