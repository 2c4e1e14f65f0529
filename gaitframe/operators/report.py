"""Evaluation report: metric families, the inputs they are a function of, limitations, fingerprint. Small, on the driver."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import canonical
from .evaluation import assert_no_leakage, split

COUNTS = ("long", "bigint", "int")


@dataclass
class Report:
    """inputs: dataset_name, dataset_version, model_identities, split, config_digest, feature_set_version, skeleton,
    site_keys, placeholder_weights, unavailable_features, feature_names."""

    inputs: dict
    families: list[dict] = field(default_factory=list)
    limitations: list[str] = field(default_factory=list)
    injections: list[str] = field(default_factory=list)

    def add(self, name: str, row: DataFrame, notes: list[str] = ()) -> Report:
        """A family from a one-row table: whole numbers are its counts, the rest its metrics. One without a row is absent, which is stated."""
        got, kinds = row.first(), dict(row.dtypes)
        if got is None:
            self.limitations.append(f"{name} was not computed: nothing was there to measure; it is unmeasured, not zero.")
            return self
        self.families.append(
            {
                "name": name, "metrics": {k: float(got[k]) for k in row.columns if kinds[k] not in COUNTS and got[k] is not None},
                "counts": {k: int(got[k]) for k in row.columns if kinds[k] in COUNTS and got[k] is not None}, "notes": list(notes),
            }
        )
        return self

    def declared(self) -> list[str]:
        """What limits every report of this kind, what limits this one, and what was added."""
        sites = len(set(self.inputs["site_keys"]))
        out = ["Health inference is a stub: baselines and alerts were exercised on injected deviations, so nothing here is clinical evidence.", f"Evaluation covers {sites} distinct site(s)."]
        if sites < 2:
            out.append("No site-disjoint split was possible with one site, so the shift between farms is not measured.")
        lost, names = self.inputs.get("unavailable_features") or {}, self.inputs.get("feature_names") or ()
        if lost:
            out.append(f"{len(lost)} of {len(names) or len(lost)} declared features could not be computed: {', '.join(sorted(lost))}.")
            out += [f"{n} is unavailable because {why}" for n, why in sorted(lost.items()) if why]
        out += [f"The {role} weights are a placeholder{f' ({why})' if why else ''}; what came from them measures the placeholder." for role, why in sorted((self.inputs.get("placeholder_weights") or {}).items())]
        if self.injections:
            out.append("Injected data was present; the injections are listed.")
        return out + list(self.limitations)

    def content(self) -> dict:
        """All the report says, but when; metrics to ten places."""
        families = [{**f, "metrics": {k: round(v, 10) for k, v in sorted(f["metrics"].items())}, "counts": dict(sorted(f["counts"].items()))} for f in self.families]
        inputs = {k: self.inputs[k] for k in ("dataset_name", "dataset_version", "model_identities", "split", "config_digest", "feature_set_version", "skeleton")}
        return {"inputs": inputs | {"site_keys": sorted(set(self.inputs["site_keys"]))}, "families": families, "limitations": self.declared(), "injections": list(self.injections)}

    def fingerprint(self) -> str:
        return hashlib.sha256(canonical(self.content()).encode()).hexdigest()

    def to_json(self) -> str:
        return json.dumps(self.content(), indent=2, sort_keys=True)

    def render(self) -> str:
        """The report as Markdown; families are never pooled into one score."""
        lines = ["# Evaluation report", "", "## Inputs", *[f"- {k}: {v}" for k, v in self.content()["inputs"].items()], f"- fingerprint: {self.fingerprint()}"]
        for f in self.families:
            lines += ["", f"## {f['name']}", *[f"- {k}: {v:.4f}" for k, v in sorted(f["metrics"].items())], *[f"- {k}: {v}" for k, v in sorted(f["counts"].items())], *[f"- _{n}_" for n in f["notes"]]]
        lines += ["", "## Limitations", *[f"- {x}" for x in self.declared()]]
        return "\n".join(lines + (["", "## Injections", *[f"- {x}" for x in self.injections]] if self.injections else []))


def evaluate(inputs: dict, items: DataFrame, key: str, families: dict[str, DataFrame | None], test_fraction: float = 0.3, seed: int = 0, lacking: dict[str, str] = {}) -> Report:
    """A report over families of metrics, each a one-row table or None.

    The split of the items is checked for shared keys before any metric is computed. A family without a table is
    absent, and what it lacks (lacking, by family) is stated.
    """
    parts = split(items, key, test_fraction, seed)
    assert_no_leakage(parts, key)
    n = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.count_distinct(key).alias("n")).collect()}
    report = Report(inputs | {"split": f"{key}-disjoint:seed={seed}:test_fraction={test_fraction}:train={n.get('train', 0)}:test={n.get('test', 0)}"})
    for name, row in families.items():
        if row is None:
            report.limitations.append(f"{name} was not computed: {lacking.get(name, 'there is no ground truth for it')}; it is unmeasured, not zero.")
        else:
            report.add(name, row)
    return report


def served_labels(families: dict[str, set[str]]) -> list[str]:
    """A limitation for each family whose models only serve labels, by the identities its rows carry."""
    return [f"The {n} family comes from a backend that serves labels ({', '.join(sorted(m))}), so its scores measure no model." for n, m in families.items() if any("label" in x for x in m)]
