"""Configuration and boundary specifications: small, read on the driver.

Settings come from a global file, the project's file over it, and the environment over both. Problems raise
``SettingsError``, whose ``code`` is the command line's exit code.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tomllib
from dataclasses import dataclass, field
from datetime import date
from pathlib import Path

from .trees import EXCLUDED

FOLDER = ".drift"


class SettingsError(Exception):
    code = 2


# The sections, keys and defaults of a configuration.
DEFAULTS: dict[str, dict] = {
    "core": {"languages": "auto", "exclude": EXCLUDED, "random_seed": 42, "log_level": "WARNING", "workers": 0},
    "snapshots": {"dir": f"{FOLDER}/snapshots", "retention": 100},
    "boundaries": {"spec_file": f"{FOLDER}/boundaries.yaml", "leiden_gamma": 1.0, "stability_threshold": 3, "weighted_edges": False},
    "patterns": {"categories": "auto", "min_pattern_nodes": 5, "count_nodes": False, "scope_exclude": []},
    "thresholds": {"pattern_entropy_rate": 2.0, "convention_drift_rate": 0.10, "coupling_delta_rate": 0.15, "boundary_violation_rate": 5.0, "overrides": {}},
    "change_coupling": {"min_frequency": 0.6, "history_depth": 500},
    "output": {"format": "text", "color": "auto"},
}
RATES = {"pattern_entropy": "pattern_entropy_rate", "convention_drift": "convention_drift_rate", "coupling_topology": "coupling_delta_rate", "boundary_violations": "boundary_violation_rate"}


def merged(base: dict, over: dict) -> dict:
    """``over`` laid over ``base``, section by section."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _toml(path: Path) -> dict:
    try:
        return tomllib.loads(path.read_text()) if path.is_file() else {}
    except tomllib.TOMLDecodeError as e:
        raise SettingsError(f"{path}: {e}") from e


def load(project: str, path: str | None = None) -> dict:
    """The settings of a project."""
    home = Path(os.environ.get("XDG_CONFIG_HOME", Path.home() / ".config"), "drift", "config.toml")
    found = merged(merged(DEFAULTS, _toml(home)), _toml(Path(path) if path else Path(project, FOLDER, "config.toml")))
    if level := os.environ.get("DRIFT_LOG_LEVEL"):
        found = merged(found, {"core": {"log_level": level}})
    if workers := os.environ.get("DRIFT_WORKERS"):
        found = merged(found, {"core": {"workers": int(workers)}})
    if not all(isinstance(p, str) for p in found["patterns"]["scope_exclude"]):
        raise SettingsError("patterns.scope_exclude must be a list of strings")
    for name, o in found["thresholds"]["overrides"].items():
        try:
            date.fromisoformat(str(o["expires"]))
        except (KeyError, ValueError, TypeError) as e:
            raise SettingsError(f"thresholds.overrides.{name}: expires must be an ISO date") from e
    return found


def fingerprint(settings: dict) -> str:
    """A hash of the settings that change what an analysis finds; the order of exclusions doesn't."""
    core, bounds, patterns = settings["core"], settings["boundaries"], settings["patterns"]
    used = {
        "core": {"languages": core["languages"], "exclude": sorted(core["exclude"]), "random_seed": core["random_seed"]},
        "boundaries": {k: bounds[k] for k in ("leiden_gamma", "stability_threshold", "weighted_edges")},
        "patterns": {"categories": patterns["categories"], "min_pattern_nodes": patterns["min_pattern_nodes"] if not patterns["count_nodes"] else [patterns["min_pattern_nodes"]], "scope_exclude": sorted(patterns["scope_exclude"])},
    }
    return hashlib.sha256(json.dumps(used, sort_keys=True).encode()).hexdigest()[:16]


def thresholds(settings: dict, today: date | None = None) -> dict[str, float]:
    """The greatest of base and active overrides for each dimension."""
    today, base = today or date.today(), settings["thresholds"]
    held = [o for o in base["overrides"].values() if date.fromisoformat(str(o["expires"])) >= today]
    return {d: max([base[rate], *(o[rate] for o in held if o.get(rate) is not None)]) for d, rate in RATES.items()}


@dataclass
class Specification:
    modules: list[tuple[str, list[str], str | None]] = field(default_factory=list)
    layers: list[str] = field(default_factory=list)
    direction: str = "downward"
    allowed: list[tuple[str, str]] = field(default_factory=list)
    reasons: list[str] = field(default_factory=list)  # of the allowed pairs, in their order
    splits: list[tuple[str, list[str], str]] = field(default_factory=list)  # module, intended modules, target date
    version: str = ""
    ratified: tuple[str, str] | None = None  # when, by whom

    def text(self) -> str:
        """As a human reads it."""
        out = [f"version {self.version or '-'}" + (f", ratified {self.ratified[0]} by {self.ratified[1]}" if self.ratified else ""), f"modules: {len(self.modules)}"]
        for name, paths, layer in self.modules:
            out.append(f"  {name} [{layer or '-'}]: {', '.join(paths)}")
        if self.layers:
            out.append(f"layers ({self.direction}): {' > '.join(self.layers)}")
        out += [f"allowed: {a} -> {b}" + (f" ({why})" if why else "") for (a, b), why in zip(self.allowed, self.reasons, strict=True)]
        out += [f"planned: {module} -> {', '.join(parts)}" + (f" by {when}" if when else "") for module, parts, when in self.splits]
        return "\n".join(out)


def specification(path: str, root: str = "boundaries") -> Specification | None:
    """A boundary specification in YAML; None if there is no such file."""
    import yaml

    file = Path(path)
    if not file.is_file():
        return None
    try:
        found = yaml.safe_load(file.read_text())
    except yaml.YAMLError as e:
        mark = getattr(e, "problem_mark", None)
        raise SettingsError(f"{path}: line {mark.line + 1 if mark else '?'}: {e}") from e
    inner = found.get(root) if isinstance(found, dict) else None
    if not isinstance(inner, dict) or "version" not in inner or "modules" not in inner:
        raise SettingsError(f"{path}: {root} with version and modules is asked for")
    modules = [(m["name"], list(m.get("paths", [])), m.get("layer")) for m in inner["modules"] or []]
    layers = inner.get("layers") or {}
    crossing = inner.get("allowed_cross_domain") or []
    splits = [(s["current_module"], list(s.get("intended_boundary", [])), str(s.get("target_date") or "")) for s in inner.get("aspirational_splits") or []]
    ratified = (str(inner["last_ratified"]), str(inner.get("ratified_by") or "")) if inner.get("last_ratified") else None
    allowed, reasons = [(a["from"], a["to"]) for a in crossing], [str(a.get("reason") or "") for a in crossing]
    return Specification(modules, list(layers.get("ordering", [])), layers.get("direction", "downward"), allowed, reasons, splits, str(inner["version"]), ratified)


def aliases(root: str) -> list[tuple[str, list[str]]]:
    """Path aliases of the first of tsconfig.json and jsconfig.json that has any; comments are allowed."""
    for name in ("tsconfig.json", "jsconfig.json"):
        file = Path(root, name)
        if not file.is_file():
            continue
        text = file.read_text(errors="replace")
        for candidate in (text, re.sub(r",(\s*[}\]])", r"\1", re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.DOTALL))):
            try:
                options = json.loads(candidate).get("compilerOptions", {})
                break
            except (json.JSONDecodeError, AttributeError):
                options = {}
        base = options.get("baseUrl", ".")
        found = [(k, [os.path.normpath(os.path.join(base, t)).replace(os.sep, "/") for t in v]) for k, v in (options.get("paths") or {}).items() if v]
        if found:
            return found
    return []
