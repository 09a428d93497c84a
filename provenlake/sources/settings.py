"""Settings of a run: what a run may choose, and the thresholds that only the rules file decides."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from importlib.resources import files
from pathlib import Path

import yaml

RULES_FILE = "rules.yaml"
#: The thresholds that the rules file decides, each with its upper bound; the defaults of the rest.
THRESHOLDS = {"retrieval_floor": 1.0, "supported_threshold": 1.0, "contradicted_threshold": 1.0, "numeric_tolerance": None, "approx_numeric_tolerance": None}
AGGREGATIONS = ("max_entailment",)
DEFAULTS = {"top_k": 5, "aggregation": "max_entailment", "retriever": {"model_id": "column", "hf_revision_sha": "none"}, "entailer": {"model_id": "column", "hf_revision_sha": "none"}}


class RulesConsistencyError(ValueError):
    """Settings that depart from the rules file that they name."""


@dataclass(frozen=True)
class Settings:
    """The settings of a run; rules_file_sha is the SHA-256 of the rules file's bytes in hex."""

    top_k: int
    aggregation: str
    retriever: dict[str, str]
    entailer: dict[str, str]
    retrieval_floor: float
    supported_threshold: float
    contradicted_threshold: float
    numeric_tolerance: float
    approx_numeric_tolerance: float
    rules_file_sha: str


def load_rules(path: str | Path | None = None) -> tuple[dict[str, object], str]:
    """(the rules file's mapping, SHA-256 of its bytes in hex); the package's own without a path."""
    raw = files("provenlake").joinpath(RULES_FILE).read_bytes() if path is None else Path(path).read_bytes()
    return yaml.safe_load(raw.decode()), hashlib.sha256(raw).hexdigest()


def load_settings(path: str | Path | None = None, rules_path: str | Path | None = None) -> Settings:
    """Settings from a YAML mapping of what a run may choose; DEFAULTS without a path.

    Thresholds are those of the rules file, whatever the mapping says.  A file that is no YAML mapping,
    an unknown or missing field, or a value out of its range raises ValueError.
    """
    chosen: object = DEFAULTS
    if path is not None:
        try:
            chosen = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
        except yaml.YAMLError as wrong:
            raise ValueError(f"malformed settings at {path}: {wrong}") from wrong
    if not isinstance(chosen, dict):
        raise ValueError(f"settings must be a mapping, got {type(chosen).__name__}")
    rules, sha = load_rules(rules_path)
    whole = {"top_k": 5, "aggregation": "max_entailment"} | chosen | {name: rules[name] for name in THRESHOLDS} | {"rules_file_sha": sha}
    fields = set(Settings.__dataclass_fields__)
    if wrong := sorted(fields ^ whole.keys()):
        raise ValueError(f"unknown or missing settings: {', '.join(wrong)}")
    found = Settings(**whole)
    _check(found)
    verify_rules(found, rules_path)
    return found


def _check(found: Settings) -> None:
    if not isinstance(found.top_k, int) or isinstance(found.top_k, bool) or found.top_k < 1:
        raise ValueError("top_k must be an integer of 1 or more")
    if found.aggregation not in AGGREGATIONS:
        raise ValueError(f"aggregation must be one of {', '.join(AGGREGATIONS)}")
    for name in ("retriever", "entailer"):
        model = getattr(found, name)
        if not isinstance(model, dict) or set(model) != {"model_id", "hf_revision_sha"} or not all(isinstance(x, str) and x for x in model.values()):
            raise ValueError(f"{name} must name model_id and hf_revision_sha")
    for name, most in THRESHOLDS.items():
        value = getattr(found, name)
        if isinstance(value, bool) or not isinstance(value, (int, float)) or value < 0 or (most is not None and value > most):
            raise ValueError(f"{name} is out of range: {value!r}")


def verify_rules(found: Settings, rules_path: str | Path | None = None) -> None:
    """Raises RulesConsistencyError unless settings name the rules file's bytes and hold its thresholds."""
    rules, sha = load_rules(rules_path)
    if found.rules_file_sha != sha:
        raise RulesConsistencyError(f"settings name the rules file {found.rules_file_sha!r}, this one is {sha!r}")
    for name in THRESHOLDS:
        if getattr(found, name) != rules[name]:
            raise RulesConsistencyError(f"{name}={getattr(found, name)!r}, the rules file says {rules[name]!r}")


def settings_hash(found: Settings) -> str:
    """The hash of settings, from their canonical JSON: the order of the fields changes nothing."""
    return "sha256:" + hashlib.sha256(json.dumps(asdict(found), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
