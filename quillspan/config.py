"""Configuration: defaults, a file, the environment; checked, and the defaults again if anything is wrong."""

from __future__ import annotations

import copy
import json
import logging
import os

log = logging.getLogger(__name__)

#: Fixed defaults by section.
DEFAULTS: dict = {
    "exclude": [],
    "include": ["src/**/*.ts", "src/**/*.tsx", "src/**/*.js", "src/**/*.jsx", "lib/**/*.ts", "lib/**/*.js"],
    "validation": {"run_tests": True, "run_lint": True, "run_type_check": True, "custom_validators": [], "parallel": True, "timeout": 300_000},
    "safety": {"auto_checkpoint": True, "auto_rollback": True, "max_risk_score": 75, "require_confirmation_above": 50, "include_untracked_files": False},
    "performance": {"caching": True, "cache_ttl": 3600, "parallel_validation": True, "max_concurrent_analysis": 4, "watch_mode": False},
    "paths": {"types_path": "src/types", "output_path": "dist", "test_path": "test", "custom_paths": {}},
}
FILE_NAMES = (".quillspan.yaml", ".quillspan.yml", "quillspan.yaml", "quillspan.yml", "quillspan.json")
#: Fixed ranges of numbers.
_RANGES = {("safety", "max_risk_score"): (0, 100), ("safety", "require_confirmation_above"): (0, 100), ("performance", "cache_ttl"): (0, None), ("performance", "max_concurrent_analysis"): (1, None), ("validation", "timeout"): (0, None)}
#: Environment variables that turn settings off.
_SWITCHES = {
    "QUILLSPAN_CACHE": [("performance", "caching")],
    "QUILLSPAN_PARALLEL": [("performance", "parallel_validation"), ("validation", "parallel")],
    "QUILLSPAN_AUTO_CHECKPOINT": [("safety", "auto_checkpoint")],
    "QUILLSPAN_AUTO_ROLLBACK": [("safety", "auto_rollback")],
}


def merged(base: dict, over: dict | None) -> dict:
    """``base`` with the settings of ``over``, section by section; a list replaces a list."""
    out = copy.deepcopy(base)
    for k, v in (over or {}).items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def check(config: dict) -> None:
    for (section, key), (low, high) in _RANGES.items():
        value = config[section][key]
        if isinstance(value, bool) or not isinstance(value, (int, float)) or value < low or (high is not None and value > high):
            raise ValueError(f"{section}.{key} must be a number from {low}" + (f" to {high}" if high is not None else ""))


def _read(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        import yaml  # where it is installed

        return yaml.safe_load(f) or {}


def load(root: str, environ: dict | None = None) -> dict:
    """The configuration for ``root``: the first file found over the defaults, then the environment."""
    env = os.environ if environ is None else environ
    config = copy.deepcopy(DEFAULTS)
    try:
        path = next((p for p in (os.path.join(root, n) for n in FILE_NAMES) if os.path.exists(p)), None)
        if path:
            config = merged(config, _read(path))
            check(config)
    except Exception as e:
        log.warning("configuration of %s: %s; the defaults are used", root, e)
        config = copy.deepcopy(DEFAULTS)
    for name, settings in _SWITCHES.items():
        if env.get(name) == "false":
            for section, key in settings:
                config[section][key] = False
    score = env.get("QUILLSPAN_MAX_RISK_SCORE", "")
    if score.isdigit() and int(score) <= 100:
        config["safety"]["max_risk_score"] = int(score)
    return config
