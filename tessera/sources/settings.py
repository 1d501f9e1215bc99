"""Settings from YAML or JSON files, folders and required variables."""

from __future__ import annotations

import json
import os
from pathlib import Path


def load(name: str, folder: str | Path) -> dict:
    """Settings file of that name; FileNotFoundError where there is none."""
    for ending in (".yaml", ".yml", ".json"):
        path = Path(folder) / f"{name}{ending}"
        if path.exists():
            if ending == ".json":
                return json.loads(path.read_text())
            import yaml

            return yaml.safe_load(path.read_text()) or {}
    raise FileNotFoundError(f"no settings {name!r} in {folder}")


def folder(*parts: str | Path) -> Path:
    path = Path(*parts)
    path.mkdir(parents=True, exist_ok=True)
    return path


def required(variable: str) -> str:
    value = os.environ.get(variable)
    if not value:
        raise RuntimeError(f"{variable} is not set")
    return value
