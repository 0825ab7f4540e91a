"""The configuration file of a repository: JSON with a fixed schema."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import asdict, dataclass, field
from pathlib import Path

FOLDER, NAME, VERSION = ".quarrylight", "config.json", 1


class ConfigError(ValueError):
    """A configuration that can't be used."""


@dataclass
class Config:
    """max_files and max_bytes bound a repository; the storage path is fixed."""

    schema_version: int = VERSION
    storage: str = FOLDER
    ignore_files: list[str] = field(default_factory=lambda: [".gitignore", ".quarryignore"])
    max_files: int = 10_000
    max_bytes: int = 52_428_800
    embedding_dimension: int = 384


def load(root: str) -> Config:
    """The repository's configuration, defaults where there is none."""
    path = Path(root, FOLDER, NAME)
    if not path.exists():
        return Config()
    try:
        data = json.loads(path.read_text("utf-8"))
    except (OSError, ValueError) as e:
        raise ConfigError(f"{path} isn't readable JSON") from e
    if not isinstance(data, dict) or data.get("schema_version") != VERSION:
        raise ConfigError(f"schema_version must be {VERSION}")
    known = asdict(Config())
    if unknown := sorted(data.keys() - known.keys()):
        raise ConfigError(f"unknown keys: {', '.join(unknown)}")
    for key, value in data.items():
        if type(value) is not type(known[key]):
            raise ConfigError(f"{key} must be of type {type(known[key]).__name__}")
    if data.get("storage", FOLDER) != FOLDER:
        raise ConfigError(f"storage must be {FOLDER}")
    for key in ("max_files", "max_bytes", "embedding_dimension"):
        if data.get(key, 1) < 1:
            raise ConfigError(f"{key} must be positive")
    return Config(**data)


def save(root: str, config: Config) -> Path:
    """Written beside the old file, then renamed over it."""
    folder = Path(root, FOLDER)
    folder.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder, prefix=NAME)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(asdict(config), f, indent=2, sort_keys=True)
    os.replace(temporary, folder / NAME)
    return folder / NAME


def create_default(root: str, force: bool = False) -> Path:
    path = Path(root, FOLDER, NAME)
    if path.exists() and not force:
        raise ConfigError(f"{path} exists")
    return save(root, Config())
