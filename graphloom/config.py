"""Where a build reads and writes, and which interviews it takes."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession


def _absolute(path: str) -> bool:
    return path.startswith("/") or "://" in path


@dataclass(frozen=True)
class Config:
    """Named paths below a root, and settings by section."""

    root: str
    paths: Mapping[str, str]
    settings: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)

    @classmethod
    def of(cls, told: Mapping[str, Any], home: str = "") -> Config:
        """From sections: `paths` has `workspace_root` and paths relative to it; a relative root is below `home`."""
        paths = {k: str(v) for k, v in told["paths"].items()}
        root = paths.pop("workspace_root", ".")
        return cls(root if _absolute(root) or not home else f"{home.rstrip('/')}/{root}", paths, {k: v for k, v in told.items() if k != "paths"})

    @classmethod
    def read(cls, spark: SparkSession, path: str, home: str = "") -> Config:
        """From a JSON file, or a YAML file where a YAML library is installed; read through Spark, so it may be in any store."""
        text = spark.read.text(path, wholetext=True).first()[0]
        if path.endswith((".yaml", ".yml")):
            import yaml

            return cls.of(yaml.safe_load(text), home)
        return cls.of(json.loads(text), home)

    def path(self, name: str) -> str:
        return self.paths[name] if _absolute(self.paths[name]) else f"{self.root.rstrip('/')}/{self.paths[name]}"

    def get(self, section: str, name: str, default: Any = None) -> Any:
        return self.settings.get(section, {}).get(name, default)
