"""Settings: flags over environment over file over defaults."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from querylens.sources.discovery import PATTERNS

#: Prefix of environment variables, e.g. ``QUERYLENS_STORE_PATH``.
PREFIX = "QUERYLENS_"


@dataclass(frozen=True)
class Config:
    store_path: str = "./data/querylens"
    slow_log_dir: str = "./logs"
    batch_size: int = 1000
    file_patterns: tuple[str, ...] = PATTERNS
    workers: int = max(1, min(4, os.cpu_count() or 1))
    host: str = "0.0.0.0"
    port: int = 8080
    api_key: str = ""

    def __post_init__(self):
        if self.workers < 1:
            object.__setattr__(self, "workers", 1)
        if not self.file_patterns:
            object.__setattr__(self, "file_patterns", PATTERNS)
        for pattern in self.file_patterns:
            if pattern.count("[") > pattern.count("]") or pattern.endswith("\\"):
                raise ValueError(f"invalid file pattern {pattern!r}")

    def with_values(self, values: Mapping[str, object]) -> Config:
        """Replace what is given; text is read as the field's type."""
        own = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        found: dict[str, object] = {}
        for name, value in values.items():
            if name not in own or value is None:
                continue
            if own[name] is tuple:
                parts = value.split(",") if isinstance(value, str) else value
                found[name] = tuple(p.strip() for p in parts if p.strip())
            else:
                found[name] = own[name](value)
        return replace(self, **found)


def _parsed(text: str) -> dict[str, object]:
    """JSON, or the plain part of YAML: ``key: value`` lines in sections that
    don't matter, and lists of ``- item``."""
    if text.lstrip().startswith("{"):
        found = json.loads(text)
        return {k: v for part in [found, *(v for v in found.values() if isinstance(v, dict))] for k, v in part.items()}
    out: dict[str, object] = {}
    key = ""
    for line in text.splitlines():
        line = line.split(" #")[0].strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith("- "):
            out.setdefault(key, [])
            if isinstance(out[key], list):
                out[key].append(line[2:].strip().strip("\"'"))
            continue
        key, _, value = (x.strip() for x in line.partition(":"))
        if value:
            out[key] = value.strip("\"'")
    if "path" in out:
        out.setdefault("store_path", out["path"])
    return out


def load(path: str | None = None, environ: Mapping[str, str] | None = None, flags: Mapping[str, object] | None = None) -> Config:
    """The settings.  A named file must exist; ``config.yaml`` here or in
    ``config/`` is read if there is one."""
    config = Config()
    places = [path] if path else ["config.yaml", "config/config.yaml"]
    for place in places:
        if path or os.path.exists(place):
            with open(place, encoding="utf-8") as f:
                config = config.with_values(_parsed(f.read()))
            break
    environ = os.environ if environ is None else environ
    config = config.with_values({k.removeprefix(PREFIX).lower(): v for k, v in environ.items() if k.startswith(PREFIX)})
    return config.with_values(flags or {})
