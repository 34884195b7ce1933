"""Settings in layers: default, property, override; each value says where it comes from."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.grammar import parse_duration, parse_size

#: Settings, their kinds and defaults.
DEFAULTS: dict[str, tuple[str, object]] = {
    "query.memory": ("size", "1GiB"),
    "query.deadline": ("duration", "600s"),
    "query.concurrent": ("int", 6),
    "query.per_client": ("int", 4),
    "query.row_cap": ("int", 1_000_000),
    "flush.rows": ("int", 50_000),
    "flush.age": ("duration", "60s"),
    "wal.cap": ("size", "2GiB"),
    "compact.min_files": ("int", 4),
    "gc.grace": ("duration", "900s"),
    "auth.mode": ("text", "optional"),
    "body.cap": ("size", "32MiB"),
    "last_cache.cap": ("int", 100_000),
    "telemetry.queue": ("int", 4096),
    "log.ring": ("int", 2000),
}


@dataclass
class Config:
    properties: dict[str, object] = field(default_factory=dict)
    overrides: dict[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, value in (*self.properties.items(), *self.overrides.items()):
            _read(name, value)

    def set(self, name: str, value: object) -> None:
        _read(name, value)
        self.overrides[name] = value

    def revert(self, name: str) -> None:
        """Back to the property or default."""
        self.overrides.pop(name, None)

    def resolve(self, name: str) -> tuple[object, str]:
        """(value, source)."""
        for source, layer in (("override", self.overrides), ("property", self.properties)):
            if name in layer:
                return _read(name, layer[name]), source
        return _read(name, DEFAULTS[name][1] if name in DEFAULTS else None), "default"

    def all(self) -> dict[str, tuple[object, str]]:
        return {n: self.resolve(n) for n in DEFAULTS}


def _read(name: str, value: object) -> object:
    if name not in DEFAULTS:
        raise ValueError(f"unknown setting {name!r}")
    kind = DEFAULTS[name][0]
    if kind == "int":
        return int(str(value))
    return {"size": parse_size, "duration": parse_duration, "text": str}[kind](str(value))
