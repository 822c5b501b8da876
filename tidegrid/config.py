"""Profiles and defaults: flag over environment over profile over built-in."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from .functions.text import parse_bool

DEFAULTS = {"database": "", "retention_policy": "", "precision": "rfc3339", "format": "table", "timeout_seconds": 10.0, "shuffle_partitions": 8, "master": "local[*]", "warehouse": "", "token": "", "password": "", "color": True, "max_rows": 200, "max_series": 5}
PREFIX = "TIDEGRID_"


class ConfigError(ValueError):
    pass


@dataclass
class Effective:
    profile: str = ""
    values: dict[str, object] = field(default_factory=dict)

    def __getattr__(self, name: str):
        try:
            return self.__dict__["values"][name]
        except KeyError:
            raise AttributeError(name) from None

    def redacted(self) -> list[str]:
        return [f"profile={self.profile or '-'}", *(f"{k}={'***' if k in ('token', 'password') and v else v if v != '' else '-'}" for k, v in sorted(self.values.items()))]


def _converted(name: str, value: object) -> object:
    kind = type(DEFAULTS[name])
    try:
        if kind is bool:
            return value if isinstance(value, bool) else parse_bool(str(value))
        return kind(value)
    except (TypeError, ValueError):
        raise ConfigError(f"invalid {name}: {value!r}") from None


def parse_profiles(text: str) -> dict:
    """Profiles in indented key: value lines: `default: name`, then `profiles:` with names and settings under them."""
    out: dict = {"profiles": {}}
    current = None
    for n, raw in enumerate(text.splitlines(), 1):
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth, (key, colon, value) = len(line) - len(line.lstrip()), line.strip().partition(":")
        if not colon:
            raise ConfigError(f"line {n}: expected key: value")
        key, value = key.strip(), value.strip().strip("\"'")
        if key == "url":
            raise ConfigError(f"line {n}: url is no longer a setting; name a warehouse")
        if depth == 0 and key == "profiles":
            continue
        if depth == 0:
            out[key] = value
        elif not value and depth <= 2:
            current = out["profiles"].setdefault(key, {})
        elif current is not None:
            if key not in DEFAULTS:
                raise ConfigError(f"line {n}: unknown setting {key}")
            current[key] = _converted(key, value)
    return out


def resolve(flags: Mapping[str, object], env: Mapping[str, str], path: Path | None = None) -> Effective:
    """The profile is the flag's, the environment's, the file's default, `local`, the only one, or the first by name."""
    file = parse_profiles(path.read_text(encoding="utf-8")) if path is not None and path.exists() else {"profiles": {}}
    profiles = file["profiles"]
    name = flags.get("profile") or env.get(f"{PREFIX}PROFILE") or file.get("default") or ("local" if "local" in profiles else min(profiles, default=""))
    if name and name not in profiles and (flags.get("profile") or env.get(f"{PREFIX}PROFILE")):
        raise ConfigError(f"profile not found: {name}")
    values = dict(DEFAULTS) | profiles.get(name, {})
    values |= {k: _converted(k, env[v]) for k in DEFAULTS if (v := PREFIX + k.upper()) in env and env[v] != ""}
    values |= {k: _converted(k, v) for k, v in flags.items() if k in DEFAULTS and v is not None}
    return Effective(str(name), values)


__all__ = ["ConfigError", "DEFAULTS", "Effective", "parse_profiles", "resolve"]
