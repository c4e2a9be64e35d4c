"""The project's settings: defaults, and a file whose keys replace them whole."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, replace

from refloom.operators.verify import RULES

FILE = ".rr.toml"  # fixed value: where a project keeps its settings


@dataclass(frozen=True)
class Config:
    in_scope: tuple[str, ...] = ("**/*.md",)
    exclude: tuple[str, ...] = ()
    rules: tuple[str, ...] = tuple(RULES)
    scan: dict[str, list[str]] = field(default_factory=lambda: {"markdown": ["prose"], "text": ["all"]})


def parse(text: str, base: Config | None = None) -> Config:
    """Keys that the text sets replace those of ``base``; what isn't understood is passed over."""
    base = base or Config()
    try:
        given = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        given = _by_table(text)
    verify = given.get("verify", {})
    names = {"in-scope": "in_scope", "exclude": "exclude", "rules": "rules"}
    changes = {ours: tuple(verify[key]) for key, ours in names.items() if isinstance(verify.get(key), list)}
    scan = {name: list(t["eligible"]) for name, t in given.get("scan", {}).items() if isinstance(t, dict) and isinstance(t.get("eligible"), list)}
    return replace(base, **changes, scan=base.scan | scan)


def _by_table(text: str) -> dict:
    """Each table by itself, without those that don't parse."""
    out: dict = {}
    for part in ("\n" + text).split("\n["):
        try:
            for name, table in tomllib.loads("[" + part if part.strip() and "]" in part.split("\n")[0] else part).items():
                out.setdefault(name, {}).update(table) if isinstance(table, dict) else None
        except tomllib.TOMLDecodeError:
            continue
    return out


def load(root: str) -> Config:
    try:
        with open(os.path.join(root, FILE), encoding="utf-8") as f:
            return parse(f.read())
    except OSError:
        return Config()
