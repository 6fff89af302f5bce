"""Settings: files over defaults, presets, signatures. Settings are not data; this runs on the driver."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Mapping
from pathlib import Path


def merged(base: Mapping, over: Mapping) -> dict:
    """FN33: a mapping with another put over it, level by level."""
    out = dict(base)
    for key, value in over.items():
        nested = isinstance(value, Mapping) and isinstance(out.get(key), Mapping)
        out[key] = merged(out[key], value) if nested else value
    return out


def load(path: str, defaults: Mapping) -> dict:
    """SRC16: a settings file over the defaults; a file that is absent or unreadable counts as empty."""
    try:
        own = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        own = {}
    return modern(merged(defaults, own if isinstance(own, Mapping) else {}), defaults)


def modern(settings: dict, defaults: Mapping) -> dict:
    """FN44: the old on/off form of notify as one of its modes; a mode that was chosen stays."""
    notify = dict(settings.get("notify") or {})
    chosen = notify.get("mode") and notify["mode"] != (defaults.get("notify") or {}).get("mode")
    if chosen or notify.get("enabled") is None:
        return settings
    if notify["enabled"] and notify.get("bin"):
        words = [notify["bin"], "send --to", notify.get("target", "telegram"), "{message}"]
        notify |= {"mode": "command", "command": notify.get("command") or " ".join(words)}
    else:
        notify["mode"] = "none"
    return settings | {"notify": notify}


def sign(secret: str, body: bytes) -> str:
    """FN35: the signature of a message's bytes."""
    return f"sha256={hmac.digest(secret.encode(), body, hashlib.sha256).hex()}"


def inside(root: str, name: str) -> Path:
    """VAL05: a path below a folder; ValueError if it leads out, links followed."""
    base = Path(root).resolve()
    path = (base / name.strip()).resolve()
    if not name.strip() or base not in path.parents:
        raise ValueError(f"path leads out of its folder: {name!r}")
    return path
