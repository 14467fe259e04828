"""Settings: defaults, then a YAML file, then environment variables with the prefix CORPUSMILL_."""

from __future__ import annotations

import copy
import os

DEFAULTS: dict = {
    "paths": {"store": "store", "inbox": "inbox", "checkpoint": "checkpoint", "exclusions": "superseded.txt", "curated": "curated", "quarantine": "quarantine", "gold": "gold.jsonl"},
    "chunk": {"chars": 1800, "overlap": 200},
    "search": {"k": 8, "mode": "hybrid", "rrf_k": 60, "boost": 0.01},
    "embedding": {"dim": 64},
    "rerank": {"enabled": True, "backend": "none", "pool": 15, "url": "http://127.0.0.1:8000/rerank", "model": ""},
    "chat": {"url": "", "model": "", "timeout": 240},
    "vision_describe": {"enabled": False, "max_pages": 4},
    "api": {"host": "127.0.0.1", "port": 8080, "token": "", "max_body": 2**20},
    "taxonomy": ["99_MISC"],
}
TRUE, FALSE = {"1", "true", "yes", "on"}, {"", "0", "false", "no", "off"}


def coerced(text: str, like):
    """The text as the type of the default; an empty text is false for a switch, a list is parted by commas."""
    if isinstance(like, bool):
        low = text.strip().lower()
        if low not in TRUE | FALSE:
            raise ValueError(f"not a switch: {text!r}")
        return low in TRUE
    if isinstance(like, int):
        return int(text)
    if isinstance(like, float):
        return float(text)
    if isinstance(like, list):
        return [x.strip() for x in text.split(",") if x.strip()]
    return text


def leaves(tree: dict, at: tuple = ()):
    """(path, value) of everything in nested sections that isn't a section itself; an empty section is a value."""
    for key, value in tree.items():
        if isinstance(value, dict) and value:
            yield from leaves(value, (*at, key))
        else:
            yield (*at, key), value


def put(tree: dict, path: tuple, value) -> None:
    """Sets one value; what is no section on its way becomes one. An empty section leaves a section as it is."""
    *sections, last = path
    for key in sections:
        if not isinstance(tree.get(key), dict):
            tree[key] = {}
        tree = tree[key]
    if not (value == {} and isinstance(tree.get(last), dict)):
        tree[last] = value


def load(path: str | None = None, env: dict[str, str] | None = None, prefix: str = "CORPUSMILL_") -> dict:
    """The settings. In a variable's name the longest section that fits is taken, so sections may hold underscores."""
    out = copy.deepcopy(DEFAULTS)
    if path and os.path.exists(path):
        import yaml

        with open(path, encoding="utf-8") as f:
            for at, value in leaves(yaml.safe_load(f) or {}):
                put(out, at, value)
    for name, text in sorted((os.environ if env is None else env).items()):
        if not name.startswith(prefix):
            continue
        rest = name[len(prefix) :].lower()
        for section in sorted(out, key=len, reverse=True):
            if rest == section and not isinstance(out[section], dict):
                out[section] = coerced(text, out[section])
                break
            if rest.startswith(section + "_") and isinstance(out[section], dict):
                key = rest[len(section) + 1 :]
                out[section][key] = coerced(text, out[section].get(key, ""))
                break
    return out
