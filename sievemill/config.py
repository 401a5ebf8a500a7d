"""Configuration: defaults, a file, the environment and single settings, merged in that order; hashes of what matters in it."""

from __future__ import annotations

import copy
import hashlib
import json
import os

ENV = "SIEVEMILL__"


def merged(base: dict, over: dict) -> dict:
    """base with over's values; sections merge, anything else is replaced. Neither argument changes."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def parsed(text: str):
    """A setting's value: JSON where it is JSON, else the text."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def setting(path: str, value) -> dict:
    """{'a': {'b': value}} for the path a.b."""
    out = value
    for k in reversed(path.split(".")):
        out = {k: out}
    return out


def load(defaults: dict, file: dict | None = None, env: dict[str, str] | None = None, settings: list[str] = ()) -> dict:
    """settings are 'a.b=value'; variables of the environment are SIEVEMILL__A__B=value. A setting of a section or key that
    the defaults don't have is an error, as it would change nothing."""
    out = merged(defaults, file or {})
    given = [(k[len(ENV) :].lower().replace("__", "."), v) for k, v in sorted((os.environ if env is None else env).items()) if k.startswith(ENV)]
    given += [tuple(s.split("=", 1)) for s in settings]
    for path, v in given:
        at = defaults
        for k in path.split("."):
            if not isinstance(at, dict) or k not in at:
                raise KeyError(f"unknown setting {path}")
            at = at[k]
        out = merged(out, setting(path, parsed(v)))
    return out


def without(config: dict, paths: set[str], at: str = "") -> dict:
    return {k: without(v, paths, f"{at}{k}.") if isinstance(v, dict) else v for k, v in config.items() if f"{at}{k}" not in paths}


def config_hash(config: dict, ignore: set[str] = frozenset()) -> str:
    """The same for configurations that differ only in key order or under the paths to ignore."""
    return hashlib.sha256(json.dumps(without(config, set(ignore)), sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]


def tasks_for(all_tasks: list[str], optional: dict[str, list[str]], config: dict) -> list[str]:
    """The tasks a configuration asks for: all but the optional ones whose switch, a path, is off."""

    def on(path: str):
        at = config
        for k in path.split("."):
            at = at.get(k) if isinstance(at, dict) else None
        return bool(at)

    off = {t for path, ts in optional.items() if not on(path) for t in ts}
    return [t for t in all_tasks if t not in off]


def resume_hash(config: dict, operational: set[str], neutral: dict[str, object] = {}) -> str:  # noqa: B006
    """What two runs must share for one to go on from the other: the hash without operational settings, such as folders and limits of time, and
    without settings that still have the value (neutral) under which they change nothing, so that a setting added later breaks no old run."""

    def at(path: str):
        x = config
        for k in path.split("."):
            x = x.get(k) if isinstance(x, dict) else None
        return x

    return config_hash(config, set(operational) | {p for p, v in neutral.items() if at(p) is None or at(p) == v})


def train_rows(sizes: dict[str, int], key: str, default: int) -> int:
    """How many training rows of a source are drawn: the number set for it, else the default; a larger set number switches the source to its larger draw."""
    n = sizes.get(key, default)
    if n < 0:
        raise ValueError(f"{key}: {n} rows")
    return n


def split_note(splits: dict[str, str], sizes: dict[str, int], key: str) -> str:
    """Where a source's splits come from, and what was set for its training draw."""
    return splits.get(key, "as published") + (f"; training draw of {sizes[key]:,} rows" if key in sizes else "")
