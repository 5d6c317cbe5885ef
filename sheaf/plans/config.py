"""Configuration files with inheritance (S13, F2), identities (T15), and sweeps over them."""

from __future__ import annotations

import copy
import functools
import hashlib
import itertools
import json
import re
from collections.abc import Mapping
from pathlib import Path
from typing import Any

import yaml

from . import registry

SECTIONS = {"name", "corpus", "index", "query", "eval", "notes"}
STAGES = {"index": ("loader", "chunker", "embedder", "indexer"), "query": ("query_transform", "retriever", "prompt", "generator"), "lists": ("post_retrieval", "post_generation")}


class ConfigError(ValueError):
    """A file that is missing, refers to itself, or doesn't fit."""


def merge(base: Mapping[str, Any], change: Mapping[str, Any]) -> dict[str, Any]:
    """Mappings merge, all else is replaced, and a component of another type drops the old one's options."""
    out = dict(base)
    for key, value in change.items():
        old = out.get(key)
        both = isinstance(old, Mapping) and isinstance(value, Mapping)
        other_type = both and "type" in old and "type" in value and old["type"] != value["type"]
        out[key] = merge(old, value) if both and not other_type else copy.deepcopy(value)
    return out


def _read(path: str | Path, folders: list[Path]) -> tuple[Path, dict[str, Any]]:
    """A YAML file, looked for in the folders, and its content."""
    name = Path(path).with_suffix(Path(path).suffix or ".yaml")
    for folder in folders:
        if (at := folder / name).exists():  # an absolute name stays as it is
            content = yaml.safe_load(at.read_text(encoding="utf-8"))
            if content is not None and not isinstance(content, dict):
                raise ConfigError(f"{at} is not a mapping")
            return at.resolve(), content or {}
    raise ConfigError(f"no configuration {path} in {', '.join(map(str, folders))}")


def load_raw(path: str | Path, folder: str | Path | None = None) -> dict[str, Any]:
    """A YAML file over what it extends: the chain is read upwards first, then merged from its root down."""
    chain: dict[Path, dict[str, Any]] = {}
    wanted: str | Path | None = path
    folders = [Path(folder)] if folder else []
    while wanted is not None:
        at, content = _read(wanted, [*folders, Path.cwd()])
        if at in chain:
            raise ConfigError("a configuration extends itself: " + " -> ".join(p.name for p in (*chain, at)))
        wanted = content.pop("extends", None)
        chain[at] = content
        folders = folders or [at.parent]
    return functools.reduce(merge, reversed(chain.values()))


def validate(raw: Mapping[str, Any]) -> Mapping[str, Any]:
    """Names of sections and stages, and each component's options against its signature."""
    if unknown := set(raw) - SECTIONS:
        raise ConfigError(f"unknown sections: {sorted(unknown)}")
    for section in ("index", "query"):
        own = raw.get(section) or {}
        allowed = set(STAGES[section]) | (set(STAGES["lists"]) if section == "query" else set())
        if unknown := set(own) - allowed:
            raise ConfigError(f"unknown stages in {section}: {sorted(unknown)}")
        for kind, spec in own.items():
            for one in spec if isinstance(spec, list) else [spec]:
                registry.check(kind, one)
    return raw


def load(path: str | Path, folder: str | Path | None = None) -> Mapping[str, Any]:
    return validate(load_raw(path, folder))


def _digest(value: Any, size: int = 12) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, default=repr).encode()).hexdigest()[:size]


def config_hash(raw: Mapping[str, Any]) -> str:
    """Identity of an experiment; its name is a label."""
    return _digest({k: v for k, v in raw.items() if k != "name"})


def index_signature(raw: Mapping[str, Any], corpus: str) -> str:
    """Identity of an index: what the query side does never changes it."""
    return _digest({"index": raw.get("index"), "corpus": corpus})


def value_at(raw: Mapping[str, Any], dotted: str) -> Any:
    """The value of a leaf, which must exist."""
    try:
        return functools.reduce(lambda at, key: at[key], dotted.split("."), raw)
    except (KeyError, TypeError, IndexError):
        raise ConfigError(f"no {dotted} in the base configuration") from None


def changed(raw: Mapping[str, Any], dotted: str, value: Any) -> dict[str, Any]:
    """A copy with another value at a leaf that exists; another `type` drops the options beside it."""
    key, _, rest = dotted.partition(".")
    value_at(raw, dotted)
    if rest:
        return {**raw, key: changed(raw[key], rest, value)}
    return {key: value} if key == "type" and raw[key] != value else {**raw, key: value}


def expand(base: Mapping[str, Any], axes: Mapping[str, list], mode: str = "ablation") -> list[dict[str, Any]]:
    """The base, then one axis at a time or all combinations; equal contents run once. A variant's name, which also
    names its folder, tells what was changed."""
    for dotted in axes:
        value_at(base, dotted)
    match mode:
        case "ablation":
            changes = [[(axis, v)] for axis, values in axes.items() for v in values]
        case "grid":
            changes = [list(zip(axes, values, strict=True)) for values in itertools.product(*axes.values())]
        case _:
            raise ConfigError(f"unknown mode {mode!r}")
    variants = {config_hash(base): copy.deepcopy(dict(base))}
    for own in changes:
        made = copy.deepcopy(functools.reduce(lambda raw, change: changed(raw, *change), own, dict(base)))
        told = (f"{dotted.rpartition('.')[2]}-{value if isinstance(value, str | int | float) else _digest(value, 6)}" for dotted, value in sorted(own))
        made["name"] = f"{base.get('name', 'base')}__" + "_".join(re.sub(r"[^\w-]+", "-", t).strip("-")[:40] for t in told)
        variants.setdefault(config_hash(made), made)
    return list(variants.values())


def plan(base: Mapping[str, Any], axes: Mapping[str, list], mode: str = "ablation") -> dict[str, Any]:
    """Every variant checked before the first runs, and which of them need an index of their own."""
    variants = [validate(v) for v in expand(base, axes, mode)]
    return {
        "mode": mode, "n_variants": len(variants), "n_indexes": len({index_signature(v, v.get("corpus", "")) for v in variants}),
        "axes": {axis: len(values) for axis, values in axes.items()}, "reindex_axes": sorted(axis for axis in axes if axis.partition(".")[0] == "index"),
    }


def run_all(variants: list[dict[str, Any]], run) -> list[tuple[str, Any, str | None]]:
    """(name, result, error) of each; one that fails doesn't stop the others."""
    out = []
    for v in variants:
        try:
            out.append((v.get("name", ""), run(v), None))
        except Exception as error:  # noqa: BLE001  recorded, not swallowed
            out.append((v.get("name", ""), None, f"{type(error).__name__}: {error}"))
    return out
