"""Named components with checked options (F1)."""

from __future__ import annotations

import difflib
import inspect
from collections.abc import Callable, Mapping
from typing import Any

_components: dict[str, dict[str, Callable]] = {}


class RegistryError(ValueError):
    """An unknown name, an unknown or missing option, or two components of one name."""


def register(kind: str, name: str) -> Callable[[Callable], Callable]:
    def add(component: Callable) -> Callable:
        known = _components.setdefault(kind, {})
        if known.get(name, component) is not component:
            raise RegistryError(f"{kind} {name!r} is registered already")
        known[name] = component
        return component

    return add


def available(kind: str) -> list[str]:
    return sorted(_components.get(kind, {}))


def _hint(word: str, known: list[str]) -> str:
    near = difflib.get_close_matches(word, known, 1)
    return f"; did you mean {near[0]!r}?" if near else f"; known: {', '.join(known)}"


def lookup(kind: str, name: str) -> Callable:
    if kind not in _components:
        raise RegistryError(f"unknown kind {kind!r}{_hint(kind, sorted(_components))}")
    if name not in _components[kind]:
        raise RegistryError(f"unknown {kind} {name!r}{_hint(name, available(kind))}")
    return _components[kind][name]


def check(kind: str, spec: Mapping[str, Any], injected: tuple[str, ...] = ()) -> Callable:
    """The component of a spec, once its options fit the signature."""
    if "type" not in spec:
        raise RegistryError(f"{kind} needs a type")
    component = lookup(kind, spec["type"])
    declared = inspect.signature(component).parameters
    options = {k for k in spec if k != "type"}
    for name in sorted(options - set(declared)):
        raise RegistryError(f"{kind} {spec['type']!r} has no option {name!r}{_hint(name, sorted(declared))}")
    if clash := options & set(injected) & set(declared):
        raise RegistryError(f"{kind} {spec['type']!r}: {sorted(clash)} is set by the pipeline")
    missing = [n for n, p in declared.items() if p.default is p.empty and p.kind is p.POSITIONAL_OR_KEYWORD and n not in options and n not in injected]
    if missing:
        raise RegistryError(f"{kind} {spec['type']!r} needs {', '.join(missing)}")
    return component


def build(kind: str, spec: Mapping[str, Any], **injected: Any) -> Any:
    """Make a component from {"type": name, **options}; of what is injected it gets what it declares."""
    component = check(kind, spec, tuple(injected))
    declared = inspect.signature(component).parameters
    return component(**{k: v for k, v in spec.items() if k != "type"}, **{k: v for k, v in injected.items() if k in declared})
