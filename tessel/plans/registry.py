"""Extension points: named transforms by kind, as DataFrame -> DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

KINDS = ("decode", "select", "encode", "prune", "backend", "orchestrate", "score")
_KNOWN: dict[str, dict[str, Callable]] = {k: {} for k in KINDS}


def register(kind: str, name: str) -> Callable[[Callable], Callable]:
    if kind not in _KNOWN:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(KINDS)}")

    def put(f: Callable) -> Callable:
        if name in _KNOWN[kind]:
            raise ValueError(f"{kind} {name!r} is registered already")
        _KNOWN[kind][name] = f
        return f

    return put


def get(kind: str, name: str) -> Callable:
    if name not in _KNOWN.get(kind, {}):
        raise KeyError(f"unknown {kind} {name!r}; known: {', '.join(available(kind))}")
    return _KNOWN[kind][name]


def available(kind: str) -> list[str]:
    return sorted(_KNOWN.get(kind, {}))
