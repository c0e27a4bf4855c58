"""Checks of arguments on the driver."""

from __future__ import annotations


def positive(name: str, value, strict: bool = True) -> None:
    if not (value > 0 if strict else value >= 0):
        raise ValueError(f"{name} must be {'positive' if strict else 'at least 0'}, not {value!r}")


def of_type(name: str, value, *types: type) -> None:
    if not isinstance(value, types):
        raise TypeError(f"{name} must be {' or '.join(t.__name__ for t in types)}, not {type(value).__name__}")


def is_callable(name: str, value) -> None:
    if not callable(value):
        raise TypeError(f"{name} must be callable")


def one_of(name: str, value, allowed) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {list(allowed)}, not {value!r}")
