"""Expressions as JSON-ready dictionaries, and content-addressed names for them."""

from __future__ import annotations

import hashlib
import json

from .expr import OPERATORS, Binary, Call, Compare, Const, Expression, Negative, Var, Where

_KINDS = {"var": Var, "const": Const, "negative": Negative, "binary": Binary, "compare": Compare, "where": Where, "call": Call}
_NAMES = {c: n for n, c in _KINDS.items()}


def to_dict(e: Expression) -> dict:
    def value(v):
        if isinstance(v, Expression):
            return to_dict(v)
        return [value(x) for x in v] if isinstance(v, tuple) else v

    return {"kind": _NAMES[type(e)]} | {k: value(getattr(e, k)) for k in e.__dataclass_fields__}


def from_dict(got: dict) -> Expression:
    """The expression of `to_dict`; unknown kinds, operators and fields raise ValueError."""
    kind = _KINDS.get(got.get("kind"))
    if kind is None or set(got) - {"kind"} != set(kind.__dataclass_fields__):
        raise ValueError(f"not an expression: {got!r}")
    if kind is Call and got["op"] not in OPERATORS:
        raise ValueError(f"unknown operator {got['op']!r}")

    def value(v):
        if isinstance(v, dict):
            return from_dict(v)
        return tuple(value(x) for x in v) if isinstance(v, list) else v

    return kind(**{k: value(v) for k, v in got.items() if k != "kind"})


def stable_id(e: Expression, prefix: str = "alpha") -> str:
    digest = hashlib.sha256(json.dumps(to_dict(e), sort_keys=True).encode()).hexdigest()
    return f"{prefix}_{digest[:12]}"
