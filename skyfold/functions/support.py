"""Small helpers of the command line and of optional parts."""

from __future__ import annotations

import ast
import builtins
import functools
import importlib
from collections.abc import Callable

#: Builtins that an assignment may call (fixed values).
_CALLS = frozenset(["dict", "int", "float", "list", "set", "slice", "str", "tuple"])


def correlation_shape(n: int, kind: str) -> tuple[int, ...]:
    """Shape of ``n`` correlations, "flat" or as a "matrix"."""
    if kind == "flat":
        return (n,)
    if kind != "matrix":
        raise ValueError("a shape is 'flat' or 'matrix'")
    if n not in (1, 2, 4):
        raise ValueError("a matrix has 1, 2 or 4 correlations")
    return (2, 2) if n == 4 else (n,)


def parse_assignments(text: str | None) -> dict[str, object]:
    """``a=1; b=[2,3]`` as a dictionary; values are literals or calls of a few builtins."""

    def value(node: ast.expr) -> object:
        if not isinstance(node, ast.Call):
            return ast.literal_eval(node)
        if not isinstance(node.func, ast.Name) or node.func.id not in _CALLS:
            raise ValueError(f"may not be called: {ast.unparse(node.func)}")
        return getattr(builtins, node.func.id)(*map(value, node.args), **{k.arg: value(k.value) for k in node.keywords if k.arg})

    found: dict[str, object] = {}
    for statement in ast.parse(text or "").body:
        if not isinstance(statement, ast.Assign) or not all(isinstance(t, ast.Name) for t in statement.targets):
            raise ValueError(f"not an assignment to a name: {ast.unparse(statement)!r}")
        for target in statement.targets:
            found[target.id] = value(statement.value)  # type: ignore[attr-defined]
    return found


class MissingPackage(ImportError):
    """A function was called whose package is not installed."""


def requires(*packages: str) -> Callable[[Callable], Callable]:
    """Decorator: a call raises :class:`MissingPackage` if a package cannot be imported."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def call(*args, **kwargs):
            missing = []
            for p in packages:
                try:
                    importlib.import_module(p)
                except ImportError:
                    missing.append(p)
            if missing:
                raise MissingPackage(f"{f.__name__} needs {', '.join(missing)}")
            return f(*args, **kwargs)

        return call

    return wrap
