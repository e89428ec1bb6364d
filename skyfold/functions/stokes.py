"""Conversion between Stokes parameters and correlations, planned on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from skyfold.functions.cplx import Complex, imag, real

# The numbers that measurement sets give to Stokes and correlation types.
TYPE_IDS = {
    "I": 1, "Q": 2, "U": 3, "V": 4, "RR": 5, "RL": 6, "LR": 7, "LL": 8, "XX": 9, "XY": 10, "YX": 11, "YY": 12,
    "RX": 13, "RY": 14, "LX": 15, "LY": 16, "XR": 17, "XL": 18, "YR": 19, "YL": 20, "PP": 21, "PQ": 22, "QP": 23, "QQ": 24,
    "RCircular": 25, "LCircular": 26, "Linear": 27, "Ptotal": 28, "Plinear": 29, "PFtotal": 30, "PFlinear": 31, "Pangle": 32,
}
TYPE_NAMES = {i: n for n, i in TYPE_IDS.items()}

# A correlation is (first + factor * second); a Stokes parameter is half of that sum.
_FROM_STOKES = {
    "XX": [("I", 1, "Q")], "XY": [("U", 1j, "V")], "YX": [("U", -1j, "V")], "YY": [("I", -1, "Q")],
    "RR": [("I", 1, "V")], "RL": [("Q", 1j, "U")], "LR": [("Q", -1j, "U")], "LL": [("I", -1, "V")],
}
_TO_STOKES = {
    "I": [("XX", 1, 1, "YY"), ("RR", 1, 1, "LL")],
    "Q": [("XX", 1, -1, "YY"), ("RL", 1, 1, "LR")],
    "U": [("XY", 1, 1, "YX"), ("RL", -1j, 1j, "LR")],
    "V": [("XY", -1j, 1j, "YX"), ("RR", 1, -1, "LL")],
}


class MissingInput(ValueError):
    """An output that the given inputs do not determine."""


def flatten(schema: object) -> list[str]:
    """Names of a nested list of names or type numbers, in order."""
    if isinstance(schema, str):
        return [schema]
    if isinstance(schema, int):
        return [TYPE_NAMES[schema]]
    return [n for s in schema for n in flatten(s)]  # type: ignore[attr-defined]


def _times(x: Complex, factor: complex) -> Complex:
    if factor == 1:
        return x
    if factor == -1:
        return -x
    return x * (imag(factor.imag) if isinstance(factor, complex) and factor.real == 0 else real(float(factor.real)))


def convert(values: Mapping[str, Complex], outputs: Sequence[object], implicit_stokes: bool = False) -> list[Complex]:
    """Each output from the inputs by name.

    An output that is itself an input is passed on.  Of several ways the first
    whose inputs are all there is taken; with ``implicit_stokes`` a missing
    Stokes input counts as 0, if at least one of a way's inputs is there.
    """
    out = []
    for name in flatten(list(outputs)):
        if name in values:
            out.append(values[name])
        elif name in _FROM_STOKES:
            out.append(_correlation(values, name, implicit_stokes))
        elif name in _TO_STOKES:
            for a, fa, fb, b in _TO_STOKES[name]:
                if a in values and b in values:
                    out.append((_times(values[a], fa) + _times(values[b], fb)).scale(0.5))
                    break
            else:
                raise MissingInput(f"{name} needs one of {[(w[0], w[3]) for w in _TO_STOKES[name]]}, there are {sorted(values)}")
        else:
            raise MissingInput(f"{name} is neither a Stokes parameter nor a known correlation")
    return out


def _correlation(values: Mapping[str, Complex], name: str, implicit: bool) -> Complex:
    for a, factor, b in _FROM_STOKES[name]:
        if a in values and b in values:
            return values[a] + _times(values[b], factor)
        if implicit:
            first = values[a] if a in values else real(0.0)
            return first + _times(values[b], factor) if b in values else first
    # Correlations of the other feed type go by way of the Stokes parameters.
    needed = {s for a, _, b in _FROM_STOKES[name] for s in (a, b)}
    try:
        stokes = dict(zip(sorted(needed), convert({k: v for k, v in values.items() if k not in _TO_STOKES}, sorted(needed)), strict=True))
    except MissingInput as e:
        raise MissingInput(f"{name} needs {sorted(needed)}, there are {sorted(values)}") from e
    return _correlation(stokes, name, False)
