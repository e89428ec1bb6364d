"""A small equation language: ``(Kpq, Bpq): [I,Q,U,V] -> [XX,XY,YX,YY]``.

Terms are named by a letter and a place: ``p`` stands left, ``pq`` in the middle,
``q`` right and conjugate-transposed.  Each term gives one, two or four complex
Columns for a (source, row, channel); their product, in the order written, is
summed over sources.  Parsing happens on the driver; the product becomes one
projection that Catalyst compiles together with the sum.

A term is any subclass of :class:`Term`; what it needs but the data lack comes
from a :class:`Transformer` that yields it.
"""

from __future__ import annotations

import ast
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.functions import cplx, sky, stokes
from skyfold.functions.cplx import Complex
from skyfold.operators import dense
from skyfold.operators.predict import small

#: Channels up to which a source's factors are computed for each.
MOST_SUMMED = 64
STOKES = ("I", "Q", "U", "V")
LINEAR, CIRCULAR = ("XX", "XY", "YX", "YY"), ("RR", "RL", "LR", "LL")


class RimeError(ValueError):
    """A specification that cannot be read or fulfilled."""


@dataclass(frozen=True)
class Spec:
    terms: tuple[tuple[str, str], ...]  # (letter, place)
    stokes: tuple[str, ...]
    correlations: tuple[str, ...]

    @property
    def feed_type(self) -> str:
        linear = [c for c in self.correlations if c in LINEAR]
        circular = [c for c in self.correlations if c in CIRCULAR]
        if linear and circular:
            raise RimeError("linear and circular feeds do not mix")
        return "circular" if circular else "linear"


def _names(text: str) -> list[str]:
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise RimeError(f"cannot be read: {text!r}") from e

    def walk(node: ast.expr) -> list[str]:
        if isinstance(node, ast.Name):
            return [node.id]
        if isinstance(node, ast.List | ast.Tuple):
            return [n for x in node.elts for n in walk(x)]
        raise RimeError(f"not a name: {ast.unparse(node)!r}")

    return walk(tree)


def parse(text: str) -> Spec:
    left, colon, rest = text.partition(":")
    before, arrow, after = rest.partition("->")
    if not colon or not arrow:
        raise RimeError("a specification reads '(terms): [stokes] -> [correlations]'")
    terms = []
    for name in _names(left):
        place = "pq" if name.endswith("pq") else name[-1:]
        if place not in ("p", "q", "pq") or len(name) <= len(place):
            raise RimeError(f"a term ends in p, pq or q: {name!r}")
        terms.append((name[: -len(place)], place))
    if not terms:
        raise RimeError("there are no terms")
    st, corr = _names(before), _names(after)
    for n, known in ((st, STOKES), (corr, (*LINEAR, *CIRCULAR))):
        if bad := [x for x in n if x not in known]:
            raise RimeError(f"not known: {bad}")
    spec = Spec(tuple(terms), tuple(st), tuple(corr))
    _ = spec.feed_type
    return spec


class Term:
    """A factor of the equation: Columns of one, two or four complex numbers."""

    #: Columns that the term reads.
    needs: tuple[str, ...] = ()

    def columns(self, spec: Spec, antenna: str) -> list[Complex]:
        raise NotImplementedError


class Phase(Term):
    needs = ("l", "m", "u", "v", "w", "freq")

    def __init__(self, convention: str = "fourier") -> None:
        self.convention = convention

    def columns(self, spec: Spec, antenna: str) -> list[Complex]:
        return [cplx.expi(sky.phase(F.col("_path"), F.col("freq"), self.convention))]


class Brightness(Term):
    """Correlations from Stokes parameters with a power law (column ``spi``)."""

    needs = ("stokes", "spi", "freq", "ref_freq")

    def columns(self, spec: Spec, antenna: str) -> list[Complex]:
        flux = {}
        for i, name in enumerate(spec.stokes):
            value = F.get("stokes", F.lit(i))
            flux[name] = cplx.real(sky.spectral_model(value, F.col("spi"), F.col("ref_freq"), F.col("freq")))
        out = stokes.convert(flux, spec.correlations, implicit_stokes=True)
        if len(out) not in (1, 2, 4):
            raise RimeError("there are one, two or four correlations")
        return out


class GaussianShape(Term):
    needs = ("u", "v", "freq", "emaj", "emin", "pa")

    def columns(self, spec: Spec, antenna: str) -> list[Complex]:
        return [cplx.real(sky.gaussian(*(F.col(c) for c in ("u", "v", "freq", "emaj", "emin", "pa"))))]


class FeedRotation(Term):
    needs = ("feed_angle_p", "feed_angle_q")

    def columns(self, spec: Spec, antenna: str) -> list[Complex]:
        return sky.feed_rotation(F.col(f"feed_angle_{antenna}"), spec.feed_type)


class BeamTerm(Term):
    """Beam values that were joined beforehand as ``beam_p`` and ``beam_q`` (see ``beam_cube_dde``)."""

    needs = ("beam_p", "beam_q")

    def columns(self, spec: Spec, antenna: str) -> list[Complex]:
        return cplx.entries(F.col(f"beam_{antenna}"), len(spec.correlations))


class Transformer:
    """Derives missing columns: ``inputs`` -> ``outputs``."""

    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


@dataclass
class LM(Transformer):
    """l and m from right ascension and declination about a phase centre."""

    ra0: float = 0.0
    dec0: float = 0.0
    inputs: tuple[str, ...] = ("ra", "dec")
    outputs: tuple[str, ...] = ("l", "m")

    def apply(self, df: DataFrame) -> DataFrame:
        l, m = sky.radec_to_lm(F.col("ra"), F.col("dec"), self.ra0, self.dec0)
        return df.withColumns({"l": l, "m": m})


@dataclass
class ParallacticAngles(Transformer):
    """Feed angles of both antennas from time and position (the test backend)."""

    inputs: tuple[str, ...] = ("time", "x_p", "y_p", "z_p", "x_q", "y_q", "z_q")
    outputs: tuple[str, ...] = ("feed_angle_p", "feed_angle_q")

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"feed_angle_{a}": sky.parallactic_angle_test(F.col("time"), F.col(f"x_{a}"), F.col(f"y_{a}"), F.col(f"z_{a}")) for a in "pq"})


DEFAULT_TERMS: dict[str, Term] = {"K": Phase(), "B": Brightness(), "L": FeedRotation(), "E": BeamTerm(), "G": GaussianShape()}


@dataclass
class Rime:
    """A specification with the terms and transformers that fulfil it."""

    spec: Spec
    terms: Mapping[str, Term] = field(default_factory=lambda: DEFAULT_TERMS)
    transformers: Sequence[Transformer] = (LM(), ParallacticAngles())

    def _resolve(self, df: DataFrame, names: set[str]) -> DataFrame:
        for _ in range(len(self.transformers) + 1):
            missing = names - set(df.columns)
            if not missing:
                return df
            for t in self.transformers:
                if missing & set(t.outputs) and set(t.inputs) <= set(df.columns):
                    df = t.apply(df)
                    break
            else:
                makers = {m: [t.inputs for t in self.transformers if m in t.outputs] for m in sorted(missing)}
                raise RimeError(f"missing inputs, with what would yield them: {makers}")
        return df

    def run(self, main: DataFrame, sources: DataFrame, channels: DataFrame) -> DataFrame:
        """(row_id, chan, vis): the sum over sources; vis is an array of complex structs."""
        unknown = [n for n, _ in self.spec.terms if n not in self.terms]
        if unknown:
            raise RimeError(f"no term for {unknown}")
        used = [self.terms[n] for n, _ in self.spec.terms]
        needs = {c for t in used for c in t.needs}
        sources = self._resolve(sources, needs & ({"l", "m"} if "l" in needs else set()))
        main = self._derive(main, needs)
        if {"l", "m"} <= set(sources.columns):
            sources = sources.withColumn("_n1", sky.n_minus_one(F.col("l"), F.col("m")))
        known = set(sources.columns) | {"freq"}
        phases = [i for i, ((_, place), t) in enumerate(zip(self.spec.terms, used, strict=True)) if type(t) is Phase and place == "pq"]
        if len(phases) == 1 and {"u", "v", "w"} <= set(main.columns) and all(set(t.needs) <= known for i, t in enumerate(used) if i not in phases) and "freq" not in sources.columns:
            spw = dense.spectral_window(channels)
            if len(spw) <= MOST_SUMMED:
                return self._sum(main, sources, spw, used, phases[0])
        lit = sources.crossJoin(small(channels))
        # A factor that hangs on the source and channel alone, or on the row
        # alone, is computed there, once, and crossed in as numbers.
        factors: list[list[Complex] | None] = []
        for i, ((_, place), term) in enumerate(zip(self.spec.terms, used, strict=True)):
            antenna = "q" if place == "q" else "p"
            early = None
            for side, df in (("lit", lit), ("main", main)):
                if set(term.needs) <= set(df.columns) and early is None:
                    early = term.columns(self.spec, antenna)
                    parts = {f"_f{i}_{k}_{p}": c for k, x in enumerate(early) for p, c in (("re", x.re), ("im", x.im))}
                    df = df.withColumns(parts)
                    lit, main = (df, main) if side == "lit" else (lit, df)
                    early = [Complex(F.col(f"_f{i}_{k}_re"), F.col(f"_f{i}_{k}_im")) for k in range(len(early))]
            factors.append(early)
        late = {c for t, f in zip(used, factors, strict=True) if f is None for c in t.needs}
        if "_n1" in lit.columns and {"u", "v", "w"} <= set(main.columns):
            late |= {"l", "m", "u", "v", "w", "_n1"}
        kept = {"row_id", "chan"} | late | {i for t in self.transformers if set(t.outputs) & late for i in t.inputs}

        def needed(df: DataFrame) -> DataFrame:
            return df.select(*(c for c in df.columns if c in kept or c.startswith("_f")))

        cells = needed(main).crossJoin(small(needed(lit)))
        if {"l", "m", "u", "v", "w", "_n1"} <= set(cells.columns):
            cells = cells.withColumn("_path", F.col("l") * F.col("u") + F.col("m") * F.col("v") + F.col("_n1") * F.col("w"))
        cells = self._resolve(cells, late - {"_n1"})
        product: list[Complex] | None = None
        for (_, place), term, early in zip(self.spec.terms, used, factors, strict=True):
            factor = early if early is not None else term.columns(self.spec, "q" if place == "q" else "p")
            factor = cplx.hermitian(factor) if place == "q" else factor
            product = factor if product is None else cplx.matmul(product, factor)
        n = len(product)
        values = cells.select("row_id", "chan", *(c.alias(f"_{p}{i}") for i, x in enumerate(product) for p, c in (("re", x.re), ("im", x.im))))
        sums = values.groupBy("row_id", "chan").agg(*(F.sum(f"_{p}{i}").alias(f"_{p}{i}") for i in range(n) for p in ("re", "im")))
        vis = F.array(*(F.struct(F.col(f"_re{i}").alias("re"), F.col(f"_im{i}").alias("im")) for i in range(n)))
        return sums.select("row_id", "chan", vis.alias("vis"))

    def _sum(self, main: DataFrame, sources: DataFrame, spw: list[tuple[int, float]], used: list[Term], phase: int) -> DataFrame:
        """The sum where rows and sources meet in the phase alone: no pair becomes a row."""
        n = 1
        for _, f in spw:
            sources = sources.withColumn("freq", F.lit(f))
            product: list[Complex] = [cplx.real(1.0)]
            for i, ((_, place), term) in enumerate(zip(self.spec.terms, used, strict=True)):
                if i != phase:
                    factor = term.columns(self.spec, "q" if place == "q" else "p")
                    product = cplx.matmul(product, cplx.hermitian(factor) if place == "q" else factor)
            n = len(product)
            sources = sources.withColumn(f"_p{f!r}", F.array(*(c for x in product for c in (x.re, x.im))))
        # Real and imaginary parts are summed as correlations of their own; those of zeros cost nothing.
        flux = F.concat(*(F.col(f"`_p{f!r}`") for _, f in spw))
        out = dense.sum_over_sources(main, sources.select(*dense.place(), flux.alias("flux")), spw, 2 * n, {"fourier": -1.0, "casa": 1.0}[used[phase].convention])
        parts = cplx.entries(F.col("vis"), 2 * n)
        vis = F.array(*((a + Complex(-b.im, b.re)).struct() for a, b in zip(parts[::2], parts[1::2], strict=True)))
        return out.select("row_id", "chan", vis.alias("vis"))

    def _derive(self, df: DataFrame, names: set[str]) -> DataFrame:
        """``df`` with what transformers can make of it alone."""
        for _ in self.transformers:
            for t in self.transformers:
                if (names - set(df.columns)) & set(t.outputs) and set(t.inputs) <= set(df.columns):
                    df = t.apply(df)
        return df


def rime(text: str, main: DataFrame, sources: DataFrame, channels: DataFrame, terms: Mapping[str, Term] | None = None, transformers: Sequence[Transformer] | None = None) -> DataFrame:
    """Visibilities of a specification; ``terms`` adds to the built-in ones."""
    return Rime(parse(text), DEFAULT_TERMS | dict(terms or {}), transformers if transformers is not None else (LM(), ParallacticAngles())).run(main, sources, channels)
