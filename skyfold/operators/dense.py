"""Direct sums between measurement rows and sources (or pixels), in numpy.

Every row meets every source, so the work is rows x sources x channels whatever
the plan; what a plan decides is what moves.  Here a task holds its rows and
one block of sources as arrays, keeps the sum over the block in registers of
numpy, and puts out one number for each row and channel: no pair becomes a
Spark row.  A sky of at most ``MOST_NUMBERS`` numbers (``MOST_NUMBERS`` x 8
bytes) is broadcast, and there is no shuffle.  A larger one is cut into blocks;
each pair of a block of rows and a block of sources is one group, and only
partial sums are shuffled.  Beyond ``DIRECT_PAIRS`` pairs the sums are made by
expansion (``operators.expansion``), whose work grows with rows + sources, where
that is less work and as exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.functions import sky
from skyfold.operators import expansion

#: Numbers of a sky that is broadcast whole: 64 MB.
MOST_NUMBERS = 8_000_000
#: Numbers of a block of a larger sky, and rows of a block that meets it.
BLOCK_NUMBERS = 1_000_000
BLOCK_ROWS = 65_536
#: Pairs of a row and a source up to which their sum is made directly, and those of a task.
DIRECT_PAIRS = 2_000_000_000
TASK_PAIRS = 20_000_000
#: Cells of a pair and a channel that are summed directly in the time of a product in matrices: about 2.5e7 and 1.7e10 a second.
MOST_WORK = 1 / 700
#: Pairs of a row and a source that are held at a time.
PAIRS = 1 << 18
#: Channels after which a phase is computed anew and not by turning the last one.
RESTART = 64

PLACE = ("l", "m", "n1")
#: The ellipse of a source: exp(-(k f)^2 ((u a1 + v a2)^2 + (u b1 + v b2)^2)).
ELLIPSE = ("a1", "a2", "b1", "b2")


@dataclass
class Sky:
    """A block of sources: places, fluxes (source, channel, correlation), ellipses."""

    place: np.ndarray  # 3 x sources
    flux: np.ndarray
    ellipse: np.ndarray | None = None  # 4 x sources


def numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def lists(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A list column whose lists have ``width`` numbers, as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def as_sky(table: pa.Table, channels: int, correlations: int) -> Sky:
    place = np.stack([numbers(table.column(c)).astype(np.float64) for c in PLACE])
    flux = lists(table.column("flux"), channels * correlations).reshape(-1, channels, correlations)
    ellipse = np.stack([numbers(table.column(c)).astype(np.float64) for c in ELLIPSE]) if "a1" in table.column_names else None
    return Sky(place, flux, ellipse)


def turns(path: np.ndarray, freqs: np.ndarray) -> Iterator[np.ndarray]:
    """exp(i path f) for each frequency; equal steps turn the last value on."""
    steps = np.diff(freqs)
    even = len(freqs) > 2 and bool(np.all(np.abs(steps - steps[0]) <= 1e-12 * np.abs(freqs[-1])))
    step = value = None
    for i, f in enumerate(freqs):
        if even and i % RESTART:
            if step is None:
                step = _expi(path * steps[0])
            value = value * step
        else:
            value = _expi(path * f)
        yield value


def _expi(phase: np.ndarray) -> np.ndarray:
    out = np.empty(phase.shape, dtype=np.complex128)
    np.cos(phase, out=out.real)
    np.sin(phase, out=out.imag)
    return out


def visibilities(uvw: np.ndarray, block: Sky, freqs: np.ndarray, sign: float) -> np.ndarray:
    """(rows, channels, correlations) complex sums over the block's sources.

    ``uvw`` has a row for each of u, v and w; ``sign`` is that of the phase.
    """
    rows, sources = uvw.shape[1], block.place.shape[1]
    out = np.zeros((rows, len(freqs), block.flux.shape[2]), dtype=np.complex128)
    if not sources:
        return out
    per = max(1, PAIRS // sources)
    narrow = (np.sqrt(2.0) * np.pi / (sky.C * sky.FWHM)) ** 2
    lit = [np.flatnonzero(block.flux[:, c].any(axis=0)).tolist() for c in range(len(freqs))]
    for lo in range(0, rows, per):
        u, v, w = (x[lo : lo + per, None] for x in uvw)
        path = (u * block.place[0] + v * block.place[1] + w * block.place[2]) * (sign * sky.TWO_PI / sky.C)
        if block.ellipse is not None:
            a1, a2, b1, b2 = block.ellipse
            spread = -narrow * ((u * a1 + v * a2) ** 2 + (u * b1 + v * b2) ** 2)
        for c, value in enumerate(turns(path, freqs)):
            if block.ellipse is not None:
                value = value * np.exp(spread * freqs[c] ** 2)
            for k in lit[c]:
                out[lo : lo + per, c, k] = value @ block.flux[:, c, k]
    return out


def ellipse(emaj: Column, emin: Column, angle: Column, flat: Column | None = None) -> list[Column]:
    """Columns ``ELLIPSE`` of a Gaussian; all 0 (a point) where ``flat`` holds."""
    point = (emaj == 0.0) if flat is None else flat | (emaj == 0.0)
    parts = [emin * F.cos(angle), -emin * F.sin(angle), emaj * F.sin(angle), emaj * F.cos(angle)]
    return [F.when(point, F.lit(0.0)).otherwise(p).alias(n) for n, p in zip(ELLIPSE, parts, strict=True)]


def place(clamp: bool = True) -> list[Column]:
    """Columns ``PLACE`` from l and m."""
    return [F.col("l").cast("double").alias("l"), F.col("m").cast("double").alias("m"), sky.n_minus_one(F.col("l"), F.col("m"), clamp).alias("n1")]


def _fetch(df: DataFrame, most: int) -> pa.Table | None:
    """``df`` at the driver if it has at most ``most`` rows."""
    found = df.limit(most + 1).toArrow()
    return found if found.num_rows <= most else None


def sum_over_sources(rows: DataFrame, sources: DataFrame, channels: Sequence[tuple[int, float]], correlations: int, sign: float, most_numbers: int = MOST_NUMBERS, block_numbers: int = BLOCK_NUMBERS, block_rows: int = BLOCK_ROWS, direct_pairs: int | None = None) -> DataFrame:
    """(row_id, chan, vis): ``vis`` is an array of (re, im) for each correlation.

    ``rows``: row_id, u, v, w; ``sources``: ``PLACE``, flux (an array, channel by
    channel, of the correlations' fluxes) and, if they are not all points,
    ``ELLIPSE``; ``channels``: (chan, frequency) pairs.
    """
    direct_pairs = DIRECT_PAIRS if direct_pairs is None else direct_pairs
    names = [c for c, _ in channels]
    freqs = np.array([f for _, f in channels], dtype=np.float64)
    width = len(PLACE) + len(ELLIPSE) + len(freqs) * correlations
    schema = f"row_id {rows.schema['row_id'].dataType.simpleString()}, chan int, vis array<struct<re:double,im:double>>"
    key = rows.schema["row_id"].dataType
    rows = rows.select("row_id", *(F.col(c).cast("double").alias(c) for c in ("u", "v", "w")))

    def put_out(ids: pa.Array, value: np.ndarray) -> pa.RecordBatch:
        n, flat = len(ids), value.reshape(-1)
        cells = pa.StructArray.from_arrays([pa.array(flat.real), pa.array(flat.imag)], names=["re", "im"])
        ends = pa.array(np.arange(0, len(flat) + 1, correlations), pa.int32())
        return pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(n), len(freqs)))), pa.array(np.tile(np.array(names, dtype=np.int32), n)), pa.ListArray.from_arrays(ends, cells)], names=["row_id", "chan", "vis"])

    def uvw_of(table: pa.RecordBatch | pa.Table) -> np.ndarray:
        return np.stack([numbers(table.column(c)) for c in ("u", "v", "w")])

    few = _fetch(sources, most_numbers // width)
    n_rows = rows.count()
    n_sources = few.num_rows if few is not None else sources.count()
    if n_rows * n_sources > direct_pairs:
        out = _by_expansion(rows, n_rows, sources, n_sources, freqs, names, correlations, sign)
        if out is not None:
            return out
    if few is not None:
        # The rows may be one small file and one task, their pairs many.
        parts = -(-n_rows * n_sources // TASK_PAIRS)
        rows = rows.repartition(parts) if parts > 1 else rows
        shared = rows.sparkSession.sparkContext.broadcast(as_sky(few, len(freqs), correlations))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield put_out(batch.column(0), visibilities(uvw_of(batch), shared.value, freqs, sign))

        return rows.mapInArrow(run, schema)

    row_blocks, sky_blocks = (max(1, -(-df.count() // n)) for df, n in ((rows, block_rows), (sources, max(1, block_numbers // width))))

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        value = visibilities(uvw_of(left), as_sky(right, len(freqs), correlations), freqs, sign)
        ids = left.column("row_id")
        return pa.Table.from_batches([put_out(ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, value)])

    partial = _block_pairs(rows, ["row_id"], row_blocks, sources, sky_blocks, pair, schema)
    sums = [F.sum(F.get("vis", F.lit(k))[part]).alias(f"_{part}{k}") for k in range(correlations) for part in ("re", "im")]
    vis = F.array(*(F.struct(F.col(f"_re{k}").alias("re"), F.col(f"_im{k}").alias("im")) for k in range(correlations)))
    return partial.groupBy("row_id", "chan").agg(*sums).select(F.col("row_id").cast(key).alias("row_id"), "chan", vis.alias("vis"))


def _by_expansion(rows: DataFrame, n_rows: int, sources: DataFrame, n_sources: int, freqs: np.ndarray, names: Sequence[int], correlations: int, sign: float) -> DataFrame | None:
    """The sum over sources by expansion; None where the field does not allow it or it is no less work."""
    if n_rows > MOST_NUMBERS // 4 or not n_sources:
        return None
    inside = F.abs(F.col("n1") - (F.sqrt(1.0 - F.col("l") * F.col("l") - F.col("m") * F.col("m")) - 1.0)) <= 1e-14
    *box, bad = sources.agg(F.min("l"), F.max("l"), F.min("m"), F.max("m"), F.sum(F.when(inside, 0).otherwise(1))).first()
    if bad:
        return None
    held = rows.toArrow()
    uvw = np.stack([numbers(held.column(c)) for c in ("u", "v", "w")])
    reach = np.nan_to_num(np.nanmax(np.abs(uvw), axis=1, initial=0.0))
    f = expansion.field(box, reach, float(np.abs(freqs).max()))
    if f is None:
        return None
    shapes = None
    if "a1" in sources.columns:
        found = sources.select(*((F.col(c) + 0.0).alias(c) for c in ELLIPSE)).distinct().limit(expansion.MOST_ELLIPSES + 1).collect()
        if len(found) > expansion.MOST_ELLIPSES or any(x is None for r in found for x in r):
            return None
        shapes = sorted(tuple(r) for r in found)
    size = 2.0 * f.held[0] * f.held[1] * len(freqs) * correlations
    work = size * (n_sources + n_rows * f.turns * len(shapes or [()]))
    if MOST_WORK * work > n_rows * n_sources * len(freqs):
        return None
    parts = expansion.expanded(held, sources, freqs.tolist(), names, correlations, sign, f, shapes, min(96, max(24, n_sources // 50_000)))
    ids = held.column("row_id").combine_chunks()
    shared = rows.sparkSession.sparkContext.broadcast(ids)
    kind = rows.schema["row_id"].dataType.simpleString()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(0, "row_id", shared.value.take(batch.column(0)))

    numbered = parts.mapInArrow(name, f"row_id {kind}, chan int, " + ", ".join(f"{p}{k} double" for k in range(correlations) for p in ("re", "im")))
    vis = F.array(*(F.struct(F.col(f"re{k}").alias("re"), F.col(f"im{k}").alias("im")) for k in range(correlations)))
    return numbered.select("row_id", "chan", vis.alias("vis"))


def _block_pairs(left: DataFrame, keys: Sequence[str], left_blocks: int, right: DataFrame, right_blocks: int, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` on every pair of a block of ``left`` and a block of ``right``."""

    def everywhere(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    a = left.withColumn("_a", F.pmod(F.xxhash64(*keys), F.lit(left_blocks)).cast("int")).withColumn("_b", everywhere(right_blocks))
    b = right.withColumn("_b", F.pmod(F.xxhash64(*right.columns), F.lit(right_blocks)).cast("int")).withColumn("_a", everywhere(left_blocks))

    def both(x: pa.Table, y: pa.Table) -> pa.Table:
        return run(x.drop_columns(["_a", "_b"]), y.drop_columns(["_a", "_b"])) if x.num_rows and y.num_rows else _empty(schema)

    return a.groupBy("_a", "_b").cogroup(b.groupBy("_a", "_b")).applyInArrow(both, schema)


def _empty(schema: str) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema)).empty_table()


def sum_over_samples(samples: DataFrame, pixels: DataFrame, by: Sequence[str], sign: float, most_numbers: int = MOST_NUMBERS, block_numbers: int = BLOCK_NUMBERS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(by, pixel, value): real part of the sum over samples of re + i im times
    exp(sign 2 pi i f / c (l u + m v + n1 w)), for each pixel and each ``by``.

    ``samples``: ``by`` (whole numbers), u, v, w, freq, re, im; ``pixels``: pixel, ``PLACE``.  A
    task keeps one sum for each pixel and ``by`` and puts them out at its end.
    """
    columns = ["u", "v", "w", "freq", "re", "im"]
    kinds = [samples.schema[c].dataType.simpleString() for c in by]
    schema = ", ".join(f"{c} {k}" for c, k in zip(by, kinds, strict=True)) + f", pixel {pixels.schema['pixel'].dataType.simpleString()}, value double"
    samples = samples.select(*by, *(F.col(c).cast("double").alias(c) for c in columns))
    pixels = pixels.select("pixel", *PLACE)

    class Sums:
        def __init__(self, table: pa.Table) -> None:
            self.pixel = table.column("pixel").combine_chunks()
            self.place = np.stack([numbers(table.column(c)).astype(np.float64) for c in PLACE])
            self.held: dict[tuple, np.ndarray] = {}

        def add(self, table: pa.RecordBatch | pa.Table) -> None:
            keys = np.stack([numbers(table.column(c)).astype(np.int64) for c in by])
            data = np.stack([numbers(table.column(c)) for c in columns])
            order = np.lexsort(keys[::-1])
            keys, data = keys[:, order], data[:, order]
            edges = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
            per = max(1, PAIRS // max(1, self.place.shape[1]))
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), keys.shape[1]], strict=True):
                total = self.held.setdefault(tuple(keys[:, lo].tolist()), np.zeros(self.place.shape[1]))
                for at in range(lo, hi, per):
                    u, v, w, f, re, im = (x[at : min(hi, at + per), None] for x in data)
                    k = f * (sign * sky.TWO_PI / sky.C)
                    phase = (u * k) * self.place[0] + (v * k) * self.place[1] + (w * k) * self.place[2]
                    total += np.einsum("rs,r->s", np.cos(phase), re[:, 0]) - np.einsum("rs,r->s", np.sin(phase), im[:, 0])

        def put_out(self) -> pa.RecordBatch:
            n = len(self.pixel)
            parts = [pa.array(np.repeat(np.array([k[i] for k in self.held], dtype=np.int64), n)).cast(t) for i, t in enumerate(kept)]
            value = np.concatenate(list(self.held.values())) if self.held else np.zeros(0)
            return pa.RecordBatch.from_arrays([*parts, pa.concat_arrays([self.pixel] * len(self.held)) if self.held else self.pixel.slice(0, 0), pa.array(value)], names=[*by, "pixel", "value"])

    kept = [pa.int32() if k == "int" else pa.int64() for k in kinds]
    few = _fetch(pixels, most_numbers // (len(PLACE) + 1))
    if few is not None:
        shared = samples.sparkSession.sparkContext.broadcast(few)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = Sums(shared.value)
            for batch in batches:
                sums.add(batch)
            yield sums.put_out()

        partial = samples.mapInArrow(run, schema)
    else:

        def pair(left: pa.Table, right: pa.Table) -> pa.Table:
            sums = Sums(right)
            sums.add(left)
            return pa.Table.from_batches([sums.put_out()])

        blocks = max(1, -(-samples.count() // block_rows)), max(1, -(-pixels.count() // (block_numbers // (len(PLACE) + 1))))
        partial = _block_pairs(samples, [*by, *columns], blocks[0], pixels, blocks[1], pair, schema)
    return partial.groupBy(*by, "pixel").agg(F.sum("value").alias("value"))


def spectral_window(channels: DataFrame, most: int = 1_000_000) -> list[tuple[int, float]]:
    """(chan, frequency) of the channels, in order; a spectral window is a bounded list."""
    found = channels.select("chan", "freq").distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a spectral window of more than {most} channels")
    return sorted((r.chan, float(r.freq)) for r in found)
