"""Flag-aware averaging in time and channel, fixed and baseline-dependent.

A measurement row has ``row_id, time, interval, antenna1, antenna2`` and, where
they exist, ``flag_row, time_centroid, exposure, u, v, w, weight, sigma``; a cell
has ``row_id, chan, corr, re, im`` and, where they exist, ``flag, weight, sigma``.
Averages are ordinary hash aggregates with partial sums before the shuffle.
Only the assignment of rows to bins depends on order: it runs over the sorted
rows of a baseline in an Arrow function that takes the rows as they stream by.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfold.functions.sky import C, decorrelation_phase
from skyfold.operators.lineage import cut
from skyfold.operators.predict import small

BASELINE = ("antenna1", "antenna2")


class DuplicateSample(ValueError):
    """Two rows of one baseline at one time."""


# ------------------------------------------------------------------------- keys
def unique_time(main: DataFrame) -> DataFrame:
    """(time, n_rows, first_row, time_idx) of the distinct times."""
    found = main.groupBy("time").agg(F.count("*").alias("n_rows"), F.min("row_id").alias("first_row"))
    return with_dense_index(found, ["time"], "time_idx")


def unique_baselines(main: DataFrame) -> DataFrame:
    """(antenna1, antenna2, n_rows, first_row, baseline), numbered by (antenna2, antenna1)."""
    found = main.groupBy(*BASELINE).agg(F.count("*").alias("n_rows"), F.min("row_id").alias("first_row"))
    return with_dense_index(found, ["antenna2", "antenna1"], "baseline")


def row_indices(main: DataFrame) -> DataFrame:
    """(row_id, time_idx, baseline): for each row its place among the distinct times and baselines.

    Both tables of distinct values are joined back; times may be many, so that
    join is left to Spark.
    """
    times = unique_time(main).select("time", "time_idx")
    pairs = unique_baselines(main).select(*BASELINE, "baseline")
    return main.select("row_id", "time", *BASELINE).join(times, "time").join(small(pairs), list(BASELINE)).select("row_id", "time_idx", "baseline")


def with_dense_index(distinct: DataFrame, order: list[str], name: str) -> DataFrame:
    """Numbers 0, 1, ... in the order of distinct rows.

    The rows are range-partitioned, counted per partition, and numbered within
    it, so that no single task sorts all of them.  The numbered rows are written
    once: both the counts and the result read the same partitions, whatever is
    lost in between.
    """
    from pyspark.sql.window import Window

    ranged = distinct.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    within = cut(ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order))))
    sizes = within.groupBy("_part").agg(F.max("_n").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    joined = within.join(F.broadcast(before), "_part")  # a row for each partition
    return joined.withColumn(name, (F.col("_before") + F.col("_n") - 1).cast("int")).drop("_part", "_n", "_before")


# ------------------------------------------------------------------------ flags
def merge_flags(main: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(row_id, flag_row): a row is flagged if all its cells are.

    With both row and cell flags every row's flag must say the same.
    """
    by_row = cells.groupBy("row_id").agg(F.bool_and("flag").alias("all_flagged")) if cells is not None and "flag" in cells.columns else None
    if by_row is None:
        if "flag_row" not in main.columns:
            raise ValueError("there are neither row nor cell flags")
        return main.select("row_id", "flag_row")
    if "flag_row" not in main.columns:
        return by_row.withColumnRenamed("all_flagged", "flag_row")
    both = main.select("row_id", "flag_row").join(by_row, "row_id")
    same = F.col("flag_row") == F.col("all_flagged")
    return both.select("row_id", F.when(same, F.col("flag_row")).otherwise(F.raise_error(F.lit("flag_row differs from the row's cell flags")).cast("boolean")).alias("flag_row"))


def flag_mismatches(main: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows whose flag differs from what their cells say."""
    by_row = cells.groupBy("row_id").agg(F.bool_and("flag").alias("all_flagged"))
    return main.select("row_id", "flag_row").join(by_row, "row_id").filter("flag_row <> all_flagged")


def _flag(columns: list[str], name: str = "flag_row") -> Column:
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False)) if name in columns else F.lit(False)


# ------------------------------------------------------------------- row binning
class TimeBins:
    """Greedy time bins of one baseline, fed with its rows in order of time."""

    def __init__(self, time_bin_secs: float) -> None:
        self.secs, self.number, self.low = time_bin_secs, -1, 0.0

    def feed(self, rows: np.ndarray, data: dict[str, np.ndarray]) -> list[tuple]:
        half = data["interval"] / 2.0
        out = []
        for row, start, end in zip(rows.tolist(), (data["time"] - half).tolist(), (data["time"] + half).tolist(), strict=True):
            if self.number < 0 or end - self.low > self.secs:
                self.number, self.low = self.number + 1, start
            out.append((row, self.number))
        return out

    def finish(self) -> list[tuple]:
        return []


def _by_baseline(main: DataFrame, columns: list[str], make: Callable[[int, int], object], extra: str) -> DataFrame:
    """Bins of each baseline's rows, assigned as they stream by in order of time.

    Rows are dealt by baseline and sorted within partitions (Spark spills), so a
    task holds one record batch and what the open bin needs, however many rows a
    baseline has.
    """
    schema = "row_id long, antenna1 int, antenna2 int, " + extra
    types = [pa.int64(), pa.int32(), pa.int32(), *(pa.int32() if x.endswith(" int") else pa.float64() for x in extra.split(", "))]
    names = [x.split()[0] for x in schema.split(", ")]

    def packed(rows: list[tuple], key: tuple[int, int]) -> pa.RecordBatch:
        cols = list(zip(*((r[0], *key, *r[1:]) for r in rows), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, bins, last = None, None, None
        for batch in batches:
            data = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
            a1, a2 = data["antenna1"], data["antenna2"]
            edges = np.flatnonzero((a1[1:] != a1[:-1]) | (a2[1:] != a2[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(a1)], strict=True):
                if lo == hi:
                    continue
                here = int(a1[lo]), int(a2[lo])
                if here != key:
                    if bins is not None and (rest := bins.finish()):
                        yield packed(rest, key)
                    key, bins, last = here, make(*here), None
                time = data["time"][lo:hi]
                if (np.diff(time) == 0).any() or time[0] == last:
                    raise DuplicateSample("a baseline has two rows at one time")
                last = time[-1]
                if out := bins.feed(data["row_id"][lo:hi], {c: data[c][lo:hi] for c in ["time", *columns]}):
                    yield packed(out, key)
        if bins is not None and (rest := bins.finish()):
            yield packed(rest, key)

    some = main.select(F.col("row_id").cast("long").alias("row_id"), *(F.col(c).cast("int").alias(c) for c in BASELINE), "time", *columns)
    return some.repartition(*BASELINE).sortWithinPartitions(*BASELINE, "time", "row_id").mapInArrow(run, schema)


def time_bins(main: DataFrame, time_bin_secs: float = 1.0) -> DataFrame:
    """(row_id, antenna1, antenna2, bin): greedy time bins of each baseline.

    A bin begins half an interval before its first row.  A row whose end lies
    more than ``time_bin_secs`` after that begins the next bin, and is in it
    however long it is itself.  Two rows of a baseline at one time are an error.
    """
    return _by_baseline(main, ["interval"], lambda p, q: TimeBins(time_bin_secs), "bin int")


def row_mapper(main: DataFrame, time_bin_secs: float = 1.0) -> DataFrame:
    """One row per bin: mean time and summed interval of all its rows, whether
    every row is flagged, and its number ``out_row`` in the order of mean time,
    then of baseline.
    """
    binned = main.join(time_bins(main, time_bin_secs).select("row_id", "bin"), "row_id")
    out = binned.groupBy(*BASELINE, "bin").agg(F.avg("time").alias("time"), F.sum("interval").alias("interval"), F.bool_and(_flag(main.columns)).alias("flag_row"), F.count("*").alias("n_rows"))
    return with_dense_index(out, ["time", "antenna2", "antenna1", "bin"], "out_row")


def channel_mapper(channels: DataFrame, chan_bin_size: int = 1) -> DataFrame:
    """``channels`` with the bin of each; the last bin may be short."""
    return channels.withColumn("chan_bin", F.floor(F.col("chan") / chan_bin_size).cast("int"))


# ---------------------------------------------------------------------- averages
def row_average(main: DataFrame, bins: DataFrame, keys: tuple[str, ...] = (*BASELINE, "bin")) -> DataFrame:
    """Per bin: time and interval of all rows; u, v, w and time_centroid averaged,
    exposure and weight summed, sigma combined over the rows whose flag equals
    the bin's flag.  ``weight`` and ``sigma`` are numbers or arrays with one for
    each correlation.
    """
    extra = [c for c in bins.columns if c not in main.columns]
    rows = main.join(bins.select("row_id", *extra), "row_id").withColumn("_flag", _flag(main.columns))
    fine, bad = ~F.col("_flag"), F.col("_flag")
    parts: list[Column] = []
    out: list[Column] = [F.col("_time").alias("time"), F.col("_interval").alias("interval"), F.col("_all").alias("flag_row")]

    def take(name: str) -> Column:
        return F.when(F.col("_all"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))

    def both(name: str, agg: Callable[[Column], Column], expr: Column) -> Column:
        """The aggregate over unflagged and over flagged rows; one is taken at the end."""
        parts.extend([agg(F.when(fine, expr)).alias(f"{name}0"), agg(F.when(bad, expr)).alias(f"{name}1")])
        return take(name)

    for how, names in ((F.avg, ("u", "v", "w", "time_centroid")), (F.sum, ("exposure",))):
        out += [both(f"_{c}", how, F.col(c)).alias(c) for c in names if c in main.columns]
    listed = "weight" in main.columns and isinstance(main.schema["weight"].dataType, T.ArrayType)
    some = main.select("weight").filter("weight is not null").first() if listed else None
    n = len(some[0]) if some else 1
    weights = [F.get("weight", F.lit(k)) for k in range(n)] if listed else [F.col("weight") if "weight" in main.columns else F.lit(1.0)]
    sums = [both(f"_w{k}_", F.sum, w.cast("double")) for k, w in enumerate(weights)]
    if "weight" in main.columns:
        out.append((F.array(*sums) if listed else sums[0]).alias("weight"))
    if "sigma" in main.columns:
        wide = isinstance(main.schema["sigma"].dataType, T.ArrayType)
        made = []
        for k in range(n if wide else 1):
            sigma, weight = (F.get("sigma", F.lit(k)) if wide else F.col("sigma")), weights[k if listed else 0]
            top = both(f"_s{k}_", F.sum, sigma * sigma * weight * weight)
            total = sums[k if listed else 0]
            made.append(F.sqrt(F.when(total == 0.0, top).otherwise(F.try_divide(top, total * total))))
        out.append((F.array(*made) if wide else made[0]).alias("sigma"))
    totals = [F.avg("time").alias("_time"), F.sum("interval").alias("_interval"), F.bool_and("_flag").alias("_all")]
    return rows.groupBy(*keys).agg(*totals, *parts).select(*keys, *out)


def row_chan_average(cells: DataFrame, keys: list[str], row_weight: str | None = None) -> DataFrame:
    """Per key: vis = sum(v w) / sum w over the cells whose flag equals the key's.

    A key is flagged if all its cells are.  The weight is the cell's, else the
    row's (``row_weight``), else 1; a zero sum leaves the visibility undivided.
    """
    weight = F.col("weight") if "weight" in cells.columns else F.col(row_weight) if row_weight else F.lit(1.0)
    flag = _flag(cells.columns, "flag")
    # Both sums are kept and one is taken at the end: no second pass for the key's flag.
    fine, bad = ~flag, flag

    def both(name: str, expr: Column) -> list[Column]:
        return [F.sum(F.when(fine, expr)).alias(f"_{name}0"), F.sum(F.when(bad, expr)).alias(f"_{name}1")]

    parts = [*both("re", F.col("re") * weight), *both("im", F.col("im") * weight), *both("w", weight)]
    if "sigma" in cells.columns:
        parts += both("s", F.col("sigma") * F.col("sigma") * weight * weight)
    out = cells.groupBy(*keys).agg(F.bool_and(flag).alias("flag"), F.count("*").alias("n"), *parts)

    def take(name: str) -> Column:
        return F.when(F.col("flag"), F.col(f"_{name}1")).otherwise(F.col(f"_{name}0"))

    def over(top: Column, total: Column) -> Column:
        return F.when(total == 0.0, top).otherwise(F.try_divide(top, total))

    w = take("w")
    columns = [*(F.col(k) for k in keys), "flag", over(take("re"), w).alias("re"), over(take("im"), w).alias("im")]
    if "weight" in cells.columns:
        columns.append(w.alias("weight"))
    if "sigma" in cells.columns:
        columns.append(F.sqrt(over(take("s"), w * w)).alias("sigma"))
    return out.select(*columns)


def chan_average(channels: DataFrame, chan_bin_size: int = 1) -> DataFrame:
    """Per channel bin: mean frequency; summed width, effective bandwidth and resolution."""
    binned = channel_mapper(channels, chan_bin_size)
    sums = [F.sum(c).alias(c) for c in ("width", "effective_bw", "resolution") if c in channels.columns]
    return binned.groupBy("chan_bin").agg(F.avg("freq").alias("freq"), *sums)


def time_and_channel(main: DataFrame, cells: DataFrame, channels: DataFrame, time_bin_secs: float = 1.0, chan_bin_size: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, cells, channels) averaged in bins of time and channel."""
    if "flag" in cells.columns and "flag_row" not in main.columns:
        main = main.join(merge_flags(main, cells), "row_id")
    bins = time_bins(main, time_bin_secs)
    rows = row_average(main, bins.select("row_id", "bin"))
    place = bins.select("row_id", *BASELINE, "bin")
    row_weight = None
    if "weight" not in cells.columns and "weight" in main.columns:
        place, row_weight = place.join(main.select("row_id", F.col("weight").alias("row_weight")), "row_id"), "row_weight"
    binned = channel_mapper(cells, chan_bin_size).join(place, "row_id")
    averaged = row_chan_average(binned, [*BASELINE, "bin", "chan_bin", "corr"], row_weight)
    return rows, averaged, chan_average(channels, chan_bin_size)


# ------------------------------------------------- baseline-dependent averaging
def factors(n: int) -> list[int]:
    """Divisors of ``n`` in order."""
    return [x for x in range(1, n + 1) if n % x == 0]


def _up_to_divisor(divisors: np.ndarray, n: int) -> int:
    return int(divisors[min(np.searchsorted(divisors, n), len(divisors) - 1)])


def bda_bins(main: DataFrame, freqs: list[float], widths: list[float], max_fov: float = 3.0, decorrelation: float = 0.98, time_bin_secs: float | None = None, min_nchan: int = 1) -> DataFrame:
    """(row_id, antenna1, antenna2, bin, nchan, time, interval): baseline-dependent bins.

    A row joins the open bin while the phase between the bin's first row and it,
    at the edge of the field and the highest frequency, decorrelates by no more
    than the bound, and the bin stays within ``time_bin_secs``.  A bin of several
    rows gets as many channels as its mean baseline needs, rounded up to a
    divisor of the number of channels; an autocorrelation gets one.
    """
    if not 0 < max_fov <= 90 or not 0 <= decorrelation <= 1:
        raise ValueError("max_fov lies in (0, 90] and decorrelation in [0, 1]")
    nchan_in, top, narrow = len(freqs), max(freqs), np.asarray(widths, dtype=float)
    divisors = np.array(factors(nchan_in))
    least = _up_to_divisor(divisors, min_nchan)
    max_lm = math.radians(max_fov)
    n_max = abs(math.sqrt(1.0 - max_lm * max_lm) - 1.0) if max_lm <= 1.0 else 1.0
    dphi = decorrelation_phase(decorrelation)
    bound = float(np.sinc(dphi))

    def channels(first: tuple, last: tuple) -> int:
        u, v, w = ((a + b) / 2 for a, b in zip(first, last, strict=True))
        d = math.sqrt(math.hypot(u, v) * abs(max_lm) + abs(w) * n_max)
        if d == 0:
            raise ZeroDivisionError("a baseline of length 0 between two antennas")
        fits = max(float((C / (2 * math.pi) * dphi / d / narrow).min()), 1.0)
        return max(_up_to_divisor(divisors, math.ceil(nchan_in / fits)), least)

    class Bins:
        """Holds the rows of the open bin; puts a bin out when it closes."""

        def __init__(self, auto: bool) -> None:
            self.auto, self.number, self.open = auto, 0, []

        def _close(self) -> list[tuple]:
            rows = self.open
            if not rows:
                return []
            (_, time, span, start, _, first), (*_, end, last) = rows[0], rows[-1]
            if len(rows) == 1:
                n = nchan_in
            else:
                n = max(1, least) if self.auto else channels(first, last)
                time, span = (start + end) / 2, end - start
            self.open, self.number = [], self.number + 1
            return [(r[0], self.number - 1, n, time, span) for r in rows]

        def feed(self, rows: np.ndarray, data: dict[str, np.ndarray]) -> list[tuple]:
            out: list[tuple] = []
            for row, t, span, u, v, w in zip(rows.tolist(), *(data[c].tolist() for c in ("time", "interval", "u", "v", "w")), strict=True):
                start, end, uvw = t - span / 2, t + span / 2, (u, v, w)
                if self.open:
                    half = math.dist(uvw, self.open[0][5]) * top * math.sin(abs(max_lm)) * math.pi / C + 1e-8
                    if (time_bin_secs is not None and end - self.open[0][3] > time_bin_secs) or (not self.auto and math.sin(half) / half < bound):
                        out += self._close()
                self.open.append((row, t, span, start, end, uvw))
            return out

        def finish(self) -> list[tuple]:
            return self._close()

    return _by_baseline(main, ["interval", "u", "v", "w"], lambda p, q: Bins(p == q), "bin int, nchan int, bin_time double, bin_interval double")


def bda(main: DataFrame, cells: DataFrame, channels: DataFrame, use_row_weight: bool = False, **settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, cells, channels of bins) averaged over baseline-dependent bins.

    Visibilities take the cell's weight or 1; the row's weight only if asked for.
    ``channels`` (chan, freq, width) is read to the driver: it is one spectral window.
    """
    spw = sorted(channels.collect(), key=lambda r: r.chan)
    bins = bda_bins(main, [r.freq for r in spw], [r.width for r in spw], **settings)
    rows = row_average(main, bins.select("row_id", "bin", "nchan", "bin_time", "bin_interval"), (*BASELINE, "bin", "nchan", "bin_time", "bin_interval"))
    rows = rows.drop("time", "interval").withColumnsRenamed({"bin_time": "time", "bin_interval": "interval"})
    place = bins.select("row_id", *BASELINE, "bin", "nchan")
    if use_row_weight and "weight" not in cells.columns:
        place = place.join(main.select("row_id", F.col("weight").alias("row_weight")), "row_id")
    width = F.greatest(F.floor(F.lit(len(spw)) / F.col("nchan")), F.lit(1))
    binned = cells.join(place, "row_id").withColumn("chan_bin", F.floor(F.col("chan") / width).cast("int"))
    averaged = row_chan_average(binned, [*BASELINE, "bin", "chan_bin", "corr"], "row_weight" if use_row_weight and "weight" not in cells.columns else None)
    per_bin = bins.select(*BASELINE, "bin", "nchan").distinct().join(small(channels), how="cross").withColumn("chan_bin", F.floor(F.col("chan") / width).cast("int"))
    out_channels = per_bin.groupBy(*BASELINE, "bin", "chan_bin").agg(F.avg("freq").alias("freq"), F.sum("width").alias("width"))
    return rows, averaged, out_channels
