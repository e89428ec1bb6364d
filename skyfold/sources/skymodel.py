"""Sky models of other kinds: text catalogues with a format line, image cubes, gain files."""

from __future__ import annotations

import io
import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.sources import fits

#: Factors to radians of the unit that ends a column's name.
_UNITS = {"d": math.pi / 180.0, "r": 1.0, "m": math.pi / 180.0 / 60.0, "s": math.pi / 180.0 / 3600.0, "h": math.pi / 12.0}


def catalogue(lines: DataFrame, header: str, freq0: float | None = None) -> DataFrame:
    """Sources of a text catalogue: (name, type, ra, dec, stokes, spi, ref_freq, emaj, emin, pa).

    ``header`` is its format line, ``#format: name ra_d dec_d i q u v spi freq0 emaj_s
    emin_s pa_d``: names of the columns in order; an angle's name ends in its unit
    (d, r, m, s, or h for hours).  ``lines`` has one source in each ``value``, with
    columns parted by white space; comments and blank lines are passed over.

    A source with a shape is a Gaussian, else a point.  Without a spectral index it
    is 0, without a reference frequency that of the model (``freq0``) holds; absent
    Stokes parameters are 0.
    """
    names = header.split(":", 1)[1].split() if ":" in header else header.split()
    if not {"i"} <= set(names):
        raise ValueError("a catalogue needs a column i")
    part = F.split(F.trim("value"), r"\s+")
    rows = lines.filter((F.length(F.trim("value")) > 0) & ~F.trim("value").startswith("#"))
    short = F.size(part) < len(names)
    rows = rows.select(F.when(short, F.raise_error(F.concat(F.lit("too few columns: "), F.col("value"))).cast("array<string>")).otherwise(part).alias("p"))

    def number(name: str, otherwise: float | None = 0.0):
        return F.get("p", F.lit(names.index(name))).cast("double") if name in names else F.lit(otherwise).cast("double")

    def angle(stem: str):
        for unit, factor in _UNITS.items():
            if f"{stem}_{unit}" in names:
                return number(f"{stem}_{unit}") * factor
        return F.lit(None).cast("double")

    emaj, emin = F.coalesce(angle("emaj"), F.lit(0.0)), F.coalesce(angle("emin"), F.lit(0.0))
    return rows.select(
        (F.get("p", F.lit(names.index("name"))) if "name" in names else F.lit(None).cast("string")).alias("name"),
        F.when((emaj > 0) | (emin > 0), F.lit("GAUSSIAN")).otherwise(F.lit("POINT")).alias("type"),
        angle("ra").alias("ra"), angle("dec").alias("dec"), F.array(*(number(s) for s in "iquv")).alias("stokes"), F.array(number("spi")).alias("spi"),
        F.coalesce(number("freq0", None), F.lit(freq0).cast("double")).alias("ref_freq"), emaj.alias("emaj"), emin.alias("emin"), F.coalesce(angle("pa"), F.lit(0.0)).alias("pa"),
    )


def cube_components(cube: DataFrame, header: Mapping[str, object]) -> DataFrame:
    """(l, m, band, corr, flux) of the places of an image cube that are not 0 in every band.

    ``cube``: x, y, band, corr, value; the header's first two axes must be in
    degrees, and its frequency axis the third or fourth.
    """
    if any(str(header.get(f"CUNIT{k}", "")).lower() != "deg" for k in (1, 2)):
        raise ValueError("image axes must be in degrees")
    if not any(str(header.get(f"CTYPE{k}", "")).strip() == "FREQ" for k in (3, 4)):
        raise ValueError("the frequency axis is the third or the fourth")

    def place(column: str, k: int):
        """Distance from the reference pixel, in radians; the first axis in rising order."""
        step = math.radians(float(header[f"CDELT{k}"]))  # type: ignore[arg-type]
        n, ref = int(header[f"NAXIS{k}"]), float(header[f"CRPIX{k}"])  # type: ignore[arg-type, call-overload]
        at = F.col(column) if k == 2 or step >= 0 else F.lit(n - 1) - F.col(column)
        return (at + 1.0 - ref) * step

    lit = cube.filter("value <> 0").select("x", "y").distinct()
    return cube.join(lit, ["x", "y"]).select(place("x", 1).alias("l"), place("y", 2).alias("m"), "band", "corr", F.col("value").alias("flux"))


def cube_frequencies(spark: SparkSession, header: Mapping[str, object]) -> DataFrame:
    """(band, freq) of a cube's frequency axis."""
    return fits.axis_table(spark, header).filter("axis = 'FREQ'").select(F.col("idx").alias("band"), F.col("coord").alias("freq"))


def gain_files(spark: SparkSession, path: str) -> DataFrame:
    """(time_idx, ant, chan, dir, g) of ``.npy`` arrays (time, antenna, channel, direction, correlations...).

    One task reads one file; its rows go out time by time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                gains = np.load(io.BytesIO(blob.as_buffer().to_pybytes()), allow_pickle=False).astype(np.complex128)
                if gains.ndim < 5:
                    raise ValueError("gains have the axes time, antenna, channel, direction and correlation")
                flat = gains.reshape(*gains.shape[:4], -1)
                for t, one in enumerate(flat):
                    cells = one.reshape(-1, one.shape[-1])
                    index = np.indices(one.shape[:3]).reshape(3, -1)
                    parts = pa.StructArray.from_arrays([pa.array(cells.real.ravel()), pa.array(cells.imag.ravel())], names=["re", "im"])
                    ends = pa.array(np.arange(0, cells.size + 1, cells.shape[1]), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), t), pa.int32()), *(pa.array(i, pa.int32()) for i in index), pa.ListArray.from_arrays(ends, parts)], names=["time_idx", "ant", "chan", "dir", "g"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("content")
    return files.mapInArrow(run, "time_idx int, ant int, chan int, dir int, g array<struct<re:double,im:double>>")
