"""Component lists in text form with a ``Format =`` header line."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that are known, with the kind of their values.
KINDS = {
    "name": "text", "type": "text", "patch": "text", "ra": "hours", "dec": "degrees", "i": "number", "q": "number", "u": "number", "v": "number",
    "spectralindex": "list", "logarithmicsi": "truth", "referencefrequency": "number", "majoraxis": "arcsec", "minoraxis": "arcsec", "orientation": "number",
}
_SPLIT = r",(?![^\[]*\])"


class SkyModelError(ValueError):
    """A header or line that cannot be read."""


def parse_header(line: str) -> list[tuple[str, str | None]]:
    """(column, default) of each field that a header line names."""
    body = re.sub(r"^\s*#?\s*\(?\s*[Ff]ormat\s*=?\s*|\)\s*=\s*[Ff]ormat\s*$", "", line.strip())
    if not re.search(r"[Ff]ormat", line):
        raise SkyModelError(f"not a header: {line!r}")
    out = []
    for field in re.split(_SPLIT, body):
        name, eq, default = field.strip().partition("=")
        if name.strip().lower() not in KINDS:
            raise SkyModelError(f"an unknown column: {name.strip()!r}")
        out.append((name.strip(), default.strip().strip("'\"") if eq else None))
    return out


def _angle(text: Column, pattern: str, parts: tuple[float, float, float]) -> Column:
    """2 pi (a / x + b / y + c / z) with the sign for all of it."""
    a, b, c = (F.regexp_extract(text, pattern, i).cast("double") for i in (2, 3, 4))
    sign = F.when(F.regexp_extract(text, pattern, 1) == "-", F.lit(-1.0)).otherwise(F.lit(1.0))
    value = sign * (2.0 * math.pi) * (a / parts[0] + b / parts[1] + c / parts[2])
    return F.when(text.rlike(pattern), value).otherwise(F.raise_error(F.concat(F.lit("not an angle: "), text)).cast("double"))


def hours_to_radians(text: Column) -> Column:
    return _angle(text, r"^\s*([+-]?)(\d+):(\d+):(\d+\.?\d*)\s*$", (24.0, 1440.0, 86400.0))


def degrees_to_radians(text: Column) -> Column:
    return _angle(text, r"^\s*([+-]?)(\d+)\.(\d+)\.(\d+\.?\d*)\s*$", (360.0, 21600.0, 1296000.0))


def _number(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("nan"), F.lit(float("nan"))).when(low.isin("inf", "+inf"), F.lit(float("inf"))).when(low == "-inf", F.lit(float("-inf"))).otherwise(low.cast("double"))


def _converted(text: Column, kind: str) -> Column:
    if kind == "hours":
        return hours_to_radians(text)
    if kind == "degrees":
        return degrees_to_radians(text)
    if kind == "arcsec":
        return F.radians(F.coalesce(_number(F.nullif(F.trim(text), F.lit(""))), F.lit(0.0)) / 3600.0)
    if kind == "number":
        return _number(F.nullif(F.trim(text), F.lit("")))
    if kind == "truth":
        return F.lower(F.trim(text)) == "true"
    if kind == "list":
        inner = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\[\]\s]", "")
        parts = F.filter(F.split(inner, ","), lambda x: x != "")
        return F.transform(parts, lambda x: _number(x))
    return F.trim(text)


def from_lines(lines: DataFrame, header: str) -> DataFrame:
    """Rows of component lines (a column ``value``) under a header line.

    An empty field takes the header's default.  A line with another number of
    fields is an error.  A source whose flux or spectral coefficients are not
    finite has no flux: 0 with ordinary coefficients; with logarithmic ones 1 with
    none, as such sources have always been read.
    """
    columns = parse_header(header)
    fields = F.split(F.col("value"), _SPLIT)
    some = lines.filter(~F.trim("value").rlike(r"^(#.*)?$") & ~F.col("value").rlike(r"(?i)^\s*#?\s*\(?\s*format")).select(F.col("value"), fields.alias("f"))
    right = F.size("f") == len(columns)
    checked = some.withColumn("f", F.when(right, F.col("f")).otherwise(F.raise_error(F.concat(F.lit(f"a line without {len(columns)} fields: "), F.col("value"))).cast("array<string>")))
    out = []
    for i, (name, default) in enumerate(columns):
        text = F.coalesce(F.nullif(F.trim(F.col("f")[i]), F.lit("")), F.lit(default))
        out.append(_converted(text, KINDS[name.lower()]).alias(name.lower()))
    rows = checked.select(*out)
    if "i" in rows.columns and "spectralindex" in rows.columns:
        finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
        good = F.coalesce(finite(F.col("i")), F.lit(True)) & F.forall("spectralindex", finite)
        log = F.coalesce(F.col("logarithmicsi"), F.lit(False)) if "logarithmicsi" in rows.columns else F.lit(False)
        flux = F.when(good, F.col("i")).when(log, F.lit(1.0)).otherwise(F.lit(0.0))
        index = F.when(good, F.col("spectralindex")).otherwise(F.transform("spectralindex", lambda c: F.lit(0.0)))
        rows = rows.withColumns({"i": flux, "spectralindex": index})
    return rows


def load(spark: SparkSession, source: str | Iterable[str]) -> DataFrame:
    """Component list from a path (or paths' folder), or from lines."""
    if isinstance(source, str):
        lines = spark.read.text(source)
        first = lines.filter(F.col("value").rlike(r"(?i)^\s*#?\s*\(?\s*format")).limit(1).collect()
        if not first:
            raise SkyModelError("there is no header line")
        return from_lines(lines, first[0].value)
    text = [x for x in source]
    header = next((x for x in text if re.match(r"(?i)^\s*#?\s*\(?\s*format", x)), None)
    if header is None:
        raise SkyModelError("there is no header line")
    return from_lines(spark.createDataFrame([(x,) for x in text], "value string"), header)
