"""Image volumes: in long form (x, y, z, t, value) and, for work along time, a series a voxel; smoothed, masked and scattered back.

``keys`` names the columns that tell images apart, such as the path of a file.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.keyed import free_name
from millrace.sources.batches import bound_batches, lean_worker

PLACE = ("x", "y", "z")
SERIES = "series"
#: Places of a line that are smoothed together, at least; values that a worker smooths at a time.
PIECE, VALUES = 256, 1 << 18


def mean_image(volume: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return volume.groupBy(*keys, *PLACE).agg(F.avg("value").alias("mean_value"))


#: Widths at half the height in a deviation.
_WIDTH = math.sqrt(8 * math.log(2))


def gaussian_weights(fwhm: float, voxel: float = 1.0) -> list[tuple[int, float]]:
    """Offsets along an axis, up to four deviations, and their weights, which sum to 1."""
    sigma = fwhm / voxel / _WIDTH
    reach = math.floor(4 * sigma + 0.5)
    axis = {d: math.exp(-(d**2) / (2 * sigma**2)) if sigma else 1.0 for d in range(-reach, reach + 1)}
    return [(d, w / sum(axis.values())) for d, w in axis.items()]


def _sizes(voxel: float | Sequence[float]) -> tuple[float, float, float]:
    return (float(voxel),) * 3 if isinstance(voxel, int | float) else tuple(map(float, voxel))


# --- the two forms ----------------------------------------------------------------------------------------------------


def to_series(volume: DataFrame, keys: Sequence[str] = (), steps: int | None = None) -> DataFrame:
    """(keys, x, y, z, series array<double>): the values of a voxel over time, all of one length.

    The length is ``steps``, or the largest time step of the table plus one. A step without a row is null in the
    series; a row whose value is null or not finite counts as 0; of rows that repeat a place and step the largest value
    counts. Steps below 0, null or beyond the length are left out. One shuffle by place.
    """
    steps = int(steps if steps is not None else (volume.agg(F.max("t")).first()[0] or 0) + 1)
    own = F.col("value").cast("double")
    finite = F.when(own.isNull() | F.isnan(own) | (F.abs(own) == float("inf")), 0.0).otherwise(own)
    rows = volume.where(F.col("t").between(0, steps - 1)).select(*keys, *PLACE, F.col("t").cast("int").alias("t"), finite.alias("value"))
    listed = rows.groupBy(*keys, *PLACE).agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias(SERIES))
    fields = [*listed.schema.fields[:-1], T.StructField(SERIES, T.ArrayType(T.DoubleType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            flat, row = column.flatten(), np.repeat(np.arange(len(column)), np.diff(np.asarray(column.offsets)))
            at = row * steps + np.asarray(flat.field("t"))
            values, known = np.zeros(len(column) * steps), np.zeros(len(column) * steps, dtype=bool)
            values[at], known[at] = np.asarray(flat.field("value")), True  # rows of a step go by value, so the largest is last
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(values, known, steps)], names=batch.schema.names)

    bound_batches(volume.sparkSession)
    return listed.mapInArrow(run, T.StructType(fields))


def from_series(series: DataFrame, keys: Sequence[str] = (), name: str = "t") -> DataFrame:
    """The long form again, a row for each step that is not null."""
    rows = series.select(*keys, *PLACE, F.posexplode(SERIES).alias(name, "value"))
    return rows.where(F.col("value").isNotNull())


def filled(series: DataFrame, fill: float = 0.0) -> DataFrame:
    """Missing steps as a number, so that series are rows of a matrix."""
    return series.withColumn(SERIES, F.transform(SERIES, lambda v: F.coalesce(v, F.lit(float(fill)))))


def _lists(values: np.ndarray, known: np.ndarray, size: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) // max(size, 1) + 1) * size, pa.int32()), pa.array(values, mask=~known))


def _matrix(column: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of one length as rows of a matrix with 0 for null, and where they are not null."""
    flat = column.flatten()
    known = ~np.asarray(flat.is_null())
    return np.asarray(flat.fill_null(0.0)).reshape(-1, size), known.reshape(-1, size)


def _by_row(series: DataFrame, change: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Replaces all series by a function of their matrix; what is null stays null. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(SERIES)
            column, columns = batch.column(at), list(batch.columns)
            if len(column):
                size = len(column.flatten()) // len(column)
                values, known = _matrix(column, size)
                columns[at] = _lists(change(values, known).ravel(), known.ravel(), size) if size else column
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    bound_batches(series.sparkSession)
    return series.mapInArrow(run, series.schema)


# --- smoothing, masks, standard scores --------------------------------------------------------------------------------


def smooth_series(series: DataFrame, fwhm: float, voxel: float | Sequence[float] | str = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Gaussian smoothing in space with the whole kernel, one axis after the other; beyond the edge, and where a voxel is absent, is 0.

    ``voxel`` is the length of a voxel's edges: one number, three, or the name of a column array<double> with the three
    of the row's image; so an axis has a kernel of its own. Along an axis the series of a line of voxels are gathered
    in pieces of 256 places, or of as many as the kernel reaches to a side, and what it reaches beside them: three shuffles,
    each of the data once and, of lines of several pieces, the voxels near their ends twice. No task holds a line as a whole. Places
    inside an image's box that have no voxel take part on the way, since what is spread to them is spread on from there.
    Missing steps count as 0 and are missing again in the result, which has the voxels that came in.
    """
    by_image = isinstance(voxel, str)
    fixed = (1.0,) * 3 if by_image else _sizes(voxel)
    held = [voxel] if by_image else []
    kinds = {f.name: f.dataType for f in series.schema.fields}
    gaps, ends = F.exists(SERIES, lambda v: v.isNull()), [F.array(F.min(p), F.max(p)).cast("array<long>") for p in PLACE]
    known = F.when(gaps, F.transform(SERIES, lambda v: v.isNotNull())).otherwise(F.array().cast("array<boolean>"))
    out = filled(series.select(*keys, *[F.col(p).cast("long").alias(p) for p in PLACE], SERIES, known.alias("known"), *held))
    if keys:
        out = out.join(series.groupBy(*keys).agg(F.array(*ends).alias("box")), list(keys))
    else:
        box = series.agg(*ends).first()
        out = out.withColumn("box", F.array(*[F.array(*[F.lit(n).cast("long") for n in own or (0, -1)]) for own in box]))
    bound_batches(series.sparkSession)
    for axis, place in enumerate(PLACE):
        others = [*keys, *(p for p in PLACE if p != place)]
        reach, size = free_name(out, "reach"), free_name(out, "size")
        cut = out.withColumn(reach, _reach(fwhm, F.col(voxel)[axis] if by_image else F.lit(fixed[axis])))
        cut = cut.withColumn(size, F.greatest(F.lit(PIECE).cast("long"), reach))
        piece = free_name(cut, "piece")
        number = lambda at: F.floor(F.greatest(F.lit(0), F.least(at, F.col("box")[axis][1]) - F.col("box")[axis][0]) / F.col(size))
        cut = cut.withColumn(piece, F.explode(F.sequence(number(F.col(place) - F.col(reach)), number(F.col(place) + F.col(reach)))))
        span = F.col("box")[axis][0] + F.col(piece) * F.col(size)
        cut = cut.withColumn(reach, F.array(span, F.least(span + F.col(size) - 1, F.col("box")[axis][1])))
        lines = cut.groupBy(*others, piece).agg(F.collect_list(F.struct(place, SERIES, "known")).alias("line"), F.first(reach).alias("span"), *[F.first(c).alias(c) for c in ("box", *held)])
        schema = T.StructType([out.schema[c] for c in (*others, "box", *held, place, SERIES, "known")])
        out = lines.select(*others, "box", *held, "span", "line").mapInArrow(_along(place, axis, fwhm, fixed[axis], voxel if by_image else None), schema)
    out = out.where("known is not null")
    missing = F.when(F.size("known") > 0, F.zip_with(SERIES, "known", lambda v, k: F.when(k, v))).otherwise(F.col(SERIES))
    return out.select(*keys, *[F.col(p).cast(kinds[p]).alias(p) for p in PLACE], missing.alias(SERIES), *held)


def _reach(fwhm: float, edge: Column) -> Column:
    """The largest offset of ``gaussian_weights``; one more, so that the last digit of a division does not count."""
    return F.floor(4 * (F.lit(float(fwhm)) / edge / _WIDTH) + 0.5) + 1


def _along(place: str, axis: int, fwhm: float, edge: float, voxel: str | None) -> Callable:
    """Smooths pieces of lines (others, box, held, span, line of (place, series, known)) to rows (others, box, held, place, series, known),
    a row for each place of the span; what the line has beside its span only weighs in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        kernels: dict[float, list[tuple[int, float]]] = {}
        for whole in batches:
            done = 0
            while done < whole.num_rows:
                spans, steps = whole.column(whole.num_columns - 2).slice(done), max(1, _steps(whole.column(whole.num_columns - 1)))
                low, high = (np.asarray(pc.list_element(spans, k)) for k in (0, 1))
                n = max(1, int(np.searchsorted(np.cumsum(high - low + 1) * steps, VALUES, "right")))
                batch, low, high = whole.slice(done, n), low[:n], high[:n]
                done += n
                yield smoothed(batch, low, high, kernels)

    def smoothed(batch: pa.RecordBatch, low: np.ndarray, high: np.ndarray, kernels: dict) -> pa.RecordBatch:
        line, rest = batch.column(batch.num_columns - 1), batch.columns[:-2]
        ends, flat = np.asarray(line.offsets), line.flatten()
        ends, at, column = ends - ends[0], np.asarray(flat.field(place)), flat.field(SERIES)
        size = len(column.flatten()) // max(len(column), 1)
        values, _ = _matrix(column, size)
        edges = [e[axis] for e in batch.column(batch.schema.get_field_index(voxel)).to_pylist()] if voxel else [edge] * len(line)
        made, source = [], []
        for no, (a, b) in enumerate(zip(ends, ends[1:])):
            if edges[no] not in kernels:
                kernels[edges[no]] = gaussian_weights(fwhm, edges[no])
            weights, length = kernels[edges[no]], int(high[no] - low[no]) + 1
            reach = min(weights[-1][0], max(int(at[a:b].max() - low[no]), int(high[no] - at[a:b].min()), 0))
            dense, of, own = np.zeros((length + 2 * reach, size)), np.full(length + 2 * reach, -1), at[a:b] - low[no] + reach
            near = (own >= 0) & (own < len(dense))
            dense[own[near]], of[own[near]] = values[a:b][near], np.arange(a, b)[near]
            total = np.zeros((length, size))
            for offset, weight in weights:
                if abs(offset) <= reach:
                    total += weight * dense[reach - offset : reach - offset + length]
            made.append(total)
            source.append(of[reach : reach + length])
        row, source = np.repeat(np.arange(len(line)), high - low + 1), np.concatenate(source)
        places = np.concatenate([np.arange(x, y + 1) for x, y in zip(low, high)])
        result = np.concatenate(made).ravel()
        known = flat.field("known").take(pa.array(source, mask=source < 0))
        columns = [pa.array(places), _lists(result, np.ones(len(result), dtype=bool), size), known]
        return pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in rest), *columns], names=[*batch.schema.names[:-2], place, SERIES, "known"])

    return run


def _steps(line: pa.ListArray) -> int:
    """The length of the series in lists of (place, series, known)."""
    flat = line.flatten()
    return len(flat.field(SERIES).flatten()) // max(len(flat), 1)


def smooth(volume: DataFrame, fwhm: float, voxel: float | Sequence[float] = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Smoothing of a volume in long form; see ``smooth_series``. A row comes back for each place and step."""
    return _as(volume, from_series(smooth_series(to_series(volume, keys), fwhm, voxel, keys), keys))


def _as(volume: DataFrame, rows: DataFrame) -> DataFrame:
    """The time step in the type that the volume has it in."""
    return rows.withColumn("t", F.col("t").cast(volume.schema["t"].dataType))


def masked(volume: DataFrame, mask: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The values, or series, of the mask's voxels."""
    return volume.join(mask.select(*keys, *PLACE), [*keys, *PLACE], "left_semi")


def standardize_series(series: DataFrame) -> DataFrame:
    """Every series less its mean, divided by its population deviation; one that does not vary becomes 0. Missing steps do not count."""

    def change(values: np.ndarray, known: np.ndarray) -> np.ndarray:
        n = np.maximum(known.sum(axis=1, keepdims=True), 1)
        centred = np.where(known, values - values.sum(axis=1, keepdims=True) / n, 0.0)
        spread = np.sqrt((centred**2).sum(axis=1, keepdims=True) / n)
        flat = spread <= 1e-12 * np.maximum(1.0, np.abs(values).max(axis=1, initial=0.0, keepdims=True))
        return np.where(flat, 0.0, centred / np.where(flat, 1.0, spread))

    return _by_row(series, change)


def mask_series(volume: DataFrame, mask: DataFrame, fwhm: float, voxel: float | Sequence[float] | str = 1.0, keys: Sequence[str] = (), steps: int | None = None) -> DataFrame:
    """The matrix of a masked image: smoothed and standardized series of the mask's voxels, (keys, x, y, z, series).

    Smoothing reads the whole image, as the voxels around the mask weigh in. With ``voxel`` the name of a column, the volume has that column.
    """
    held = {voxel: F.first(voxel)} if isinstance(voxel, str) else {}
    series = to_series(volume, keys, steps)
    if held:
        series = series.join(volume.groupBy(*keys).agg(*[f.alias(n) for n, f in held.items()]), list(keys))
    return standardize_series(masked(smooth_series(series, fwhm, voxel, keys), mask, keys)).drop(*held)


def mask_transform(volume: DataFrame, mask: DataFrame, fwhm: float, voxel: float | Sequence[float] = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Smooths, keeps the mask's voxels and standardizes each over time, in long form."""
    return _as(volume, from_series(mask_series(volume, mask, fwhm, voxel, keys), keys))


def inverse_mask(values: DataFrame, space: DataFrame, others: Sequence[str] = ("component",), keys: Sequence[str] = ()) -> DataFrame:
    """Scatters masked values to every voxel of ``space``, which has a row for each place and each of ``others``; 0 outside."""
    every = [*keys, *PLACE, *others]
    return space.select(*every).join(values.select(*every, "value"), every, "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def inverse_series(series: DataFrame, space: DataFrame, keys: Sequence[str] = (), name: str = "component") -> DataFrame:
    """Scatters vectors of the mask's voxels to every place of ``space``, as rows (keys, x, y, z, name, value); 0 outside the mask."""
    size = series.agg(F.max(F.size(SERIES))).first()[0] or 0
    places = space.select(*keys, *PLACE).distinct().join(series.select(*keys, *PLACE, SERIES), [*keys, *PLACE], "left")
    zeros = F.array_repeat(F.lit(0.0), size)
    return places.select(*keys, *PLACE, F.posexplode(F.coalesce(SERIES, zeros)).alias(name, "value"))


def component_image(volume: DataFrame, component: int) -> DataFrame:
    return volume.where(F.col("component") == component).drop("component")
