"""Masks of image volumes: the threshold in the widest gap of the mean image, morphology on the voxel grid, components.

A mask is a table of places (x, y, z), one row a voxel that is in it. ``keys`` names the columns that tell images apart, so that any
number of images is masked at once; an image is one file, and only its sorted values ever meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.keyed import free_name
from millrace.sources.workspace import materialize, settled

PLACE = ("x", "y", "z")
#: The voxels that share a face with one, and the voxel itself.
CROSS = ((0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))
ROUNDS = 100


def gap_threshold(means: DataFrame, keys: Sequence[str] = (), value: str = "mean_value", lower: float = 0.2, upper: float = 0.85) -> DataFrame:
    """(keys, threshold): the middle of the widest gap between neighbours in the sorted values of each image.

    Only neighbours from the rank floor(lower * n) to floor(upper * n) count, n being the image's voxels; of equally wide gaps the first
    one does. Values that are null or not finite count as 0. An image of one voxel has that value as its threshold.
    """
    image = Window.partitionBy(*keys)
    own = F.col(value).cast("double")
    finite = F.when(own.isNull() | F.isnan(own) | (F.abs(own) == float("inf")), 0.0).otherwise(own)
    by_value = image.orderBy("v")
    ranked = means.select(*keys, finite.alias("v")).withColumns(
        {"at": F.row_number().over(by_value) - 1, "up": F.lead("v").over(by_value), "n": F.count("*").over(image)}
    )
    low, high = F.floor(F.col("n") * lower), F.least(F.floor(F.col("n") * upper), F.col("n") - 1)
    inside = ranked.where((F.col("at") >= low) & ((F.col("at") < high) | (F.col("at") == low)))
    width = F.when(F.col("at") < high, F.col("up") - F.col("v")).otherwise(0.0)
    first_widest = F.max_by(F.struct("v", F.when(F.col("at") < high, F.col("up")).otherwise(F.col("v")).alias("up")), F.struct(width, -F.col("at")))
    return inside.groupBy(*keys).agg(first_widest.alias("gap")).select(*keys, ((F.col("gap.v") + F.col("gap.up")) / 2).alias("threshold"))


def above_threshold(means: DataFrame, thresholds: DataFrame, keys: Sequence[str] = (), value: str = "mean_value") -> DataFrame:
    """The places whose value is at least the threshold of their image."""
    if keys:
        met = means.join(thresholds, list(keys))
    else:
        least = thresholds.first()
        met = means.withColumn("threshold", F.lit(least.threshold if least else None).cast("double"))
    own = F.col(value).cast("double")
    return met.where(F.when(own.isNull() | F.isnan(own) | (F.abs(own) == float("inf")), 0.0).otherwise(own) >= F.col("threshold")).select(*keys, *PLACE)


def _neighbours(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each voxel and each voxel that shares a face with it."""
    kinds = {f.name: f.dataType for f in mask.schema.fields}
    steps = F.array(*[F.struct(*[F.lit(d).alias(p) for p, d in zip(PLACE, step)]) for step in CROSS])
    moved = mask.select(*keys, *PLACE, F.explode(steps).alias("step"))
    return moved.select(*keys, *[(F.col(p) + F.col(f"step.{p}")).cast(kinds[p]).alias(p) for p in PLACE])


def eroded(mask: DataFrame, keys: Sequence[str] = (), times: int = 1) -> DataFrame:
    """The voxels all six neighbours of which are in the mask too; beyond the grid nothing is. Counts are combined before the shuffle."""
    for _ in range(times):
        mask = _neighbours(mask, keys).groupBy(*keys, *PLACE).agg(F.count("*").alias("seen")).where(F.col("seen") == len(CROSS)).drop("seen")
    return mask


def dilated(mask: DataFrame, space: DataFrame, keys: Sequence[str] = (), times: int = 1) -> DataFrame:
    """The voxels of the mask and all that share a face with one, inside the places of ``space``."""
    for _ in range(times):
        mask = _neighbours(mask, keys).distinct()
    return mask.join(space.select(*keys, *PLACE).distinct(), [*keys, *PLACE], "left_semi") if times else mask


def _runs(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unbroken runs along x as (keys, y, z, first, last, run); a run's number orders them by z, y and x within an image."""
    along = Window.partitionBy(*keys, "y", "z").orderBy("x")
    islands = mask.select(*keys, *[F.col(p).cast("long").alias(p) for p in PLACE]).withColumn("island", F.col("x") - F.row_number().over(along))
    runs = islands.groupBy(*keys, "y", "z", "island").agg(F.min("x").alias("first"), F.max("x").alias("last")).drop("island")
    return runs.withColumn("run", F.struct("z", "y", "first"))


def component_runs(mask: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Runs of voxels with the component that they belong to: (keys, y, z, first, last, component, size), voxels that share a face being connected.

    Runs along x are the nodes, so a solid body has few. Two runs of neighbouring lines that overlap are an edge. Every
    round a run takes the least label of its neighbours, and then the label that the run of that label has, so labels cross a
    body in a number of rounds that grows with the logarithm of its length. A component is named by its least run, and
    ``size`` is its number of voxels.
    """
    spark = mask.sparkSession

    def build() -> DataFrame:
        runs = materialize(_runs(mask, keys), "mask-runs")
        other = runs.select(*keys, F.col("y").alias("oy"), F.col("z").alias("oz"), F.col("first").alias("ofirst"), F.col("last").alias("olast"), F.col("run").alias("v"))
        edges = None
        for dy, dz in ((1, 0), (0, 1)):
            moved = other.withColumns({"y": F.col("oy") - dy, "z": F.col("oz") - dz}).drop("oy", "oz")
            met = runs.join(moved, [*keys, "y", "z"]).where((F.col("first") <= F.col("olast")) & (F.col("last") >= F.col("ofirst")))
            pairs = met.select(*keys, F.col("run").alias("u"), "v")
            edges = pairs if edges is None else edges.unionByName(pairs)
        edges = materialize(edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))), "mask-edges")
        labels = runs.select(*keys, "run", F.col("run").alias("label"))
        for _ in range(ROUNDS):
            near = edges.join(labels.withColumnRenamed("run", "v"), [*keys, "v"]).groupBy(*keys, F.col("u").alias("run")).agg(F.min("label").alias("near"))
            stepped = labels.join(near, [*keys, "run"], "left").select(*keys, "run", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
            stepped = materialize(stepped, "mask-labels")
            jump = stepped.select(*keys, F.col("run").alias("label"), F.col("label").alias("far"))
            labels = stepped.join(jump, [*keys, "label"]).select(*keys, "run", "old", F.least("label", "far").alias("label"))
            labels = materialize(labels, "mask-labels")
            if labels.where("label <> old").isEmpty():
                break
            labels = labels.drop("old")
        else:
            raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
        named = runs.join(labels.select(*keys, "run", F.col("label").alias("component")), [*keys, "run"])
        sizes = named.groupBy(*keys, "component").agg(F.sum(F.col("last") - F.col("first") + 1).alias("size"))
        return named.join(sizes, [*keys, "component"]).select(*keys, "y", "z", "first", "last", "component", "size")

    return settled(spark, "mask-components", build)


def largest_component(mask: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The places of each image's largest component; of equally large ones that with the least z, y and x."""
    runs = component_runs(mask, keys)
    rank = F.struct("size", *[-F.col(f"component.{c}") for c in ("z", "y", "first")])
    best = free_name(runs, "best")
    won = runs.groupBy(*keys).agg(F.max_by("component", rank).alias(best))
    if keys:
        met = runs.join(won, list(keys)).where(F.col("component") == F.col(best))
    else:
        one = won.first()[0]  # null if there is no voxel
        met = runs.where(F.col("component") == F.struct(*[F.lit(one[c]).alias(c) for c in ("z", "y", "first")])) if one else runs.limit(0)
    kinds = {f.name: f.dataType for f in mask.schema.fields}
    voxels = met.select(*keys, F.explode(F.sequence("first", "last")).alias("x"), "y", "z")
    return voxels.select(*keys, *[F.col(p).cast(kinds[p]).alias(p) for p in PLACE])


def epi_mask(
    means: DataFrame, keys: Sequence[str] = (), value: str = "mean_value", lower: float = 0.2, upper: float = 0.85, opening: int = 2, connected: bool = True
) -> DataFrame:
    """The mask of the head in mean images of echo-planar series: (keys, x, y, z).

    Voxels at least as bright as the middle of the widest gap between the darkest fifth and the brightest seventh of the
    values are eroded ``opening`` times, the largest component is kept, and that is dilated twice as often and eroded
    again, so thin bridges and specks go and the outline stays. ``means`` has a row for every voxel of an image (``mean_image``).

    Cases: images where erosion leaves nothing have no row; places must not be null; an empty table gives no row.
    """
    mask = above_threshold(means, gap_threshold(means, keys, value, lower, upper), keys, value)
    mask = materialize(eroded(mask, keys, opening), "mask-eroded")
    if connected:
        mask = largest_component(mask, keys)
    return eroded(dilated(mask, means, keys, 2 * opening), keys, opening)
