"""Scenes as pixel tables (scene, y, x, ...): masks, blending, region statistics, screening."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import clip01, total, wind_plausibility
from ..sources.written import saved
from .order_statistics import percentiles

WEIGHTS = {"damping": 1.80, "edge": 1.60, "homogeneity": 3.00, "shape": 1.40, "wind": 3.00, "model": 1.40}
BIAS = -1.20


def hann(i: Column, size: int) -> Column:
    return F.greatest(F.lit(1e-3), 0.5 - 0.5 * F.cos(2 * math.pi * (i + 1) / (size + 1)))


def blend(tiles: DataFrame, size: int) -> DataFrame:
    """Overlapping tiles (scene, tile_y, tile_x, y, x inside the tile, p) into one posterior per pixel."""
    w = F.greatest(F.lit(1e-3), hann(F.col("y"), size) * hann(F.col("x"), size))
    each = tiles.select("scene", (F.col("tile_y") + F.col("y")).alias("y"), (F.col("tile_x") + F.col("x")).alias("x"), (F.col("p") * w).alias("pw"), w.alias("w"))
    return each.groupBy("scene", "y", "x").agg((F.sum("pw") / F.greatest(F.sum("w"), F.lit(1e-6))).alias("p"))


def combine(views: DataFrame, how: str = "mean") -> DataFrame:
    """Several views of each pixel into one, with their spread."""
    return views.groupBy("scene", "y", "x").agg((F.avg("p") if how == "mean" else F.max("p")).alias("p"), F.stddev_pop("p").alias("p_std"))


def dice(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """scene, dice, iou, precision, recall of masks (scene, y, x, m); null where both or the divisor are empty."""
    both = predicted.select("scene", "y", "x", F.col("m").cast("int").alias("a")).join(truth.select("scene", "y", "x", F.col("m").cast("int").alias("b")), ["scene", "y", "x"])
    s = both.groupBy("scene").agg(F.sum(F.col("a") * F.col("b")).alias("i"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    over = lambda n, d: F.when(d > 0, n / d)
    i, a, b = F.col("i"), F.col("a"), F.col("b")
    return s.select("scene", over(2 * i, a + b).alias("dice"), over(i, a + b - i).alias("iou"), over(i, a).alias("precision"), over(i, b).alias("recall"))


def dilate(mask: DataFrame, by: int) -> DataFrame:
    """4-connected dilation: all pixels within L1 distance `by` of the mask, on a plane without edges.

    A pixel covers one run of pixels in each row near it; overlapping runs are merged before they are laid out."""
    dy = F.explode(F.sequence(F.lit(-by), F.lit(by))).alias("dy")
    rows = mask.select("scene", "y", "x", dy).select("scene", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") - by + F.abs("dy")).alias("a"), (F.col("x") + by - F.abs("dy")).alias("b"))
    own = Window.partitionBy("scene", "y").orderBy("a", "b")
    fresh = (F.col("a") > F.coalesce(F.max("b").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.col("a") - 2) + 1).cast("int")
    runs = rows.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("scene", "y", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return merged.select("scene", "y", F.explode(F.sequence("a", "b")).alias("x"))


def distances(scene: DataFrame, marked: str, name: str) -> DataFrame:
    """Adds the L1 distance to the nearest pixel of the scene where `marked` holds (null where there is none): one pass along
    the rows, then one along the columns, so the work doesn't depend on how far one looks."""
    along = lambda part, by: Window.partitionBy("scene", part).orderBy(by)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    after = lambda w: w.rowsBetween(0, Window.unboundedFollowing)
    row, column = along("y", "x"), along("x", "y")
    at = F.when(F.col(marked), F.col("x"))
    in_row = F.least(F.col("x") - F.last(at, True).over(before(row)), F.first(at, True).over(after(row)) - F.col("x"))
    out = scene.withColumn(name, in_row)
    up = F.min(F.col(name) - F.col("y")).over(before(column)) + F.col("y")
    down = F.min(F.col(name) + F.col("y")).over(after(column)) - F.col("y")
    return out.withColumn(name, F.least(up, down))


def zones(scene: DataFrame, mask: DataFrame, width: int) -> DataFrame:
    """Every pixel with its zone: inside the mask, in the ring around it, or outside."""
    inside = mask.select("scene", "y", "x", F.lit(True).alias("is_in"))
    marked = scene.join(inside, ["scene", "y", "x"], "left").withColumn("is_in", F.coalesce("is_in", F.lit(False)))
    near = distances(marked, "is_in", "away")
    return near.withColumn("zone", F.when(F.col("is_in"), "inside").when(F.col("away") <= width, "ring").otherwise("outside")).drop("is_in", "away")


def region_statistics(zoned: DataFrame) -> DataFrame:
    """scene, n_in, n_ring, mean and population deviation of both zones, mean and 90th percentile inside."""
    zoned = saved(zoned.select("scene", "zone", "p"), "zoned")
    own = lambda z, f: f(F.when(F.col("zone") == z, F.col("p")))
    moments = zoned.groupBy("scene").agg(
        own("inside", F.count).alias("n_in"), own("ring", F.count).alias("n_ring"), own("inside", F.avg).alias("in_mean"), own("ring", F.avg).alias("ring_mean"),
        own("inside", F.stddev_pop).alias("in_std"), own("ring", F.stddev_pop).alias("ring_std"),
    )
    p90 = percentiles(zoned.where("zone = 'inside'"), ["scene"], "p", [0.9]).select("scene", F.col("percentiles")[0].alias("in_p90"))
    return moments.join(p90, "scene", "left")


def extents(scene: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """scene, height, width: as given (by headers, say), for scenes may lack pixels; else as far as the pixels reach."""
    if sizes is not None:
        return sizes.select("scene", "height", "width")
    return scene.groupBy("scene").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))


def filled(scene: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pixels and, with nulls, those that a scene of its size lacks; `there` tells them apart."""
    lacking = scene.groupBy("scene").agg(F.count("*").alias("n")).join(sizes, "scene").where(F.col("n") < F.col("height") * F.col("width"))
    places = lacking.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).select("scene", "y", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    holes = places.join(scene.select("scene", "y", "x"), ["scene", "y", "x"], "left_anti").withColumn("there", F.lit(False))
    return scene.withColumn("there", F.lit(True)).unionByName(holes, allowMissingColumns=True)


def reflected(scene: DataFrame, at: str, most: str, reach: int) -> DataFrame:
    """The pixels and those that mirror them beyond the edges, edge pixels included, up to `reach` away. `most` pixels along `at`."""
    x, n = F.col(at), F.col(most)
    copies = F.array(x, F.when(x < reach, -1 - x), F.when(x >= n - reach, 2 * n - 1 - x))
    return scene.withColumn(at, F.explode(F.array_compact(copies)))


def window_means(scene: DataFrame, names: list[str], size: int, sizes: DataFrame | None = None) -> DataFrame:
    """The names as means over the square of `size` pixels around each pixel, edges reflected: a pass along rows, one along columns.
    With sizes, scenes may lack pixels, which count for none and get none."""
    reach, out = size // 2, (scene if sizes is None else filled(scene, sizes)).join(extents(scene, sizes), "scene")
    counts = {n: f"{n}_count" for n in names if sizes is not None}
    out = out.withColumns({c: F.col(n).isNotNull().cast("int") for n, c in counts.items()})
    for at, along, most in (("x", "y", "width"), ("y", "x", "height")):
        w = Window.partitionBy("scene", along).orderBy(at).rowsBetween(-reach, reach)
        passed = {n: F.avg(n).over(w) for n in names} if sizes is None else {c: F.sum(c).over(w) for c in (*counts, *counts.values())}
        out = reflected(out, at, most, reach).withColumns(passed).where((F.col(at) >= 0) & (F.col(at) < F.col(most)))
    if sizes is not None:
        out = out.where("there").withColumns({n: F.try_divide(F.col(n), F.col(c)) for n, c in counts.items()}).drop("there", *counts.values())
    return out.drop("height", "width")


def local_cv(scene: DataFrame, reach: int, sizes: DataFrame | None = None) -> DataFrame:
    """scene, y, x, mean, cv: mean, and deviation over mean, of the square around each pixel; edges reflected."""
    moments = scene.select("scene", "y", "x", F.col("p").alias("m"), (F.col("p") * F.col("p")).alias("q"))
    done = window_means(moments, ["m", "q"], 2 * reach + 1, sizes)
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("q") - F.col("m") * F.col("m")))
    return done.select("scene", "y", "x", F.col("m").alias("mean"), (spread / F.greatest(F.col("m"), F.lit(1e-6))).alias("cv"))


def speckle(scene: DataFrame, reach: int = 4, floor: float = 0.02 * 255, smooth: float = 0.05, sizes: DataFrame | None = None) -> DataFrame:
    """scene, median_cv, smooth_fraction, valid_fraction of grey values p in 0..255; nearly black pixels don't count, and
    with fewer than 64 others a scene is all smooth."""
    own = saved(local_cv(scene, reach, sizes).select("scene", F.when(F.col("mean") > floor, F.col("cv")).alias("valid")), "cv")
    s = own.groupBy("scene").agg(F.avg((F.col("valid") < smooth).cast("int")).alias("smooth"), F.count("valid").alias("n"), F.count("*").alias("all"))
    s = s.join(percentiles(own, ["scene"], "valid", [0.5]).select("scene", F.col("percentiles")[0].alias("median")), "scene", "left")
    enough = F.col("n") >= 64
    return s.select("scene", F.when(enough, F.col("median")).otherwise(0.0).alias("median_cv"), F.when(enough, F.col("smooth")).otherwise(1.0).alias("smooth_fraction"), F.when(enough, F.col("n") / F.col("all")).otherwise(0.0).alias("valid_fraction"))


def channel_agreement(scene: DataFrame) -> DataFrame:
    """scene, min_corr: the least correlation of two of the channels r, g, b; 0 where some but not all are flat, and where
    all are flat 1, or 0 if their means lie more than 5 apart."""
    pairs = (("r", "g"), ("g", "b"), ("r", "b"))
    s = scene.groupBy("scene").agg(
        *[F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"c_{a}{b}") for a, b in pairs], *[(F.stddev_pop(c) <= 1.0).cast("int").alias(f"flat_{c}") for c in "rgb"], *[F.avg(c).alias(f"m_{c}") for c in "rgb"]
    )
    flat = F.col("flat_r") + F.col("flat_g") + F.col("flat_b")
    apart = F.greatest(*[F.abs(F.col(f"m_{a}") - F.col(f"m_{b}")) for a, b in pairs])
    least = F.least(*[F.col(f"c_{a}{b}") for a, b in pairs])
    return s.select("scene", F.when(flat == 3, F.when(apart > 5.0, 0.0).otherwise(1.0)).when(flat > 0, 0.0).otherwise(least).alias("min_corr"))


def flat_patches(scene: DataFrame, patch: int = 16, least: float = 0.5, sizes: DataFrame | None = None) -> DataFrame:
    """scene, flat_ratio: the share of patches without variance (of p), on a grid as wide as a patch or a 32nd of the scene."""
    step = lambda n: F.greatest(F.lit(patch), F.floor(F.col(n) / 32))
    out = scene.join(extents(scene, sizes), "scene").withColumn("sy", step("height")).withColumn("sx", step("width"))
    for at, by, most in (("y", "sy", "height"), ("x", "sx", "width")):
        start = F.col(at) - F.col(at) % F.col(by)
        out = out.where((F.col(at) - start < patch) & (start < F.col(most) - patch)).withColumn(f"o{at}", start)
    each = out.groupBy("scene", "oy", "ox").agg((F.var_pop("p") < least).cast("int").alias("flat"))
    found = each.groupBy("scene").agg(F.avg("flat").alias("flat_ratio"))
    return scene.select("scene").distinct().join(found, "scene", "left").select("scene", F.coalesce("flat_ratio", F.lit(0.0)).alias("flat_ratio"))


def radar_gate(scene: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """scene, valid, reason, and the signals: whether a scene (r, g, b in 0..255) can be radar backscatter.

    It can't if its channels disagree strongly, or somewhat where blocks are flat too, or over half of it is flat, or it
    has no speckle; the reason names each signal that speaks against it."""
    grey = scene.select("scene", "y", "x", ((F.col("r") + F.col("g") + F.col("b")) / 3).alias("p"))
    s = channel_agreement(scene).join(flat_patches(grey, sizes=sizes), "scene").join(speckle(grey, sizes=sizes), "scene")
    apart, strongly = F.col("min_corr") < 0.98, F.col("min_corr") < 0.85
    flat, mostly = F.col("flat_ratio") > 0.30, F.col("flat_ratio") > 0.50
    bare = (F.col("median_cv") < 0.18) & (F.col("smooth_fraction") > 0.15)
    told = [
        F.when(apart, F.format_string("channels disagree (%.3f)", "min_corr")),
        F.when(flat, F.format_string("flat blocks (%.1f%%)", F.col("flat_ratio") * 100)),
        F.when(bare, F.format_string("no speckle (%.3f, %.0f%% smooth)", F.col("median_cv"), F.col("smooth_fraction") * 100)),
    ]
    out = strongly | (apart & flat) | mostly | bare
    return s.withColumn("valid", ~out).withColumn("reason", F.when(out, F.concat_ws("; ", *told)).otherwise("passed"))


def gradients(scene: DataFrame) -> DataFrame:
    """Adds slope: the length of the gradient of p, by central differences, one-sided at the edges."""

    def along(part: str, by: str):
        w = Window.partitionBy("scene", part).orderBy(by)
        before, after, p = F.lag("p").over(w), F.lead("p").over(w), F.col("p")
        return F.when(before.isNull(), after - p).when(after.isNull(), p - before).otherwise((after - before) / 2)

    return scene.withColumn("dx", along("y", "x")).withColumn("dy", along("x", "y")).withColumn("slope", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).drop("dx", "dy")


def region_features(scene: DataFrame, mask: DataFrame, shapes: DataFrame, width: int = 25, edge: int = 2, sizes: DataFrame | None = None) -> DataFrame:
    """The six features of each scene's region: scene, n_in, n_ring, damping, edge, homogeneity, shape, model (wind comes with shapes).

    scene: p (grey, 0..1) and prob (the model's, may be null) of every pixel; mask: the region's pixels; shapes: scene,
    shape_complexity, wind, either may be null. A feature that can't be measured is 0.5."""
    marked = scene.join(mask.select("scene", "y", "x", F.lit(True).alias("is_in")), ["scene", "y", "x"], "left").withColumn("is_in", F.coalesce("is_in", F.lit(False))).withColumn("is_out", ~F.col("is_in"))
    sloped = gradients(marked) if sizes is None else filled(gradients(marked), sizes)
    d = distances(distances(sloped, "is_in", "away"), "is_out", "deep").join(extents(scene, sizes), "scene")
    d = d if sizes is None else d.where("there")
    rim = F.least(F.col("y") + 1, F.col("x") + 1, F.col("height") - F.col("y"), F.col("width") - F.col("x"))  # beyond the edge is no region
    near_edge = (F.col("away") <= edge) & (F.least(F.coalesce("deep", rim), rim) <= edge)
    ring, own = ~F.col("is_in") & (F.col("away") <= width), F.col("is_in")
    of = lambda when, f, c="p": f(F.when(when, F.col(c)))
    s = d.groupBy("scene").agg(
        of(own, F.count).alias("n_in"), of(ring, F.count).alias("n_ring"), of(own, F.avg).alias("in_mean"), of(ring, F.avg).alias("ring_mean"),
        of(own, F.stddev_pop).alias("in_std"), of(ring, F.stddev_pop).alias("ring_std"), F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"),
        of(near_edge, F.avg, "slope").alias("edge_slope"), F.avg("slope").alias("slope"), of(own, F.avg, "prob").alias("prob"),
    )
    floor = lambda c: F.greatest(F.col(c), F.lit(1e-6))
    unclear = F.col("n_ring") < F.greatest(F.lit(32.0), F.col("n_in") * 0.05)
    cv = lambda z: F.col(f"{z}std") / floor(f"{z}mean")
    around = F.when(F.col("n_ring") >= 32, cv("ring_")).otherwise(cv(""))
    return s.where("n_in > 0").join(shapes, "scene", "left").select(
        "scene", "n_in", "n_ring", "wind",
        F.when(unclear, 0.5).otherwise(clip01((F.col("ring_mean") - F.col("in_mean")) / floor("ring_mean") / 0.5)).alias("damping"),
        F.when(unclear | F.col("edge_slope").isNull(), 0.5).otherwise(clip01(F.col("edge_slope") / (F.col("slope") + 1e-6) / 3)).alias("edge"),
        clip01((1 - cv("in_") / F.greatest(around, F.lit(1e-6))) / 0.6).alias("homogeneity"),
        F.when(F.col("shape_complexity").isNull(), 0.5).otherwise(clip01((F.col("shape_complexity") - 1) / 3)).alias("shape"),
        F.coalesce("prob", F.lit(0.5)).alias("model"),
    )


def assessed(regions: DataFrame, scored: DataFrame) -> DataFrame:
    """Every region with its assessment, by region and never by position; one whose pixels were not kept is ambiguous at 0.5."""
    out = regions.join(scored, "scene", "left")
    return out.withColumns({"oil_probability": F.coalesce("oil_probability", F.lit(0.5)), "screen": F.coalesce("screen", F.lit("ambiguous"))})


def rejected(assessments: DataFrame, by: str) -> DataFrame:
    """by, kept, rejected: look-alikes are counted, not silently lost."""
    out = F.col("oil_probability") < 0.35
    return assessments.groupBy(by).agg(F.count_if(~out).alias("kept"), F.count_if(out).alias("rejected"))


def to_bytes(scene: DataFrame, name: str, kind: str) -> DataFrame:
    """A raster column as whole numbers in 0..255: uint8 as it is, uint16 by its high byte, float by the scene's range (0
    where flat or not a number), other integers likewise."""
    v = F.col(name)
    if kind == "uint8":
        return scene.withColumn(name, v.cast("int"))
    if kind == "uint16":
        return scene.withColumn(name, F.floor(v / 256).cast("int"))
    number = F.when(F.isnan(v.cast("double")), None).otherwise(v)
    ends = scene.groupBy("scene").agg(F.min(number).alias("low"), F.max(number).alias("high"))
    share = F.when(F.col("high") > F.col("low"), (number - F.col("low")) / (F.col("high") - F.col("low")) * 255.0).otherwise(0.0)
    return scene.join(ends, "scene").withColumn(name, F.floor(F.coalesce(share, F.lit(0.0))).cast("int")).drop("low", "high")


def ratio_band(vv: Column, vh: Column) -> Column:
    """The third band of a two-channel scene: vh over vv, in 0..255."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (vh + 1e-5) / (vv + 1e-5) * 128.0))).cast("int")


# fixed values: mean and deviation of each channel that some models were trained with
CHANNEL_SCALE = {"r": (0.485, 0.229), "g": (0.456, 0.224), "b": (0.406, 0.225)}


def normalised(scene: DataFrame, mode: str = "scale_0_1") -> DataFrame:
    """r, g, b (0..255) as a model takes them."""
    scaled = lambda c: F.col(c) / 255.0
    return scene.withColumns({c: (scaled(c) - m) / d if mode == "imagenet" else scaled(c) for c, (m, d) in CHANNEL_SCALE.items()})


def tile_grid(sizes: DataFrame, size: int = 256, stride: int = 224) -> DataFrame:
    """scene, tile_y, tile_x: where the tiles of each scene (height, width) begin, once it is padded to a whole number of strides."""

    def starts(n: str):
        padded = F.when(F.col(n) < size, F.lit(size)).otherwise(F.col(n) + F.pmod(-F.col(n), F.lit(stride)))
        return F.explode(F.sequence(F.lit(0), padded - size, F.lit(stride)))

    return sizes.withColumn("tile_y", starts("height")).withColumn("tile_x", starts("width")).select("scene", "tile_y", "tile_x")


def tiled(scene: DataFrame, size: int, stride: int, sizes: DataFrame | None = None) -> DataFrame:
    """(scene, tile_y, tile_x, y, x inside the tile, p): every pixel in each tile that covers it; what pads a scene mirrors it
    without repeating the edge. Scenes are at least half a tile wide, so that one reflection fills the padding."""
    ends = extents(scene, sizes)
    grid = tile_grid(ends, size, stride)
    out = scene.join(ends, "scene")
    for at, most in (("y", "height"), ("x", "width")):
        mirror = 2 * (F.col(most) - 1) - F.col(at)
        out = out.withColumn(at, F.explode(F.array_distinct(F.array(F.col(at), F.greatest(F.col(at), mirror)))))
        first = F.greatest(F.lit(0), F.ceil((F.col(at) - size + 1) / stride)).cast("long")
        out = out.withColumn(f"tile_{at}", F.explode(F.sequence(first, F.floor(F.col(at) / stride).cast("long")))).withColumn(f"tile_{at}", F.col(f"tile_{at}") * stride)
    inside = out.join(grid, ["scene", "tile_y", "tile_x"], "left_semi")
    return inside.select("scene", "tile_y", "tile_x", (F.col("y") - F.col("tile_y")).alias("y"), (F.col("x") - F.col("tile_x")).alias("x"), "p")


def flipped(tiles: DataFrame, size: int) -> DataFrame:
    """The four views of each tile: as it is, upside down, mirrored, both; `view` is 0..3."""
    each = tiles.withColumn("view", F.explode(F.array(*map(F.lit, range(4)))))
    turn = lambda at, on: F.when(on, size - 1 - F.col(at)).otherwise(F.col(at)).alias(at)
    return each.select("scene", "tile_y", "tile_x", "view", turn("y", F.col("view") % 2 == 1), turn("x", F.col("view") >= 2), "p")


def median_filter(scene: DataFrame, size: int = 3, sizes: DataFrame | None = None) -> DataFrame:
    """p as the median of the square around each pixel, edges reflected; pixels that aren't there count for none and get none."""
    reach, out = size // 2, scene.select("scene", "y", "x", "p", F.lit(True).alias("own")).join(extents(scene, sizes), "scene")
    for at, most in (("x", "width"), ("y", "height")):
        out = reflected(out, at, most, reach)
        to = F.explode(F.sequence(F.greatest(F.col(at) - reach, F.lit(0)), F.least(F.col(at) + reach, F.col(most) - 1)))
        out = out.where((F.col(at) >= -reach) & (F.col(at) < F.col(most) + reach)).withColumn("to", to)
        out = out.withColumn("own", F.col("own") & (F.col("to") == F.col(at))).drop(at).withColumnRenamed("to", at)
    return out.groupBy("scene", "y", "x").agg(F.median("p").alias("p"), F.bool_or("own").alias("own")).where("own").drop("own")


def suite_means(rows: DataFrame, alert: float = 0.001) -> DataFrame:
    """One row: means over scenes with a slick, false alarms over those without, and how many of the latter raise any."""
    slick = lambda c: F.avg(F.when(F.col("has_slick"), F.col(c)))
    clean = F.when(~F.col("has_slick"), F.col("found_share"))
    return rows.agg(*[slick(c).alias(c) for c in ("dice", "precision", "recall")], F.coalesce(F.avg(clean), F.lit(0.0)).alias("clean_found"), F.count_if(clean > alert).alias("clean_alerts"), F.count(clean).alias("n_clean"))


def lookalike(features: DataFrame) -> DataFrame:
    """Adds contributions, oil_probability and screen to features in 0..1 (damping, edge, homogeneity, shape, model, wind in m/s)."""
    plausible = wind_plausibility(F.col("wind"))
    swing = {k: WEIGHTS[k] * (F.col(k) - 0.5) * 2 for k in ("damping", "edge", "homogeneity", "shape", "model")}
    held = {k: F.when(v > 0, v * plausible).otherwise(v) if k in ("damping", "edge", "homogeneity") else v for k, v in swing.items()}
    held["wind"] = F.when(F.col("wind").isNull(), 0.0).otherwise(WEIGHTS["wind"] * (plausible - 1) * 2)
    logit = BIAS + total(list(held.values()))
    scored = features.withColumns({f"c_{k}": v for k, v in held.items()}).withColumn("logit", logit)
    p = F.least(F.lit(0.99), F.greatest(F.lit(0.01), 1 / (1 + F.exp(-F.col("logit")))))
    return scored.withColumn("oil_probability", p).withColumn("screen", F.when(F.col("oil_probability") < 0.35, "probable_lookalike").when(F.col("oil_probability") > 0.65, "probable_oil").otherwise("ambiguous"))


def evidence_order(contributions: Column) -> Column:
    """Contributions (name to log-odds) by falling size: what speaks loudest first; names decide ties."""
    entries = F.transform(F.map_entries(contributions), lambda e: F.struct((-F.abs(e["value"])).alias("by"), e["key"].alias("name"), e["value"].alias("value")))
    return F.transform(F.array_sort(entries), lambda e: F.struct(e["name"].alias("name"), e["value"].alias("value")))


def strongest(contributions: Column) -> Column:
    """The name of what speaks most for oil and of what speaks most against it, of equals the first by name; the bias is no evidence."""
    named = F.map_filter(contributions, lambda k, _: k != "bias")
    first = lambda by: F.element_at(F.array_sort(F.transform(F.map_entries(named), lambda e: F.struct(by(e["value"]).alias("by"), e["key"].alias("name")))), 1)["name"]
    return F.struct(first(lambda v: -v).alias("for_oil"), first(lambda v: v).alias("against"))


def screen_features(stats: DataFrame) -> DataFrame:
    """Feature values from region statistics; damping is neutral where the ring is too small."""
    small = F.col("n_ring") < F.greatest(F.lit(32.0), 0.05 * F.col("n_in"))
    damping = F.when(small, 0.5).otherwise(clip01((F.col("ring_mean") - F.col("in_mean")) / F.col("ring_mean") / 0.5))
    cv = lambda z: F.col(f"{z}_std") / F.col(f"{z}_mean")
    return stats.withColumn("damping", damping).withColumn("homogeneity", clip01((1 - cv("in") / cv("ring")) / 0.6)).withColumn("model", clip01(F.col("in_mean")))
