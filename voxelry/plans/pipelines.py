"""The programs: segmentation of membranes, sampling on their surfaces, and membranograms.

Each stage is one job whose table is written before the next begins, so that a program can go on from any stage.
Lengths are in nm and are divided by the volume's pixel size; clouds come back in whole places of the volume.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelry.operators import division, evolution, forest, image, matching, membrane, mesh, paths, points, spatial
from voxelry.sources.points import clouds_to_model
from voxelry.storage import cut

ZYX = ["z", "y", "x"]


@dataclass(frozen=True)
class SegmentArgs:
    """Arguments of the segmentation, in nm where they are lengths."""

    pixel_nm: float = 1.0
    extend: float = 30.0
    neigh_thresh: float = 5.0
    detect_smooth: float = 5.0
    detect_tv: float = 50.0
    detect_filt: float = 3.5
    detect_supp: float = 0.25
    components_min: float = 0.5
    fit_lengrids: tuple[float, float] = (50.0, 200.0)
    fit_shrinkside: float = 0.25
    fit_popsize: int = 80
    fit_tol: float = 0.005
    fit_maxiter: int = 200
    meshrefine_spacing: float = 20.0
    seed: int = 0

    def px(self, nm: float) -> float:
        return nm / self.pixel_nm


@dataclass
class Segmentation:
    """Tables of the stages; ``results`` has ``label, idx, z, y, x`` and normals."""

    steps: dict[str, DataFrame] = field(default_factory=dict)
    results: DataFrame | None = None
    areas: DataFrame | None = None
    distances: DataFrame | None = None


def prepare_guide(model: DataFrame) -> DataFrame:
    """Guide lines ``idx, z, y, x`` at every slice: annotated slices of two points or more, matched along z, splined in each."""
    from voxelry.operators.contour import slices_with_points

    kept = slices_with_points(points.deduplicate(model)).withColumn("object", F.lit(1))
    along = paths.interpolate_along_z(kept).withColumn("z", F.rint("z").cast("int"))
    return cut(paths.interpolate_along_xy(along))


def guide_normals(guide: DataFrame, reference: tuple[float, float, float] | None = None) -> DataFrame:
    """Guide points with unit normals in the slice, all turned away from a reference point."""
    ref = reference or points.reference_point(guide)
    line = Window.partitionBy("z").orderBy("idx")
    dy = F.lead("y", 1).over(line) - F.lag("y", 1).over(line)
    dx = F.lead("x", 1).over(line) - F.lag("x", 1).over(line)
    near = lambda c: F.coalesce(F.lead(c).over(line) - F.col(c), F.col(c) - F.lag(c).over(line))
    t = guide.withColumns({"ty": F.coalesce(dy, near("y")).cast("double"), "tx": F.coalesce(dx, near("x")).cast("double")})
    size = F.sqrt(F.col("ty") * F.col("ty") + F.col("tx") * F.col("tx"))
    t = t.withColumns({"ny": F.coalesce(F.try_divide(F.col("tx"), size), F.lit(1.0)), "nx": F.coalesce(F.try_divide(-F.col("ty"), size), F.lit(0.0))})
    away = (F.col("y") - ref[1]) * F.col("ny") + (F.col("x") - ref[2]) * F.col("nx")
    return t.withColumns({c: F.when(away < 0, -F.col(c)).otherwise(F.col(c)) for c in ("ny", "nx")}).drop("ty", "tx")


def segment(voxels: DataFrame | Callable[[tuple[int, ...], tuple[int, ...]], DataFrame], model: DataFrame, shape: tuple[int, int], args: SegmentArgs, membranes: int = 2, reference: tuple[float, float, float] | None = None, by_region: bool = False) -> Segmentation:
    """One or two membranes near a guide, in the box around the regions beside it.

    ``voxels`` is a table or a function that reads the box [low, high). ``membranes`` 2 takes the two largest
    components, dividing the largest while the second is too small, or with ``by_region`` the largest on either side of
    the guide. Labels follow the distance to the reference point.
    """
    out = Segmentation()
    neigh = max(args.px(args.neigh_thresh), 1.0)
    guide = prepare_guide(model)
    lined = cut(guide_normals(guide, reference))
    reach = args.px(args.extend)
    regions = cut(paths.regions_beside_contour(lined, (reach, reach)).where(f"y < {shape[0]} and x < {shape[1]}"))
    bound = regions.select(*ZYX).unionByName(guide.select(*ZYX)).distinct()
    out.steps |= {"guide": guide, "regions": regions}

    r = bound.agg(*(f(c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ZYX)).first()
    low = tuple(max(0, int(r[f"lo_{c}"])) for c in ZYX)
    high = tuple(min(int(r[f"hi_{c}"]) + 1, n) for c, n in zip(ZYX, (2**31 - 1, *shape), strict=True))
    if callable(voxels):
        volume = voxels(low, high)
    else:
        volume = voxels.where(" and ".join(f"{c} >= {a} and {c} < {b}" for c, a, b in zip(ZYX, low, high, strict=True)))
    moved = lambda df, sign: df.withColumns({c: (F.col(c) + sign * a).cast("int") for c, a in zip(ZYX[1:], low[1:], strict=True)})
    size = (high[1] - low[1], high[2] - low[2])
    found, first = (moved(df, 1) for df in membrane.detect(moved(volume, -1), moved(guide, -1), moved(bound, -1), size, args.px(args.detect_smooth), args.px(args.detect_tv), args.detect_filt, args.detect_supp))
    found = cut(found)
    out.steps |= {"detect": found, "detect_nofilter": cut(first)}

    cloud = cut(found.select(F.xxhash64(*ZYX).alias("idx"), *ZYX, F.col("o").alias("orient")))
    least = int(guide.count() * args.components_min)
    if membranes == 1:
        parts = division.one_component(cloud, neigh, least).select("idx", *ZYX, F.lit(1).alias("label"))
    elif by_region:
        sides = regions.select(F.when(F.col("side") < 0, 1).otherwise(2).alias("region"), *ZYX)
        parts = division.region_components(cloud, sides, neigh, least).select("idx", *ZYX, F.col("region").alias("label"))
    else:
        two = division.two_components(cloud, neigh, least)
        ref = reference or points.reference_point(guide)
        order = points.sort_clouds_by_ref(two, ref, "part")
        parts = two.join(F.broadcast(order.select("part", "place")), "part").select("idx", *ZYX, F.col("place").alias("label"))
    parts = cut(parts)
    out.steps["components"] = parts

    labels = F.explode(F.sequence(F.lit(1), F.lit(membranes))).alias("label")
    guides = guide.select("idx", *ZYX, labels)
    lengths = tuple(args.px(v) for v in args.fit_lengrids)
    states = cut(evolution.robust_states(parts, guides, lengths=lengths, shrink=args.fit_shrinkside, r=neigh, downscale=args.px(args.detect_smooth), pop_size=args.fit_popsize, tol=args.fit_tol, max_iter=args.fit_maxiter, seed=args.seed))
    fitted = cut(evolution.surfaces_of(states))
    out.steps |= {"fit": fitted, "fit_state": states, "bound": cut(bound)}

    matched = None
    for label in range(1, membranes + 1):
        one = matching.match_candidates(cloud, fitted.where(F.col("label") == label), guide, neigh, shape).withColumn("label", F.lit(label))
        matched = one if matched is None else matched.unionByName(one)
    matched = cut(matched)
    out.steps["match"] = matched
    return finish(out, matched, guide, lengths, args, neigh, bound, reference)


def finish(out: Segmentation, matched: DataFrame, guide: DataFrame, lengths: tuple[float, float], args: SegmentArgs, neigh: float, bound: DataFrame | None = None, reference: tuple[float, float, float] | None = None, simplify: bool = False) -> Segmentation:
    """Refines matched clouds, orders them along the guide, and takes normals, areas and mutual distances (in nm)."""
    spacing = args.px(args.meshrefine_spacing)
    refined = cut(mesh.refine_surface(matched, 2 * neigh, spacing, neigh, bound))
    ordered = None
    for r in refined.select("label").distinct().orderBy("label").collect():
        own = refined.where(F.col("label") == r["label"]).withColumn("idx", F.xxhash64(*ZYX))
        placed = spatial.sort_by_guide(own, guide)
        own = placed.select(F.col("place").cast("long").alias("idx"), *ZYX)
        own = paths.simplify_by_path(own) if simplify else own
        own = points.ordinal(own, "z", "idx").select(F.lit(r["label"]).alias("label"), (F.col("ord") + 1).alias("idx"), *ZYX)
        ordered = own if ordered is None else ordered.unionByName(own)
    ordered = cut(ordered)
    out.steps["refine"] = ordered
    ref = reference or points.reference_point(guide)
    normals = forest.oriented_normals(ordered, 2 * neigh, ref)
    flip = F.when(F.col("label") == 2, -1.0).otherwise(1.0)
    out.results = cut(normals.withColumns({f"n{c}": F.col(f"n{c}") * flip for c in ZYX}))
    labels = F.explode(F.array(*(F.lit(k) for k in (1, 2)))).alias("label")
    out.areas = evolution.areas(ordered, guide.select("idx", *ZYX, labels), lengths).withColumn("area_nm2", F.col("area") * args.pixel_nm**2)
    if ordered.where("label = 2").limit(1).count():
        sides = [ordered.where(F.col("label") == k).select(F.col("idx").alias("id"), *ZYX) for k in (1, 2)]
        both = [spatial.nearest(sides[k], sides[1 - k], 4 * neigh).select(F.lit(k + 1).alias("label"), F.col("a_id").alias("idx"), (F.sqrt("d2") * args.pixel_nm).alias("dist_nm")) for k in (0, 1)]
        out.distances = both[0].unionByName(both[1])
    return out


def sampling_localmax(surface: DataFrame, voxels: DataFrame, pixel_nm: float, box: tuple[float, float, float] = (3, 10, 4), r_exclude: float = 2.0) -> DataFrame:
    """Points (``idx``, coordinates, normals) of a surface where the inverted, rescaled volume stands out.

    The mean over a box above each point; its maxima in each slice; and of those the greatest, dropping neighbours.
    """
    lo, hi, rt = (v / pixel_nm for v in box)
    scaled = image.scale_minmax(voxels, qrange=(0.02, 0.98), vrange=(1.0, 0.0))
    mean = spatial.box_average(points.normals_tangent(surface), scaled, (lo, hi), rt)
    valued = cut(surface.join(mean.withColumnRenamed("mean", "v"), "idx"))
    tops = cut(spatial.local_maxima(valued, 1.5, per_slice=True))
    return spatial.exclusion(tops, r_exclude / pixel_nm)


def sampling_classify(sampled: DataFrame, voxels: DataFrame, pixel_nm: float, box: tuple[float, float, float] = (3, 10, 4)) -> DataFrame:
    """Sampled points with ``class``: 0 for those whose surroundings look like a particle."""
    lo, hi, rt = (v / pixel_nm for v in box)
    scaled = image.scale_minmax(voxels, qrange=(0.02, 0.98), vrange=(1.0, 0.0))
    cells = spatial.box_cells(points.normals_tangent(sampled), scaled, (lo, hi), rt)
    return sampled.join(matching.classify_boxes(cells, (lo, hi), rt), "idx")


def sampling_boxes(sampled: DataFrame, voxels: DataFrame, pixel_nm: float, box: tuple[float, float, float] = (3, 10, 4), rotate: bool = False) -> DataFrame:
    """The boxes around sampled points, whole or averaged around the normal."""
    lo, hi, rt = (v / pixel_nm for v in box)
    return spatial.box_cells(points.normals_tangent(sampled), voxels, (lo, hi), rt, rotate=rotate)


def sampling_strided(surface: DataFrame, pixel_nm: float, spacing_xy: float = 5.0, spacing_z: float = 3.0, seed: int = 0) -> DataFrame:
    """Points at regular steps along z and along each slice (in order of ``idx``), from random offsets given by the seed.

    Of points within 1 of each other in a slice, one stays: the greatest of values given by the seed.
    """
    step_z, step_xy = (max(1, round(v / pixel_nm)) for v in (spacing_z, spacing_xy))
    zs = surface.select("z").distinct().withColumn("__r", F.row_number().over(Window.orderBy("z")) - 1)
    first = F.pmod(F.xxhash64(F.lit(seed)), F.lit(step_z))
    kept = zs.where(F.pmod("__r", F.lit(step_z)) == first).select("z")
    place = F.row_number().over(Window.partitionBy("z").orderBy("idx")) - 1
    offset = F.pmod(F.xxhash64(F.lit(seed), "z"), F.lit(step_xy))
    taken = cut(surface.join(F.broadcast(kept), "z").withColumn("__p", place).where(F.pmod("__p", F.lit(step_xy)) == offset).drop("__p"))
    valued = taken.withColumn("v", F.xxhash64(F.lit(seed), "z", "idx"))
    return spatial.local_maxima(valued, 1.0, include_eq=False, per_slice=True).drop("v")


def sampling_excluded(surface: DataFrame, pixel_nm: float, r_exclude: float = 10.0) -> DataFrame:
    """Points at least ``r_exclude`` apart; the first ones win."""
    return spatial.exclusion(surface.withColumn("v", F.lit(0)), r_exclude / pixel_nm).drop("v")


def output_model(bound: DataFrame, clouds: DataFrame, gap: float) -> DataFrame:
    """A point model of a segmentation: object 1 is the outline of its bounding region, the others its membranes by label.

    A contour holds one slice, split where neighbours lie more than ``gap`` apart.
    """
    outline = image.component_contour(bound).select(F.lit(1).alias("object"), "idx", *ZYX)
    parts = clouds.select((F.col("label") + 1).cast("int").alias("object"), "idx", *ZYX)
    return clouds_to_model(outline.unionByName(parts), gap)


def output_slices(bound: DataFrame, clouds: DataFrame, n: int = 5) -> DataFrame:
    """``object, z, y, x`` of the same on ``n`` slices spread evenly over the bounding region."""
    outline = image.component_contour(bound).select(F.lit(1).alias("object"), *ZYX)
    parts = clouds.select((F.col("label") + 1).cast("int").alias("object"), *ZYX)
    return outline.unionByName(parts).where(F.col("z").isin(image.spread_slices(bound, n)))


def box_stack(cells: DataFrame) -> DataFrame:
    """Averaged boxes (``idx, i, j, value``) as the slices ``z, y, x, v`` of one volume, in order of ``idx``."""
    place = cells.select("idx").distinct().withColumn("__block", F.floor(F.col("idx") / 1024))
    return cells.join(points.ordinal(place, "__block", "idx").select("idx", F.col("ord").cast("int").alias("z")), "idx").select("z", F.col("i").cast("int").alias("y"), F.col("j").cast("int").alias("x"), F.col("value").alias("v"))


def membranogram(surface: DataFrame, voxels: DataFrame, dists: list[float], outside: str = "raise") -> DataFrame:
    """``idx, v, p1, p2``: the volume's mean over distances along each normal, laid out on the surface's plane.

    Values are rescaled between their 2 % and 98 % quantiles.
    """
    mean = spatial.sample_along_normals(surface, voxels, dists, outside=outside).groupBy("idx").agg(F.avg("sample").alias("v"))
    laid = spatial.project(surface).join(mean, "idx").select("idx", "v", "p1", "p2")
    return image.scale_minmax(laid, qrange=(0.02, 0.98))
