"""Queries whose kernels are not SQL: those of ``ORACLE`` have a plain SQL twin all the same, as sums over all pairs of
places, recursion or closed forms; the others are held against numpy, closed forms and invariants in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelry import fixtures as fx
from voxelry.functions.columns import orients_absdiff
from voxelry.plans.catalogue import _D2, _RIDGE, r, rounded
from voxelry.operators import division, evolution, forest, image, matching, membrane, membranogram, mesh, paths, points, spatial, vote

SHAPE = (fx.NY, fx.NX)
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f):
        ORACLE[f.__name__] = sql
        return f

    return register


def _ridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.ridge(fx.dense(spark, sf_dir))


def _guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.guide(spark, sf_dir).withColumn("idx", F.row_number().over(Window.partitionBy("z").orderBy("x")))


#: Two sheets: for each slice and column the mean row of the voxels in either half of the image.
SHEETS = f"select z, x, case when y < 25 then 1 else 2 end as label, cast(floor(avg(y)) as int) y from ({fx.VOX}) vox group by 1, 2, 3"
#: The rows in the middle of the two.
ROWS = {1: 12, 2: 37}
_RIDGES = f"select z, y, x, s, o from ({_RIDGE}) where s > 0"


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx.load(spark, sf_dir, "lineitem")
    return points.ordinal(spark.sql(SHEETS), "z", "x", "label").select((F.col("ord") + 1).cast("int").alias("idx"), "label", "z", "y", "x")


def _sheet_guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.explode(F.array(*map(F.lit, ROWS))).alias("label")
    row = F.element_at(F.create_map(*(F.lit(v) for pair in ROWS.items() for v in pair)), F.col("label"))
    return _guide(spark, sf_dir).select("idx", "z", "x", label).select("idx", "label", "z", row.alias("y"), "x")


def _votes(circle: str, wide: float, pixels: str, weight: str) -> str:
    """Sums over all pairs of places of a slice, on the torus: the closed form of the sums of Fourier terms.

    A vote from orientation o along the angle a is cos(a - o)^4 exp(i (4 a - 2 o)), damped with the distance.
    """
    return f"""with p as materialized ({pixels}), t as (select a.z::int z, b.y::int y, c.x::int x from range(1, 8) a(z), range(0, {fx.NY}) b(y), range(0, {fx.NX}) c(x)),
  d as (select t.z, t.y, t.x, p.o, {weight} w, (t.y - p.y + {fx.NY // 2 + fx.NY}) % {fx.NY} - {fx.NY // 2} dy, (t.x - p.x + {fx.NX // 2 + fx.NX}) % {fx.NX} - {fx.NX // 2} dx from t join p on t.z = p.z),
  e as (select *, atan2(dy, dx) a, w * exp(-(dy * dy + dx * dx) / {2 * wide * wide}e0) * pow(cos(atan2(dy, dx) - o), 4) c from d where {circle}),
  f as (select z, y, x, sum(c * cos(4 * a - 2 * o)) re, sum(c * sin(4 * a - 2 * o)) im, sum(c) c from e group by 1, 2, 3)"""


@query(_votes("dy <> 0 or dx <> 0", 5, _RIDGES, "p.s") + f" select z, y, x, {r('sqrt(re * re + im * im) / 1000', 3)} s, {r('re / 1000', 3)} re, {r('im / 1000', 3)} im from f")
def stick_vote(spark, sf_dir):
    v = vote.vote(_ridges(spark, sf_dir), 5.0, SHAPE)
    return rounded(v.select("z", "y", "x", F.col("s") / 1000, (F.col("s") * F.cos(2 * F.col("o")) / 1000).alias("re"), (F.col("s") * F.sin(2 * F.col("o")) / 1000).alias("im")).withColumnRenamed("(s / 1000)", "s"), 3, "s", "re", "im")


@query(_votes("dy * dy + dx * dx >= 3", 5, _RIDGES, "p.s") + f" select z, y, x, {r('c / 1000', 3)} s from f")
def ball_vote(spark, sf_dir):
    v = vote.vote(_ridges(spark, sf_dir), 5.0, SHAPE, kind="ball")
    return rounded(v.select("z", "y", "x", (F.col("s") / 1000).alias("s")), 3, "s")


@query(_votes("dy <> 0 or dx <> 0", 10, _RIDGES, "1.0e0") + """, g as (select p.z, p.y, p.x, abs(p.o - 0.5e0 * atan2(im, re)) u from p join f using (z, y, x))
select z, y, x from g where least(u - pi() * floor(u / pi()), pi() - (u - pi() * floor(u / pi()))) < pi() / 4""")
def orientation_suppression(spark, sf_dir):
    return membrane.suppress_by_orientation(_ridges(spark, sf_dir).where("s > 0").select("z", "y", "x", "o"), 10.0, SHAPE).select("z", "y", "x")


def points_orientation(spark, sf_dir):
    placed = fx.guide(spark, sf_dir).select("z", "y", "x").withColumn("v", F.lit(1.0))
    return image.ridge(matching._padded(placed, SHAPE), 1.5).select("z", "y", "x", "o").join(placed, ["z", "y", "x"], "left_semi")


#: A value's chance to belong to the first of the two Gaussians with means 0 and pi / 2.
_POST = "coalesce(({w0} / {s0} * exp(-d * d / (2 * {s0} * {s0}))) / nullif({w0} / {s0} * exp(-d * d / (2 * {s0} * {s0})) + {w1} / {s1} * exp(-(d - pi() / 2) * (d - pi() / 2) / (2 * {s1} * {s1})), 0), 0)"
_OLD, _NEW = ({k: f"{t}.{k}" for k in ("w0", "w1", "s0", "s1")} for t in ("o", "n"))


@query(f"""with recursive a as materialized (select least(abs(o), pi() - abs(o)) d from ({_RIDGES})),
em(k, w0, w1, s0, s1, grown) as (select 0, 0.5e0, 0.5e0, 0.1e0, 0.1e0, 1e0 union all
  select n.k, n.w0, n.w1, n.s0, n.s1, (select max({_POST.format(**_NEW)} - {_POST.format(**_OLD)}) from a) from (
    select o.k + 1 k, sum(p) / count(*) w0, 1 - sum(p) / count(*) w1, sqrt(sum(p * d * d) / sum(p)) s0, sqrt(sum((1 - p) * (d - pi() / 2) * (d - pi() / 2)) / sum(1 - p)) s1, any_value(o.w0) v0, any_value(o.w1) v1, any_value(o.s0) t0, any_value(o.s1) t1
    from (select em.*, d, {_POST.format(w0="w0", w1="w1", s0="s0", s1="s1")} p from em, a where grown >= 1e-3 and k < 100) o group by o.k) n, lateral (select n.v0 w0, n.v1 w1, n.t0 s0, n.t1 s1) o)
select max(d)::double threshold from a, (select * from em order by k desc limit 1) l where {_POST.format(w0="w0", w1="w1", s0="s0", s1="s1")} > 0.5""")
def fixed_mean_em(spark, sf_dir):
    angles = _ridges(spark, sf_dir).where("s > 0").select(orients_absdiff(F.col("o"), F.lit(0.0)).alias("d"))
    limit = matching.fixed_mean_threshold(angles, "d")
    return spark.range(1).select(F.lit(limit).cast("double").alias("threshold"))


def _ways(between: str, weight: str, inside: str) -> str:
    """Cheapest ways in each slice and component, from the first to the last point that is ``inside``: tables kept by key."""
    return f"""with recursive p as materialized (select row_number() over (partition by z order by x, y) idx, z, y, x, (v % 314) / 100.0e0 o from ({fx.VOX})),
e as materialized (select z, src, dst, {weight} w from (select a.z, a.idx src, b.idx dst, {between} u from p a join p b on a.z = b.z and a.idx <> b.idx and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1)),
c(z, idx, low) using key (z, idx) as (select z, idx, idx from p union
  select e.z, e.dst, min(c.low) from c join e on c.z = e.z and c.idx = e.src join recurring.c k on k.z = e.z and k.idx = e.dst where c.low < k.low group by 1, 2),
ends as materialized (select z, min(idx) a, max(idx) b from c where {inside} group by z, low),
t(z, idx, d, h, b) using key (z, idx) as (select z, a, 0.0e0, 0, 0::bigint from ends union
  select n.z, n.dst, m.d, m.h, m.b from (select e.z, e.dst, min({{'d': t.d + e.w, 'h': t.h + 1, 'b': e.src}}) m from t join e on t.z = e.z and t.idx = e.src group by 1, 2) n
  left join recurring.t k on k.z = n.z and k.idx = n.dst where k.idx is null or m.d < k.d or (m.d = k.d and (m.h < k.h or (m.h = k.h and m.b < k.b)))),
way(z, idx) as (select z, b from ends union select w.z, t.b from way w join t on t.z = w.z and t.idx = w.idx where t.b > 0)
select p.idx, p.z, p.y, p.x from p join way w on w.z = p.z and w.idx = p.idx"""


def _bridged(spark, sf_dir):
    p = fx.vox(spark, sf_dir).select(F.row_number().over(Window.partitionBy("z").orderBy("x", "y")).alias("idx"), "z", "y", "x", (F.col("v") % 314 / 100.0).alias("orient"))
    return paths.bridge_gaps(p, p.where("idx % 5 = 0"), 1.5)


@query(_ways("case when a.idx < b.idx then b.o - a.o else a.o - b.o end", "least(case when u < 0 then u + pi() else u end, pi() - case when u < 0 then u + pi() else u end)", "idx % 5 = 0"))
def bridge_gaps(spark, sf_dir):
    return _bridged(spark, sf_dir).select("idx", "z", "y", "x")


@query(_ways("(a.y - b.y) ** 2 + (a.x - b.x) ** 2", "sqrt(u)", "true"))
def simplify_path(spark, sf_dir):
    p = fx.vox(spark, sf_dir).select(F.row_number().over(Window.partitionBy("z").orderBy("x", "y")).alias("idx"), "z", "y", "x")
    return paths.simplify_by_path(p)


def contour_match(spark, sf_dir):
    return paths.interpolate_along_z(_guide(spark, sf_dir).withColumns({"object": F.lit(1), "z": F.col("z") * 3}))


def contour_spline(spark, sf_dir):
    return paths.interpolate_along_xy(_guide(spark, sf_dir))


@query(f"""with c as (select row_number() over (partition by z order by x) idx, z, y, x from ({fx.GUIDE})), h as (select a.v dy, b.v dx from range(-7, 8) a(v), range(-7, 8) b(v) where a.v * a.v + b.v * b.v <= 49),
n as (select z, idx, c.y cy, c.y + dy y, c.x + dx x, dy * dy + dx * dx d2 from c, h where c.y + dy >= 0 and c.x + dx >= 0 qualify row_number() over (partition by z, c.y + dy, c.x + dx order by dy * dy + dx * dx, idx) = 1),
s as (select *, case when y > cy and d2 <= 36 then 1 when y < cy and d2 <= 16 then -1 end side from n),
e as (select z, min(idx) a, max(idx) b, least(min(idx) + 5, max(idx)) pa, greatest(max(idx) - 5, min(idx)) pb from c group by z),
f as (select e.*, ca.x xa, cpa.x xpa, cb.x xb, cpb.x xpb from e join c ca on ca.z = e.z and ca.idx = a join c cpa on cpa.z = e.z and cpa.idx = pa join c cb on cb.z = e.z and cb.idx = b join c cpb on cpb.z = e.z and cpb.idx = pb)
select s.z, s.y::int y, s.x::int x, s.side::int side from s join f on s.z = f.z where side is not null and not ((x - xa) * (xa - xpa) >= 0 and idx < pa) and not ((x - xb) * (xb - xpb) >= 0 and idx > pb)""")
def contour_regions(spark, sf_dir):
    return paths.regions_beside_contour(_guide(spark, sf_dir).withColumns({"ny": F.lit(1.0), "nx": F.lit(0.0)}), (6.0, 4.0))


def point_normals(spark, sf_dir):
    return forest.oriented_normals(_sheets(spark, sf_dir), 4.0, (0.0, -100.0, 0.0))


#: Least axes in closed form: the least root of the characteristic polynomial, and the longest product of two rows of what is left.
@query(f"""with p as materialized (select row_number() over (order by z, x, label) idx, * from ({SHEETS})),
s as (select a.idx, a.label, count(*) n, sum(b.z - a.z)::double z, sum(b.y - a.y)::double y, sum(b.x - a.x)::double x, sum((b.z - a.z) * (b.z - a.z))::double zz, sum((b.z - a.z) * (b.y - a.y))::double zy,
  sum((b.z - a.z) * (b.x - a.x))::double zx, sum((b.y - a.y) * (b.y - a.y))::double yy, sum((b.y - a.y) * (b.x - a.x))::double yx, sum((b.x - a.x) * (b.x - a.x))::double xx
  from p a join p b on a.label = b.label and {_D2} <= 16 group by 1, 2 having count(*) >= 3),
m as (select idx, label, zz - z * z / n a, yy - y * y / n b, xx - x * x / n c, zy - z * y / n d, zx - z * x / n e, yx - y * x / n f from s),
q as (select *, (a + b + c) / 3 t, sqrt(greatest(((a - (a + b + c) / 3) ** 2 + (b - (a + b + c) / 3) ** 2 + (c - (a + b + c) / 3) ** 2 + 2 * (d * d + e * e + f * f)) / 6, 0)) u from m),
w as (select *, ((a - t) * ((b - t) * (c - t) - f * f) - d * (d * (c - t) - f * e) + e * (d * f - (b - t) * e)) / (u * u * u) / 2 h from q where u > 0),
l as (select *, t + 2 * u * cos(acos(least(greatest(h, -1), 1)) / 3 + 2 * pi() / 3) k from w),
v as (select idx, label, unnest([[d * f - e * (b - k), e * d - (a - k) * f, (a - k) * (b - k) - d * d], [d * (c - k) - e * f, e * e - (a - k) * (c - k), (a - k) * f - d * e], [(b - k) * (c - k) - f * f, f * e - d * (c - k), d * f - (b - k) * e]]) r, t + u * 2 * cos(acos(least(greatest(h, -1), 1)) / 3 + 4 * pi() / 3) - k gap, u from l),
b as (select * from v qualify row_number() over (partition by idx order by r[1] ** 2 + r[2] ** 2 + r[3] ** 2 desc) = 1)
select idx::int idx, label, {', '.join(r(f'r[{i}] * r[{j}] / (r[1] ** 2 + r[2] ** 2 + r[3] ** 2)', 4) + f' {n}' for n, i, j in (('zz', 1, 1), ('zy', 1, 2), ('yy', 2, 2), ('yx', 2, 3)))} from b where gap > 1e-3 * u""")
def normal_axes(spark, sf_dir):
    """Products of the axes' components, which have no sign, of points with one least axis."""
    p = _sheets(spark, sf_dir)
    numbered = points.ordinal(p, "label", "idx").withColumnRenamed("ord", "id")
    near = spatial.neighbor_edges(numbered.select("label", F.col("id").alias("idx"), "z", "y", "x"), 4.0, by=("label",))
    n = forest.local_axes(numbered, near).join(numbered.select("id", "idx", "label"), "id")
    return rounded(n.where("gap > 1e-3 * spread").select("idx", "label", *((F.col(f"n{a}") * F.col(f"n{b}")).alias(a + b) for a, b in ("zz", "zy", "yy", "yx"))), 4, "zz", "zy", "yy", "yx")


@query(f"""with recursive p as materialized (select row_number() over (order by z, y, x, idx) - 1 id, * from ({fx.CLOUD_DUCK})),
e as materialized (select a.id src, b.id dst, {{'w': (a.id * b.id) % 97, 'a': a.id, 'b': b.id}} k from p a join p b on a.id < b.id and (a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 36),
bi as materialized (select src, dst, k from e union all select dst, src, k from e),
reach(id, k) using key (id, k) as (select src, k from e union select b.dst, r.k from reach r join bi b on b.src = r.id and b.k < r.k)
select src, dst from e where not exists (select 1 from reach r where r.k = e.k and r.id = e.dst)""")
def spanning_forest(spark, sf_dir):
    """An edge is in the least forest if no way of lesser edges joins its ends."""
    p = points.ordinal(fx.cloud(spark, sf_dir), "z", "y", "x", "idx").select(F.col("ord").alias("idx"), "z", "y", "x")
    edges = spatial.neighbor_edges(p, 6.0).select("src", "dst", (F.col("src") * F.col("dst") % 97).alias("weight"), F.lit(1).alias("sign"))
    return forest.minimum_forest(edges)[1]


@query(fx.CLOUD_DUCK)
def convex_hull(spark, sf_dir):
    facets = mesh.convex_hull(fx.cloud(spark, sf_dir))
    return points.in_hull(fx.cloud(spark, sf_dir), facets, 1e-6)


def _quad(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    v = spark.range(25).select(F.col("id").alias("vid"), F.lit(0.0).alias("z"), (F.floor(F.col("id") / 5) * 4.0).alias("y"), (F.col("id") % 5 * 4.0).alias("x"))
    c = spark.range(16).select((F.floor(F.col("id") / 4) * 5 + F.col("id") % 4).alias("k"), "id")
    one = F.explode(F.array(F.struct((F.col("id") * 2).alias("tid"), F.col("k").alias("a"), (F.col("k") + 1).alias("b"), (F.col("k") + 5).alias("c")), F.struct((F.col("id") * 2 + 1).alias("tid"), (F.col("k") + 1).alias("a"), (F.col("k") + 6).alias("b"), (F.col("k") + 5).alias("c")))).alias("t")
    return v, c.select(one).select("t.*")


def subdivide_mesh(spark, sf_dir):
    v, _ = mesh.subdivide_to(*_quad(spark), 1.0)
    return v


def meshpoints_surround(spark, sf_dir):
    v, t = _quad(spark)
    return mesh.surround(t, v.where("vid in (6, 7, 11, 12)"))


def refine_surface(spark, sf_dir):
    return mesh.refine_surface(_sheets(spark, sf_dir), 4.0, 6.0, 2.0)


def divide_graph(spark, sf_dir):
    p = fx.cloud(spark, sf_dir).withColumn("orient", (F.col("idx") % 31) / 10.0)
    top = division.largest(division.point_components(p, 12.0)).drop("component", "size", "place")
    return division.divide(top, 12.0).select("idx", "part")


@query(f"""with recursive p as materialized (select row_number() over (order by z, x, label) idx, * from ({SHEETS})),
b as materialized (select a.label, a.idx src, b.idx dst from p a join p b on a.label = b.label and a.idx <> b.idx and abs(a.z - b.z) <= 1 and {_D2} <= 2.25e0),
reach(label, id, to_id) as (select label, idx, idx from p union select reach.label, reach.id, b.dst from reach join b on b.src = reach.to_id),
c as (select label, id, min(to_id) low from reach group by 1, 2), n as (select label, low from c group by 1, 2 qualify row_number() over (partition by label order by count(*) desc, low) = 1)
select c.label::int region, id::int idx from c join n on c.label = n.label and c.low = n.low""")
def components_regions(spark, sf_dir):
    p = _sheets(spark, sf_dir)
    regions = p.select(F.col("label").alias("region"), "z", "y", "x")
    return division.region_components(p.drop("label"), regions, 1.5).select("region", "idx")


def evolve_surface(spark, sf_dir):
    return evolution.robust_fit(_sheets(spark, sf_dir), _sheet_guides(spark, sf_dir), lengths=(3.0, 16.0), seed=1)


def surface_areas(spark, sf_dir):
    return evolution.areas(_sheets(spark, sf_dir), _sheet_guides(spark, sf_dir), (3.0, 16.0))


def _grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guide's points, with normals along y."""
    p = points.ordinal(fx.guide(spark, sf_dir), "z", "x").select((F.col("ord") + 1).cast("int").alias("idx"), "z", "y", "x")
    return points.normals_tangent(p.withColumns({"nz": F.lit(0.0), "ny": F.lit(1.0), "nx": F.lit(0.0)}))


def box_classify(spark, sf_dir):
    cells = spatial.box_cells(_grid_points(spark, sf_dir), fx.dense(spark, sf_dir), (-1, 3), 2, normalize=True)
    return matching.classify_boxes(cells, (-1, 3), 2)


def detect_membrane(spark, sf_dir):
    found, _ = membrane.detect(fx.dense(spark, sf_dir), fx.guide(spark, sf_dir), fx.dense(spark, sf_dir), SHAPE, 1.0, 5.0)
    return found


def match_candidates(spark, sf_dir):
    p = _sheets(spark, sf_dir).where("label = 1")
    return matching.match_candidates(p.select("idx", "z", "y", "x"), p.where("x % 2 = 0").select("idx", "z", "y", "x"), _guide(spark, sf_dir), 3.0, SHAPE)


def component_contour(spark, sf_dir):
    return image.component_contour(image.dilate(fx.guide(spark, sf_dir).select("z", "y", "x")))


def membranogram_cubic(spark, sf_dir):
    return membranogram.sample_cubic(_grid_points(spark, sf_dir), fx.dense(spark, sf_dir), 0.5)


def embed_surface(spark, sf_dir):
    return membranogram.embed(_sheets(spark, sf_dir).where("label = 1"), 2, 12)


def box_pca(spark, sf_dir):
    return membranogram.box_components(spatial.box_cells(_grid_points(spark, sf_dir), fx.dense(spark, sf_dir), (-1, 3), 2))


QUERIES = {
    f.__name__: f
    for f in (
        stick_vote, ball_vote, orientation_suppression, points_orientation, fixed_mean_em, bridge_gaps, simplify_path, contour_match, contour_spline, contour_regions,
        point_normals, normal_axes, spanning_forest, convex_hull, subdivide_mesh, meshpoints_surround, refine_surface, divide_graph, components_regions, evolve_surface, surface_areas, box_classify, detect_membrane, match_candidates,
        component_contour, membranogram_cubic, embed_surface, box_pca,
    )
}
