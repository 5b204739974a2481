"""Queries over the driver's tables for the library's operators, with DuckDB SQL for those that SQL can express.

Images, clouds and contours are the fixtures' (:mod:`voxelry.fixtures`); both sides round alike.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelry import fixtures as fx
from voxelry.functions.columns import neighbour_weight, orients_absdiff
from voxelry.operators import contour, division, image, points, spatial, surface
from voxelry.sources import points as point_files

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        @functools.wraps(f)
        def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
            """Numbers of rows and places are long, as in the SQL."""
            df = f(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast("long") for c, kind in df.dtypes if kind == "int" and c in ("idx", "place", "iu", "iv")})

        QUERIES[f.__name__] = wide
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Columns rounded, and without a negative zero."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in columns})


def r(expr: str, digits: int = 4) -> str:
    return f"round({expr}, {digits}) + 0.0e0"


DENSE, CLOUD = fx.DENSE_DUCK, fx.CLOUD_DUCK

# --- images ---------------------------------------------------------------------------------------------------------


@query(f"""
with vox as ({fx.VOX}), g as (select z, x, cast(floor(avg(y)) as int) y from vox group by 1, 2), gn as (select z, count(*) ng from g group by 1),
r as (select vox.*, row_number() over (partition by vox.z order by v, y, x) rn, count(*) over (partition by vox.z) nd, gn.ng from vox join gn on vox.z = gn.z),
q as (select *, (nd - 1) * (1 - least(1.0e0, ng * 3.0e0 / nd)) h from r),
t as (select z, max(case when rn - 1 = floor(h) then v end) lo, max(case when rn - 1 = ceil(h) then v end) hi, max(h - floor(h)) f from q group by z),
thr as (select z, lo + (hi - lo) * f vt from t)
select r.z, count(*) kept, cast(sum(r.v) as bigint) sv, min(r.y) ymin, max(r.x) xmax from r join thr on r.z = thr.z where r.v >= thr.vt group by r.z""")
def slice_value_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = image.slice_value_filter(fx.vox(spark, sf_dir), fx.guide(spark, sf_dir), 3.0)
    return kept.groupBy("z").agg(F.count("*").alias("kept"), F.sum("v").cast("long").alias("sv"), F.min("y").alias("ymin"), F.max("x").alias("xmax"))


@query(f"select z, y, x, {r('(v - avg(v) over ()) / stddev_pop(v) over ()')} v from ({fx.VOX})")
def scale_zscore(spark, sf_dir):
    return rounded(image.scale_zscore(fx.vox(spark, sf_dir)).drop("n"), 4, "v")


@query(f"""with a as ({fx.VOX}), q as (select quantile_cont(v, 0.02) lo, quantile_cont(v, 0.98) hi from a)
select z, y, x, {r('1 - (least(greatest(v, lo), hi) - lo) / (hi - lo)')} v from a, q""")
def scale_minmax(spark, sf_dir):
    return rounded(image.scale_minmax(fx.vox(spark, sf_dir), qrange=(0.02, 0.98), vrange=(1.0, 0.0)).drop("n"), 4, "v")


def _gradient(v: str, axis: str, out: str, of: str) -> str:
    others = ", ".join(c for c in "zyx" if c != axis)
    w = f"over (partition by {others} order by {axis})"
    return f"""select *, case when lag({v}) {w} is null then lead({v}) {w} - {v} when lead({v}) {w} is null then {v} - lag({v}) {w}
      else (lead({v}) {w} - lag({v}) {w}) / 2.0e0 end::double {out} from ({of})"""


_G = _gradient("v", "y", "gy", _gradient("v", "x", "gx", DENSE))


@query(f"select z, y, x, gx, gy from ({_G})")
def image_gradient(spark, sf_dir):
    d = fx.dense(spark, sf_dir)
    return image.gradient(image.gradient(d, "v", "x", "gx"), "v", "y", "gy").select("z", "y", "x", "gx", "gy")


_H = _gradient("gy", "y", "hyy", _gradient("gx", "y", "hxy", _gradient("gx", "x", "hxx", _G)))


@query(f"select z, y, x, hxx, hxy, hyy from ({_H})")
def image_hessian(spark, sf_dir):
    return image.hessian(fx.dense(spark, sf_dir)).select("z", "y", "x", "hxx", "hxy", "hyy")


_H3 = _gradient("gz", "z", "hzz", _gradient("gy", "z", "hyz", _gradient("gx", "z", "hxz", _gradient("v", "z", "gz", _H))))


@query(f"select z, y, x, hxx, hxy, hxz, hyy, hyz, hzz from ({_H3})")
def image_hessian3d(spark, sf_dir):
    return image.hessian(fx.dense(spark, sf_dir), axes=("x", "y", "z")).select("z", "y", "x", "hxx", "hxy", "hxz", "hyy", "hyz", "hzz")


@query(f"select z, y, x, hxx a, hxy b, hxy c, hyy d from ({_H})")
def symmetric_image(spark, sf_dir):
    h = image.symmetric_image(image.hessian(fx.dense(spark, sf_dir)))
    return h.select("z", "y", "x", *(F.col("h")[i][j].alias(n) for n, i, j in (("a", 0, 0), ("b", 0, 1), ("c", 1, 0), ("d", 1, 1))))


_RIDGE = f"""select z, y, x, v, case when t < 0 then sqrt((a - c) * (a - c) + 4 * b * b) else 0 end::double s,
  case when t < 0 then 0.5e0 * atan2(0.0e0 - 2 * b, 0.0e0 - (a - c)) else 0 end::double o from (
  select z, y, x, v, hxx + hyy t, hxx * hxx + hxy * hxy a, (hxx + hyy) * hxy b, hyy * hyy + hxy * hxy c from ({_H}))"""


@query(f"select z, y, x, {r('s')} s, {r('o')} o from ({_RIDGE})")
def ridge_saliency(spark, sf_dir):
    return rounded(image.ridge(fx.dense(spark, sf_dir)).drop("v"), 4, "s", "o")


def _nms(of: str, digits: int = 6) -> str:
    p8 = math.pi / 8
    return f"""with i as materialized (select z, y, x, s, round(((o + {math.pi / 2}) % {math.pi} + {math.pi}) % {math.pi}, {digits}) n,
    y > 0 and y < {fx.NY - 1} and x > 0 and x < {fx.NX - 1} as inside from ({of})),
  d as (select *, case when n >= {7 * p8} then -1 when n >= {5 * p8} then -1 when n >= {3 * p8} then 0 else 1 end dx,
    case when n >= {7 * p8} then 0 when n >= {5 * p8} then 1 when n >= {3 * p8} then 1 when n >= {p8} then 1 else 0 end dy from i),
  b as materialized (select d.z, d.y py, d.x px, i.y, i.x from d, (values (1), (-1)) as k(e), i
    where d.inside and i.z = d.z and i.y = d.y + k.e * d.dy and i.x = d.x + k.e * d.dx and d.s > i.s),
  m as (select z, py y, px x from b group by 1, 2, 3 having count(*) = 2)
  select z, y, x from m anti join b using (z, y, x)"""


@query(_nms(_RIDGE))
def nms_slices(spark, sf_dir):
    return image.non_maximum_suppression(image.ridge(fx.dense(spark, sf_dir)), digits=6)


@query(f"select z, y, x, {r(f'least(((b - a) % {math.pi} + {math.pi}) % {math.pi}, {math.pi} - ((b - a) % {math.pi} + {math.pi}) % {math.pi})')} d from (select z, y, x, (v % 1000) / 100.0e0 a, (y * 7 + x) / 10.0e0 b from ({fx.VOX}))")
def orient_absdiff(spark, sf_dir):
    v = fx.vox(spark, sf_dir)
    return rounded(v.select("z", "y", "x", orients_absdiff((F.col("v") % 1000) / 100.0, (F.col("y") * 7 + F.col("x")) / 10.0).alias("d")), 4, "d")


def _smooth(of: str, axis: str, n: int) -> str:
    others = [c for c in "zyx" if c != axis]
    k = ", ".join(f"({a}, {w!r}::double)" for a, w in image.gaussian_kernel(1.0))
    return f"""select a.z, a.y, a.x, sum(k.w * b.v) v from ({of}) a, (values {k}) k(d, w), ({of}) b
      where {" and ".join(f"a.{c} = b.{c}" for c in others)} and b.{axis} = least(greatest(a.{axis} + k.d, 0), {n - 1}) group by 1, 2, 3"""


@query(f"with d as materialized ({DENSE}), e as materialized ({_smooth('select * from d', 'y', fx.NY)}) select z, y, x, {r('v', 3)} v from ({_smooth('select * from e', 'x', fx.NX)})")
def gaussian_smooth(spark, sf_dir):
    return rounded(image.gaussian(fx.dense(spark, sf_dir), 1.0), 3, "v")


_SET = f"select z, y, x from ({fx.VOX}) where n >= 2 or v % 3 = 0"


def _set(spark, sf_dir):
    return fx.vox(spark, sf_dir).where("n >= 2 or v % 3 = 0").select("z", "y", "x")


_CROSS = "(values (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) k(dy, dx)"


@query(f"select distinct z, y + dy y, x + dx x from ({_SET}), {_CROSS}")
def dilate(spark, sf_dir):
    return image.dilate(_set(spark, sf_dir))


@query(f"with s as ({_SET}) select s.z, s.y, s.x from s, {_CROSS}, s b where b.z = s.z and b.y = s.y + dy and b.x = s.x + dx group by 1, 2, 3 having count(*) = 5")
def erode(spark, sf_dir):
    return image.erode(_set(spark, sf_dir))


@query(f"with s as (select distinct z, y + dy y, x + dx x from ({_SET}), {_CROSS}) select s.z, s.y, s.x from s, {_CROSS}, s b where b.z = s.z and b.y = s.y + dy and b.x = s.x + dx group by 1, 2, 3 having count(*) = 5")
def close(spark, sf_dir):
    return image.close(_set(spark, sf_dir))


@query(f"with s as ({_SET}), e as (select s.z, s.y, s.x from s, {_CROSS}, s b where b.z = s.z and b.y = s.y + dy and b.x = s.x + dx group by 1, 2, 3 having count(*) = 5) select * from s except select * from e")
def component_boundary(spark, sf_dir):
    return image.boundary(_set(spark, sf_dir))


@query(f"select row_number() over (order by z, y, x) - 1 idx, z, y, x from ({DENSE}) where v <> 0")
def pixels_to_points(spark, sf_dir):
    return image.pixels2points(fx.dense(spark, sf_dir))


@query(f"select * from ({DENSE}) where v <> 0")
def sparsify(spark, sf_dir):
    return image.sparsify(fx.dense(spark, sf_dir))


@query(f"select a.z::int z, b.y::int y, c.x::int x, coalesce(vox.v, 0)::bigint v from range(0, 8) a(z), range(0, 50) b(y), range(0, 64) c(x) left join ({fx.VOX}) vox on a.z = vox.z and b.y = vox.y and c.x = vox.x")
def densify(spark, sf_dir):
    return image.densify(fx.vox(spark, sf_dir), (8, fx.NY, fx.NX))


#: Places brighter than their slice's mean by half of it: a mask, with components of all sizes.
_IDS = f"select z * 10000 + y * 100 + x as id, z, y, x from ({fx.VOX}) qualify v > 1.5e0 * avg(v) over (partition by z)"


def _ids(spark, sf_dir):
    means = fx.vox(spark, sf_dir).groupBy("z").agg(F.avg("v").alias("mean"))
    return fx.vox(spark, sf_dir).join(means, "z").where("v > 1.5 * mean").select((F.col("z") * 10000 + F.col("y") * 100 + F.col("x")).alias("id"), "z", "y", "x")


def _components(nodes: str, edges: str) -> str:
    """DuckDB's components: the smallest label around is taken until nothing changes."""
    return f"""with recursive n as materialized ({nodes}), e as materialized ({edges}), b as materialized (select src, dst from e union select dst, src from e),
  reach(id, to_id) as (select id, id from n union select reach.id, b.dst from reach join b on b.src = reach.to_id)
  select id, min(to_id) component from reach group by 1"""


@query(_components(_IDS, f"select a.id src, b.id dst from ({_IDS}) a join ({_IDS}) b on a.z = b.z and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 and a.id < b.id"))
def image_components(spark, sf_dir):
    from voxelry.operators.graph import connected_components

    px = _ids(spark, sf_dir)
    found = connected_components(image.adjacent_pairs(px, 2)).withColumn("id", F.col("id").cast("int"))
    return px.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").cast("int").alias("component"))


_NEAR3 = "greatest(abs(a.z - b.z), abs(a.y - b.y), abs(a.x - b.x)) = 1 and abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) <= 2"
_C3 = _components(_IDS, f"select a.id src, b.id dst from ({_IDS}) a join ({_IDS}) b on a.id < b.id and {_NEAR3}")


@query(f"""with c as materialized ({_C3}), s as (select component, count(*) size from c group by 1), k as (select *, row_number() over (order by size desc, component) place from s)
select id, k.component::bigint component, size, place from c join k on c.component = k.component where place <= 3""")
def image_components_3d(spark, sf_dir):
    kept = image.largest_image_components(_ids(spark, sf_dir), 3, 2, ("z", "y", "x"), ())
    return kept.select("id", F.col("component").cast("long").alias("component"), "size", "place")


# --- points ---------------------------------------------------------------------------------------------------------

_SPREAD = f"select idx, z, y / 7.0e0 y, x / 7.0e0 x from ({CLOUD})"


def _spread(spark, sf_dir):
    return fx.cloud(spark, sf_dir).withColumns({"y": F.col("y") / 7.0, "x": F.col("x") / 7.0})


_EVEN = "round_even({0}, 0)::int {0}"


@query(f"select distinct z, y, x from (select z, {_EVEN.format('y')}, {_EVEN.format('x')} from ({_SPREAD})) where y >= 0 and y < 20 and x >= 0 and x < 20")
def rasterize(spark, sf_dir):
    return points.rasterize(_spread(spark, sf_dir), (10, 20, 20))


@query(f"select {', '.join(f'greatest(floor(min({c})) - 2, 0)::bigint lo_{c}, (ceil(max({c})) + 2)::bigint hi_{c}, (ceil(max({c})) + 2 - greatest(floor(min({c})) - 2, 0) + 1)::bigint n_{c}' for c in 'zyx')} from ({_SPREAD})")
def points_range(spark, sf_dir):
    return points.points_range(_spread(spark, sf_dir), 1.5)


@query(f"select min(idx) idx, z, y, x from (select idx, z, {_EVEN.format('y')}, {_EVEN.format('x')} from ({_SPREAD})) group by z, y, x")
def deduplicate(spark, sf_dir):
    return points.deduplicate(_spread(spark, sf_dir))


@query(f"select min(idx) idx, z, y, x, count(*) n from (select idx, z, {_EVEN.format('y')}, {_EVEN.format('x')} from ({_SPREAD})) group by z, y, x")
def deduplicate_count(spark, sf_dir):
    return points.deduplicate(_spread(spark, sf_dir), count=True)


@query(f"select idx, x z, y, z x from ({CLOUD})")
def reverse_coord(spark, sf_dir):
    return points.reverse_coord(fx.cloud(spark, sf_dir))


_PLACED = f"select idx, z, y / 3.0e0 + 25 y, x / 3.0e0 + 30 x from ({CLOUD})"


def _placed(spark, sf_dir):
    return fx.cloud(spark, sf_dir).withColumns({"y": F.col("y") / 3.0 + 25, "x": F.col("x") / 3.0 + 30})


@query(f"select idx, p.z, {r('p.y')} y, {r('p.x')} x from ({_PLACED}) p semi join ({fx.VOX}) v on v.z = p.z and v.y = trunc(p.y)::int and v.x = trunc(p.x)::int where p.y >= 0 and p.y < 50 and p.x >= 0 and p.x < 64 and p.z < 8")
def points_in_region(spark, sf_dir):
    return rounded(points.in_region(_placed(spark, sf_dir), fx.vox(spark, sf_dir), (8, fx.NY, fx.NX)), 4, "y", "x")


@query(f"select * from ({CLOUD}) where 2 * y + x - 20 < 1e-9 and x - 3 * y - 40 < 1e-9 and z - 8 < 1e-9")
def points_in_hull(spark, sf_dir):
    return points.in_hull(fx.cloud(spark, sf_dir), [(0, 2, 1, -20), (0, -3, 1, -40), (1, 0, 0, -8)])


_GUIDE = f"select row_number() over (partition by z order by x) idx, z, y, x from ({fx.GUIDE})"


def _guide(spark, sf_dir):
    return fx.guide(spark, sf_dir).withColumn("idx", F.row_number().over(Window.partitionBy("z").orderBy("x")))


@query(f"select z, {r('sum(d)')} length from (select z, coalesce(sqrt((y - lag(y) over w) ** 2 + (x - lag(x) over w) ** 2), 0) d from ({_GUIDE}) window w as (partition by z order by idx)) group by z")
def wireframe_length(spark, sf_dir):
    return rounded(points.wireframe_length(_guide(spark, sf_dir)), 4, "length")


@query(f"select idx, 0.0e0 tz, (0 - x)::double ty, y::double tx, (y * y + x * x)::double bz, (0 - z * y)::double by_, (0 - z * x)::double bx from ({CLOUD})")
def normals_tangent(spark, sf_dir):
    n = fx.cloud(spark, sf_dir).select("idx", *(F.col(c).alias(f"n{c}") for c in "zyx"))
    t = points.normals_tangent(n)
    zero = F.lit(0.0)
    return t.select("idx", *((F.col(a) + zero).alias(b) for a, b in (("tz", "tz"), ("ty", "ty"), ("tx", "tx"), ("bz", "bz"), ("by", "by_"), ("bx", "bx"))))


@query(f"select *, row_number() over (order by d2, cloud) place from (select z cloud, min((z - 3) ** 2 + (y - 5) ** 2 + (x + 7) ** 2) d2 from ({CLOUD}) group by 1)")
def sort_clouds_by_ref(spark, sf_dir):
    return points.sort_clouds_by_ref(fx.cloud(spark, sf_dir).withColumn("cloud", F.col("z")), (3, 5, -7))


@query(f"""with m as (select avg(y) my, avg(x) mx, var_pop(y) vy, var_pop(x) vx, covar_pop(y, x) c from ({CLOUD})),
s as (select idx, z, y, x, (x - mx) * cos(0.5e0 * atan2(2 * c, vx - vy)) + (y - my) * sin(0.5e0 * atan2(2 * c, vx - vy)) score from ({CLOUD}), m)
select idx, z, y, x, {r('score')} score, row_number() over (partition by z order by round(score, 6), idx) place from s""")
def sort_by_pca(spark, sf_dir):
    return rounded(points.sort_by_pca(fx.cloud(spark, sf_dir)), 4, "score")


# --- distances ------------------------------------------------------------------------------------------------------

_D2 = "((a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2)"
_EDGES = f"select a.idx src, b.idx dst, {_D2}::bigint d2 from ({CLOUD}) a join ({CLOUD}) b on a.idx < b.idx and {_D2} <= 36"


@query(f"select * from ({_EDGES})")
def neighbor_edges(spark, sf_dir):
    e = spatial.neighbor_edges(fx.cloud(spark, sf_dir), 6.0)
    return e.select("src", "dst", F.round(F.col("dist") * F.col("dist")).cast("long").alias("d2"))


@query(f"select src, dst, {r(f'exp(-0.5e0 * (least(d, {math.pi} - d) / ({math.pi} / 4)) ** 2)')} weight from (select src, dst, ((((dst % 31) - (src % 31)) / 10.0e0) % {math.pi} + {math.pi}) % {math.pi} d from ({_EDGES}))")
def edge_weights(spark, sf_dir):
    e = spatial.neighbor_edges(fx.cloud(spark, sf_dir), 6.0)
    w = neighbour_weight(orients_absdiff((F.col("src") % 31) / 10.0, (F.col("dst") % 31) / 10.0))
    return rounded(e.select("src", "dst", w.alias("weight")), 4, "weight")


_COMPONENTS = _components(f"select idx id from ({CLOUD})", _EDGES)


@query(f"select id idx, component from ({_COMPONENTS})")
def components(spark, sf_dir):
    return division.point_components(fx.cloud(spark, sf_dir), 6.0).select("idx", "component")


@query(f"""with c as materialized ({_COMPONENTS}), s as (select component, count(*) size from c group by 1), k as (select *, row_number() over (order by size desc, component) place from s)
select id idx, k.component, size, place from c join k on c.component = k.component where place <= 2""")
def largest_components(spark, sf_dir):
    return division.largest(division.point_components(fx.cloud(spark, sf_dir), 6.0), 2).select("idx", "component", "size", "place")


@query(f"select idx, (d2.d2)::bigint d2, d2.b nearest from (select a.idx, min({{'d2': {_D2}, 'b': b.idx}}) d2 from ({CLOUD}) a, ({CLOUD}) b where a.idx % 2 = 0 and b.idx % 2 = 1 group by 1)")
def nn_distance(spark, sf_dir):
    c = fx.cloud(spark, sf_dir).withColumnRenamed("idx", "id")
    near = spatial.nearest(c.where("id % 2 = 0"), c.where("id % 2 = 1"), 8.0)
    return near.select(F.col("a_id").alias("idx"), F.col("d2").cast("long").alias("d2"), F.col("b_id").alias("nearest"))


_MUTUAL = f"select a.idx, min({_D2})::bigint d2, a.idx % 2 side from ({CLOUD}) a, ({CLOUD}) b where a.idx % 2 <> b.idx % 2 group by a.idx"


@query(_MUTUAL.replace("a.idx % 2 side", "(a.idx % 2)::bigint side"))
def mutual_distance(spark, sf_dir):
    c = fx.cloud(spark, sf_dir).withColumnRenamed("idx", "id")
    halves = [c.where(f"id % 2 = {k}") for k in (0, 1)]
    both = [spatial.nearest(halves[k], halves[1 - k], 8.0).select(F.col("a_id").alias("idx"), F.col("d2").cast("long").alias("d2"), F.lit(k).cast("long").alias("side")) for k in (0, 1)]
    return both[0].unionByName(both[1])


_IN_BOX = "select idx, z % 7 + 1 z, 25 + y % 20 y, 32 + x % 20 x from ({})"


def _in_box(spark, sf_dir):
    return fx.cloud(spark, sf_dir).select("idx", (F.col("z") % 7 + 1).alias("z"), (25 + F.col("y") % 20).alias("y"), (32 + F.col("x") % 20).alias("x"))


@query(f"""with p as ({_IN_BOX.format(CLOUD)}), g as (select min(idx) g, z, y, x from ({_GUIDE}) group by z, y, x),
n as (select p.idx, p.z, min({{'d2': (p.y - g.y) ** 2 + (p.x - g.x) ** 2, 'g': g.g}}) k from p join g on p.z = g.z group by 1, 2)
select idx, z, k.g guide_idx, (k.d2)::bigint d2, row_number() over (partition by z order by k.g, k.d2, idx) place from n""")
def sort_by_guide(spark, sf_dir):
    s = spatial.sort_by_guide(_in_box(spark, sf_dir), _guide(spark, sf_dir))
    return s.select("idx", "z", F.col("guide_idx").cast("long").alias("guide_idx"), F.col("d2").cast("long").alias("d2"), "place")


_VALUED = f"select *, (idx * 7919) % 101 v from ({CLOUD})"


def _valued(spark, sf_dir):
    return fx.cloud(spark, sf_dir).withColumn("v", (F.col("idx") * 7919) % 101)


def _local_max(extra: str, r2: int, op: str) -> str:
    return f"with p as ({_VALUED}), t as (select a.idx, max(b.v) m from p a join p b on a.idx <> b.idx and {_D2} <= {r2} {extra} group by 1) select p.idx, p.v from p left join t using (idx) where m is null or p.v {op} m"


@query(_local_max("", 36, ">="))
def localmax_neighbors(spark, sf_dir):
    return spatial.local_maxima(_valued(spark, sf_dir), 6.0).select("idx", "v")


@query(_local_max("", 36, ">"))
def localmax_strict(spark, sf_dir):
    return spatial.local_maxima(_valued(spark, sf_dir), 6.0, include_eq=False).select("idx", "v")


@query(_local_max("and a.z = b.z", 100, ">="))
def localmax_perslice(spark, sf_dir):
    return spatial.local_maxima(_valued(spark, sf_dir), 10.0, per_slice=True).select("idx", "v")


@query(f"""with recursive p as materialized (select *, row_number() over (order by v desc, idx) k from ({_VALUED})),
g(k, kept) as (select 0::bigint, []::bigint[] union all
  select g.k + 1, case when exists (select 1 from p b where list_contains(g.kept, b.idx) and {_D2} <= 64) then g.kept else list_append(g.kept, a.idx) end
  from g join p a on a.k = g.k + 1)
select unnest(kept) idx from g where k = (select max(k) from p)""")
def localmax_exclusion(spark, sf_dir):
    return spatial.exclusion(_valued(spark, sf_dir), 8.0).select("idx")


# --- sampling volumes -----------------------------------------------------------------------------------------------

#: A place for each slice and column: the guide's row, between places along y and x.
_PTS = f"select row_number() over (order by z, x) idx, z, y + 0.5e0 y, x * 0.9375e0 + 0.25e0 x from ({fx.GUIDE})"


def _pts(spark, sf_dir):
    p = points.ordinal(fx.guide(spark, sf_dir), "z", "x")
    p = p.select((F.col("ord") + 1).cast("int").alias("idx"), "z", (F.col("y") + 0.5).alias("y"), (F.col("x") * 0.9375 + 0.25).alias("x"))
    return points.normals_tangent(p.withColumns({"nz": F.lit(0.0), "ny": F.lit(0.0), "nx": F.lit(1.0)}))


def _sample(of: str) -> str:
    """Linear samples at z, y, x of every row; only z is whole."""
    return f"""select s.*, coalesce(t.v, (select min(v) from d)) sample from (select *, row_number() over () rid from ({of})) s left join (
      select s.rid, sum((1 - abs(s.y - d.y)) * (1 - abs(s.x - d.x)) * d.v) v from (select *, row_number() over () rid from ({of})) s join d
      on d.z = s.z and d.y between floor(s.y) and ceil(s.y) and d.x between floor(s.x) and ceil(s.x) group by 1
      having sum((1 - abs(s.y - d.y)) * (1 - abs(s.x - d.x))) > 1 - 1e-9) t on s.rid = t.rid"""


_OFFSETS = ", ".join(f"({n}, {a}, {b})" for n, a, b in spatial.box_offsets((-1, 2), 2))
# With the normal along x, the first tangent is -y and the second z.
_BOX = f"select p.idx, o.n, o.t1, o.t2, p.z + o.t2 z, p.y - o.t1 y, p.x + o.n x from ({_PTS}) p, (values {_OFFSETS}) o(n, t1, t2) order by p.idx, o.n, o.t1, o.t2"


@query(f"select n, t1, t2 from (values {_OFFSETS}) o(n, t1, t2)")
def box_coords(spark, sf_dir):
    each = F.explode(F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(("n", "t1", "t2"), o, strict=True))) for o in spatial.box_offsets((-1, 2), 2)))).alias("o")
    return spark.range(1).select(each).select("o.*")


@query(f"with d as materialized ({DENSE}), s as materialized ({_sample(_BOX)}) select idx, {r('avg(sample)')} mean from s group by 1")
def box_average(spark, sf_dir):
    return rounded(spatial.box_average(_pts(spark, sf_dir), fx.dense(spark, sf_dir), (-1, 2), 2), 4, "mean")


@query(f"with d as materialized ({DENSE}), s as materialized ({_sample(_BOX)}), q as (select idx, quantile_cont(sample, 0.5) q from s group by 1) select s.idx, {r('avg(sample)')} mean from s join q using (idx) where sample >= q group by 1")
def box_average_frac(spark, sf_dir):
    return rounded(spatial.box_average(_pts(spark, sf_dir), fx.dense(spark, sf_dir), (-1, 2), 2, fraction=0.5), 4, "mean")


_ROT = f"""with d as materialized ({DENSE}), s as materialized ({_sample(_BOX)}), c as (select idx, n + 1 i, ceil(sqrt(t1 * t1 + t2 * t2))::int j, avg(sample) m from s group by 1, 2, 3),
f as (select p.idx, i.i::int i, j.j::int j, coalesce(c.m, 0) "value" from ({_PTS}) p cross join range(0, 4) i(i) cross join range(0, 3) j(j) left join c on c.idx = p.idx and c.i = i.i and c.j = j.j)"""


@query(f'{_ROT} select idx, i, j, {r(chr(34) + "value" + chr(34))} "value" from f')
def box_rotavg(spark, sf_dir):
    b = spatial.box_cells(_pts(spark, sf_dir), fx.dense(spark, sf_dir), (-1, 2), 2, normalize=False)
    return rounded(b, 4, "value")


@query(f'{_ROT} select idx, i, j, round(("value" - avg("value") over w) / case when stddev_pop("value") over w < 1e-8 then 1 else stddev_pop("value") over w end, 4) + 0.0e0 "value" from f window w as (partition by idx)')
def box_rotavg_zscore(spark, sf_dir):
    return rounded(spatial.box_cells(_pts(spark, sf_dir), fx.dense(spark, sf_dir), (-1, 2), 2), 4, "value")


@query(f"""with d as materialized ({DENSE}), s as materialized ({_sample(_BOX)}) select p.idx, i.i::int i, j.j::int j, k.k::int k, coalesce({r('s.sample')}, 0.0e0) "value"
from ({_PTS}) p cross join range(0, 4) i(i) cross join range(0, 5) j(j) cross join range(0, 5) k(k) left join s on s.idx = p.idx and s.n + 1 = i.i and s.t1 + 2 = j.j and s.t2 + 2 = k.k""")
def box_3d(spark, sf_dir):
    return rounded(spatial.box_cells(_pts(spark, sf_dir), fx.dense(spark, sf_dir), (-1, 2), 2, rotate=False, normalize=False), 4, "value")


_ALONG = f"select p.idx, k.dist, p.z, p.y, p.x + k.dist x from ({_PTS}) p, (values (0.0e0), (0.5e0), (1.0e0), (2.5e0)) k(dist) order by 1, 2"
_PROJECT = "with m as (select avg(z) mz, avg(y) my, avg(x) mx from p) select idx, y - my p1, z - mz p2 from p, m"


@query(f"with d as materialized ({DENSE}), s as materialized ({_sample(_ALONG)}) select idx, dist, {r('sample')} sample from s")
def sample_along_normals(spark, sf_dir):
    return rounded(spatial.sample_along_normals(_pts(spark, sf_dir), fx.dense(spark, sf_dir), [0, 0.5, 1, 2.5]), 4, "sample")


@query(f"""with d as materialized ({DENSE}), s as materialized ({_sample(_ALONG)}), a as (select idx, avg(sample) v from s group by 1),
p as (select idx, z::double z, y, x from ({_PTS})), m as (select avg(z) mz, avg(y) my from p)
select p.idx, {r('a.v')} v, {r('(y - my)')} p1, {r('(z - mz)')} p2 from p join a using (idx), m""")
def membranogram(spark, sf_dir):
    p = _pts(spark, sf_dir)
    mean = spatial.sample_along_normals(p, fx.dense(spark, sf_dir), [0, 0.5, 1, 2.5]).groupBy("idx").agg(F.avg("sample").alias("v"))
    # The normals lie along x, so e1 = z x normal is the axis y, up to its sign.
    placed = spatial.project(p).withColumn("p1", F.col("p1"))
    return rounded(placed.join(mean, "idx").select("idx", "v", "p1", "p2"), 4, "v", "p1", "p2")


_N = f"select idx, z::double z, y::double y, x::double x, 0.0e0 nz, 3.0e0 ny, (idx % 3 - 4)::double nx from ({CLOUD})"


@query(f"""with p as ({_N}), m as (select avg(z) mz, avg(y) my, avg(x) mx, avg(ny) ny, avg(nx) nx from p), e as (select *, -ny / sqrt(ny * ny + nx * nx) e1x, nx / sqrt(ny * ny + nx * nx) e1y from m)
select idx, {r('case when e1x < 0 then -1 else 1 end * ((x - mx) * e1x + (y - my) * e1y)')} p1, {r('(z - mz)')} p2 from p, e""")
def plane_projection(spark, sf_dir):
    p = fx.cloud(spark, sf_dir).select("idx", *(F.col(c).cast("double").alias(c) for c in "zyx"), F.lit(0.0).alias("nz"), F.lit(3.0).alias("ny"), (F.col("idx") % 3 - 4).cast("double").alias("nx"))
    return rounded(spatial.project(p).select("idx", "p1", "p2"), 4, "p1", "p2")


# --- contours and grids ---------------------------------------------------------------------------------------------


@query(f"""select object, idx, (sum(case when d is null or d > 40 then 1 else 0 end) over (partition by object order by idx))::bigint contour
from (select object, idx, abs(value - lag(value) over (partition by object order by idx)) d from ({fx.CONTOUR}))""")
def contour_split(spark, sf_dir):
    return contour.split_at_gaps(fx.contour(spark, sf_dir), 40.0, axes=("value",)).select("object", "idx", "contour")


_TRACK = f"select * from ({fx.GUIDE}) where (z * 31 + x * 17) % 3 <> 0"


def _track(spark, sf_dir):
    return fx.guide(spark, sf_dir).where("(z * 31 + x * 17) % 3 <> 0")


@query(f"""with t as (select x, z, y, lead(z) over w z2, lead(y) over w y2 from ({_TRACK}) window w as (partition by x order by z))
select x, zi::int z, {r('case when z2 is null then y else ((z2 - zi) * y + (zi - z) * y2) / (z2 - z)::double end')} y from (select *, unnest(range(z, coalesce(z2, z + 1))) zi from t)""")
def contour_gap_fill(spark, sf_dir):
    return rounded(contour.gap_fill(_track(spark, sf_dir)), 4, "y")


_CHORD = f"""select z, idx, y, x, run / max(run) over (partition by z) t from (select *, sum(s) over (partition by z order by idx) run from (
  select *, coalesce(sqrt(sqrt((y - lag(y) over w) ** 2 + (x - lag(x) over w) ** 2)), 0) s from ({_GUIDE}) window w as (partition by z order by idx)))"""


@query(f"select z, idx, {r('t')} t from ({_CHORD})")
def chord_parameters(spark, sf_dir):
    return rounded(contour.chord_parameters(_guide(spark, sf_dir)).select("z", "idx", "t"), 4, "t")


@query(f"""with c as ({_CHORD}), n as (select z, count(*) n from c group by 1), m as (select c.z, idx::bigint k, avg(t) over (partition by c.z order by idx rows 1 preceding) knot, n from c join n on c.z = n.z)
select z, k, {r('knot')} knot from m where k >= 3 and k < n union all select z, unnest(range(0, 3)), 0.0e0 from n union all select z, n + unnest(range(0, 3)), 1.0e0 from n""")
def knots(spark, sf_dir):
    return rounded(contour.knots(contour.chord_parameters(_guide(spark, sf_dir)), 2), 4, "knot")


_SLICES = f"select row_number() over (partition by z order by y, x) idx, z, y, x from ({fx.VOX})"


def _slices(spark, sf_dir):
    return fx.vox(spark, sf_dir).select(F.row_number().over(Window.partitionBy("z").orderBy("y", "x")).alias("idx"), "z", "y", "x")


@query(f"""with p as ({_SLICES}), zs as (select distinct z from p), q as (select z, row_number() over (order by z) rz, count(*) over () nz from zs),
b as (select z, ntile(3) over (order by z) - 1 iu from q where rz < nz), f as (select iu, min(z) z from b group by 1 union all select 3, z from q where rz = nz),
s as (select f.iu, p.*, row_number() over (partition by p.z order by idx) rr, count(*) over (partition by p.z) n from p join f on p.z = f.z),
e as (select *, greatest(1, floor(n / 6.0e0 * 0.25e0))::int side from s)
select iu, z, idx, y, x, case when rr <= side then 0 else 5 end::int iv from e where rr <= side or rr > n - side
union all select iu, z, idx, y, x, ntile(4) over (partition by iu, z order by idx) from e where rr > side and rr <= n - side""")
def sampling_grid(spark, sf_dir):
    g = contour.sampling_grid(_slices(spark, sf_dir), 4, 6)
    return g.select("iu", "z", "idx", "y", "x", "iv")


@query(f"select min(idx) idx, z, y, x, count(*) n from (select idx, round_even(z / 4.0e0, 0)::int z, round_even(y / 4.0e0, 0)::int y, round_even(x / 4.0e0, 0)::int x from ({CLOUD})) group by z, y, x")
def grid_downscale(spark, sf_dir):
    return contour.grid_downscale(fx.cloud(spark, sf_dir), 4.0)


@query(f"""with a as (select * from ({CLOUD}) where idx % 2 = 0), b as (select * from ({CLOUD}) where idx % 2 = 1),
p as (select a.idx, least(min({_D2}), 25) d from a, b group by 1), q as (select b.idx, min({_D2}) d from a, b group by 1)
select (select sum(d) from p)::double coverage, (select count(*) from q where d > 25) excess""")
def surface_fitness(spark, sf_dir):
    c = fx.cloud(spark, sf_dir)
    return surface.surface_fitness(c.where("idx % 2 = 0"), c.where("idx % 2 = 1"), 5.0)


@query(f"with f as materialized ({fx.FITNESS}) select * from f a where not exists (select 1 from f b where b.f1 <= a.f1 and b.f2 <= a.f2 and (b.f1 < a.f1 or b.f2 < a.f2))")
def pareto_front(spark, sf_dir):
    return surface.pareto_front(fx.fitness(spark, sf_dir)).select("id", "f1", "f2")


@query(f"select gen, coverage, {r('1 - coverage / lag(coverage) over (order by gen)')} change_ratio from (select z gen, sum(v)::double coverage from ({fx.VOX}) group by 1)")
def change_ratios(spark, sf_dir):
    log = fx.vox(spark, sf_dir).groupBy(F.col("z").alias("gen")).agg(F.sum("v").cast("double").alias("coverage"))
    return rounded(surface.change_ratios(log), 4, "change_ratio")


@query(f"""with p as (select z, 1 object, idx, y, x, sqrt((y - lag(y) over w) ** 2 + (x - lag(x) over w) ** 2) d, lag(z) over w lz from ({_GUIDE}) window w as (order by z, idx))
select object, (sum(case when lz is null or lz <> z or d > 3 then 1 else 0 end) over (order by z, idx))::int contour, x::double x, y::double y, z, idx from p""")
def model_contours(spark, sf_dir):
    return point_files.clouds_to_model(_guide(spark, sf_dir).withColumn("object", F.lit(1)), 3.0)


@query(f"select * from ({_GUIDE}) where z in (select z from ({_GUIDE}) group by z having count(*) >= 2)")
def slices_with_points(spark, sf_dir):
    return contour.slices_with_points(_guide(spark, sf_dir))
