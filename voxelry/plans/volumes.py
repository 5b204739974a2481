"""Queries over many volumes side by side, with DuckDB SQL: blocks with rims, files of volumes and of contours, graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelry import fixtures as fx
from voxelry.operators import blocks, division, image, isolines
from voxelry.operators import nearest_place as nearest
from voxelry.plans.catalogue import r, rounded
from voxelry.sources import models
from voxelry.sources import mrc_source as mrc_source_
from voxelry.storage import cut, new_folder

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Blocks that cut the fixtures' volumes of 7 x 50 x 64 places along every axis.
SIZE = (4, 16, 24)
_DENSE = fx.VOL_DENSE_DUCK
_SIDES = {"z": (0, 7), "y": (0, fx.NY - 1), "x": (0, fx.NX - 1)}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _blocks(spark, sf_dir):
    return blocks.to_blocks(fx.vol_dense(spark, sf_dir), SIZE, (8, fx.NY, fx.NX))


def _slope(v: str, axis: str, out: str, of: str) -> str:
    w = f"over (partition by vol, {', '.join(c for c in 'zyx' if c != axis)} order by {axis})"
    return f"""select *, case when lag({v}) {w} is null then lead({v}) {w} - {v} when lead({v}) {w} is null then {v} - lag({v}) {w}
      else (lead({v}) {w} - lag({v}) {w}) / 2.0e0 end::double {out} from ({of})"""


def _smooth(of: str, axis: str) -> str:
    low, high = _SIDES[axis]
    k = ", ".join(f"({a}, {w!r}::double)" for a, w in image.gaussian_kernel(1.0))
    same = " and ".join(f"a.{c} = b.{c}" for c in ("vol", *"zyx") if c != axis)
    return f"""select a.vol, a.z, a.y, a.x, sum(k.w * b.v) v from {of} a, (values {k}) k(d, w), {of} b
      where {same} and b.{axis} = least(greatest(a.{axis} + k.d, {low}), {high}) group by 1, 2, 3, 4"""


#: With slice 0, which has no voxel and counts as zeros.
_WHOLE = f"w as materialized (select vol, z, y, x, v::double v from ({_DENSE}) union all select vol, 0, y, x, 0 from ({_DENSE}) where z = 1)"
_SMOOTH = f"{_WHOLE}, sz as materialized ({_smooth('w', 'z')}), sy as materialized ({_smooth('sz', 'y')}), sx as materialized ({_smooth('sy', 'x')})"


@query(f"with {_SMOOTH} select vol, z, y, x, {r('v', 3)} v from sx")
def block_smooth(spark, sf_dir):
    return rounded(blocks.to_voxels(blocks.smooth_blocks(_blocks(spark, sf_dir), 1.0, SIZE), "v"), 3, "v")


_SLOPES = _slope("v", "z", "gz", _slope("v", "y", "gy", _slope("v", "x", "gx", "select * from sx")))


@query(f"with {_SMOOTH} select vol, z, y, x, {r('gz', 3)} gz, {r('gy', 3)} gy, {r('gx', 3)} gx from ({_SLOPES})")
def block_gradient(spark, sf_dir):
    return rounded(blocks.to_voxels(blocks.gradient_blocks(_blocks(spark, sf_dir), 1.0, SIZE), "gz", "gy", "gx"), 3, "gz", "gy", "gx")


_H = _slope("gy", "y", "hyy", _slope("gx", "y", "hxy", _slope("gx", "x", "hxx", _slope("v", "y", "gy", _slope("v", "x", "gx", "select * from w")))))


@query(f"""with {_WHOLE} select vol, z, y, x, {r('case when t < 0 then sqrt((a - c) * (a - c) + 4 * b * b) else 0 end::double')} s,
  {r('case when t < 0 then 0.5e0 * atan2(0.0e0 - 2 * b, 0.0e0 - (a - c)) else 0 end::double')} o from (
  select vol, z, y, x, hxx + hyy t, hxx * hxx + hxy * hxy a, (hxx + hyy) * hxy b, hyy * hyy + hxy * hxy c from ({_H}))""")
def block_ridge(spark, sf_dir):
    return rounded(blocks.to_voxels(blocks.ridge_blocks(_blocks(spark, sf_dir), 0.0, SIZE), "s", "o"), 4, "s", "o")


@query(f"select vol, z, y, x, v::double v from ({_DENSE}) where z between 3 and 5 and y < 20 and x >= 40")
def mrc_source(spark, sf_dir):
    """Volumes written as files by the data source, and a box of each read from them."""
    mrc_source_.register(spark)
    path = new_folder(spark)
    voxels = fx.vol_vox(spark, sf_dir).select("vol", "z", "y", "x", F.expr("v div 10000").alias("v"))
    # A volume's rows in one run of one task: few writes of long stretches.
    voxels = voxels.repartition("vol").sortWithinPartitions("vol", "z", "y", "x")
    voxels.write.format("mrc").option("shape", f"8,{fx.NY},{fx.NX}").option("pixel", "2.5").mode("overwrite").save(path)
    box = mrc_source_.read_volumes(spark, path).where("z between 3 and 5 and y < 20 and x >= 40")
    return box.withColumn("vol", F.regexp_extract("vol", r"(\d+)\.mrc$", 1).cast("int"))


_VOL_GUIDE = f"select vol, z, x, cast(floor(avg(y)) as int) y from ({fx.VOL_VOX}) vox group by 1, 2, 3"


@query(f"select vol, z object, x + 1 contour, x::double x, y::double y, z::double z from ({_VOL_GUIDE})")
def model_source(spark, sf_dir):
    """A binary model for each volume, an object for each slice, written and read."""
    fx.load(spark, sf_dir, "lineitem")
    path = new_folder(spark)
    models.write_models(spark.sql(_VOL_GUIDE).select("vol", F.col("z").alias("object"), (F.col("x") + 1).alias("contour"), "x", "y", "z"), path)
    found = models.read_models(spark, path).where("problem is null")
    return found.select(F.regexp_extract("vol", r"(\d+)\.mod$", 1).cast("int").alias("vol"), "object", "contour", "x", "y", "z")


_CUSTOMERS = "select c_custkey id, c_nationkey nation, n_regionkey region, row_number() over (partition by c_nationkey order by c_custkey) - 1 k, count(*) over (partition by c_nationkey) size from customer join nation on c_nationkey = n_nationkey"


@query(f"""select id, (rank - 1)::int part from ({_CUSTOMERS}) c join (
  select region, row_number() over (order by count(*) desc, min(id)) rank from ({_CUSTOMERS}) group by region) o on o.region = c.region""")
def divide_regions(spark, sf_dir):
    """Customers are linked within their nation, less to the nations of their region, and least to those of others: five parts."""
    fx.load(spark, sf_dir, "customer", "nation")
    to = lambda nation, k, w: F.struct(nation.cast("int").alias("nation"), k.cast("int").alias("k"), F.lit(w).alias("weight"))
    # Nations are numbered 5 r + m here: region r's m-th.
    place = spark.sql("select n_nationkey nation, n_regionkey region, row_number() over (partition by n_regionkey order by n_nationkey) - 1 m from nation")
    number = F.col("region") * 5 + F.col("m")
    named = cut(spark.sql(_CUSTOMERS).join(F.broadcast(place.drop("region")), "nation").select("id", "k", "size", number.cast("int").alias("nation")))
    n, k = F.col("nation"), F.col("k")
    links = [to(n, (k + d) % F.col("size"), 1.0) for d in (1, 2)] + [to(n, (k * m + 1) % F.col("size"), 1.0) for m in (5, 7, 11)]
    links += [to(F.floor(n / 5) * 5 + (n + d) % 5, k, 0.1) for d in (1, 2)] + [to((n + 5) % 25, k, 0.002)]
    ends = named.select("id", F.explode(F.array(*links)).alias("e")).select(F.col("id").alias("src"), "e.*")
    edges = ends.join(named.select(F.col("id").alias("dst"), "nation", "k"), ["nation", "k"])
    return division.divide_graph(edges.select("src", "dst", "weight"), 5)


_VOL_PLACES = f"select vol, z, row_number() over (partition by vol, z order by x) idx, y, x from ({_VOL_GUIDE}) where (x * 7 + z) % 5 = 0"


@query(f"""with p as materialized ({_VOL_PLACES}), g as (select vol, z, b.y::int y, c.x::int x from (select distinct vol, z from p), range(0, {fx.NY}) b(y), range(0, {fx.NX}) c(x))
select g.vol, g.z, g.y, g.x, min({{'d': (g.y - p.y) ** 2 + (g.x - p.x) ** 2, 'i': p.idx}}).i idx, min((g.y - p.y) ** 2 + (g.x - p.x) ** 2)::bigint d2 from g join p on p.vol = g.vol and p.z = g.z group by 1, 2, 3, 4""")
def nearest_place(spark, sf_dir):
    fx.load(spark, sf_dir, "lineitem")
    return nearest.nearest_place(spark.sql(_VOL_PLACES), (fx.NY, fx.NX), ("vol", "z"))


LEVEL = 300.37


def _millionths(df, *columns: str):
    """Columns rounded to six digits as DuckDB does it: of the product, not of the decimal digits, which differ where those end in 5."""
    return df.withColumns({c: F.round(F.col(c) * 1e6) / 1e6 + F.lit(0.0) for c in columns})


#: Cells with their corners in turn; a line enters over a side where high turns to low, and leaves where low turns to high.
_SEGMENTS = f"""d as materialized ({_DENSE}),
cell as materialized (select a.vol, a.z, a.y, a.x, [a.v, b.v, c.v, e.v] v, (a.v + b.v + c.v + e.v) / 4.0e0 > {LEVEL}e0 middle from d a join d b on b.vol = a.vol and b.z = a.z and b.y = a.y and b.x = a.x + 1
  join d c on c.vol = a.vol and c.z = a.z and c.y = a.y + 1 and c.x = a.x + 1 join d e on e.vol = a.vol and e.z = a.z and e.y = a.y + 1 and e.x = a.x),
side as materialized (select vol, z, y, x, middle, k, v[k + 1] > {LEVEL}e0 h0, v[(k + 1) % 4 + 1] > {LEVEL}e0 h1, ({LEVEL}e0 - v[k + 1]) / (v[(k + 1) % 4 + 1] - v[k + 1]) t from cell, (select unnest(range(0, 4)) k) where (v[k + 1] > {LEVEL}e0) <> (v[(k + 1) % 4 + 1] > {LEVEL}e0)),
place as (select *, count(*) over (partition by vol, z, y, x) n, {{'y': y + (k = 2)::int, 'x': x + (k = 1)::int, 'down': (k % 2)::int}} s, y + case k when 0 then 0 when 1 then t when 2 then 1 else 1 - t end py, x + case k when 0 then t when 1 then 1 when 2 then 1 - t else 0 end px from side),
seg as materialized (select a.vol, a.z, a.s a, b.s b, a.py ay, a.px ax, b.py bty, b.px btx from place a join place b on a.vol = b.vol and a.z = b.z and a.y = b.y and a.x = b.x and a.h0 and b.h1 and (a.n = 2 or b.k = (a.k + case when a.middle then 1 else 3 end) % 4))"""


@query(f"with {_SEGMENTS} select vol, z, a.y sy, a.x sx, a.down down, {r('ay', 6)} ay, {r('ax', 6)} ax, {r('bty', 6)} bty, {r('btx', 6)} btx from seg")
def iso_segments(spark, sf_dir):
    s = isolines.segments(fx.vol_dense(spark, sf_dir), LEVEL, by=("vol", "z"), parts=fx.vol_parts(spark, sf_dir))
    s = s.select("vol", "z", F.col("a.y").alias("sy"), F.col("a.x").alias("sx"), F.col("a.down").alias("down"), "ay", "ax", F.col("by_").alias("bty"), F.col("bx").alias("btx"))
    return _millionths(s, "ay", "ax", "bty", "btx")


@query(f"""with recursive {_SEGMENTS},
node as materialized (select vol, z, a, ay y, ax x from seg union all select vol, z, b, bty, btx from seg where not exists (select 1 from seg o where o.vol = seg.vol and o.z = seg.z and o.a = seg.b)),
link as materialized (select vol, z, a s, b d from seg union all select vol, z, b, a from seg),
c(vol, z, s, low) using key (vol, z, s) as (select vol, z, a, a from node union
  select l.vol, l.z, l.d, min(c.low) from c join link l on l.vol = c.vol and l.z = c.z and l.s = c.s join recurring.c k on k.vol = l.vol and k.z = l.z and k.s = l.d where c.low < k.low group by 1, 2, 3),
size as (select vol, z, low, count(*) n from c group by 1, 2, 3),
first as (select c.vol, c.z, c.low, c.s from c where not exists (select 1 from seg o where o.vol = c.vol and o.z = c.z and o.b = c.s)),
start as (select vol, z, low, s, false closed from first union all select vol, z, low, low, true from size where not exists (select 1 from first f where f.vol = size.vol and f.z = size.z and f.low = size.low)),
walk(vol, z, low, closed, s, place) as (select vol, z, low, closed, s, 0::bigint from start union all
  select w.vol, w.z, w.low, w.closed, seg.b, w.place + 1 from walk w join seg on seg.vol = w.vol and seg.z = w.z and seg.a = w.s where not (w.closed and seg.b = w.low))
select w.vol, w.z, w.low.y sy, w.low.x sx, w.low.down down, w.place, w.closed, size.n, {r('node.y', 6)} y, {r('node.x', 6)} x from walk w join size using (vol, z, low) join node on node.vol = w.vol and node.z = w.z and node.a = w.s""")
def iso_lines(spark, sf_dir):
    found = isolines.iso_lines(fx.vol_dense(spark, sf_dir), LEVEL, by=("vol", "z"), parts=fx.vol_parts(spark, sf_dir))
    return _millionths(found.select("vol", "z", F.col("line.y").alias("sy"), F.col("line.x").alias("sx"), F.col("line.down").alias("down"), "place", "closed", "n", "y", "x"), "y", "x")
