"""Images, clouds and contours made from the driver's tables; the SQL is the same for Spark and DuckDB unless noted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sparse voxels: slice, row, column, count and value (cents).
VOX = """select cast(l_linenumber as int) z, cast(l_quantity as int) - 1 y, cast(l_partkey % 64 as int) x,
  count(*) n, cast(sum(cast(round(l_extendedprice * 100, 0) as bigint)) as bigint) v from lineitem group by 1, 2, 3"""
#: One row for each slice and column: the mean row.
GUIDE = f"select z, x, cast(floor(avg(y)) as int) y from ({VOX}) vox group by 1, 2"
#: Rows of voxels with a value for every place of a 7 x 50 x 64 box (units of 10000, so that sums stay exact).
NY, NX = 50, 64
#: Rows of lineitem to a partition of the volumes' places; there are about six places to a row.
PART_ROWS = 500_000
DENSE_SPARK = f"""select g.z, g.y, g.x, coalesce(vox.v div 10000, 0) v from
  (select z, y, explode(sequence(0, {NX - 1})) x from (select z, explode(sequence(0, {NY - 1})) y from (select explode(sequence(1, 7)) z))) g
  left join ({VOX}) vox on g.z = vox.z and g.y = vox.y and g.x = vox.x"""
DENSE_DUCK = f"""select g.z, g.y, g.x, coalesce(vox.v // 10000, 0)::bigint v from
  (select a.z::int z, b.y::int y, c.x::int x from range(1, 8) a(z), range(0, {NY}) b(y), range(0, {NX}) c(x)) g
  left join ({VOX}) vox on g.z = vox.z and g.y = vox.y and g.x = vox.x"""
#: The same by volume; the number of volumes grows with the table.
VOL_VOX = VOX.replace("select ", "select cast(floor(l_orderkey / 4000.0e0) as int) vol, ").replace("group by 1, 2, 3", "group by 1, 2, 3, 4")
VOL_DENSE_DUCK = f"""select g.vol, g.z, g.y, g.x, coalesce(v.v // 10000, 0)::bigint v from
  (select vol, a.z::int z, b.y::int y, c.x::int x from (select distinct vol from ({VOL_VOX})), range(1, 8) a(z), range(0, {NY}) b(y), range(0, {NX}) c(x)) g
  left join ({VOL_VOX}) v on g.vol = v.vol and g.z = v.z and g.y = v.y and g.x = v.x"""
#: A cloud of points; arrays start at 0 in Spark and at 1 in DuckDB.
CLOUD_SPARK = "select vec_id idx, label z, cast(floor(100 * cast(embedding[0] as double)) as int) y, cast(floor(100 * cast(embedding[1] as double)) as int) x from embeddings"
CLOUD_DUCK = CLOUD_SPARK.replace("[1]", "[2]").replace("[0]", "[1]")
#: Ordered contours with gaps: one for each user.
CONTOUR = "select user_id object, row_number() over (partition by user_id order by ts, event_id) idx, 0 z, value from events"
#: Two sums to minimise for each part.
FITNESS = """select l_partkey id, cast(sum(cast(round(l_extendedprice * 100, 0) as bigint)) as bigint) f1,
  cast(-sum(cast(l_quantity as bigint)) as bigint) f2 from lineitem group by 1"""


def load(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def vox(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "lineitem")
    return spark.sql(VOX)


def guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "lineitem")
    return spark.sql(GUIDE)


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "lineitem")
    return spark.sql(DENSE_SPARK)


def vol_vox(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "lineitem")
    return spark.sql(VOL_VOX)


def vol_parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for the volumes' places: their number grows with the table, so that a task's share doesn't."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))


def vol_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As VOL_DENSE_DUCK, dealt to :func:`vol_parts` partitions at each step."""
    load(spark, sf_dir, "lineitem")
    n, place = vol_parts(spark, sf_dir), ["vol", "z", "y", "x"]
    row = spark.sql("select cast(floor(l_orderkey / 4000.0e0) as int) vol, cast(l_linenumber as int) z, cast(l_quantity as int) - 1 y, cast(l_partkey % 64 as int) x, cast(round(l_extendedprice * 100, 0) as bigint) v from lineitem")
    voxels = row.repartition(n, *place).groupBy(*place).agg(F.sum("v").alias("sum"))
    each = lambda low, high: F.explode(F.sequence(F.lit(low), F.lit(high)))
    grid = row.select("vol").distinct().repartition(n, "vol").withColumn("z", each(1, 7)).withColumn("y", each(0, NY - 1)).withColumn("x", each(0, NX - 1))
    return grid.repartition(n, *place).join(voxels, place, "left").select(*place, F.coalesce(F.expr("sum div 10000"), F.lit(0)).cast("bigint").alias("v"))


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "embeddings")
    return spark.sql(CLOUD_SPARK)


def contour(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "events")
    return spark.sql(CONTOUR)


def fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "lineitem")
    return spark.sql(FITNESS)
