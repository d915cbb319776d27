"""Named queries over the star schema, and the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import aggregate, cluster, fill, fits, lines, masks, matching, morphology, neighbours, project, registration, select, shape, stabilise, tomography
from ..sources import adapters

FLAGSHIP = "otsu_threshold"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

VOX = "vox AS (SELECT CAST(l_partkey % 12 AS INT) i, CAST(l_suppkey % 12 AS INT) j, CAST(l_orderkey % 12 AS INT) k, CAST(SUM(l_quantity) AS BIGINT) v FROM lineitem GROUP BY 1,2,3)"
PIX = "pix AS (SELECT l_linenumber AS view, CAST(l_partkey % 16 AS INT) r, CAST(l_orderkey % 16 AS INT) c, CAST(SUM(l_quantity) AS BIGINT) v FROM lineitem GROUP BY 1,2,3)"
FRM = "frm AS (SELECT CAST(l_suppkey % 3 AS INT) frame, l_linenumber AS view, CAST(l_partkey % 16 AS INT) r, CAST(l_orderkey % 16 AS INT) c, CAST(SUM(l_quantity) AS BIGINT) v FROM lineitem GROUP BY 1,2,3,4)"
ATM = "atm AS (SELECT vec_id atom_id, CAST(embedding[1] AS DOUBLE)*10 x, CAST(embedding[2] AS DOUBLE)*10 y, CAST(embedding[3] AS DOUBLE)*10 z, CAST(label % 3 AS INT) species FROM embeddings)"
MSK = "msk AS (SELECT i, j, k FROM vox, (SELECT avg(v) a FROM vox) WHERE v > a)"
PMSK = "pmsk AS (SELECT view, r, c FROM pix JOIN (SELECT view, avg(v) a FROM pix GROUP BY view) USING (view) WHERE v > a)"
NEAR = "near AS (SELECT a.atom_id a, b.atom_id b, a.species ta, b.species tb, sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z)) d FROM atm a JOIN atm b ON a.atom_id <> b.atom_id AND abs(a.x-b.x) < 1.0 AND abs(a.y-b.y) < 1.0 AND abs(a.z-b.z) < 1.0)"


def query(sql: str | None = None, *parts: str):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = ("WITH " + ", ".join(parts) + " " if parts else "") + sql
        return f

    return put


def rounded(df: DataFrame, *columns: str, to: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), to) for c in columns})


def mask3(spark: SparkSession, d: str) -> DataFrame:
    v = adapters.voxels(spark, d)
    return v.crossJoin(F.broadcast(v.agg(F.avg("v").alias("a")))).where("v > a").select("i", "j", "k")  # one row


def mask2(spark: SparkSession, d: str) -> DataFrame:
    p = adapters.pixels(spark, d)
    return p.join(p.groupBy("view").agg(F.avg("v").alias("a")), "view").where("v > a").select("view", "r", "c")


# thresholds and histograms
SPLIT = """, run AS (SELECT b, n, SUM(n) OVER w AS w, SUM(n*(b+1)) OVER w AS m, SUM(n) OVER () AS wt, SUM(n*(b+1)) OVER () AS mt FROM cnt WINDOW w AS (ORDER BY b ROWS UNBOUNDED PRECEDING)),
 best AS (SELECT b FROM run WHERE w < wt ORDER BY (CAST(mt AS DOUBLE)*w - CAST(m AS DOUBLE)*wt) * (CAST(mt AS DOUBLE)*w - CAST(m AS DOUBLE)*wt) / (CAST(w AS DOUBLE)*(wt-w)) DESC, b LIMIT 1) """


@query("SELECT CAST(b + 1 AS INT) AS threshold FROM best", VOX, "cnt AS (SELECT CAST(greatest(0, least(255, floor(v*255.0/mx))) AS INT) b, COUNT(*) n FROM vox, (SELECT CAST(MAX(v) AS DOUBLE) mx FROM vox) GROUP BY 1)" + SPLIT)
def otsu_threshold(spark: SparkSession, d: str) -> DataFrame:
    """A1 on voxels stretched to 0..255."""
    v = adapters.voxels(spark, d)
    top = v.agg(F.max("v").cast("double").alias("mx"))
    return aggregate.otsu(v.crossJoin(F.broadcast(top)).select((F.col("v") * 255.0 / F.col("mx")).alias("v")))  # one row


@query("SELECT round((b + 1) * mx / 255.0, 6) AS threshold FROM best, (SELECT CAST(MAX(v) AS DOUBLE) mx FROM pix)", PIX, "cnt AS (SELECT CAST(greatest(0, least(255, floor(v*255.0/mx))) AS INT) b, COUNT(*) n FROM pix, (SELECT CAST(MAX(v) AS DOUBLE) mx FROM pix) GROUP BY 1)" + SPLIT)
def otsu_scaled(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregate.otsu_scaled(adapters.pixels(spark, d)), "threshold")


@query("SELECT round(lo + b * (hi - lo) / 256, 6) AS threshold FROM best, ext", PIX, "ext AS (SELECT CAST(MIN(v) AS DOUBLE) lo, CAST(MAX(v) AS DOUBLE) hi FROM pix)", "cnt AS (SELECT CAST(least(255, floor((v-lo)*256/(hi-lo))) AS INT) b, COUNT(*) n FROM pix, ext GROUP BY 1)" + SPLIT)
def otsu_range(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregate.otsu_range(adapters.pixels(spark, d)), "threshold")


@query("SELECT species, CAST(least(19, floor((x-lo)*20/(hi-lo))) AS INT) AS bin, COUNT(*) AS n FROM atm, ext GROUP BY 1, 2", ATM, "ext AS (SELECT MIN(x) lo, MAX(x) hi FROM atm)")
def equal_width_histogram(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.histogram(adapters.atoms(spark, d), "x", 20, ["species"])


@query("SELECT atom_id, x, CAST(dense_rank() OVER (ORDER BY m, species) - 1 AS INT) AS species FROM atm JOIN (SELECT species, AVG(x) m FROM atm GROUP BY 1) USING (species)", ATM)
def relabel_by_mean(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.relabel_by_mean(adapters.atoms(spark, d).select("atom_id", "species", "x"), "species", "x")


@query("SELECT view, round(CAST(SUM((r+1)*v) AS DOUBLE)/SUM(v), 6) AS cr, round(CAST(SUM((c+1)*v) AS DOUBLE)/SUM(v), 6) AS cc FROM pix GROUP BY view", PIX)
def weighted_centroid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregate.centroid(adapters.pixels(spark, d), 16, 16), "cr", "cc")


@query("SELECT view, r, c, round(v * t / s, 6) AS v FROM pix JOIN (SELECT view, CAST(SUM(v) AS DOUBLE) s FROM pix GROUP BY 1) USING (view), (SELECT CAST(SUM(v) AS DOUBLE) t FROM pix WHERE view = (SELECT MIN(view) FROM pix))", PIX)
def normalize_to_first_view(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregate.normalise(adapters.pixels(spark, d)), "v").select("view", "r", "c", "v")


SUM1 = "one AS (SELECT view, r, c, SUM(v) v FROM frm WHERE frame = 0 GROUP BY 1,2,3), two AS (SELECT view, r, c, SUM(v) v FROM frm WHERE frame = 1 GROUP BY 1,2,3), pr AS (SELECT coalesce(one.view, two.view) AS view, coalesce(one.r, two.r) AS r, coalesce(one.c, two.c) AS c, CAST(coalesce(one.v, 0) AS DOUBLE) x, CAST(coalesce(two.v, 0) AS DOUBLE) y FROM one FULL JOIN two ON one.view = two.view AND one.r = two.r AND one.c = two.c)"


def _two(spark, d):
    f = adapters.frames(spark, d)
    return (f.where(F.col("frame") == n).select("view", "r", "c", "v") for n in (0, 1))


@query("SELECT view, round(SUM(abs(x-y))/SUM(abs(x)), 6) AS r1, round(sqrt(SUM((x-y)*(x-y))/SUM(x*x)), 6) AS r2 FROM pr GROUP BY view", FRM, SUM1)
def r_factor(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregate.r_factors(*_two(spark, d), ["view", "r", "c"]), "r1", "r2")


@query("SELECT round(MAX(abs(x-y)), 6) AS max_abs, round(AVG(abs(x-y)), 6) AS mean_abs, round(sqrt(AVG((x-y)*(x-y))), 6) AS rmse, round(corr(x, y), 6) AS corr, round(MAX(abs(x-y) / greatest(abs(x), 1e-12)), 6) AS max_rel, bool_and(abs(x-y) <= 1e-6 + 1e-6*abs(x)) AS allclose FROM pr", FRM, SUM1)
def array_compare(spark: SparkSession, d: str) -> DataFrame:
    out = aggregate.compare(*_two(spark, d), ["view", "r", "c"])
    return rounded(out, "max_abs", "max_rel", "mean_abs", "rmse", "corr")


@query("SELECT round(SUM(x*y)/SUM(x*x), 6) AS scale FROM pr", FRM, SUM1)
def optimal_scale(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    j = a.withColumnRenamed("v", "x").join(b.withColumnRenamed("v", "y"), ["view", "r", "c"], "full").na.fill(0)
    return j.agg(F.round(aggregate.best_scale(F.col("x").cast("double"), F.col("y").cast("double")), 6).alias("scale"))


@query("SELECT i, j, MAX(v) AS v FROM vox GROUP BY i, j", VOX)
def mip_z(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.projection_max(adapters.voxels(spark, d), "k")


@query("SELECT i, j, v FROM vox WHERE k = 6", VOX)
def mid_slice(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.middle_slice(adapters.voxels(spark, d), "k", 12)


@query("SELECT CAST(MIN(v) AS DOUBLE) AS lo, CAST(MAX(v) AS DOUBLE) AS hi FROM vox", VOX)
def finite_min_max(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.finite_range(adapters.voxels(spark, d))


@query("SELECT view, r, c, CAST(SUM(v) AS BIGINT) AS v FROM frm GROUP BY 1,2,3", FRM)
def frame_sum(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.frame_sum(adapters.frames(spark, d))


@query("SELECT view, r, c, round(AVG(v), 6) AS mean, round(var_samp(v), 6) AS var FROM frm GROUP BY 1,2,3", FRM)
def temporal_variance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(adapters.frames(spark, d).groupBy("view", "r", "c").agg(F.avg("v").alias("mean"), F.var_samp("v").alias("var")), "mean", "var")


NOISE = "px AS (SELECT view, r, c, AVG(v) m, var_samp(v) s FROM frm GROUP BY 1,2,3), ok AS (SELECT * FROM px JOIN (SELECT view, MIN(m) least FROM px GROUP BY 1) USING (view) WHERE m > least AND s IS NOT NULL), g AS (SELECT view, SUM(s*m)/SUM(m*m) AS alpha, AVG(s) s, AVG(m) m FROM ok GROUP BY view)"


@query("SELECT view, round(alpha, 6) AS alpha, round(greatest(0E0, s - alpha*m), 6) AS sigma2 FROM g", FRM, NOISE)
def noise_parameters(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregate.noise_parameters(adapters.frames(spark, d)), "alpha", "sigma2")


@query("SELECT round(AVG(CASE WHEN greatest(0E0, s - alpha*m) <> 0 THEN alpha END), 6) AS alpha, round(AVG(CASE WHEN greatest(0E0, s - alpha*m) <> 0 THEN greatest(0E0, s - alpha*m) END), 6) AS sigma2 FROM g", FRM, NOISE)
def average_noise(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregate.average_noise(aggregate.noise_parameters(adapters.frames(spark, d))), "alpha", "sigma2")


@query("""SELECT frame, view, CAST(2 * p + q AS INT) AS phase, CAST(a.x AS INT) AS r, CAST(b.x AS INT) AS c, v FROM range(2) s(p) CROSS JOIN range(2) t(q) CROSS JOIN range(8) a(x) CROSS JOIN range(8) b(x) JOIN frm ON frm.r = (2 * a.x + p) % 15 AND frm.c = 2 * b.x + q""", FRM)
def binned_phases(spark: SparkSession, d: str) -> DataFrame:
    """A19 on 15 rows, where a rolled image's last row is the first, and 16 columns."""
    return aggregate.binned_phases(adapters.frames(spark, d).where("r < 15"), 15, 16)


@query("SELECT view, v FROM (SELECT view, v, row_number() OVER (PARTITION BY view ORDER BY v) k, COUNT(*) OVER (PARTITION BY view) n FROM pix) WHERE k = greatest(1, CAST(round(n / 128E0) AS BIGINT))", PIX)
def kth_background(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.kth(adapters.pixels(spark, d), "v", F.greatest(F.lit(1), F.round(F.col("n") / 128)), ["view"])


@query("SELECT view, frame, CAST(s - p AS BIGINT) AS diff FROM (SELECT view, frame, SUM(v) s, lag(SUM(v)) OVER (PARTITION BY view ORDER BY frame) p FROM frm GROUP BY 1, 2) WHERE p IS NOT NULL", FRM)
def frame_diff_lag(spark: SparkSession, d: str) -> DataFrame:
    sums = adapters.frames(spark, d).groupBy("view", "frame").agg(F.sum("v").alias("s"))
    return aggregate.first_differences(sums, "view", "frame", "s")


@query("SELECT COUNT(*) AS n, round(SUM(u), 6) AS su, round(SUM(u*u), 6) AS suu, round(SUM(dark), 6) AS sy, round(SUM(u*dark), 6) AS suy FROM (SELECT 1/cos(radians(view*10E0-30)) u, CAST(MIN(v) AS DOUBLE) dark FROM pix GROUP BY view)", PIX)
def dark_fit_sums(spark: SparkSession, d: str) -> DataFrame:
    dark = adapters.pixels(spark, d).groupBy("view").agg(F.min("v").cast("double").alias("dark"))
    return rounded(aggregate.dark_fit_sums(dark.join(adapters.angles(spark), "view")), "su", "suu", "sy", "suy")


# shape
@query("SELECT i - 3 AS i, j - 3 AS j, k - 3 AS k, v FROM vox WHERE i BETWEEN 3 AND 8 AND j BETWEEN 3 AND 8 AND k BETWEEN 3 AND 8", VOX)
def center_crop(spark: SparkSession, d: str) -> DataFrame:
    return shape.crop(adapters.voxels(spark, d), {a: (12, 6) for a in "ijk"})


@query("SELECT i + 4 AS i, j + 4 AS j, k + 4 AS k, v FROM vox", VOX)
def center_pad(spark: SparkSession, d: str) -> DataFrame:
    return shape.pad(adapters.voxels(spark, d), {a: (12, 20) for a in "ijk"})


@query("SELECT view, CAST(r - 3 AS INT) AS r, CAST(c + 2 AS INT) AS c, v FROM pix WHERE r BETWEEN 3 AND 12", PIX)
def crop_or_pad(spark: SparkSession, d: str) -> DataFrame:
    return shape.crop_or_pad(adapters.pixels(spark, d), {"r": (16, 10), "c": (16, 20)})


@query("SELECT view, CAST(r - rs AS INT) AS r, CAST(c - cs AS INT) AS c, v FROM pix JOIN (SELECT view, floor(SUM(r*v)/CAST(SUM(v) AS DOUBLE)+1.5)-1-5 rs, floor(SUM(c*v)/CAST(SUM(v) AS DOUBLE)+1.5)-1-5 cs FROM pix GROUP BY view) USING (view) WHERE r - rs BETWEEN 0 AND 9 AND c - cs BETWEEN 0 AND 9", PIX)
def crop_at_center(spark: SparkSession, d: str) -> DataFrame:
    p = adapters.pixels(spark, d)
    centres = aggregate.centroid(p, 16, 16).select("view", (F.col("cr") - 1).alias("cr"), (F.col("cc") - 1).alias("cc"))
    return shape.crop_at(p, centres, 10)


@query("SELECT * FROM pix WHERE view > 1 AND view < 7", PIX)
def select_views(spark: SparkSession, d: str) -> DataFrame:
    return shape.select_views(adapters.pixels(spark, d), trim=True)


@query("SELECT view, CAST(r + 3 AS INT) AS r, CAST(c - 2 AS INT) AS c, v FROM pix WHERE r + 3 < 16 AND c >= 2", PIX)
def zero_shift(spark: SparkSession, d: str) -> DataFrame:
    return shape.shift(adapters.pixels(spark, d), {"r": 3, "c": -2}, {"r": 16, "c": 16})


@query("SELECT view, CAST((r + 3) % 16 AS INT) AS r, CAST((c + 11) % 16 AS INT) AS c, v FROM pix", PIX)
def circular_shift(spark: SparkSession, d: str) -> DataFrame:
    return shape.roll(adapters.pixels(spark, d), {"r": 3, "c": -5}, {"r": 16, "c": 16})


@query("SELECT view, c AS r, r AS c, v FROM pix", PIX)
def transpose_image(spark: SparkSession, d: str) -> DataFrame:
    return shape.transpose(adapters.pixels(spark, d)).select("view", "r", "c", "v")


@query("SELECT * FROM pix WHERE r >= 1 AND c >= 1", PIX)
def drop_first_row_column(spark: SparkSession, d: str) -> DataFrame:
    return shape.drop_first(adapters.pixels(spark, d), ["r", "c"])


@query("SELECT CAST(a.x AS INT) i, CAST(b.x AS INT) j, CAST(c.x AS INT) k FROM range(12) a(x), range(12) b(x), range(12) c(x) WHERE (a.x-6)*(a.x-6)+(b.x-6)*(b.x-6)+(c.x-6)*(c.x-6) <= 36")
def support_sphere(spark: SparkSession, d: str) -> DataFrame:
    return shape.sphere_support(spark, 12)


@query("SELECT CAST(a.x AS INT) di, CAST(b.x AS INT) dj, CAST(c.x AS INT) dk FROM range(-3, 4) a(x), range(-3, 4) b(x), range(-3, 4) c(x) WHERE a.x*a.x+b.x*b.x+c.x*c.x <= 12.25")
def ball_offsets(spark: SparkSession, d: str) -> DataFrame:
    return shape.offsets_frame(spark, shape.ball_offsets(3), ["di", "dj", "dk"])


@query("SELECT CAST(v AS INT) AS view, 0E0 AS phi, v * 10E0 - 30 AS theta, 0E0 AS psi FROM range(1, 8) t(v)")
def angle_table(spark: SparkSession, d: str) -> DataFrame:
    return shape.angle_table(adapters.angles(spark))


@query("SELECT * FROM atm WHERE x BETWEEN -2 AND 2 AND y BETWEEN -2 AND 2 AND z BETWEEN -2 AND 2", ATM)
def border_exclusion(spark: SparkSession, d: str) -> DataFrame:
    a = adapters.atoms(spark, d)
    moved = shape.border(a.withColumns({c: F.col(c) + 5 for c in "xyz"}), 3.0, 10)
    return moved.select("atom_id").join(a, "atom_id").select("atom_id", "x", "y", "z", "species")


# scalar functions
@query("SELECT p_partkey AS id, CAST(round(CAST(p_retailprice AS DECIMAL(30,12)), 0) AS BIGINT) AS up, CASE WHEN p_retailprice < 0 THEN -1 ELSE 1 END * floor(abs(p_retailprice) + 0.5) AS away, round_even(p_retailprice, 0) AS even FROM part")
def rounding_modes(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return adapters.prices(spark, d).select("id", fn.half_up(x).alias("up"), fn.half_away(x).cast("double").alias("away"), fn.half_even(x).alias("even"))


@query("SELECT view, r, c, round(2/0.5E0*sqrt(greatest(0E0, 0.5E0*v + 0.375E0*0.25E0 + 4 - 0.5E0*1)), 6) AS v FROM pix", PIX)
def vst_forward(spark: SparkSession, d: str) -> DataFrame:
    return rounded(adapters.pixels(spark, d).withColumn("v", fn.vst_forward(F.col("v"), F.lit(0.5), F.lit(2.0), F.lit(1.0))), "v")


@query("SELECT view, r, c, round((v-lo)/(hi-lo)*0.7E0+0.15E0, 6) AS v FROM pix JOIN (SELECT view, CAST(MIN(v) AS DOUBLE) lo, CAST(MAX(v) AS DOUBLE) hi FROM pix GROUP BY view) USING (view)", PIX)
def affine_scale(spark: SparkSession, d: str) -> DataFrame:
    p = adapters.pixels(spark, d)
    ends = p.groupBy("view").agg(F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi"))
    return rounded(p.join(ends, "view").select("view", "r", "c", fn.to_unit(F.col("v"), F.col("lo"), F.col("hi")).alias("v")), "v")


@query("SELECT view, r, c, round(CASE WHEN x - 1500 < -1000 THEN 0 ELSE x - 1500 END, 6) AS v FROM (SELECT view, r, c, CASE WHEN v <= 1000 THEN 1E10 ELSE CAST(v AS DOUBLE) END x FROM pix)", PIX)
def dark_current(spark: SparkSession, d: str) -> DataFrame:
    p = adapters.pixels(spark, d).withColumn("v", fn.dark_floor(F.col("v").cast("double")))
    return rounded(p.withColumn("v", fn.subtract_dark(F.col("v"), F.lit(1500.0))), "v")


@query("SELECT CAST(q AS INT) AS q, round(0.1E0/(q*q+0.2E0)+0.3E0/(q*q+0.4E0)+0.5E0/(q*q+0.6E0)+0.7E0*exp(-0.8E0*q*q)+0.9E0*exp(-1.0E0*q*q)+1.1E0*exp(-1.2E0*q*q), 8) AS f FROM range(6) t(q)")
def form_factor(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("q").cast("double")
    return spark.range(6).select(F.col("id").cast("int").alias("q")).select("q", F.round(fn.form_factor(q, [0.1, 0.3, 0.5], [0.2, 0.4, 0.6], [0.7, 0.9, 1.1], [0.8, 1.0, 1.2]), 8).alias("f"))


@query("SELECT atom_id, view, round(x*cos(radians(t)) - z*sin(radians(t)), 6) AS x, round(y, 6) AS y, round(x*sin(radians(t)) + z*cos(radians(t)), 6) AS z FROM atm, (SELECT CAST(v AS INT) AS view, v*10E0-30 t FROM range(1, 8) r(v))", ATM)
def rotate_points(spark: SparkSession, d: str) -> DataFrame:
    return rounded(project.view_positions(adapters.atoms(spark, d), adapters.angles(spark)).select("atom_id", "view", "x", "y", "z"), "x", "y", "z")


@query("SELECT atom_id, round(greatest(-0.5E0, least(0.5E0, -(x)/(-2E0))), 6) AS dx, round(greatest(-0.5E0, least(0.5E0, -(y)/(-3E0))), 6) AS dy, round(greatest(-0.5E0, least(0.5E0, -(z)/(-4E0))), 6) AS dz, true AS top FROM atm", ATM)
def stationary_point(spark: SparkSession, d: str) -> DataFrame:
    h = {"xx": -2.0, "yy": -3.0, "zz": -4.0, "xy": 0.0, "xz": 0.0, "yz": 0.0}
    step, top = fn.stationary_point([F.col(a) for a in "xyz"], {k: F.lit(v) for k, v in h.items()})
    return rounded(adapters.atoms(spark, d).select("atom_id", *(s.alias(f"d{a}") for s, a in zip(step, "xyz")), top.alias("top")), "dx", "dy", "dz")


@query("SELECT atom_id, round(3*exp(-((x-0.5E0)*(x-0.5E0)/2 + y*y/8 + z*z/18)), 8) AS g FROM atm", ATM)
def gaussian_3d(spark: SparkSession, d: str) -> DataFrame:
    return rounded(adapters.atoms(spark, d).select("atom_id", fn.gauss3(F.col("x"), F.col("y"), F.col("z"), 3.0, (1.0, 2.0, 3.0), (0.5, 0.0, 0.0)).alias("g")), "g", to=8)


# neighbours
@query("SELECT atom_id, CAST(COUNT(d) AS BIGINT) AS n FROM atm LEFT JOIN near ON atom_id = a AND d > 0 AND d < 1.0 GROUP BY atom_id", ATM, NEAR)
def neighbor_count(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_count(adapters.atoms(spark, d), 1.0)


@query("SELECT ti, tj, n, round(1 - n / CAST(SUM(n) OVER (PARTITION BY ti) AS DOUBLE) / x, 6) AS alpha FROM (SELECT ta ti, tb tj, COUNT(*) n FROM near WHERE d > 0 AND d < 1.0 GROUP BY 1, 2) JOIN (SELECT species tj, COUNT(*) / CAST((SELECT COUNT(*) FROM atm) AS DOUBLE) x FROM atm GROUP BY 1) USING (tj)", ATM, NEAR)
def csro_warren_cowley(spark: SparkSession, d: str) -> DataFrame:
    return rounded(neighbours.short_range_order(adapters.atoms(spark, d), 1.0), "alpha")


@query("SELECT CAST(floor(d / 0.1E0) AS INT) AS bin, COUNT(*) AS n FROM near WHERE d > 0 AND d < 1.0 AND floor(d / 0.1E0) < 10 GROUP BY 1", ATM, NEAR)
def rdf_histogram(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.radial_counts(adapters.atoms(spark, d), 0.0, 1.0, 0.1)


@query("SELECT round(MIN(x), 6) AS x0, round(MIN(y), 6) AS y0, round(MIN(z), 6) AS z0, round(MAX(x)-MIN(x), 6) AS xw, round(MAX(y)-MIN(y), 6) AS yw, round(MAX(z)-MIN(z), 6) AS zw FROM atm", ATM)
def bounding_box(spark: SparkSession, d: str) -> DataFrame:
    return rounded(neighbours.bounding_box(adapters.atoms(spark, d)), "x0", "y0", "z0", "xw", "yw", "zw")


@query("SELECT ta AS ti, tb AS tj, COUNT(*) AS n FROM (SELECT a.species ta, b.species tb, (b.x+p.s*xw-a.x) dx, (b.y+q.s*yw-a.y) dy, (b.z+r.s*zw-a.z) dz FROM atm a, atm b, (SELECT MAX(x)-MIN(x) xw, MAX(y)-MIN(y) yw, MAX(z)-MIN(z) zw FROM atm), (VALUES (-1),(0),(1)) p(s), (VALUES (-1),(0),(1)) q(s), (VALUES (-1),(0),(1)) r(s)) WHERE dx*dx+dy*dy+dz*dz > 0 AND dx*dx+dy*dy+dz*dz < 0.25 GROUP BY 1, 2", ATM)
def periodic_species_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = neighbours.periodic_pairs(adapters.atoms(spark, d), 0.5, ["species"])
    return p.groupBy(F.col("a_species").alias("ti"), F.col("b_species").alias("tj")).agg(F.count(F.lit(1)).alias("n"))


WIDE_ATM = "watm AS (SELECT atom_id, 2 * x + 6 AS x, 2 * y + 6 AS y, 2 * z + 6 AS z FROM atm)"
GRID_ATM = "gatm AS (SELECT atom_id, x + 6 AS x, y + 6 AS y, z + 6 AS z FROM atm)"


def _grid_atoms(spark, d):
    return adapters.atoms(spark, d).select("atom_id", *((F.col(a) + 6).alias(a) for a in "xyz"))


@query("SELECT atom_id FROM gatm WHERE EXISTS (SELECT 1 FROM msk WHERE i = round_even(x, 0) - 1 AND j = round_even(y, 0) - 1 AND k = round_even(z, 0) - 1)", VOX, MSK, ATM, GRID_ATM)
def point_in_mask_semi(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.inside_mask(_grid_atoms(spark, d), mask3(spark, d)).select("atom_id")


@query("""SELECT atom_id FROM (SELECT atom_id, round_even(x,0)-1+o.a AS pi, round_even(y,0)-1+o.b AS pj, round_even(z,0)-1+o.c AS pk FROM watm, (VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(a,b,c)) p LEFT JOIN msk ON i = pi AND j = pj AND k = pk
 WHERE atom_id IN (SELECT atom_id FROM watm WHERE round_even(x,0) BETWEEN 1 AND 12 AND round_even(y,0) BETWEEN 1 AND 12 AND round_even(z,0) BETWEEN 1 AND 12) GROUP BY atom_id HAVING bool_and(i IS NOT NULL OR pi < 0 OR pi > 11 OR pj < 0 OR pj > 11 OR pk < 0 OR pk > 11)""", VOX, MSK, ATM, WIDE_ATM)
def eroded_point_query(spark: SparkSession, d: str) -> DataFrame:
    """Atoms spread so wide that many lie outside the volume."""
    wide = adapters.atoms(spark, d).select("atom_id", *((F.col(a) * 2 + 6).alias(a) for a in "xyz"))
    return neighbours.inside_eroded(wide, mask3(spark, d), [(0, 0, 0), *select.FACES], (12, 12, 12)).select("atom_id")


# selection
MAXIMA = "SELECT i, j, k, v FROM vox a, (SELECT avg(v) m FROM vox) WHERE v > 1.02E0 * m AND NOT EXISTS (SELECT 1 FROM vox b WHERE abs(a.i-b.i)+abs(a.j-b.j)+abs(a.k-b.k) = 1 AND b.v > a.v)"


@query(MAXIMA + " ORDER BY v DESC, i, j, k LIMIT 50", VOX)
def local_maxima_topk(spark: SparkSession, d: str) -> DataFrame:
    v = adapters.voxels(spark, d)
    return select.local_maxima(v, 1.02 * (v.agg(F.avg("v")).first()[0] or 0.0), 50)


@query()
def dedup_min_distance(spark: SparkSession, d: str) -> DataFrame:
    a = adapters.atoms(spark, d).withColumn("v", F.col("atom_id") * 7919 % 1009)
    return select.greedy_min_distance(a, 1.0)


@query("SELECT view, MIN(r) AS r, v FROM (SELECT view, r, SUM(v) v FROM pix GROUP BY 1, 2) JOIN (SELECT view, MIN(v) v FROM (SELECT view, r, SUM(v) v FROM pix GROUP BY 1, 2) GROUP BY 1) USING (view, v) GROUP BY view, v", PIX)
def argmin_angle(spark: SparkSession, d: str) -> DataFrame:
    lines = adapters.pixels(spark, d).groupBy("view", "r").agg(F.sum("v").alias("v"))
    return select.best(lines, ["view"], "v", "r")


ORACLE_SQL["argmin_angle"] = ORACLE_SQL["argmin_angle"].replace("v FROM (SELECT view, r", "CAST(v AS BIGINT) AS v FROM (SELECT view, r", 1)


@query("SELECT * FROM vox WHERE v > (SELECT MIN(v) FROM vox)", VOX)
def above_minimum(spark: SparkSession, d: str) -> DataFrame:
    return select.above_least(adapters.voxels(spark, d), "v")


MSKB = "mskb AS (SELECT i, j, k FROM vox WHERE (i + j + k) % 2 = 0)"


def _even(spark, d):
    return adapters.voxels(spark, d).where("(i + j + k) % 2 = 0").select("i", "j", "k")


@query("SELECT * FROM msk UNION SELECT * FROM mskb", VOX, MSK, MSKB)
def mask_union(spark: SparkSession, d: str) -> DataFrame:
    return select.mask_or(mask3(spark, d), _even(spark, d))


@query("SELECT * FROM msk INTERSECT SELECT * FROM mskb", VOX, MSK, MSKB)
def mask_intersect(spark: SparkSession, d: str) -> DataFrame:
    return select.mask_and(mask3(spark, d), _even(spark, d))


@query("SELECT * FROM msk EXCEPT SELECT * FROM mskb", VOX, MSK, MSKB)
def mask_except(spark: SparkSession, d: str) -> DataFrame:
    return select.mask_minus(mask3(spark, d), _even(spark, d))


@query("SELECT * FROM atm WHERE species = 1 OR x > 0", ATM)
def keep_by_either(spark: SparkSession, d: str) -> DataFrame:
    a = adapters.atoms(spark, d)
    return select.kept_by_either(a, a.where("species = 1"), a.where("x > 0"))


# morphology
@query("SELECT DISTINCT CAST(i+a AS INT) i, CAST(j+b AS INT) j, CAST(k+c AS INT) k FROM msk, (VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(a,b,c) WHERE i+a BETWEEN 0 AND 11 AND j+b BETWEEN 0 AND 11 AND k+c BETWEEN 0 AND 11", VOX, MSK)
def binary_dilate6(spark: SparkSession, d: str) -> DataFrame:
    return morphology.dilate(mask3(spark, d), [(0, 0, 0), *select.FACES], ["i", "j", "k"], [12] * 3)


@query("SELECT m.i, m.j, m.k FROM msk m WHERE NOT EXISTS (SELECT 1 FROM (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(a,b,c) WHERE m.i+a BETWEEN 0 AND 11 AND m.j+b BETWEEN 0 AND 11 AND m.k+c BETWEEN 0 AND 11 AND NOT EXISTS (SELECT 1 FROM msk n WHERE n.i = m.i+a AND n.j = m.j+b AND n.k = m.k+c))", VOX, MSK)
def binary_erode6(spark: SparkSession, d: str) -> DataFrame:
    return morphology.erode(mask3(spark, d), [(0, 0, 0), *select.FACES], ["i", "j", "k"], [12] * 3)


@query("SELECT DISTINCT CAST(g.x AS INT) i, CAST(h.x AS INT) j, CAST(l.x AS INT) k FROM msk, range(12) g(x), range(12) h(x), range(12) l(x) WHERE (g.x-i)*(g.x-i)+(h.x-j)*(h.x-j)+(l.x-k)*(l.x-k) <= 4", VOX, MSK)
def dilate_ball(spark: SparkSession, d: str) -> DataFrame:
    return morphology.dilate_ball(mask3(spark, d), 2, ["i", "j", "k"], [12] * 3)


@query("SELECT view, r, c, MAX(v) OVER (PARTITION BY view, r ORDER BY c ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM (SELECT view, r, c, MIN(v) OVER (PARTITION BY view, r ORDER BY c ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) v FROM pix)", PIX)
def grey_opening_row(spark: SparkSession, d: str) -> DataFrame:
    return morphology.line_opening(adapters.pixels(spark, d), 2, "c", ["view", "r"])


OCTAGON = "(SELECT CAST(a.x AS INT) dr, CAST(b.x AS INT) dc FROM range(-4, 5) a(x), range(-4, 5) b(x) WHERE abs(a.x) + abs(b.x) <= 6)"
FULL = "full2 AS (SELECT w.view, CAST(a.x AS INT) r, CAST(b.x AS INT) c, coalesce(p.v, 0) v FROM (SELECT DISTINCT view FROM pix) w CROSS JOIN range(16) a(x) CROSS JOIN range(16) b(x) LEFT JOIN pix p ON p.view = w.view AND p.r = a.x AND p.c = b.x)"


def _full(spark, d):
    """Dense images; a missing pixel is 0."""
    p = adapters.pixels(spark, d)
    grid = shape.grid(spark, {a: (0, 15) for a in "rc"})
    return p.select("view").distinct().crossJoin(F.broadcast(grid)).join(p, ["view", "r", "c"], "left").select("view", "r", "c", F.coalesce("v", F.lit(0)).alias("v"))  # 256 rows


@query(f"SELECT e.view, e.r, e.c, MAX(n.v) AS v FROM full2 e CROSS JOIN {OCTAGON} o JOIN low n ON n.view = e.view AND n.r = least(15, greatest(0, e.r + dr)) AND n.c = least(15, greatest(0, e.c + dc)) GROUP BY 1, 2, 3", PIX, FULL, f"low AS (SELECT e.view, e.r, e.c, MIN(n.v) v FROM full2 e CROSS JOIN {OCTAGON} o JOIN full2 n ON n.view = e.view AND n.r = e.r + dr AND n.c = e.c + dc GROUP BY 1, 2, 3)")
def grey_opening_octagon(spark: SparkSession, d: str) -> DataFrame:
    return morphology.octagon_opening(_full(spark, d), 2, 1, 16, 16).select("view", "r", "c", "v")


DENSE = "dns AS (SELECT CAST(a.x AS INT) i, CAST(b.x AS INT) j, CAST(c.x AS INT) k, CAST(coalesce(v, 0) AS DOUBLE) v FROM range(12) a(x) CROSS JOIN range(12) b(x) CROSS JOIN range(12) c(x) LEFT JOIN vox ON i = a.x AND j = b.x AND k = c.x)"


def _dense(spark, d):
    return shape.grid(spark, {a: (0, 11) for a in "ijk"}).join(adapters.voxels(spark, d), ["i", "j", "k"], "left").select("i", "j", "k", F.coalesce("v", F.lit(0)).cast("double").alias("v"))


@query("SELECT g.i, g.j, g.k, round(AVG(n.v), 6) AS v FROM dns g CROSS JOIN range(-1, 2) a(x) CROSS JOIN range(-1, 2) b(x) CROSS JOIN range(-1, 2) c(x) JOIN dns n ON n.i = least(11, greatest(0, g.i+a.x)) AND n.j = least(11, greatest(0, g.j+b.x)) AND n.k = least(11, greatest(0, g.k+c.x)) GROUP BY 1,2,3", VOX, DENSE)
def box_mean_separable(spark: SparkSession, d: str) -> DataFrame:
    return rounded(morphology.box_mean(_dense(spark, d), 1, ["i", "j", "k"], [12] * 3), "v")


COMP = """WITH RECURSIVE {0}, {1}, reach(view, r, c, comp) AS (SELECT view, r, c, CAST(r AS BIGINT) * 65536 + c FROM pmsk UNION
 SELECT n.view, n.r, n.c, reach.comp FROM reach JOIN pmsk n ON n.view = reach.view AND abs(n.r - reach.r) <= 1 AND abs(n.c - reach.c) <= 1),
 lab AS (SELECT view, r, c, MIN(comp) AS comp FROM reach GROUP BY 1,2,3)"""


@query()
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return morphology.components(mask2(spark, d), ["r", "c"])


@query()
def remove_small_components(spark: SparkSession, d: str) -> DataFrame:
    return morphology.large_components(mask2(spark, d), ["r", "c"], 10)


@query()
def largest_component(spark: SparkSession, d: str) -> DataFrame:
    return morphology.largest_component(mask2(spark, d), ["r", "c"], full=True)


ORACLE_SQL["connected_components"] = COMP.format(PIX, PMSK) + " SELECT * FROM lab"
ORACLE_SQL["remove_small_components"] = COMP.format(PIX, PMSK) + " SELECT view, r, c FROM lab JOIN (SELECT view, comp FROM lab GROUP BY 1, 2 HAVING COUNT(*) >= 10) USING (view, comp)"
ORACLE_SQL["largest_component"] = COMP.format(PIX, PMSK) + " SELECT view, r, c FROM lab JOIN (SELECT view, comp, row_number() OVER (PARTITION BY view ORDER BY COUNT(*) DESC, comp) o FROM lab GROUP BY 1, 2) USING (view, comp) WHERE o = 1"


# clustering
def _lloyd_sql(middle: str, rounds: int) -> str:
    parts = ["src AS (SELECT p_partkey AS id, p_retailprice AS x FROM part)", "c0 AS (SELECT MIN(x) a, (MIN(x)+MAX(x))/2 b, MAX(x) c FROM src)"]
    pick = "CASE WHEN abs(x-a) <= abs(x-b) AND abs(x-a) <= abs(x-c) THEN 0 WHEN abs(x-b) <= abs(x-c) THEN 1 ELSE 2 END"
    for n in range(rounds):
        got = ", ".join(f"coalesce({middle}(CASE WHEN l = {i} THEN x END), any_value({k})) {k}" for i, k in enumerate("abc"))
        parts.append(f"c{n + 1} AS (SELECT {got} FROM (SELECT x, a, b, c, {pick} l FROM src, c{n}))")
    return f"WITH {', '.join(parts)} SELECT CAST(l AS INT) AS label, COUNT(*) AS n, round(SUM(x), 2) AS s FROM (SELECT x, {pick} l FROM src, c{rounds}) GROUP BY 1"


def _summary(df):
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 2).alias("s"))


@query(_lloyd_sql("AVG", 10))
def kmeans_1d(spark: SparkSession, d: str) -> DataFrame:
    return _summary(cluster.kmeans(adapters.prices(spark, d), "x", 3)[0])


@query(_lloyd_sql("MEDIAN", 10))
def kmedians_1d(spark: SparkSession, d: str) -> DataFrame:
    return _summary(cluster.kmedians(adapters.prices(spark, d), "x", 3)[0])


@query()
def boundary_refinement(spark: SparkSession, d: str) -> DataFrame:
    p = adapters.prices(spark, d)
    return _summary(cluster.classify_by_boundaries(p, "x", cluster.refine_boundaries(p, "x", 3)))


@query()
def local_reclassify(spark: SparkSession, d: str) -> DataFrame:
    a = adapters.atoms(spark, d)
    e = adapters.table(spark, d, "embeddings").select(F.col("vec_id").alias("atom_id"), F.posexplode(F.slice("embedding", 4, 8)).alias("off_id", "v"))
    return cluster.local_reclassify(a, e.withColumn("v", F.col("v").cast("double")), 1.5, 3)


# gather and splat
def _samples(spark, d, axes):
    return adapters.atoms(spark, d).select(F.col("atom_id").alias("id"), *((F.col(a) + 5.5).alias(a) for a in axes))


@query("""SELECT id, round(coalesce(SUM((CASE WHEN a.x = 0 THEN 1 - (s.x - bi) ELSE s.x - bi END) * (CASE WHEN b.x = 0 THEN 1 - (s.y - bj) ELSE s.y - bj END) * (CASE WHEN c.x = 0 THEN 1 - (s.z - bk) ELSE s.z - bk END) * v), 0), 6) AS v
 FROM (SELECT atom_id id, x+5.5E0 x, y+5.5E0 y, z+5.5E0 z, least(10, floor(x+5.5E0)) bi, least(10, floor(y+5.5E0)) bj, least(10, floor(z+5.5E0)) bk FROM atm) s CROSS JOIN range(2) a(x) CROSS JOIN range(2) b(x) CROSS JOIN range(2) c(x)
 LEFT JOIN vox ON i = bi + a.x AND j = bj + b.x AND k = bk + c.x AND s.x BETWEEN 0 AND 11 AND s.y BETWEEN 0 AND 11 AND s.z BETWEEN 0 AND 11 GROUP BY id""", VOX, ATM)
def trilinear_gather(spark: SparkSession, d: str) -> DataFrame:
    return rounded(project.gather(_samples(spark, d, "xyz"), adapters.voxels(spark, d), {a: (i, 12) for a, i in zip("xyz", "ijk")}), "v")


@query("""SELECT id, round(coalesce(SUM((CASE WHEN a.x = 0 THEN 1 - (s.x - bi) ELSE s.x - bi END) * (CASE WHEN b.x = 0 THEN 1 - (s.y - bj) ELSE s.y - bj END) * v), 0), 6) AS v
 FROM (SELECT atom_id id, x+5.5E0 x, y+5.5E0 y, least(14, floor(x+5.5E0)) bi, least(14, floor(y+5.5E0)) bj FROM atm) s CROSS JOIN range(2) a(x) CROSS JOIN range(2) b(x)
 LEFT JOIN (SELECT * FROM pix WHERE view = 1) p ON r = bi + a.x AND c = bj + b.x AND s.x BETWEEN 0 AND 15 AND s.y BETWEEN 0 AND 15 GROUP BY id""", PIX, ATM)
def bilinear_gather(spark: SparkSession, d: str) -> DataFrame:
    return rounded(project.gather(_samples(spark, d, "xy"), adapters.pixels(spark, d).where("view = 1"), {"x": ("r", 16), "y": ("c", 16)}), "v")


@query("SELECT id, round(coalesce(SUM((CASE WHEN a.x = 0 THEN 1 - (s.x - b) ELSE s.x - b END) * v), 0), 6) AS v FROM (SELECT atom_id id, x+5.5E0 x, least(10, floor(x+5.5E0)) b FROM atm) s CROSS JOIN range(2) a(x) LEFT JOIN (SELECT i, SUM(v) v FROM vox GROUP BY 1) l ON i = b + a.x AND s.x BETWEEN 0 AND 11 GROUP BY id", VOX, ATM)
def linear_gather(spark: SparkSession, d: str) -> DataFrame:
    line = adapters.voxels(spark, d).groupBy("i").agg(F.sum("v").alias("v"))
    return rounded(project.gather(_samples(spark, d, "x"), line, {"x": ("i", 12)}), "v")


@query()
def box_intensity(spark: SparkSession, d: str) -> DataFrame:
    a = _samples(spark, d, "xyz").withColumnRenamed("id", "atom_id")
    return rounded(aggregate.box_sum(project.box_samples(a, adapters.voxels(spark, d), shape.ball_offsets(1), 12)), "intensity")


SPLAT = """spl AS (SELECT view, CAST(rx + dx + 16 AS INT) r, CAST(ry + dy + 16 AS INT) c, species, SUM(h * sqrt(pi() / b) * exp(-b * ((rx+dx-x)*(rx+dx-x) + (ry+dy-y)*(ry+dy-y)))) v FROM
 (SELECT view, species, x, y, sign(x)*floor(abs(x)+0.5E0) rx, sign(y)*floor(abs(y)+0.5E0) ry, CASE species WHEN 0 THEN 1E0 WHEN 1 THEN 2E0 ELSE 3E0 END h, CASE species WHEN 0 THEN 0.5E0 WHEN 1 THEN 0.6E0 ELSE 0.7E0 END b
  FROM (SELECT view, species, x*cos(radians(t)) - z*sin(radians(t)) x, y FROM atm, (SELECT CAST(v AS INT) AS view, v*10E0-30 t FROM range(1, 8) q(v)))) CROSS JOIN range(-4, 5) p(dx) CROSS JOIN range(-4, 5) q(dy)
 WHERE rx + dx + 16 BETWEEN 0 AND 31 AND ry + dy + 16 BETWEEN 0 AND 31 GROUP BY 1,2,3,4)"""


def _splat(spark, d):
    at = project.view_positions(adapters.atoms(spark, d), adapters.angles(spark))
    return project.splat(at, {0: 1.0, 1: 2.0, 2: 3.0}, {0: 0.5, 1: 0.6, 2: 0.7}, 32)


@query("SELECT view, r, c, species, round(v, 6) AS v FROM spl", ATM, SPLAT)
def splat_planes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_splat(spark, d), "v")


@query("SELECT view, r, c, round(SUM(v), 6) AS v FROM spl GROUP BY 1,2,3", ATM, SPLAT)
def splat_project(spark: SparkSession, d: str) -> DataFrame:
    return rounded(project.combined(_splat(spark, d)), "v")


@query("SELECT round(SUM(res*res), 4) AS rr, round(SUM(j0*res), 4) AS jr0, round(SUM(j1*res), 4) AS jr1, round(SUM(j0*j0), 4) AS jj0_0, round(SUM(j0*j1), 4) AS jj0_1, round(SUM(j1*j1), 4) AS jj1_1 FROM (SELECT x - y AS res, x AS j0, 1E0 AS j1 FROM pr)", FRM, SUM1)
def residual_sums(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    j = a.withColumnRenamed("v", "x").join(b.withColumnRenamed("v", "y"), ["view", "r", "c"], "full").na.fill(0)
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    out = project.residual_sums(j.select((x - y).alias("res"), x.alias("j0"), F.lit(1.0).alias("j1")), 2)
    return rounded(out, *out.columns, to=4)


# statistics that SQL doesn't reach
@query()
def radial_distribution(spark: SparkSession, d: str) -> DataFrame:
    return rounded(neighbours.radial_distribution(adapters.atoms(spark, d), 0.0, 2.0, 0.1), "r", "g")


@query()
def bond_order(spark: SparkSession, d: str) -> DataFrame:
    return rounded(neighbours.bond_order(adapters.atoms(spark, d), 1.0, periodic=False), "q4", "q6")


@query()
def voronoi_index(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import voronoi

    return rounded(voronoi.index_fractions(voronoi.voronoi_indices(adapters.atoms(spark, d))), "fraction")


# kernels, an image a task
def _kernel(name: str, kernel):
    from ..operators import blocks

    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(blocks.map_images(adapters.pixels(spark, d).withColumn("v", F.col("v").cast("double")), kernel, 16, 16), "v")

    run.__name__ = name
    QUERIES[name] = run


def _kernels() -> None:
    from ..operators import blocks, images

    _kernel("power_spectrum", lambda a: np.log1p(np.abs(images.centred_fft(a)) ** 2))
    _kernel("inverse_spectrum", lambda a: images.centred_ifft(images.centred_fft(a) * (1 + np.abs(np.indices(a.shape).sum(axis=0) - 16)) ** -1.0).real)
    _kernel("half_spectrum", lambda a: np.log1p(np.abs(images.half_spectrum(a)) ** 2))
    _kernel("spline_upsample", images.upsample)
    _kernel("bicubic_resample", lambda a: images.bicubic(a, *[x * 0.5 for x in np.indices((31, 31))]))
    _kernel("rotate_image", lambda a: images.rotate(a, 10.0))

    def frame_registration(spark: SparkSession, d: str) -> DataFrame:
        f = adapters.frames(spark, d).withColumn("v", F.col("v").cast("double"))
        return rounded(aggregate.frame_sum(registration.register_frames(f, 16, 16)[0]), "v")

    def peak_refine(spark: SparkSession, d: str) -> DataFrame:
        v = adapters.voxels(spark, d)
        top = select.local_maxima(v, 0.0)
        ids = top.select(((F.col("i") * 144) + F.col("j") * 12 + F.col("k")).cast("long").alias("peak_id"), "i", "j", "k")
        return rounded(fits.refine_peaks(ids, v), "x", "y", "z", to=4)

    def common_line(spark: SparkSession, d: str) -> DataFrame:
        p = adapters.pixels(spark, d).withColumn("v", F.col("v").cast("double"))
        angles = [x / 2 for x in range(-10, 11)]
        mean = p.groupBy("c").agg((F.sum("v") / F.count_distinct("view")).alias("m")).orderBy("c").limit(16).collect()  # a detector row
        line = np.array([r["m"] for r in mean])

        def kernel(a):
            scores = images.common_line_scores(a, angles, line)
            k = min(range(len(scores)), key=lambda i: (round(scores[i], 6), i))
            return {"angle": angles[k], "score": scores[k]}

        return rounded(blocks.view_values(p, kernel, 16, 16, ["angle", "score"]), "angle", "score")

    def bm3d_denoise(spark: SparkSession, d: str) -> DataFrame:
        p = _full(spark, d)
        top = p.groupBy("view").agg(F.greatest(F.lit(1.0), F.max("v").cast("double")).alias("m"))
        return rounded(matching.denoise(p.join(F.broadcast(top), "view").withColumn("v", F.col("v") / F.col("m")), 0.05, 16, 16, height=4), "v")  # a row for each view

    for f in (frame_registration, peak_refine, common_line, bm3d_denoise):
        QUERIES[f.__name__] = f


_kernels()


BLOCKS = """blk AS (SELECT f.view, CAST(f.r AS INT) r, CAST(f.c AS INT) c FROM full2 f WHERE r <= 12 AND c <= 12),
 dist AS (SELECT a.view, a.r, a.c, b.r AS mr, b.c AS mc, CAST(SUM((x.v - y.v) * (x.v - y.v)) AS DOUBLE) AS d FROM blk a JOIN blk b ON a.view = b.view AND abs(a.r - b.r) <= 6 AND abs(a.c - b.c) <= 6
 JOIN full2 x ON x.view = a.view AND x.r BETWEEN a.r AND a.r + 3 AND x.c BETWEEN a.c AND a.c + 3 JOIN full2 y ON y.view = b.view AND y.r - b.r = x.r - a.r AND y.c - b.c = x.c - a.c WHERE (a.r % 2 = 0 OR a.r = 12) AND (a.c % 2 = 0 OR a.c = 12) GROUP BY 1, 2, 3, 4, 5),
 near AS (SELECT *, CAST(row_number() OVER (PARTITION BY view, r, c ORDER BY CASE WHEN mr = r AND mc = c THEN 0 ELSE 1 END, d, mr, mc) - 1 AS INT) AS rank FROM dist WHERE d < {limit} OR (mr = r AND mc = c))"""
#: Over any difference, so that each block has matches whatever the tables' size; tests hold lower limits.
LIKE = 1e15


@query("SELECT view, r, c, rank, mr, mc, d FROM (SELECT *, least(8, COUNT(*) OVER (PARTITION BY view, r, c)) AS n FROM near) WHERE rank < pow(2, floor(log2(n)))", PIX, FULL, BLOCKS.format(limit=int(LIKE)))
def block_matches(spark: SparkSession, d: str) -> DataFrame:
    """The blocks most like each reference block of 4 x 4 pixels, by strips of three rows."""
    return matching.matches(_full(spark, d), 16, 16, matching.Search(size=4, reach=6, most=8, limit=LIKE / 16), height=3)


def iterative(spark: SparkSession, d: str) -> DataFrame:
    from . import pipelines

    return pipelines.small_reconstruction(spark, d)


QUERIES["small_reconstruction"] = iterative


@query()
def tight_support(spark: SparkSession, d: str) -> DataFrame:
    return morphology.tight_support(_dense(spark, d), [12] * 3, half=1, small=3, ball=1, least=5, eroded=3)


@query("""SELECT view, r, c, round(coalesce(arg_min(m, key), any_value(v)), 6) AS v FROM (SELECT f.view, f.r, f.c, CAST(f.v AS DOUBLE) v, w.m, CASE WHEN w.m IS NULL THEN NULL ELSE row(w.s, w.c, w.r) END AS key FROM full2 f
 LEFT JOIN win w ON w.view = f.view AND abs(w.r - f.r) <= 1 AND abs(w.c - f.c) <= 1 AND f.r BETWEEN 2 AND 13 AND f.c BETWEEN 2 AND 13) GROUP BY view, r, c""", PIX, FULL,
 "win AS (SELECT a.view, a.r, a.c, AVG(b.v) m, round(var_pop(b.v), 9) s FROM full2 a JOIN full2 b ON a.view = b.view AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY 1, 2, 3 HAVING COUNT(*) = 9)")
def edge_preserving(spark: SparkSession, d: str) -> DataFrame:
    return rounded(morphology.edge_preserving(_full(spark, d), 1, 16, 16), "v")


TAPS = "tap AS (SELECT CAST(x AS INT) t, exp(-x * x / 2.0) / (SELECT SUM(exp(-x * x / 2.0)) FROM range(-4, 5) s(x)) AS w FROM range(-4, 5) s(x))"
#: Spectra as sums over all pixels: what a transform is, without its fast form.
WAVE = "wave AS (SELECT view, CAST(a.x AS INT) kr, CAST(b.x AS INT) kc, SUM(v * cos(2 * pi() * ((a.x - 8) * (r - 8) + (b.x - 8) * (c - 8)) / 16)) re, -SUM(v * sin(2 * pi() * ((a.x - 8) * (r - 8) + (b.x - 8) * (c - 8)) / 16)) im FROM full2 CROSS JOIN range(16) a(x) CROSS JOIN range(16) b(x) GROUP BY 1, 2, 3)"
ORACLE_SQL["gaussian_filter"] = f"WITH {PIX}, {FULL}, {TAPS} SELECT f.view, f.r, f.c, round(SUM(a.w * b.w * n.v), 6) AS v FROM full2 f CROSS JOIN tap a CROSS JOIN tap b JOIN full2 n ON n.view = f.view AND n.r = least(15, greatest(0, f.r + a.t)) AND n.c = least(15, greatest(0, f.c + b.t)) GROUP BY 1, 2, 3"
ORACLE_SQL["power_spectrum"] = f"WITH {PIX}, {FULL}, {WAVE} SELECT view, kr AS r, kc AS c, round(ln(1 + re * re + im * im), 6) AS v FROM wave"
ORACLE_SQL["fourier_shift"] = f"""WITH {PIX}, {FULL}, {WAVE} SELECT f.view, f.r, f.c, round(SUM(re * cos(t) - im * sin(t)) / 256, 6) AS v FROM (SELECT f.view, f.r, f.c, re, im, 2 * pi() * ((kr - 8) * (f.r - 8 - 1.25E0) + (kc - 8) * (f.c - 8 + 0.5E0)) / 16 AS t FROM full2 f JOIN wave w ON w.view = f.view) f GROUP BY 1, 2, 3"""
ORACLE_SQL["mask_growth"] = f"""WITH {PIX}, {FULL}, cov AS (SELECT view, r, c, CAST(v > AVG(v) OVER (PARTITION BY view) AS INT) m FROM full2)
 SELECT f.view, f.r, f.c, CASE WHEN SUM(m * exp(-((f.r - n.r) * (f.r - n.r) + (f.c - n.c) * (f.c - n.c)) * ln(2))) > 0.1 THEN 1E0 ELSE 0E0 END AS v FROM full2 f JOIN cov n ON n.view = f.view GROUP BY 1, 2, 3"""
ORACLE_SQL["half_spectrum"] = f"WITH {PIX}, {FULL}, {WAVE} SELECT view, CAST((kr + 8) % 16 AS INT) AS r, CAST((kc + 8) % 16 AS INT) AS c, round(ln(1 + re * re + im * im), 6) AS v FROM wave WHERE (kc + 8) % 16 <= 8"


@query("SELECT view, round(CAST(SUM(v) AS DOUBLE), 6) AS total, round(AVG(v), 6) AS mean, round(var_samp(v), 6) AS variance FROM pix GROUP BY view", PIX)
def ordered_moments(spark: SparkSession, d: str) -> DataFrame:
    """Sums whose last bits don't depend on partitions."""
    rows = adapters.pixels(spark, d).groupBy("view").agg(F.sort_array(F.collect_list(F.struct("r", "c", F.col("v").cast("double").alias("v")))).alias("a"))  # one image
    rows = rows.select("view", F.transform("a", lambda x: x["v"]).alias("a")).withColumn("mean", fn.ordered_mean(F.col("a")))
    return rounded(rows.select("view", fn.ordered_sum(F.col("a")).alias("total"), "mean", fn.ordered_variance(F.col("a"), F.col("mean")).alias("variance")), "total", "mean", "variance")


COEFFICIENTS = [(6, *(0.1 * k for k in range(1, 13))), (14, *(0.2 + 0.05 * k for k in range(1, 13)))]
COEF = "coef AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"{x!r}E0" if isinstance(x, float) else str(x) for x in row) + ")" for row in COEFFICIENTS) + ") t(z, a1, a2, a3, b1, b2, b3, c1, c2, c3, d1, d2, d3))"


@query("SELECT CAST(y AS INT) AS r, CAST(x AS INT) AS c, round(AVG(a1/(q+b1) + a2/(q+b2) + a3/(q+b3) + c1*exp(-d1*q) + c2*exp(-d2*q) + c3*exp(-d3*q)), 8) AS v FROM (SELECT y, x, ((y - 7) / 8.0) * ((y - 7) / 8.0) + ((x - 7) / 8.0) * ((x - 7) / 8.0) AS q FROM range(16) i(y) CROSS JOIN range(16) j(x)) CROSS JOIN coef GROUP BY 1, 2", COEF)
def mean_form_factor(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of half a unit; one filter for all elements."""
    names = ["z", *(f"{k}{n}" for k in "abcd" for n in (1, 2, 3))]
    table = spark.createDataFrame(COEFFICIENTS, "z int, " + ", ".join(f"{n} double" for n in names[1:]))
    return rounded(project.mean_form_factor(table, 16, 16, 0.5), "v", to=8)


@query("SELECT atom_id, round(0.5E0 + 3*exp(-(u*u/2 + v*v/4 + w*w/8)), 8) AS g FROM (SELECT atom_id, x*cos(radians(30)) + y*sin(radians(30)) AS u, -x*sin(radians(30)) + y*cos(radians(30)) AS v, z AS w FROM atm)", ATM)
def gaussian_3d_turned(spark: SparkSession, d: str) -> DataFrame:
    """Turned by 10 and 20 degrees about z, which add up to 30."""
    return rounded(adapters.atoms(spark, d).select("atom_id", fn.gauss3_turned(*(F.col(a) for a in "xyz"), 3.0, (2.0, 4.0, 8.0), (10.0, 0.0, 20.0), floor=0.5).alias("g")), "g", to=8)


@query("""SELECT id, round(coalesce(SUM(w * v), 0), 6) AS re, round(coalesce(SUM(w * (i - j) * v), 0), 6) AS im FROM (SELECT id, s.x, s.y, bi + a.x pi, bj + b.x pj, (CASE WHEN a.x = 0 THEN 1 - (s.x - bi) ELSE s.x - bi END) * (CASE WHEN b.x = 0 THEN 1 - (s.y - bj) ELSE s.y - bj END) w
 FROM (SELECT atom_id id, x+5.5E0 x, y+5.5E0 y, least(14, floor(x+5.5E0)) bi, least(14, floor(y+5.5E0)) bj FROM atm) s CROSS JOIN range(2) a(x) CROSS JOIN range(2) b(x)) s
 LEFT JOIN (SELECT r i, c j, v FROM pix WHERE view = 1) p ON i = pi AND j = pj AND s.x BETWEEN 0 AND 15 AND s.y BETWEEN 0 AND 15 GROUP BY id""", PIX, ATM)
def complex_gather(spark: SparkSession, d: str) -> DataFrame:
    cells = adapters.pixels(spark, d).where("view = 1").select("r", "c", F.col("v").cast("double").alias("re"), ((F.col("r") - F.col("c")) * F.col("v")).cast("double").alias("im"))
    return rounded(project.gather_complex(_samples(spark, d, "xy"), cells, {"x": ("r", 16), "y": ("c", 16)}), "re", "im")


@query("SELECT species, CAST(CASE WHEN t = 19 THEN 18 ELSE floor(t) END AS INT) AS bin, COUNT(*) AS n FROM (SELECT species, (x-lo)*20/(hi-lo) - 0.5 AS t FROM atm, (SELECT MIN(x) lo, MAX(x) hi FROM atm)) WHERE t >= 0 AND t <= 19 GROUP BY 1, 2", ATM)
def histogram_between_centres(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.class_histograms(adapters.atoms(spark, d), "x", 20, "species", centres_as_edges=True)


@query("""SELECT view, round(alpha, 6) AS alpha, round(greatest(0, coalesce(s2, 0) - alpha * coalesce(m2, 0)), 6) AS sigma2 FROM (SELECT view, SUM(s * m) / SUM(m * m) AS alpha FROM blk JOIN (SELECT view, MIN(m) lo FROM blk GROUP BY 1) USING (view) WHERE m > lo AND s IS NOT NULL GROUP BY 1)
 LEFT JOIN (SELECT view, AVG(v * w) m2, var_samp(v * w) s2 FROM (SELECT view, r // 2 br, c // 2 bc, v FROM frm) JOIN (SELECT view, r // 2 br, c // 2 bc, COUNT(*) / 4.0 w FROM full2 JOIN (SELECT view, AVG(v) a FROM full2 GROUP BY 1) USING (view) WHERE v <= a GROUP BY 1, 2, 3) USING (view, br, bc) WHERE v * w <> 0 GROUP BY 1) USING (view)""",
 FRM, PIX, FULL, "blk AS (SELECT view, r // 2 br, c // 2 bc, AVG(v) m, var_samp(v) s FROM frm GROUP BY 1, 2, 3)")
def background_noise(spark: SparkSession, d: str) -> DataFrame:
    """Background: pixels up to their view's mean."""
    full = _full(spark, d)
    dark = full.join(full.groupBy("view").agg(F.avg("v").alias("a")), "view").where("v <= a").select("view", "r", "c")
    return rounded(aggregate.background_noise(adapters.frames(spark, d), dark), "alpha", "sigma2")
ORACLE_SQL["inverse_spectrum"] = f"WITH {PIX}, {FULL}, {WAVE} SELECT view, r, c, round(SUM((re * cos(t) - im * sin(t)) / (1 + abs(kr + kc - 16))) / 256, 6) AS v FROM (SELECT f.view, f.r, f.c, kr, kc, re, im, 2 * pi() * ((kr - 8) * (f.r - 8) + (kc - 8) * (f.c - 8)) / 16 AS t FROM full2 f JOIN wave w ON w.view = f.view) GROUP BY 1, 2, 3"
ORACLE_SQL["box_intensity"] = f"""WITH {VOX}, {ATM}, s AS (SELECT atom_id, atm.x + 5.5E0 + p.x AS x, y + 5.5E0 + q.x AS y, z + 5.5E0 + r.x AS z FROM atm CROSS JOIN range(-1, 2) p(x) CROSS JOIN range(-1, 2) q(x) CROSS JOIN range(-1, 2) r(x) WHERE p.x * p.x + q.x * q.x + r.x * r.x <= 2.25),
 t AS (SELECT *, least(10, floor(x)) bi, least(10, floor(y)) bj, least(10, floor(z)) bk FROM s)
 SELECT atom_id, round(coalesce(SUM((CASE WHEN a.x = 0 THEN 1 - (t.x - bi) ELSE t.x - bi END) * (CASE WHEN b.x = 0 THEN 1 - (t.y - bj) ELSE t.y - bj END) * (CASE WHEN c.x = 0 THEN 1 - (t.z - bk) ELSE t.z - bk END) * v), 0), 6) AS intensity
 FROM t CROSS JOIN range(2) a(x) CROSS JOIN range(2) b(x) CROSS JOIN range(2) c(x) LEFT JOIN vox ON i = bi + a.x AND j = bj + b.x AND k = bk + c.x AND t.x BETWEEN 0 AND 11 AND t.y BETWEEN 0 AND 11 AND t.z BETWEEN 0 AND 11 GROUP BY atom_id"""
ORACLE_SQL["radial_distribution"] = f"""WITH {ATM}, ext AS (SELECT MAX(x) - MIN(x) xw, MAX(y) - MIN(y) yw, MAX(z) - MIN(z) zw, COUNT(*) AS n FROM atm),
 far AS (SELECT sqrt((b.x + p.s * xw - a.x) ** 2 + (b.y + q.s * yw - a.y) ** 2 + (b.z + r.s * zw - a.z) ** 2) d FROM atm a CROSS JOIN atm b CROSS JOIN ext CROSS JOIN (VALUES (-1), (0), (1)) p(s) CROSS JOIN (VALUES (-1), (0), (1)) q(s) CROSS JOIN (VALUES (-1), (0), (1)) r(s)),
 cnt AS (SELECT floor(d / 0.1E0) AS bin, COUNT(*) AS k FROM far WHERE d > 0 AND d < 2.0 GROUP BY 1),
 raw AS (SELECT g.x AS bin, coalesce(k, 0) / (4E0 / 3 * pi() * (((g.x + 1) * 0.1E0) ** 3 - (g.x * 0.1E0) ** 3) * n / (xw * yw * zw) * n) AS g FROM range(20) g(x) CROSS JOIN ext LEFT JOIN cnt ON bin = g.x),
 tap AS (SELECT x AS t, exp(-x * x / 2.0) / (SELECT SUM(exp(-x * x / 2.0)) FROM range(-4, 5) s(x)) AS w FROM range(-4, 5) s(x))
 SELECT round((a.bin + 0.5E0) * 0.1E0, 6) AS r, round(SUM(w * coalesce(b.g, a.g)), 6) AS g FROM raw a CROSS JOIN tap LEFT JOIN raw b ON b.bin = a.bin + t GROUP BY a.bin"""
#: By the addition theorem: harmonics of all bonds around an atom only enter through the angles between bonds.
ORACLE_SQL["bond_order"] = f"""WITH {ATM}, pr AS (SELECT a.atom_id a, b.atom_id b, b.x - a.x dx, b.y - a.y dy, b.z - a.z dz, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2) d FROM atm a JOIN atm b ON a.atom_id <> b.atom_id),
 nb AS (SELECT a, b, dx / d u, dy / d v, dz / d w, COUNT(*) OVER (PARTITION BY a) n FROM pr WHERE d > 0 AND d < 1.0),
 hood AS (SELECT atom_id i, atom_id j FROM atm UNION ALL SELECT a, b FROM nb), size AS (SELECT i, COUNT(*) h FROM hood GROUP BY 1),
 bond AS (SELECT hood.i, u, v, w, 1E0 / (h * n) f FROM hood JOIN size USING (i) JOIN nb ON nb.a = hood.j),
 ang AS (SELECT p.i, p.f * q.f f, p.u * q.u + p.v * q.v + p.w * q.w o FROM bond p JOIN bond q ON p.i = q.i)
 SELECT atom_id, round(sqrt(greatest(0, coalesce(SUM(f * (35 * o ** 4 - 30 * o ** 2 + 3) / 8), 0))), 6) AS q4, round(sqrt(greatest(0, coalesce(SUM(f * (231 * o ** 6 - 315 * o ** 4 + 105 * o ** 2 - 5) / 16), 0))), 6) AS q6 FROM atm LEFT JOIN ang ON i = atom_id GROUP BY atom_id"""


AXES = {"i": "jk", "j": "ik", "k": "ij"}


@query(" UNION ALL ".join(f"SELECT '{a}' AS axis, {o[0]} AS p, {o[1]} AS q, MAX(v) AS v FROM vox GROUP BY {o[0]}, {o[1]}" for a, o in AXES.items()), VOX)
def mip_axes(spark: SparkSession, d: str) -> DataFrame:
    v = adapters.voxels(spark, d)
    parts = [aggregate.projection_max(v, a).select(F.lit(a).alias("axis"), F.col(o[0]).alias("p"), F.col(o[1]).alias("q"), "v") for a, o in AXES.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(" UNION ALL ".join(f"SELECT '{a}' AS axis, {o[0]} AS p, {o[1]} AS q, v FROM vox WHERE {a} = 6" for a, o in AXES.items()), VOX)
def mid_slices(spark: SparkSession, d: str) -> DataFrame:
    v = adapters.voxels(spark, d)
    parts = [aggregate.middle_slice(v, a, 12).select(F.lit(a).alias("axis"), F.col(o[0]).alias("p"), F.col(o[1]).alias("q"), "v") for a, o in AXES.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT atom_id, view, round(x * cos(f) + y * sin(f), 6) AS x, round(-x * sin(f) + y * cos(f), 6) AS y, round(z, 6) AS z FROM
 (SELECT atom_id, view, f, x * cos(t) - z * sin(t) AS x, y, x * sin(t) + z * cos(t) AS z FROM
 (SELECT atom_id, view, f, t, x, y * cos(p) + z * sin(p) AS y, -y * sin(p) + z * cos(p) AS z FROM atm, (SELECT CAST(v AS INT) AS view, radians(v * 7E0) f, radians(v * 10E0 - 30) t, radians(v * 5E0 - 12) p FROM range(1, 8) r(v))))""", ATM)
def rotate_points_three_angles(spark: SparkSession, d: str) -> DataFrame:
    view = F.col("id")
    angles = spark.range(1, 8).select(view.cast("int").alias("view"), (view * 7.0).alias("phi"), (view * 10.0 - 30.0).alias("theta"), (view * 5.0 - 12.0).alias("psi"))
    return rounded(project.view_positions(adapters.atoms(spark, d), angles).select("atom_id", "view", "x", "y", "z"), "x", "y", "z")


FINITE = """odd AS (SELECT c.x AS kind, CASE WHEN c.x = 0 AND p_partkey % 3 = 0 THEN 'NaN'::DOUBLE WHEN c.x = 0 AND p_partkey % 3 = 1 THEN 'Infinity'::DOUBLE WHEN c.x = 1 THEN '-Infinity'::DOUBLE WHEN c.x = 2 THEN 4.5 ELSE p_retailprice END AS v FROM part CROSS JOIN range(3) c(x))"""


@query("SELECT CAST(kind AS INT) AS kind, CASE WHEN lo IS NULL THEN 0 ELSE lo END AS lo, CASE WHEN lo IS NULL THEN 1 WHEN lo = hi THEN lo + 1 ELSE hi END AS hi FROM (SELECT kind, MIN(CASE WHEN isfinite(v) THEN v END) lo, MAX(CASE WHEN isfinite(v) THEN v END) hi FROM odd GROUP BY kind)", FINITE)
def finite_min_max_odd(spark: SparkSession, d: str) -> DataFrame:
    """Kind 0 has NaN and infinities, 1 nothing else, 2 one value."""
    p = adapters.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v"))
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    kinds = [p.withColumn("v", F.when(F.col("k") % 3 == 0, nan).when(F.col("k") % 3 == 1, inf).otherwise(F.col("v"))), p.withColumn("v", -inf), p.withColumn("v", F.lit(4.5))]
    parts = [aggregate.finite_range(x).select(F.lit(n).alias("kind"), "lo", "hi") for n, x in enumerate(kinds)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT a.ti, a.tj, round((a.alpha + b.alpha) / 2 * 3, 6) AS alpha FROM al a JOIN al b ON a.ti = b.tj AND a.tj = b.ti""", ATM, NEAR,
 "al AS (SELECT ti, tj, 1 - n / CAST(SUM(n) OVER (PARTITION BY ti) AS DOUBLE) / x AS alpha FROM (SELECT ta ti, tb tj, COUNT(*) n FROM near WHERE d > 0 AND d < 1.0 GROUP BY 1, 2) JOIN (SELECT species tj, COUNT(*) / CAST((SELECT COUNT(*) FROM atm) AS DOUBLE) x FROM atm GROUP BY 1) USING (tj))")
def symmetric_order(spark: SparkSession, d: str) -> DataFrame:
    return rounded(neighbours.symmetric_order(neighbours.short_range_order(adapters.atoms(spark, d), 1.0)), "alpha")


#: One atom after another in order of rank, with the list of those accepted so far.
ORACLE_SQL["dedup_min_distance"] = f"""WITH RECURSIVE {ATM}, {NEAR}, rk AS (SELECT *, atom_id * 7919 % 1009 AS v FROM atm), o AS (SELECT atom_id, row_number() OVER (ORDER BY v DESC, atom_id) k FROM rk),
 nb AS (SELECT o.atom_id, o.k, coalesce(list(b) FILTER (WHERE d < 1.0), []) l FROM o LEFT JOIN near ON a = o.atom_id GROUP BY 1, 2),
 go(k, done) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT nb.k, CASE WHEN list_has_any(done, l) THEN done ELSE list_append(done, atom_id) END FROM go JOIN nb ON nb.k = go.k + 1),
 top AS (SELECT unnest(done) AS id FROM (SELECT done FROM go ORDER BY k DESC LIMIT 1))
 SELECT atom_id, x, y, z, species, v, CASE WHEN atom_id IN (SELECT id FROM top) THEN 0 ELSE -3 END AS flag FROM rk"""


# tomography and region filling
THREE = "three AS (SELECT CAST(v AS INT) AS view, radians(v * 7E0) f, radians(v * 10E0 - 30) t, radians(v * 5E0 - 12) p FROM range(1, 8) r(v))"


def _three_angles(spark: SparkSession) -> DataFrame:
    view = F.col("id")
    return spark.range(1, 8).select(view.cast("int").alias("view"), (view * 7.0).alias("phi"), (view * 10.0 - 30.0).alias("theta"), (view * 5.0 - 12.0).alias("psi"))


@query("SELECT i, j, k, round(SUM((CASE WHEN a.x = 0 THEN 1 - (q.x - lx) ELSE q.x - lx END) * (CASE WHEN b.x = 0 THEN 1 - (q.y - ly) ELSE q.y - ly END) * v), 6) AS v FROM low q CROSS JOIN range(2) a(x) CROSS JOIN range(2) b(x) JOIN full2 s ON s.view = q.view AND s.r = lx + a.x AND s.c = ly + b.x GROUP BY i, j, k",
 PIX, FULL, THREE, """turn AS (SELECT i, j, k, view, x * cos(t) - z * sin(t) + 8 AS x, y * cos(p) + (x * sin(t) + z * cos(t)) * sin(p) + 8 AS y FROM
 (SELECT CAST(a.x AS INT) i, CAST(b.x AS INT) j, CAST(c.x AS INT) k, view, t, p, (a.x - 8) * cos(f) + (b.x - 8) * sin(f) AS x, (b.x - 8) * cos(f) - (a.x - 8) * sin(f) AS y, c.x - 8 AS z FROM range(16) a(x) CROSS JOIN range(16) b(x) CROSS JOIN range(16) c(x) CROSS JOIN three))""",
 "low AS (SELECT *, least(14, floor(x)) lx, least(14, floor(y)) ly FROM turn WHERE x BETWEEN 0 AND 15 AND y BETWEEN 0 AND 15)")
def back_projection(spark: SparkSession, d: str) -> DataFrame:
    """R1, R2: all views carried back into a cube of 16, three angles a view."""
    return rounded(tomography.back_project(adapters.pixels(spark, d), tomography.turns_of(_three_angles(spark)), 16, block=6), "v")


@query("""SELECT CAST(ka AS INT) AS i, CAST(kb AS INT) AS j, CAST(kc AS INT) AS k, round(ln(1 + SUM(v * cos(w)) ** 2 + SUM(v * sin(w)) ** 2), 6) AS v FROM
 (SELECT v, a.x ka, b.x kb, c.x kc, 2 * pi() * ((a.x - 8) * (i - 6) + (b.x - 8) * (j - 6) + (c.x - 8) * (k - 6)) / 16 AS w FROM vox CROSS JOIN range(16) a(x) CROSS JOIN range(16) b(x) CROSS JOIN range(16) c(x)) GROUP BY 1, 2, 3""", VOX)
def volume_spectrum(spark: SparkSession, d: str) -> DataFrame:
    """R3: power of the transform of the padded volume."""
    s = tomography.spectrum(adapters.voxels(spark, d), 12, 16, thick=3)
    return rounded(s.select("i", "j", "k", F.log1p(F.col("re") ** 2 + F.col("im") ** 2).alias("v")), "v")


def _real(spark: SparkSession, d: str) -> DataFrame:
    return _full(spark, d).withColumn("v", F.col("v").cast("double"))


#: Laplace's equation by relaxing step by step: a view's pixels as a list, the bright ones unknown.
@query("SELECT view, CAST(i // 16 AS INT) AS r, CAST(i % 16 AS INT) AS c, round(vals[i + 1], 4) AS v FROM go CROSS JOIN range(256) t(i) WHERE n = 1500", PIX, FULL,
 "cov AS (SELECT view, r, c, v, v > 1.2E0 * AVG(v) OVER (PARTITION BY view) AS hole FROM full2)", "grid AS (SELECT view, list(CAST(v AS DOUBLE) ORDER BY r, c) AS vals, list(hole ORDER BY r, c) AS hole FROM cov GROUP BY view)",
 """go(n, view, vals, hole) AS (SELECT 0, view, list_transform(vals, lambda v, i: CASE WHEN hole[i] THEN 0 ELSE v END), hole FROM grid UNION ALL
 SELECT n + 1, view, list_transform(range(256), lambda i: CASE WHEN hole[i + 1] THEN (CASE WHEN i >= 16 THEN vals[i - 15] ELSE 0 END + CASE WHEN i < 240 THEN vals[i + 17] ELSE 0 END + CASE WHEN i % 16 > 0 THEN vals[i] ELSE 0 END + CASE WHEN i % 16 < 15 THEN vals[i + 2] ELSE 0 END)
 / ((i >= 16)::INT + (i < 240)::INT + (i % 16 > 0)::INT + (i % 16 < 15)::INT) ELSE vals[i + 1] END), hole FROM go WHERE n < 1500)""")
def region_fill(spark: SparkSession, d: str) -> DataFrame:
    """C10: pixels over 1.2 times their view's mean from the others, by conjugate gradients."""
    full = _real(spark, d)
    mask = full.join(full.groupBy("view").agg(F.avg("v").alias("a")), "view").where("v > 1.2D * a").select("view", "r", "c")
    return rounded(fill.fill_region(full, mask, 16, 16, tolerance=1e-12), "v", to=4)


ORACLE_SQL["region_fill"] = ORACLE_SQL["region_fill"].replace("WITH ", "WITH RECURSIVE ", 1)


def _image(px: DataFrame, mask: DataFrame) -> DataFrame:
    marked = px.select("view", "r", "c").join(mask.withColumn("_in", F.lit(1.0)), ["view", "r", "c"], "left")
    return marked.select("view", "r", "c", F.coalesce("_in", F.lit(0.0)).alias("v"))


def _morphology_steps(start: str, steps: str) -> tuple[list[str], str]:
    """SQL of erosions (e) and dilations (d) by a cross from the mask ``start`` on, and the last one's name."""
    out, now = [], start
    for n, step in enumerate(steps):
        name = f"{start}_{n}"
        if step == "e":
            out.append(f"{name} AS (SELECT m.view, m.r, m.c FROM {now} m JOIN {now} n ON n.view = m.view AND abs(n.r - m.r) + abs(n.c - m.c) <= 1 GROUP BY ALL HAVING COUNT(*) = 5)")
        else:
            out.append(f"{name} AS (SELECT DISTINCT f.view, f.r, f.c FROM full2 f JOIN {now} n ON n.view = f.view AND abs(n.r - f.r) + abs(n.c - f.c) <= 1)")
        now = name
    return out, now


def _particle_sql() -> str:
    first, last = _morphology_steps("m", "eedd" + "dddd" + "eeee")
    then, end = _morphology_steps("h", "ddd")
    mirror = lambda a, t: f"CASE WHEN f.{a} + {t} < 0 THEN -1 - f.{a} - {t} WHEN f.{a} + {t} > 15 THEN 31 - f.{a} - {t} ELSE f.{a} + {t} END"
    parts = [
        PIX, FULL, "tap AS (SELECT CAST(x AS INT) t, exp(-x * x / 8.0) / (SELECT SUM(exp(-x * x / 8.0)) FROM range(-8, 9) s(x)) AS w FROM range(-8, 9) s(x))",
        f"sm AS (SELECT f.view, f.r, f.c, SUM(a.w * b.w * n.v) AS v FROM full2 f CROSS JOIN tap a CROSS JOIN tap b JOIN full2 n ON n.view = f.view AND n.r = {mirror('r', 'a.t')} AND n.c = {mirror('c', 'b.t')} GROUP BY 1, 2, 3)",
        "ext AS (SELECT view, MIN(v) lo, MAX(v) hi FROM sm GROUP BY view)", "cnt AS (SELECT view, CAST(least(255, floor((v - lo) * 256 / (hi - lo))) AS INT) b, COUNT(*) n FROM sm JOIN ext USING (view) GROUP BY 1, 2)",
        "run AS (SELECT view, b, SUM(n) OVER w AS w, SUM(n * (b + 1)) OVER w AS m, SUM(n) OVER (PARTITION BY view) AS wt, SUM(n * (b + 1)) OVER (PARTITION BY view) AS mt FROM cnt WINDOW w AS (PARTITION BY view ORDER BY b ROWS UNBOUNDED PRECEDING))",
        "best AS (SELECT view, arg_max(b, row((CAST(mt AS DOUBLE) * w - CAST(m AS DOUBLE) * wt) ** 2 / (CAST(w AS DOUBLE) * (wt - w)), -b)) AS b FROM run WHERE w < wt GROUP BY view)",
        "m AS (SELECT view, r, c FROM sm JOIN ext USING (view) JOIN best USING (view) WHERE v > (lo + b * (hi - lo) / 256) * 0.9E0)", *first,
        f"rest AS (SELECT view, r, c FROM full2 ANTI JOIN {last} USING (view, r, c))",
        "out_(view, r, c) AS (SELECT view, r, c FROM rest WHERE r IN (0, 15) OR c IN (0, 15) UNION SELECT rest.view, rest.r, rest.c FROM out_ JOIN rest ON rest.view = out_.view AND abs(rest.r - out_.r) + abs(rest.c - out_.c) = 1)",
        "h AS (SELECT view, r, c FROM full2 ANTI JOIN out_ USING (view, r, c))", *then,
    ]
    return "WITH RECURSIVE " + ", ".join(parts) + f" SELECT f.view, f.r, f.c, CASE WHEN k.view IS NULL THEN 0E0 ELSE 1E0 END AS v FROM full2 f LEFT JOIN {end} k USING (view, r, c)"


@query()
def particle_mask(spark: SparkSession, d: str) -> DataFrame:
    """C15: blurred, cut, opened, closed, filled and dilated."""
    px = _real(spark, d)
    return _image(px, masks.blob_mask(px, 16, 16))


ORACLE_SQL["particle_mask"] = _particle_sql()


@query()
def centred_particle(spark: SparkSession, d: str) -> DataFrame:
    """C9: rolled to the middle."""
    return rounded(masks.centred(_real(spark, d), 16, 16, 0.9, (4, 4))["shifted"], "v")


@query()
def particle_centres(spark: SparkSession, d: str) -> DataFrame:
    """C14."""
    return rounded(masks.centres(_real(spark, d), 6, 16, 16, 1.0), "cr", "cc")


def gaussian_filter(spark: SparkSession, d: str) -> DataFrame:
    """W7 as two line filters."""
    return rounded(lines.gaussian(_real(spark, d), 1.0, 16, 16, 4), "v")


def fourier_shift(spark: SparkSession, d: str) -> DataFrame:
    """T4 as two complex line maps."""
    px = _real(spark, d)
    return rounded(lines.fourier_shift(px, px.select("view").distinct().select("view", F.lit(1.25).alias("dy"), F.lit(-0.5).alias("dx")), 16, 16), "v")


def mask_growth(spark: SparkSession, d: str) -> DataFrame:
    """C8 by sends along both axes."""
    px = _real(spark, d)
    mask = px.join(px.groupBy("view").agg(F.avg("v").alias("a")), "view").where("v > a").select("view", "r", "c")
    return _image(px, masks.grown(mask, 1.0, 16, 16))


QUERIES.update({f.__name__: f for f in (gaussian_filter, fourier_shift, mask_growth)})


@query("""SELECT view, dy, dx, round(CASE WHEN q - p * p / n > 1e-9 AND tt > 0 THEN s / sqrt((q - p * p / n) * tt) ELSE 0 END, 6) AS score FROM (SELECT f.view, CAST(y.x AS INT) AS dy, CAST(z.x AS INT) AS dx, SUM((t.v - m) * f.v) AS s, SUM(CAST(f.v AS DOUBLE)) AS p, SUM(CAST(f.v AS DOUBLE) * f.v) AS q, COUNT(*) AS n, SUM((t.v - m) * (t.v - m)) AS tt
 FROM full2 t CROSS JOIN (SELECT AVG(v) m FROM full2 WHERE view = 1 AND r BETWEEN 2 AND 13 AND c BETWEEN 3 AND 12) CROSS JOIN range(-2, 3) y(x) CROSS JOIN range(-3, 4) z(x) JOIN full2 f ON f.r = t.r + y.x AND f.c = t.c + z.x WHERE t.view = 1 AND t.r BETWEEN 2 AND 13 AND t.c BETWEEN 3 AND 12 GROUP BY 1, 2, 3)""", PIX, FULL)
def normalised_correlation(spark: SparkSession, d: str) -> DataFrame:
    """T5: the middle of the first view against all views at shifts up to 2 rows and 3 columns."""
    px = _real(spark, d)
    middle = px.where("view = 1 AND r BETWEEN 2 AND 13 AND c BETWEEN 3 AND 12").select(F.col("r") - 2, F.col("c") - 3, "v").toDF("r", "c", "v")
    template = px.select("view").distinct().crossJoin(F.broadcast(middle))  # 120 rows
    return rounded(registration.correlations(template, px, 16, 16, (2, 3)), "score")


def _inverse_points() -> list[tuple[float, float, float]]:
    """sigma, mean, expected transform."""
    from ..operators import images

    return [(s, float(m), float(e)) for s in (0.0, 0.5, 1.0, 2.0) for e, m in zip(*images.inverse_table(s, highest=60.0, n=24))]


POINTS = _inverse_points()
STABLE = "dat AS (SELECT view, r, c, v * 30E0 / max(v) OVER () - 4 AS d, CASE WHEN view = 1 THEN 0E0 WHEN view = 2 THEN 3E0 ELSE view / 4E0 END AS s, 1 + view / 10E0 AS alpha FROM full2)"


@query("""SELECT view, r, c, round(alpha * CASE WHEN s > 2 THEN greatest(0, ex - s * s) WHEN s = 0 THEN ex WHEN d < lo THEN 0 WHEN d > hi THEN ex - s * s ELSE own END + view, 6) AS v FROM
 (SELECT dat.*, ends.lo, ends.hi, CASE WHEN d < 2 * sqrt(0.375E0) THEN 0 WHEN d > (SELECT MAX(x) FROM seg0) THEN d * d / 4 - 0.125E0 ELSE p.y + (d - p.x) * (p.y1 - p.y) / (p.x1 - p.x) END AS ex, o.y + (d - o.x) * (o.y1 - o.y) / (o.x1 - o.x) AS own
 FROM dat LEFT JOIN (SELECT *, MIN(x) OVER () = x AS f, MAX(x1) OVER () = x1 AS l FROM seg0 WHERE x1 IS NOT NULL) p ON (d >= p.x OR p.f) AND (d < p.x1 OR p.l)
 LEFT JOIN (SELECT *, MIN(x) OVER (PARTITION BY s) = x AS f, MAX(x1) OVER (PARTITION BY s) = x1 AS l FROM segs WHERE x1 IS NOT NULL) o ON o.s = dat.s AND (d >= o.x OR o.f) AND (d < o.x1 OR o.l)
 LEFT JOIN (SELECT s, MIN(x) lo, MAX(x) hi FROM segs GROUP BY s) ends ON ends.s = dat.s)""", PIX, FULL, STABLE,
 "pts AS (SELECT * FROM (VALUES " + ", ".join(f"({s!r}::DOUBLE, {m!r}::DOUBLE, {e!r}::DOUBLE)" for s, m, e in POINTS) + ") t(sigma, ez, efz))",
 "seg0 AS (SELECT efz AS x, ez AS y, lead(efz) OVER (ORDER BY efz) AS x1, lead(ez) OVER (ORDER BY efz) AS y1 FROM pts WHERE sigma = 0)",
 "bl AS (SELECT s, a.ez AS y, a.efz * (1 - (s - a.sigma) / (b.sigma - a.sigma)) + b.efz * (s - a.sigma) / (b.sigma - a.sigma) AS x FROM (SELECT DISTINCT s FROM dat WHERE s > 0 AND s <= 2) JOIN pts a ON a.sigma = (SELECT CASE WHEN s >= 1 THEN 1 ELSE 0.5 END) JOIN pts b ON b.ez = a.ez AND b.sigma = CASE WHEN s >= 1 THEN 2 ELSE 1 END)",
 "segs AS (SELECT s, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM bl WINDOW w AS (PARTITION BY s ORDER BY x))")
def vst_inverse(spark: SparkSession, d: str) -> DataFrame:
    """without Gaussian noise, with a sigma between the table's, and over them; values beyond both ends."""
    px = _real(spark, d)
    top = px.agg(F.max("v").alias("_m"))
    px = px.crossJoin(F.broadcast(top)).select("view", "r", "c", (F.col("v") * 30 / F.col("_m") - 4).alias("v"))  # one row
    view = F.col("view")
    noise = px.select("view").distinct().select("view", (F.when(view == 1, 0.0).when(view == 2, 3.0).otherwise(view / 4) * (1 + view / 10)).alias("sigma"), (1 + view / 10).alias("alpha"), view.cast("double").alias("mean"))
    general = spark.createDataFrame([p for p in POINTS if p[0] > 0], "sigma double, ez double, efz double")
    plain = spark.createDataFrame([p[1:] for p in POINTS if p[0] == 0], "ez double, efz double")
    return rounded(stabilise.inverse(px, noise, general, plain), "v")
