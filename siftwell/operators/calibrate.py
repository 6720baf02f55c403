"""Calibration of a selection from a table of frequencies (col_id, t, phi), as DataFrame operators.

t counts dummies from 0; the last t is the terminal frequency.  Tables have p x T rows; sums over columns are partial
aggregates, and what is joined back has T or V rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def voting_grid(spark: SparkSession, k: int) -> DataFrame:
    """(v_idx, v): 0.5 + i / K below 1, then 1 - eps."""
    return spark.range(k).select(F.col("id").cast("int").alias("v_idx"), (0.5 + F.col("id") / k).alias("v")).filter(f"v < 1 - {EPS}").union(
        spark.sql(f"select cast(count(*) as int) as v_idx, 1 - {EPS}D as v from range({k}) where 0.5 + id / {k} < 1 - {EPS}D")
    )


def terminal(phi: DataFrame) -> DataFrame:
    """(col_id, phi) at each column's last t."""
    return phi.groupBy("col_id").agg(F.max_by("phi", "t").alias("phi"))


def phi_prime(phi: DataFrame, p: int, num_dummies: int, eps: float = 1e-6) -> DataFrame:
    """(col_id, phi, phi_prime): frequencies deflated by the expected null picks."""
    d = phi.withColumn("d", F.col("phi") - F.coalesce(F.lag("phi").over(Window.partitionBy("col_id").orderBy("t")), F.lit(0.0)))
    last = terminal(phi).withColumnRenamed("phi", "last")
    d = d.join(last, "col_id")
    steps = d.groupBy("t").agg(F.sum("phi").alias("av"), F.sum(F.when(F.col("last") > 0.5, F.col("d")).otherwise(0.0)).alias("dphi"))
    scale = F.when(F.col("dphi") > eps, 1 - ((p - F.col("av")) / (num_dummies - F.col("t"))) / F.col("dphi")).otherwise(0.0)
    out = d.join(steps.select("t", scale.alias("scale")), "t").groupBy("col_id").agg(F.first("last").alias("phi"), F.sum(F.col("scale") * F.col("d")).alias("s"))
    return out.select("col_id", "phi", clamp01(F.col("s")).alias("phi_prime"))


def fdp_hat(primes: DataFrame, grid: DataFrame) -> DataFrame:
    """(v_idx, v, fdp_hat, r): the estimated false share among columns with phi > v.

    Columns are first counted by their number of grid points below phi, so nothing is multiplied by the grid.
    """
    v = grid.agg(F.transform(F.array_sort(F.collect_list(F.struct("v_idx", "v"))), lambda x: x["v"]).alias("vs"))  # V values, V <= K
    vs = v.first()["vs"] or []
    level = F.size(F.filter(F.array(*[F.lit(x) for x in vs]), lambda x: x < F.col("phi")))
    cells = primes.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum(1 - F.col("phi_prime")).alias("false"))
    out = grid.join(cells, cells["level"] > grid["v_idx"], "left").groupBy("v_idx", "v").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("r"), F.coalesce(F.sum("false"), F.lit(0.0)).alias("f"))
    return out.select("v_idx", "v", F.when(F.col("r") > 0, clamp01(F.col("f") / F.col("r"))).otherwise(0.0).alias("fdp_hat"), "r")


def pick_cell(cells: DataFrame, t_fdr: float) -> DataFrame:
    """The winner of cells (T, v_idx, v, fdp_hat, r): most selections within the target; ties to larger v, then T.

    With several T the last one is no candidate.  Without a feasible cell: v = 1 and r = 0.
    """
    last = cells.agg(F.max("T").alias("hi"), F.min("T").alias("lo"))
    open_ = cells.join(last, (F.col("T") < F.col("hi")) | (F.col("lo") == F.col("hi"))).filter(F.col("fdp_hat") <= t_fdr)
    best = open_.agg(F.max(F.struct("r", "v_idx", "T", "v")).alias("b"))
    return best.select(F.coalesce("b.T", F.lit(0)).alias("T"), F.coalesce("b.v", F.lit(1.0)).alias("v"), F.coalesce("b.r", F.lit(0)).alias("r"))


def _over(gap: Column) -> Column:
    """What a frequency is divided by: 2 less the least difference to a neighbour's, 2 without neighbours."""
    return F.when(gap.isNull(), 2.0).otherwise(2 - gap)


def _nearest(w) -> Column:
    return F.least(F.abs(F.col("phi") - F.lag("phi").over(w)), F.abs(F.col("phi") - F.lead("phi").over(w)))


def deflate_equi(phi: DataFrame) -> DataFrame:
    """(col_id, phi) deflated among all columns.

    Equal frequencies are one row of a table of at most K + 1 values, so the ordering is of values and not of columns: a
    value that occurs twice has the gap 0, and the others have that of their neighbours in the order.
    """
    last = terminal(phi)
    values = last.groupBy("phi").agg(F.count("*").alias("n"))
    gaps = values.select("phi", F.when(F.col("n") > 1, 0.0).otherwise(_nearest(Window.orderBy("phi"))).alias("gap"))
    return last.join(gaps, "phi").select("col_id", (F.col("phi") / _over(F.col("gap"))).alias("phi"))


def deflate_groups(phi: DataFrame, groups: DataFrame) -> DataFrame:
    """The same within groups (col_id, group_id); a column alone in its group is halved."""
    near = _nearest(Window.partitionBy("group_id").orderBy("phi", "col_id"))
    return terminal(phi).join(groups, "col_id").withColumn("gap", near).select("col_id", (F.col("phi") / _over(F.col("gap"))).alias("phi"))


def deflate_levels(phi: DataFrame, levels: DataFrame) -> DataFrame:
    """(rho_idx, col_id, t, phi) for every level of levels (rho_idx, col_id, group_id): gaps are those of the terminal
    frequencies, and divide the frequencies at all t."""
    last = terminal(phi).withColumnRenamed("phi", "last")
    near = F.least(*[F.abs(F.col("last") - f("last").over(Window.partitionBy("rho_idx", "group_id").orderBy("last", "col_id"))) for f in (F.lag, F.lead)])
    over = levels.join(last, "col_id").withColumn("gap", near).select("rho_idx", "col_id", _over(F.col("gap")).alias("over"))
    return phi.join(over, "col_id").select("rho_idx", "col_id", "t", (F.col("phi") / F.col("over")).alias("phi"))


def deflate_ar1(phi: DataFrame, kap: int) -> DataFrame:
    """The same among columns at most kap places away: a join on cells of kap columns."""
    last = terminal(phi)
    other = last.select(F.col("col_id").alias("other"), F.col("phi").alias("q"), F.explode(F.expr(f"array(col_id div {kap} - 1, col_id div {kap}, col_id div {kap} + 1)")).alias("cell"))
    pairs = last.withColumn("cell", F.expr(f"col_id div {kap}")).join(other, "cell").filter(f"other != col_id and abs(other - col_id) <= {kap}")
    near = pairs.groupBy("col_id").agg(F.min(F.abs(F.col("phi") - F.col("q"))).alias("gap"))
    return last.join(near, "col_id", "left").select("col_id", (F.col("phi") / _over(F.col("gap"))).alias("phi"))


def pick_level(cells: DataFrame, t_fdr: float, faithful: bool = False) -> DataFrame:
    """The winner of cells (rho_idx, T, v_idx, v, fdp_hat, r): most selections within the target; ties to larger v, then
    larger rho, then T.  `faithful` also admits cells beyond the target that have that number of selections."""
    ends = cells.agg(F.max("T").alias("hi"), F.min("T").alias("lo")).first()
    open_ = cells if ends["lo"] == ends["hi"] else cells.filter(F.col("T") < ends["hi"])
    most = open_.filter(F.col("fdp_hat") <= t_fdr).agg(F.max("r")).first()[0]
    mine = open_.filter(F.col("r") == most) if most is not None else open_.limit(0)
    best = (mine if faithful else mine.filter(F.col("fdp_hat") <= t_fdr)).agg(F.max(F.struct("v_idx", "rho_idx", "T", "v", "r")).alias("b"))
    return best.select(F.coalesce("b.rho_idx", F.lit(-1)).alias("rho_idx"), F.coalesce("b.T", F.lit(0)).alias("T"), F.coalesce("b.v", F.lit(1.0)).alias("v"), F.coalesce("b.r", F.lit(0)).alias("r"))


def ar1_reach(rho: float) -> int:
    import math

    return math.ceil(math.log(0.02) / math.log(rho))


def biobank_choice(estimates: DataFrame, lo: float = 0.05, hi: float = 0.15) -> DataFrame:
    """(phenotype_id, choice) from ordinary and bootstrap estimates: the bootstrap where it lies in the bounds and is no
    less than an ordinary estimate of at most `hi`, else the ordinary one in the bounds, else the full selection."""
    o, b = F.col("fdr_ordinary"), F.col("fdr_bootstrap")
    inside = lambda x: (x >= lo) & (x <= hi)
    return estimates.select("phenotype_id", F.when(inside(b) & ((o > hi) | (b >= o)), "bootstrap").when(inside(o), "ordinary").otherwise("full").alias("choice"))


def rates(selected: DataFrame, support: DataFrame) -> DataFrame:
    """(tp, fp, fn, fdp, tpp, precision, recall, f1) of two sets of col_id; empty sets give 0."""
    both = selected.select("col_id").distinct().withColumn("s", F.lit(1)).join(support.select("col_id").distinct().withColumn("t", F.lit(1)), "col_id", "full")
    hit = F.col("s").isNotNull() & F.col("t").isNotNull()
    c = both.agg(F.count_if(hit).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("s").isNull()).alias("fn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    c = c.select("tp", "fp", "fn", share(fp, tp + fp).alias("fdp"), share(tp, tp + fn).alias("tpp"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"))
    return c.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def rates_dense(pairs: DataFrame, eps: float = EPS) -> DataFrame:
    """(fdp, tpp) from (beta_hat, beta)."""
    s, t = F.abs("beta_hat") > eps, F.abs("beta") > eps
    c = pairs.agg(F.count_if(s).alias("s"), F.count_if(t).alias("t"), F.count_if(s & t).alias("st"))
    return c.select(F.when(F.col("s") > 0, (F.col("s") - F.col("st")) / F.col("s")).otherwise(0.0).alias("fdp"), F.when(F.col("t") > 0, F.col("st") / F.col("t")).otherwise(0.0).alias("tpp"))
