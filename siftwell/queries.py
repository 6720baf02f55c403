"""Queries over the reference operators, on the driver's tables: `embeddings` is the design, and the planted response is
5 x1 - 3 x2 + 2 x3 + noise from a hash of the row's id, so its support is known."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import calibrate as C
from .operators import clusters as CL
from .operators import linear as L
from .operators import matrix as M
from .operators import penalties as P
from .operators import scaling as SC

K = 20


def _x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rows_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


def _noise() -> Column:
    """Uniform over [-1, 1), from a hash of the row's id."""
    return 2 * (F.conv(F.substring(F.md5(F.col("row_id").cast("string").cast("binary")), 1, 7), 16, 10).cast("double") / 2.0**28 - 0.5)


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = 5 * F.col("features")[1] - 3 * F.col("features")[2] + 2 * F.col("features")[3]
    return _x(spark, sf_dir).withColumn("y", signal + _noise())


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


def _phi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies that SQL can make too: each of K parts of the rows ranks the 64 columns by their product with the planted
    response, and a column counts at t where it is among the 3 + 2 t first."""
    k = F.pmod(F.col("row_id"), F.lit(K)).alias("k")
    products = _planted(spark, sf_dir).select(k, "y", F.posexplode("features").alias("col_id", "value")).groupBy("k", "col_id").agg(F.abs(F.sum(F.col("value") * F.col("y"))).alias("s"))
    ranked = products.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("s"), "col_id")))
    at = ranked.select("col_id", "place", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("t"))
    return at.groupBy("col_id", "t").agg((F.count_if(F.col("place") <= 3 + 2 * F.col("t")) / K).alias("phi"))


def _blocks(spark: SparkSession, sf_dir: str, within: float = 0.5) -> DataFrame:
    """24 columns in six related blocks, from the embeddings; the signal is columns 1, 8 and 18."""
    f = F.col("features")
    x = _x(spark, sf_dir).withColumn("features", F.array(*[f[j // 4] + within * f[6 + j] for j in range(24)]))
    return x.withColumn("y", 5 * f[1] - 4 * f[8] + 4 * f[18] + _noise())


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 columns, each related to the ones before it; the signal is columns 4, 19 and 33."""
    f = F.col("features")
    chain = F.array(*[sum((0.6 ** (j - i) * f[i] for i in range(max(0, j - 8), j)), f[j]) for j in range(40)])
    return _x(spark, sf_dir).withColumn("features", chain).withColumn("y", 5 * f[4] - 4 * f[19] + 4 * f[33] + _noise())


def _shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 columns with one common part; the signal is column 5."""
    f = F.col("features")
    x = _x(spark, sf_dir).withColumn("features", F.array(*[0.7 * f[40] + f[j] for j in range(30)]))
    return x.withColumn("y", 5 * f[5] + _noise())


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each column with its frequency, deflated frequency, and whether it is selected at 10 %."""
    from .plans.selectors import Control, select

    s = select(_planted(spark, sf_dir), "y", 0.1, Control(k=K, seed=1))
    rows = [(i, float(s.phi[i]), float(s.phi_prime[i]), bool(i in set(s.selected.tolist()))) for i in range(len(s.phi))]
    return spark.createDataFrame(rows, "col_id int, phi double, phi_prime double, selected boolean")


def _selector(**options):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .plans import selectors as S

        c = {k: options[k] for k in ("solver", "strategy", "distribution") if k in options}
        s = S.select(_planted(spark, sf_dir), "y", 0.1, S.Control(k=K, seed=1, **c), options.get("dependence"))
        return spark.createDataFrame([(int(i), s.v, s.t_stop, s.layers) for i in s.selected], "col_id int, v double, t_stop int, layers int")

    return query


def screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.selectors import Control, screen

    found, rate = screen(_planted(spark, sf_dir), "y", Control(k=K, seed=1))
    return spark.createDataFrame([(int(i), rate) for i in found], "col_id int, fdr double")


def grouped_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.selectors import Control, select_groups

    s = select_groups(_planted(spark, sf_dir), "y", 0.1, control=Control(k=K, seed=1))
    return spark.createDataFrame([(int(i), s.v) for i in s.selected], "col_id int, v double")


def column_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.moments(M.to_long(_x(spark, sf_dir))), "mean", "sd", "l2", "l1")


def _scaled(how: str):
    return lambda spark, sf_dir: _rounded(M.scaled(M.to_long(_x(spark, sf_dir)), how), "value")


def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.gram(_x(spark, sf_dir)), "g")


def tall_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = M.assemble(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey", ["l_quantity", "l_discount", "l_tax"])
    return _rounded(M.gram(x), "g", digits=2)


def xty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.gram(_planted(spark, sf_dir), "y").filter("j = 64 and i < 64").select("i", "g"), "g", digits=5)


def _distance(how: str):
    return lambda spark, sf_dir: _rounded(M.distances(_x(spark, sf_dir), how), "d", digits=5)


def equi_rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.equi_rho(_x(spark, sf_dir)), "rho")


def block_equi_rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.block_equi_rho(_x(spark, sf_dir), 13), "rho")


def ar1_rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.ar1_rho(_x(spark, sf_dir)), "rho")


def voting_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(C.voting_grid(spark, K), "v", digits=9)


def phi_prime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(C.phi_prime(_phi(spark, sf_dir), 64, 64), "phi", "phi_prime")


def fdp_hat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(C.fdp_hat(C.phi_prime(_phi(spark, sf_dir), 64, 64), C.voting_grid(spark, K)), "v", "fdp_hat")


def pick_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = None
    for t in range(1, 6):
        one = C.fdp_hat(C.phi_prime(_phi(spark, sf_dir).filter(F.col("t") < t), 64, 64), C.voting_grid(spark, K)).withColumn("T", F.lit(t))
        cells = one if cells is None else cells.unionByName(one)
    return _rounded(C.pick_cell(cells, 0.1), "v")


def da_equi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(C.deflate_equi(_phi(spark, sf_dir)), "phi")


def da_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(C.deflate_groups(_phi(spark, sf_dir), spark.range(64).select(F.col("id").cast("int").alias("col_id"), F.expr("id div 7").alias("group_id"))), "phi")


def da_ar1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(C.deflate_ar1(_phi(spark, sf_dir), 3), "phi")


def selection_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = C.rates(s.filter("quality = 0").select(F.col("doc_id").alias("col_id")), s.filter("toxic = 1").select(F.col("doc_id").alias("col_id")))
    return _rounded(got, "fdp", "tpp", "precision", "recall", "f1")


def dense_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("quality").cast("double").alias("beta_hat"), F.col("toxic").cast("double").alias("beta"))
    return _rounded(C.rates_dense(s), "fdp", "tpp")


def biobank_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One phenotype for each class: the rates are 1 / (columns whose correlation with it is above a bound)."""
    x = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", F.posexplode("embedding").alias("col_id", "value"))
    classes = [r["label"] for r in x.select("label").distinct().orderBy("label").collect()]  # ten classes
    each = x.groupBy("col_id").agg(*[F.abs(F.corr(F.col("value").cast("double"), (F.col("label") == c).cast("double"))).alias(f"r{c}") for c in classes])
    rate = lambda c, low: F.when(F.count_if(F.col(f"r{c}") > low) > 0, 1 / F.count_if(F.col(f"r{c}") > low)).otherwise(0.0)
    wide = each.agg(*[rate(c, low).alias(f"{name}{c}") for c in classes for name, low in (("o", 0.04), ("b", 0.05))])
    rows = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("phenotype_id"), F.col(f"o{c}").alias("fdr_ordinary"), F.col(f"b{c}").alias("fdr_bootstrap")) for c in classes])).alias("e")).select("e.*")
    return C.biobank_choice(rows)


def da_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terminal frequencies deflated at levels of a single-linkage tree of the 64 columns."""
    return _rounded(C.deflate_levels(_phi(spark, sf_dir), _levels(spark, sf_dir)), "phi")


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rho_idx, col_id, group_id): blocks of 64, 16, 4 and 1 columns."""
    return spark.range(256).select(F.expr("cast(id div 64 as int)").alias("rho_idx"), F.expr("cast(id % 64 as int)").alias("col_id"), F.expr("cast(id % 64 div cast(pow(4, 3 - id div 64) as int) as int)").alias("group_id"))


def pick_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winning (rho, T, v) over those levels."""
    grid, cells = C.voting_grid(spark, K), None
    phi = C.deflate_levels(_phi(spark, sf_dir), _levels(spark, sf_dir))
    for level in range(4):
        for t in range(1, 6):
            one = C.fdp_hat(C.phi_prime(phi.filter((F.col("rho_idx") == level) & (F.col("t") < t)).drop("rho_idx"), 64, 64), grid).withColumns({"T": F.lit(t), "rho_idx": F.lit(level)})
            cells = one if cells is None else cells.unionByName(one)
    return _rounded(C.pick_level(cells, 0.2), "v")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return M.assemble(items, "l_orderkey", ["l_quantity", "l_discount", "l_extendedprice"]).select("row_id", F.slice("features", 1, 2).alias("features"), F.col("features")[2].alias("y"))


def ridge_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    beta = L.ridge(_lines(spark, sf_dir), "y", 5.0)
    return _rounded(spark.createDataFrame([(i, float(b)) for i, b in enumerate(beta)], "col_id int, beta double"), "beta", digits=3)


def svd_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    sd = L.components(_lines(spark, sf_dir), 2, center=False).sd
    return _rounded(spark.createDataFrame([(i, float(v)) for i, v in enumerate(sd)], "k int, sd double"), "sd", digits=4)


def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = L.components(_lines(spark, sf_dir), 2).explained
    return _rounded(spark.createDataFrame([(i, float(v)) for i, v in enumerate(got)], "k int, variance double"), "variance", digits=5)


def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _x(spark, sf_dir)
    return L.scores(x, L.components(x, 5))


def synthetic_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.synthetic(spark, 300, {1: 5.0, 2: -3.0, 3: 2.0}, 100, 1.0, 42)


def ridge_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of all 64 columns; the residual of the normal equations is what SQL checks (ridge_residuals)."""
    beta = L.ridge(_planted(spark, sf_dir), "y", 5.0)
    return _rounded(spark.createDataFrame([(i, float(b)) for i, b in enumerate(beta)], "col_id int, beta double"), "beta")


def ridge_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(col_id, r): X'(y - X b) - lambda b of the ridge fit, which is zero."""
    x = _planted(spark, sf_dir)
    beta = L.ridge(x, "y", 5.0)
    g = L._dense(M.gram(x, "y"), 65)
    r = g[:64, 64] - g[:64, :64] @ beta - 5.0 * beta
    return _rounded(spark.createDataFrame([(i, float(v)) for i, v in enumerate(r)], "col_id int, r double"), "r", digits=5)


def svd_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sums of squared and of fourth powers of all singular values, which are traces of cross products."""
    sd = L.components(_x(spark, sf_dir), 64, center=False).sd
    return spark.createDataFrame([(round(float((sd**2).sum()), 3), round(float((sd**4).sum()), 1))], "squares double, fourths double")


def _merges(method: str, metric: str):
    return lambda spark, sf_dir: _rounded(CL.cluster(_x(spark, sf_dir), method, metric), "distance", digits=5)


def cluster_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(col_id, group_id): single linkage of correlations cut at 0.95; a group is named by its least column."""
    x = _x(spark, sf_dir)
    labels = CL.cut_by_height(CL.tree(CL.square(x)), 64, 0.95)
    return spark.createDataFrame([(j, int(of.min())) for of in CL.members(labels) for j in of.tolist()], "col_id int, group_id int")


def lsh_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(CL.lsh_distances(_x(spark, sf_dir)), "d", digits=5)


def scaler_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _x(spark, sf_dir)
    s = SC.fit(x, "zscore")
    return _rounded(M.to_long(s.inverse(s.transform(x))), "value")


def scaler_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.to_long(SC.fit(_x(spark, sf_dir), "zscore", center=False).transform(_x(spark, sf_dir))), "value")


def elastic_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = P.elastic_net(_planted(spark, sf_dir), "y", 0.5, n_lambda=20)
    rows = [(k, j, float(b)) for k, beta in enumerate(path.beta) for j, b in enumerate(beta) if b]
    return _rounded(spark.createDataFrame(rows, "step int, col_id int, beta double"), "beta")


def elastic_net_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = P.elastic_net_cv(_planted(spark, sf_dir), "y", 0.0)
    return _rounded(spark.createDataFrame([(k, float(a), float(e), float(s)) for k, (a, e, s) in enumerate(zip(v.lambdas, v.error, v.se, strict=True))], "k int, lambda double, mse double, se double"), "lambda", "mse", "se")


def ridge_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = P.ridge_cv(_planted(spark, sf_dir), "y", n_lambda=100)
    return spark.createDataFrame([(v.at_min, v.at_1se)], "at_min double, at_1se double")


def matrix_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import store

    return M.to_long(store.view(_x(spark, sf_dir), (10, 90), (5, 9)))


def screening_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.selectors import Control, screen

    found, rate = screen(_planted(spark, sf_dir), "y", Control(k=K, seed=1), bootstrap=True)
    return spark.createDataFrame([(int(i), rate) for i in found], "col_id int, fdr double")


def biobank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screening of ten class indicators and the planted response, from one job."""
    from .plans.selectors import Control, screen_many

    x = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), "label")
    y = _planted(spark, sf_dir).join(x, "row_id")
    classes = [r["label"] for r in x.select("label").distinct().orderBy("label").collect()]  # ten classes
    y = y.withColumns({f"class_{c}": (F.col("label") == c).cast("double") for c in classes})
    got = screen_many(y, ["y", *[f"class_{c}" for c in classes]], Control(k=K, seed=1, max_layers=2))
    return spark.createDataFrame([(q, how, len(on)) for q, (on, how) in got.items()], "phenotype string, choice string, columns int")


def sparse_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.selectors import Control, sparse_components as fit

    c = fit(_blocks(spark, sf_dir), 2, 0.1, Control(k=10, seed=1, max_layers=3))
    rows = [(k, int(j), float(c.loadings[j, k])) for k in range(c.loadings.shape[1]) for j in np.flatnonzero(c.loadings[:, k])]
    return spark.createDataFrame(rows, "component int, col_id int, loading double")


def _found(frame, **options):
    """The selected columns on a design with a planted signal."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .plans import selectors as S

        c = S.Control(k=K, seed=1, **{k: options[k] for k in ("solver", "strategy", "options") if k in options})
        s = S.select(frame(spark, sf_dir), "y", 0.1, c, options.get("dependence"))
        return spark.createDataFrame([(int(i),) for i in s.selected], "col_id int")

    return query


QUERIES = {
    f.__name__: f
    for f in (flagship, screening, grouped_selection, column_moments, gram_matrix, tall_gram, xty, equi_rho, block_equi_rho, ar1_rho, voting_grid, phi_prime, fdp_hat, pick_cell, da_equi, da_groups, da_ar1, da_levels, pick_level, selection_rates, dense_rates, biobank_choice, ridge_fit, svd_values, pca_variance, pca_scores, synthetic_data, ridge_embeddings, ridge_residuals, svd_embeddings, cluster_cut, lsh_distance, scaler_round_trip, scaler_rms, elastic_net, elastic_net_cv, ridge_cv, matrix_view, screening_bootstrap, biobank, sparse_components)
}
QUERIES |= {f"cluster_{m}": _merges(m, "sq_euclidean" if m in CL.GEOMETRIC else "correlation") for m in CL.LINKAGES}
QUERIES |= {"standardize_l2": _scaled("l2"), "standardize_zscore": _scaled("zscore"), "lp_norm_l1": _scaled("l1")}
QUERIES |= {"sq_euclidean": _distance("sq_euclidean"), "corr_distance": _distance("correlation"), "manhattan": _distance("manhattan")}
QUERIES |= {f"select_{s}": _selector(solver=s) for s in ("tlasso", "tstepwise", "tstagewise", "tenet", "tomp", "tools", "tmp", "tgp", "tacgp", "tncgmp", "tafs", "tccd")}
QUERIES |= {f"select_da_{d}": _found(frame, dependence=d, options={"groups": [j // 4 for j in range(24)]}) for d, frame in (("equi", _shared), ("ar1", _chain), ("nn", _blocks), ("bt", _blocks), ("prior_groups", _blocks))}
QUERIES |= {f"select_{s}": _selector(strategy=s) for s in ("hconcat", "permutation", "skipl")}
QUERIES |= {f"found_{s}": _found(_planted, solver=s) for s in ("tlars", "tlasso", "tstepwise", "tstagewise", "tenet", "tccd", "tomp", "tools", "tmp", "tgp", "tacgp", "tncgmp", "tafs")}
