"""DuckDB SQL for the queries that SQL can express."""

LONG = "long as (select vec_id as row_id, unnest(range(0, 64))::int as col_id, unnest(embedding)::double as value from embeddings)"
MOMENTS = LONG + """, means as (select col_id, count(*) as n, avg(value) as mean, stddev_samp(value) as sd from long group by col_id),
    mom as (select m.col_id, n, mean, sd, sd * sqrt(n - 1) as l2, sum(abs(value - mean)) as l1 from means m join long using (col_id) group by all)"""
Z = MOMENTS + ", z as (select row_id, col_id, (value - mean) / l2 as value from long join mom using (col_id))"
CORR = Z + ", r as (select a.col_id as i, b.col_id as j, sum(a.value * b.value) as r from z a join z b on a.row_id = b.row_id and a.col_id < b.col_id group by all)"
PLANTED = LONG + """, y as (select vec_id as row_id, 5 * embedding[2]::double - 3 * embedding[3]::double + 2 * embedding[4]::double
    + 2 * (('0x' || substr(md5(vec_id::varchar), 1, 7))::bigint / 268435456.0 - 0.5) as y from embeddings)"""
PHI = PLANTED + """, ranked as (select k, col_id, row_number() over (partition by k order by s desc, col_id) as place
        from (select row_id % 20 as k, col_id, abs(sum(value * y)) as s from long join y using (row_id) group by all)),
    phi as (select col_id, t::int as t, count(*) filter (place <= 3 + 2 * t) / 20.0::double as phi from ranked, range(5) x(t) group by col_id, t),
    term as (select col_id, phi from phi where t = 4)"""
GRID = "grid as (select (row_number() over (order by v) - 1)::int as v_idx, v from (select 0.5 + i / 20.0::double as v from range(10) x(i) union all select 1 - 2.220446049250313e-16::double))"


def _prime(source: str, last: str, tag: str = "") -> str:
    return f"""d{tag} as (select *, phi - coalesce(lag(phi) over (partition by col_id order by t), 0) as d from {source}),
    s{tag} as (select t, sum(d.phi) as av, sum(case when l.phi > 0.5 then d else 0 end) as dphi from d{tag} d join {last} l using (col_id) group by t),
    p{tag} as (select col_id, l.phi as phi, least(greatest(sum(case when dphi > 1e-6 then 1 - ((64 - av) / (64 - t)) / dphi else 0 end * d), 0), 1) as phi_prime
        from d{tag} join s{tag} using (t) join {last} l using (col_id) group by col_id, l.phi),
    f{tag} as (select v_idx, v, count(p.col_id) as r, case when count(p.col_id) > 0 then least(greatest(sum(1 - phi_prime) / count(p.col_id), 0), 1) else 0 end as fdp_hat
        from grid left join p{tag} p on p.phi > v group by v_idx, v)"""


_CELLS = ", ".join(f"phi{t} as (select * from phi where t < {t}), term{t} as (select col_id, phi from phi where t = {t - 1}), {_prime(f'phi{t}', f'term{t}', str(t))}" for t in range(1, 6))
_ALL = " union all ".join(f"select {t} as T, * from f{t}" for t in range(1, 6))
_SCALED = "select row_id, col_id, round((value - mean) / {}, 6) as value from long join mom using (col_id)"

ORACLES: dict[str, str] = {
    "column_moments": f"with {MOMENTS} select col_id, n, round(mean, 6) as mean, round(sd, 6) as sd, round(l2, 6) as l2, round(l1, 6) as l1 from mom",
    "standardize_l2": f"with {MOMENTS} {_SCALED.format('l2')}", "standardize_zscore": f"with {MOMENTS} {_SCALED.format('sd')}", "lp_norm_l1": f"with {MOMENTS} {_SCALED.format('l1')}",
    "gram_matrix": f"with {LONG} select a.col_id as i, b.col_id as j, round(sum(a.value * b.value), 6) as g from long a join long b using (row_id) group by all",
    "tall_gram": "with v as (select l_quantity as a, l_discount as b, l_tax as c from lineitem), w as (select unnest([0, 0, 0, 1, 1, 1, 2, 2, 2])::int as i, unnest([0, 1, 2, 0, 1, 2, 0, 1, 2])::int as j, unnest([a * a, a * b, a * c, a * b, b * b, b * c, a * c, b * c, c * c]) as g from v) select i, j, round(sum(g), 2) as g from w group by all",
    "xty": f"with {PLANTED} select col_id as i, round(sum(value * y), 5) as g from long join y using (row_id) group by all",
    "sq_euclidean": f"with {LONG} select a.col_id as i, b.col_id as j, round(sum((a.value - b.value) ** 2), 5) as d from long a join long b on a.row_id = b.row_id and a.col_id < b.col_id group by all",
    "manhattan": f"with {LONG} select a.col_id as i, b.col_id as j, round(sum(abs(a.value - b.value)), 5) as d from long a join long b on a.row_id = b.row_id and a.col_id < b.col_id group by all",
    "corr_distance": f"with {CORR} select i, j, round(1 - abs(r), 5) as d from r",
    "equi_rho": f"with {CORR} select round(avg(r), 6) as rho from r",
    "block_equi_rho": f"with {CORR} select (i // 13)::bigint as block, round(avg(r), 6) as rho from r where i // 13 = j // 13 group by all",
    "ar1_rho": f"with {Z}, l as (select *, lag(value) over (partition by row_id order by col_id) as b from z), q as (select row_id, sum(value * b) / sum(value * value) as r from l group by row_id) select round(abs(avg(r)), 6) as rho from q",
    "voting_grid": f"with {GRID} select v_idx, round(v, 9) as v from grid",
    "phi_prime": f"with {PHI}, {GRID}, {_prime('phi', 'term')} select col_id, round(phi, 6) as phi, round(phi_prime, 6) as phi_prime from p",
    "fdp_hat": f"with {PHI}, {GRID}, {_prime('phi', 'term')} select v_idx, round(v, 6) as v, round(fdp_hat, 6) as fdp_hat, r from f",
    "pick_cell": f"with {PHI}, {GRID}, {_CELLS}, c as ({_ALL}) select T, round(v, 6) as v, r from (select T, v, r, v_idx from c where T < 5 and fdp_hat <= 0.1 union all select 0, 1.0, 0, -1) order by r desc, v_idx desc, T desc limit 1",
    "da_equi": f"with {PHI}, n as (select a.col_id, a.phi, min(abs(a.phi - b.phi)) as near from term a join term b on a.col_id <> b.col_id group by all) select col_id, round(phi / (2 - near), 6) as phi from n",
    "da_groups": f"with {PHI}, n as (select a.col_id, a.phi, min(abs(a.phi - b.phi)) as near from term a left join term b on a.col_id <> b.col_id and a.col_id // 7 = b.col_id // 7 group by all) select col_id, round(phi / coalesce(2 - near, 2), 6) as phi from n",
    "da_ar1": f"with {PHI}, n as (select a.col_id, a.phi, min(abs(a.phi - b.phi)) as near from term a left join term b on a.col_id <> b.col_id and abs(a.col_id - b.col_id) <= 3 group by all) select col_id, round(phi / coalesce(2 - near, 2), 6) as phi from n",
    "selection_rates": """with c as (select count(*) filter (quality = 0 and toxic = 1) as tp, count(*) filter (quality = 0 and toxic is distinct from 1) as fp, count(*) filter (toxic = 1 and quality is distinct from 0) as fn from labels)
        select tp, fp, fn, round(fp / (tp + fp), 6) as fdp, round(tp / (tp + fn), 6) as tpp, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from c""",
    "dense_rates": "select round(count(*) filter (quality = 1 and toxic = 0) / count(*) filter (quality = 1), 6) as fdp, round(count(*) filter (quality = 1 and toxic = 1) / count(*) filter (toxic = 1), 6) as tpp from labels",
    "biobank_choice": """with long as (select label, unnest(range(0, 64)) as col_id, unnest(embedding)::double as value from embeddings), classes as (select distinct label as c from embeddings),
        r as (select c, col_id, abs(corr(value, (label = c)::int::double)) as r from long, classes group by c, col_id),
        e as (select c, coalesce(1 / nullif(count(*) filter (r > 0.04), 0), 0) as o, coalesce(1 / nullif(count(*) filter (r > 0.05), 0), 0) as b from r group by c)
        select c as phenotype_id, case when b between 0.05 and 0.15 and (o > 0.15 or b >= o) then 'bootstrap' when o between 0.05 and 0.15 then 'ordinary' else 'full' end as choice from e""",
    "ridge_fit": """with g as (select sum(l_quantity * l_quantity) + 5 as a, sum(l_quantity * l_discount) as b, sum(l_discount * l_discount) + 5 as c, sum(l_quantity * l_extendedprice) as u, sum(l_discount * l_extendedprice) as v from lineitem)
        select 0 as col_id, round((c * u - b * v) / (a * c - b * b), 3) as beta from g union all select 1, round((a * v - b * u) / (a * c - b * b), 3) from g""",
    "svd_values": """with g as (select sum(l_quantity * l_quantity) as a, sum(l_quantity * l_discount) as b, sum(l_discount * l_discount) as c from lineitem), r as (select a, b, c, (a + c + sqrt((a - c) ** 2 + 4 * b * b)) / 2 as e from g)
        select 0 as k, round(sqrt(e), 4) as sd from r union all select 1, round(sqrt((a * c - b * b) / e), 4) from r""",
    "pca_variance": """with g as (select var_samp(l_quantity) as a, covar_samp(l_quantity, l_discount) as b, var_samp(l_discount) as c from lineitem), r as (select a, b, c, (a + c + sqrt((a - c) ** 2 + 4 * b * b)) / 2 as e from g)
        select 0 as k, round(e, 5) as variance from r union all select 1, round((a * c - b * b) / e, 5) from r""",
}

_LEVELS = """levels as (select (id // 64)::int as rho_idx, (id % 64)::int as col_id, ((id % 64) // (4 ** (3 - id // 64))::int)::int as group_id from range(256) x(id)),
    gaps as (select a.rho_idx, a.col_id, min(abs(p.phi - q.phi)) filter (b.col_id <> a.col_id) as gap
        from levels a join levels b on b.rho_idx = a.rho_idx and b.group_id = a.group_id join term p on p.col_id = a.col_id join term q on q.col_id = b.col_id group by all),
    adjusted as (select rho_idx, col_id, t, phi / coalesce(2 - gap, 2) as phi from phi join gaps using (col_id))"""
_LEVEL_CELLS = ", ".join(
    f"phi{r}{t} as (select col_id, t, phi from adjusted where rho_idx = {r} and t < {t}), term{r}{t} as (select col_id, phi from adjusted where rho_idx = {r} and t = {t - 1}), {_prime(f'phi{r}{t}', f'term{r}{t}', f'{r}{t}')}" for r in range(4) for t in range(1, 6)
)
_LEVEL_ALL = " union all ".join(f"select {r} as rho_idx, {t} as T, * from f{r}{t}" for r in range(4) for t in range(1, 6))


def _above(table: str, low: float) -> str:
    """Columns whose correlation with the response is above a bound."""
    return f"select col_id from (select col_id, abs(corr(value, y)) as r from {table} group by col_id) where r > {low}"


ORACLES |= {
    "da_levels": f"with {PHI}, {_LEVELS} select rho_idx, col_id, t, round(phi, 6) as phi from adjusted",
    "pick_level": f"with {PHI}, {GRID}, {_LEVELS}, {_LEVEL_CELLS}, c as ({_LEVEL_ALL}) select rho_idx, T, round(v, 6) as v, r from (select rho_idx, T, v, r, v_idx from c where T < 5 and fdp_hat <= 0.2 union all select -1, 0, 1.0, 0, -1) order by r desc, v_idx desc, rho_idx desc, T desc limit 1",
    "ridge_residuals": "select i::int as col_id, 0.0::double as r from range(64) x(i)",
    "svd_embeddings": f"with {LONG}, g as (select a.col_id as i, b.col_id as j, sum(a.value * b.value) as g from long a join long b using (row_id) group by all) select round(sum(g) filter (i = j), 3) as squares, round(sum(g * g), 1) as fourths from g",
    "cluster_cut": f"with recursive {CORR}, e as (select i, j from r where 1 - abs(r) <= 0.95 union all select j, i from r where 1 - abs(r) <= 0.95), walk as (select i::int as col_id, i::int as seen from range(64) x(i) union select w.col_id, e.j from walk w join e on e.i = w.seen) select col_id, min(seen) as group_id from walk group by col_id",
    "scaler_round_trip": f"with {LONG} select row_id, col_id, round(value, 6) as value from long",
    "scaler_rms": f"with {LONG}, s as (select col_id, sqrt(sum(value * value) / (count(*) - 1)) as scale from long group by col_id) select row_id, col_id, round(value / scale, 6) as value from long join s using (col_id)",
    "matrix_view": "select vec_id as row_id, unnest(range(0, 4))::int as col_id, unnest(embedding[6:9])::double as value from embeddings where vec_id >= 10 and vec_id < 90",
}
ORACLES |= {f"found_{s}": f"with {PLANTED} " + _above("(select * from long join y using (row_id))", 0.2) for s in ("tlars", "tlasso", "tstepwise", "tstagewise", "tenet", "tccd", "tomp", "tools", "tmp", "tgp", "tacgp", "tncgmp", "tafs")}
