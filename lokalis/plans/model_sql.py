"""SQL of the local models: moments by weighted pairs, elimination of small systems, unrolled iterations.

Texts are made of common table expressions; each function returns those that it adds, in order.
"""

from __future__ import annotations


def added(terms) -> str:
    return "(" + " + ".join(terms) + ")"


def inverse(source: str, k: int, name: str) -> list[str]:
    """Table ``name``: the rows of ``source`` with a{i}_{k+j}, the inverse of their k x k matrix m{i}_{j}; Gauss-Jordan without pivots, for positive definite matrices."""
    cols = [f"CAST({f'm{i}_{j}' if j < k else float(j - k == i)} AS DOUBLE) AS a{i}_{j}" for i in range(k) for j in range(2 * k)]
    out = [f"{name}_0 AS MATERIALIZED (SELECT *, {', '.join(cols)} FROM {source})"]
    for p in range(k):
        new = []
        for j in range(2 * k):
            if j > p or j >= k:
                scaled = f"a{p}_{j}/a{p}_{p}"
                new += [f"{scaled if i == p else f'a{i}_{j}-a{i}_{p}*({scaled})'} AS a{i}_{j}" for i in range(k)]
        target = name if p == k - 1 else f"{name}_{p + 1}"
        out.append(f"{target} AS MATERIALIZED (SELECT * REPLACE ({', '.join(new)}) FROM {name}_{p})")
    return out


def moments(w: str, xs: list[str], y: str, name: str, squares: bool = True) -> str:
    """By focus: m = sum w x x', b = sum w^2 x x' and v = sum w x y of the pairs in ``w``."""
    k = range(len(xs))
    cols = [f"sum(w*({xs[i]})*({xs[j]})) AS m{i}_{j}" for i in k for j in k] + [f"sum(w*({xs[i]})*({y})) AS v{i}" for i in k]
    cols += [f"sum(w*w*({xs[i]})*({xs[j]})) AS b{i}_{j}" for i in k for j in k] if squares else []
    return f"{name} AS MATERIALIZED (SELECT fid, {', '.join(cols)} FROM {w} GROUP BY fid)"


def betas(k: int) -> list[str]:
    return [added(f"a{i}_{k + j}*v{j}" for j in range(k)) + f" AS beta{i}" for i in range(k)]


def fit(w: str, xs: list[str], y: str, name: str, points: str = "p") -> list[str]:
    """Table ``name`` by data point: beta, yhat, res, raw variances, s_ii, ss, leave-one-out residual; xs and y are expressions in a data row's columns."""
    k = len(xs)
    n = range(k)
    g = [added(f"a{i}_{k + j}*x{j}" for j in n) + f" AS g{i}" for i in n]
    raw = [added(f"a{i}_{k + p}*b{p}_{q}*a{q}_{k + i}" for p in n for q in n) + f" AS raw{i}" for i in n]
    own = ", ".join(f"CAST({x} AS DOUBLE) AS x{i}" for i, x in enumerate(xs))
    return [
        moments(w, xs, y, f"{name}_m"),
        *inverse(f"{name}_m", k, f"{name}_i"),
        f"{name}_p AS MATERIALIZED (SELECT fid AS own_fid, CAST({y} AS DOUBLE) AS yy, {own} FROM {points})",
        f"{name}_o AS MATERIALIZED (SELECT fid AS w_fid, max(w) AS w_own FROM {w} WHERE fid = d_fid GROUP BY fid)",
        f"{name}_g AS MATERIALIZED (SELECT *, {', '.join(betas(k) + g + raw)} FROM {name}_i JOIN {name}_p ON fid = own_fid JOIN {name}_o ON fid = w_fid)",
        f"{name}_h AS MATERIALIZED (SELECT *, {added(f'beta{i}*x{i}' for i in n)} AS yhat, w_own*{added(f'x{i}*g{i}' for i in n)} AS s_ii, {added(f'g{p}*b{p}_{q}*g{q}' for p in n for q in n)} AS ss FROM {name}_g)",
        f"{name} AS MATERIALIZED (SELECT *, yy - yhat AS res, (yy - yhat)/(1 - s_ii) AS cv FROM {name}_h)",
    ]


def full(w: str, xs: list[str], y: str, name: str, names: list[str]) -> list[str]:
    """Table ``name`` with the columns of a regression's result."""
    k = range(len(xs))
    s = added(f"g{i}*({x})" for i, x in enumerate(xs))
    return [
        *fit(w, xs, y, f"{name}_f"),
        f"{name}_d AS MATERIALIZED (SELECT sum(res*res)/(count(*)-2*sum(s_ii)+sum(ss)) AS sigma2, avg(yy) AS ybar FROM {name}_f)",
        f"{name}_q AS MATERIALIZED (SELECT d_fid AS q_fid, sum(pow(CASE WHEN fid=d_fid THEN 1.0 ELSE 0.0 END - w*{s}, 2)) AS q FROM {w} JOIN {name}_f USING (fid) GROUP BY d_fid)",
        f"{name}_r AS MATERIALIZED (SELECT e.fid AS r_fid, (sum(w*pow(f.yy-ybar,2)) - sum(w*pow(f.res,2)))/sum(w*pow(f.yy-ybar,2)) AS r2 FROM {w} e JOIN {name}_f f ON f.fid = e.d_fid CROSS JOIN {name}_d GROUP BY e.fid)",
        f"{name} AS MATERIALIZED (SELECT fid, {', '.join(f'beta{i} AS \"{names[i]}\"' for i in k)}, yy AS y, yhat, res AS residual, res/sqrt(sigma2*q) AS \"Stud_residual\", {', '.join(f'sqrt(sigma2*raw{i}) AS \"{names[i]}_SE\", beta{i}/sqrt(sigma2*raw{i}) AS \"{names[i]}_TV\"' for i in k)}, r2 AS \"localR2\" FROM {name}_f CROSS JOIN {name}_d JOIN {name}_q ON fid = q_fid JOIN {name}_r ON fid = r_fid)",
    ]


def rounded(source: str, digits: dict[str, int]) -> str:
    return "SELECT fid, " + ", ".join(f'round("{c}",{d}) AS "{c}"' for c, d in digits.items()) + f" FROM {source}"


def robust(w: str, xs: list[str], y: str, points: str, most: int = 21, tol: float = 1e-5) -> list[str]:
    """Table ``rw``: the pairs with the weights that the last iterated fit used."""
    k = len(xs)
    hat = added(f"beta{i}*({x})" for i, x in enumerate(xs))
    out = [f"k0 AS MATERIALIZED (SELECT fid AS k_fid, 1.0::DOUBLE AS mask, NULL::DOUBLE AS mse, false AS done FROM {points})"]
    for t in range(most):
        out += [
            f"u{t} AS MATERIALIZED (SELECT e.* REPLACE (e.w*mask AS w) FROM {w} e JOIN k{t} ON e.d_fid = k_fid)",
            moments(f"u{t}", xs, y, f"m{t}", False),
            *inverse(f"m{t}", k, f"i{t}"),
            f"r{t} AS MATERIALIZED (SELECT {points}.fid AS r_fid, ({y}) - {hat} AS res FROM {points} JOIN (SELECT fid AS b_fid, {', '.join(betas(k))} FROM i{t}) ON fid = b_fid)",
            f"e{t} AS MATERIALIZED (SELECT avg(res*res) AS now FROM r{t})",
            f"k{t + 1} AS MATERIALIZED (SELECT k_fid, CASE WHEN done OR stop THEN mask WHEN z <= 2 THEN 1.0 WHEN z < 3 THEN pow(1-pow(z-2,2),2) ELSE 0.0 END AS mask, CASE WHEN done THEN mse ELSE now END AS mse, done OR stop AS done FROM (SELECT k{t}.*, now, abs(res)/sqrt(now) AS z, coalesce(abs(mse-now)/now <= {tol!r}, false) AS stop FROM k{t} JOIN r{t} ON k_fid = r_fid CROSS JOIN e{t}))",
        ]
    # the last fit used the weights that stopped it, or those before the last update
    return [*out, f"rw AS MATERIALIZED (SELECT e.* REPLACE (e.w*mask AS w) FROM {w} e JOIN (SELECT k{most}.k_fid, CASE WHEN k{most}.done THEN k{most}.mask ELSE b.mask END AS mask FROM k{most} JOIN k{most - 1} b ON b.k_fid = k{most}.k_fid) ON e.d_fid = k_fid)"]


def family_sql(family: str) -> dict[str, str]:
    """Start values, means, working weights, working responses and log-likelihood, in ``yy``, ``mu`` and ``nu``."""
    if family == "poisson":
        return {"mu0": "yy+0.1", "nu0": "ln(yy+0.1)", "mu": "exp(nu)", "v": "mu", "z": "nu+(yy-mu)/mu", "ll": "yy*ln(mu)-mu-lgamma(yy+1)"}
    return {"mu0": "0.5", "nu0": "0.0", "mu": "1/(1+exp(-nu))", "v": "mu*(1-mu)", "z": "nu+(yy-mu)/(mu*(1-mu))", "ll": "yy*ln(mu)+(1-yy)*ln(1-mu)"}


def generalized(w: str | None, xs: list[str], y: str, points: str, family: str, most: int, tol: float, slack: float = 0.0) -> list[str]:
    """Table ``gl`` by data point: beta, mean and response after the iterations; ``w`` None: one global fit, whose first step has the working weights too."""
    k, f = len(xs), family_sql(family)
    hat = added(f"beta{i}*({x})" for i, x in enumerate(xs))
    first = "1.0" if w else f["v"]
    none = ", ".join(f"NULL::DOUBLE AS beta{i}" for i in range(k))
    start = f"SELECT *, CAST({f['mu0']} AS DOUBLE) AS mu, CAST({f['nu0']} AS DOUBLE) AS nu FROM (SELECT *, CAST({y} AS DOUBLE) AS yy FROM {points})"
    out = [f"s0 AS MATERIALIZED (SELECT *, {first} AS wk, NULL::DOUBLE AS ll, false AS done, {none} FROM ({start}))"]
    for t in range(most):
        pairs = f"SELECT e.fid, e.w*wk AS w, {f['z']} AS zz, {', '.join(f'CAST({x} AS DOUBLE) AS q{i}' for i, x in enumerate(xs))} FROM (SELECT fid, d_fid, w FROM {w}) e JOIN (SELECT * RENAME (fid AS s_fid) FROM s{t}) ON d_fid = s_fid" if w else f"SELECT 0 AS fid, wk AS w, {f['z']} AS zz, {', '.join(f'CAST({x} AS DOUBLE) AS q{i}' for i, x in enumerate(xs))} FROM s{t}"
        on = "ON fid = b_fid" if w else "ON b_fid = 0"
        out += [
            f"u{t} AS MATERIALIZED ({pairs})",
            moments(f"u{t}", [f"q{i}" for i in range(k)], "zz", f"m{t}", False),
            *inverse(f"m{t}", k, f"i{t}"),
            f"n{t} AS MATERIALIZED (SELECT * REPLACE ({hat} AS nu) FROM (SELECT s{t}.* EXCLUDE ({', '.join(f'beta{i}' for i in range(k))}), fresh.* FROM s{t} JOIN (SELECT fid AS b_fid, {', '.join(betas(k))} FROM i{t}) fresh {on}))",
            f"c{t} AS MATERIALIZED (SELECT * REPLACE ({f['mu']} AS mu) FROM n{t})",
            f"l{t} AS MATERIALIZED (SELECT sum({f['ll']}) AS now FROM c{t})",
            f"s{t + 1} AS MATERIALIZED (SELECT c{t}.* EXCLUDE (b_fid, wk, ll, done) REPLACE ({', '.join(f'CASE WHEN o.done THEN o.beta{i} ELSE c{t}.beta{i} END AS beta{i}' for i in range(k))}, CASE WHEN o.done THEN o.nu ELSE c{t}.nu END AS nu, CASE WHEN o.done THEN o.mu ELSE c{t}.mu END AS mu), {f['v'].replace('mu', f'c{t}.mu')} AS wk, CASE WHEN o.done THEN o.ll ELSE now END AS ll, o.done OR coalesce(abs((o.ll-now)/(abs(now)+{slack!r})) < {tol!r}, false) AS done FROM c{t} JOIN s{t} o ON o.fid = c{t}.fid CROSS JOIN l{t})",
        ]
    return [*out, f"gl AS MATERIALIZED (SELECT * FROM s{most})"]


def eigen3(source: str, name: str) -> list[str]:
    """Table ``name``: the rows of ``source`` with the eigenvalues e1 >= e2 >= e3 of their symmetric matrix m{i}_{j}, by the trigonometric formula."""
    return [
        f"{name}_q AS MATERIALIZED (SELECT *, (m0_0+m1_1+m2_2)/3 AS eq FROM {source})",
        f"{name}_p AS MATERIALIZED (SELECT *, sqrt((pow(m0_0-eq,2)+pow(m1_1-eq,2)+pow(m2_2-eq,2)+2*(m0_1*m0_1+m0_2*m0_2+m1_2*m1_2))/6) AS ep FROM {name}_q)",
        f"{name}_r AS MATERIALIZED (SELECT *, greatest(-1.0, least(1.0, ((m0_0-eq)*((m1_1-eq)*(m2_2-eq)-m1_2*m1_2)-m0_1*(m0_1*(m2_2-eq)-m1_2*m0_2)+m0_2*(m0_1*m1_2-(m1_1-eq)*m0_2))/(2*ep*ep*ep))) AS er FROM {name}_p)",
        f"{name}_a AS MATERIALIZED (SELECT *, eq+2*ep*cos(acos(er)/3) AS e1, m0_0*m1_1-m0_1*m0_1+m0_0*m2_2-m0_2*m0_2+m1_1*m2_2-m1_2*m1_2 AS minors, m0_0*(m1_1*m2_2-m1_2*m1_2)-m0_1*(m0_1*m2_2-m1_2*m0_2)+m0_2*(m0_1*m1_2-m1_1*m0_2) AS det FROM {name}_r)",
        # the two smaller ones by their product and sum, which lose no digits beside a large first one
        f"{name}_b AS MATERIALIZED (SELECT *, det/e1 AS product, (minors-det/e1)/e1 AS total FROM {name}_a)",
        f"{name}_c AS MATERIALIZED (SELECT *, (total+sqrt(greatest(total*total-4*product,0)))/2 AS e2 FROM {name}_b)",
        f"{name} AS MATERIALIZED (SELECT *, product/e2 AS e3 FROM {name}_c)",
    ]


def golden(points: str, xs: list[str], y: str, low: int, high: str) -> str:
    """The probes of a golden-section search over whole bisquare bandwidths with their CV scores: all scores are made, then the search is walked through by recursion."""
    share = (5**0.5 - 1) / 2
    ctes = [
        f"p0 AS MATERIALIZED ({points})",
        f"lim AS MATERIALIZED (SELECT {low}::DOUBLE AS lo, CAST({high} AS DOUBLE) AS hi FROM p0)",
        "sizes AS MATERIALIZED (SELECT unnest(generate_series(CAST(lo AS BIGINT), CAST(hi AS BIGINT))) AS bw FROM lim)",
        "p AS MATERIALIZED (SELECT p0.* REPLACE (bw*1000000+fid AS fid) FROM p0 CROSS JOIN sizes)",
        "pq AS MATERIALIZED (SELECT f.fid AS ffid, d.fid AS dfid, sqrt((f.x-d.x)*(f.x-d.x)+(f.y-d.y)*(f.y-d.y)) AS d FROM p0 f CROSS JOIN p0 d)",
        "rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ffid ORDER BY d, dfid) AS rk FROM pq)",
        "reach AS MATERIALIZED (SELECT ffid, rk AS bw, d AS b FROM rk)",
        "w AS MATERIALIZED (SELECT reach.bw*1000000+pq.ffid AS fid, reach.bw*1000000+pq.dfid AS d_fid, CASE WHEN pq.d > reach.b THEN 0.0 ELSE (1.0-(pq.d/reach.b)*(pq.d/reach.b))*(1.0-(pq.d/reach.b)*(pq.d/reach.b)) END AS w, p0.* EXCLUDE (fid) FROM pq JOIN reach ON pq.ffid = reach.ffid JOIN sizes ON sizes.bw = reach.bw JOIN p0 ON p0.fid = pq.dfid)",
        *fit("w", xs, y, "o"),
        "z AS MATERIALIZED (SELECT CAST(fid//1000000 AS DOUBLE) AS bandwidth, sum(cv*cv) AS score FROM o GROUP BY fid//1000000)",
        f"RECURSIVE_WALK(step, low, high, reach, u, l) AS (SELECT 0, lo, hi, {share!r}::DOUBLE*(hi-lo), floor(lo+{share!r}::DOUBLE*(hi-lo)), round(hi-{share!r}::DOUBLE*(hi-lo)) FROM lim UNION ALL SELECT step+1, CASE WHEN a.score < b.score THEN l ELSE low END, CASE WHEN a.score < b.score THEN high ELSE u END, reach*{share!r}::DOUBLE, CASE WHEN a.score < b.score THEN round(l+reach*{share!r}::DOUBLE) ELSE l END, CASE WHEN a.score < b.score THEN u ELSE floor(u-reach*{share!r}::DOUBLE) END FROM RECURSIVE_WALK JOIN z a ON a.bandwidth = u JOIN z b ON b.bandwidth = l WHERE step < 100 AND reach > 1e-4 AND abs(a.score-b.score) > 1e-4)",
    ]
    text = ", ".join(ctes).replace("RECURSIVE_WALK", "walk")
    return f"WITH RECURSIVE {text} SELECT bandwidth, round(score/1000,3) AS score FROM z WHERE bandwidth IN (SELECT u FROM walk UNION SELECT l FROM walk)"
