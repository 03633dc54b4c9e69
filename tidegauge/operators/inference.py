"""Design-weighted, additive and random-intercept logistic fits, and relative importance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.codes import APPENDIX_INTERACTIONS, APPENDIX_MAIN
from tidegauge.functions.hashing import hex_slice
from tidegauge.operators.cells import WEIGHT
from tidegauge.operators.learners import assemble
from tidegauge.operators.prep import Scaler
from tidegauge.operators.ranking import auc, quantiles
from tidegauge.session import cut_lineage, local_rows, small_table

Z95 = 1.959963984540054
APPENDIX_TERMS = APPENDIX_MAIN + tuple(f"{a}_x_{b}" for a, b in APPENDIX_INTERACTIONS)


def appendix_terms(df: DataFrame) -> DataFrame:
    """Add the two interaction columns."""
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in APPENDIX_INTERACTIONS})


# ---- design-weighted logistic -------------------------------------------------------------

def design_logistic(
    df: DataFrame, features: Sequence[str], label: str, strata: str, cluster: str, weight: str
) -> DataFrame:
    """(term, coefficient, se, z): weighted fit with the linearised between-cluster variance.

    Score residuals are summed per (stratum, cluster) on the map side; only those sums and
    the information matrix, both sized by the number of terms, leave the executors.
    """
    spark = df.sparkSession
    rows = df.na.drop(subset=[*features, label, strata, cluster, weight])
    x = assemble(rows, features)
    m = LogisticRegression(labelCol=label, weightCol=weight, maxIter=100, tol=1e-10).fit(x)
    names = ["intercept", *features]
    beta = [float(m.intercept), *map(float, m.coefficients)]
    cols = [F.lit(1.0), *[F.col(f) for f in features]]
    eta = sum((F.lit(b) * c for b, c in zip(beta, cols)), F.lit(0.0))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
    rows = rows.withColumn("_p", p)
    resid = F.col(weight) * (F.col(label) - F.col("_p"))
    per_cluster = rows.groupBy(strata, cluster).agg(*[F.sum(resid * c).alias(f"u{i}") for i, c in enumerate(cols)])
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    n_c = F.count("*")
    # within a stratum: n/(n-1) * sum of centred cross products; single clusters add nothing
    meat = per_cluster.groupBy(strata).agg(
        *[
            F.when(n_c > 1, n_c * F.covar_samp(f"u{i}", f"u{j}")).otherwise(0.0).alias(f"v{i}_{j}")
            for i, j in pairs
        ]
    ).agg(*[F.sum(f"v{i}_{j}").alias(f"v{i}_{j}") for i, j in pairs])
    info_w = F.col(weight) * F.col("_p") * (1 - F.col("_p"))
    bread = rows.agg(*[F.sum(info_w * cols[i] * cols[j]).alias(f"h{i}_{j}") for i, j in pairs])
    v, h = meat.first(), bread.first()
    big_v, big_h = np.zeros((k, k)), np.zeros((k, k))
    for i, j in pairs:
        big_v[i, j] = big_v[j, i] = v[f"v{i}_{j}"]
        big_h[i, j] = big_h[j, i] = h[f"h{i}_{j}"]
    inv = np.linalg.inv(big_h)
    se = np.sqrt(np.diag(inv @ big_v @ inv))
    out = [(n, float(b), float(s), float(b / s)) for n, b, s in zip(names, beta, se)]
    return local_rows(spark, out, "term string, coefficient double, se double, z double")


# ---- random intercept by wave -------------------------------------------------------------

SIGMA_FLOOR = 1e-4  # groups that do not differ end here
TERMS = "term string, coefficient double, se double, lo double, hi double"


@dataclass
class GroupBlocks:
    """Gradient and information of each group at one point, and the penalised solution they give.

    A group's intercept shares its column with the common one, so its part of the system is one
    number and one vector and is eliminated first; what is left has the size of the terms.
    """

    grad: np.ndarray  # group, term
    info: np.ndarray  # group, term, term
    ridge: np.ndarray  # of the terms
    beta: np.ndarray
    u: np.ndarray

    def solve(self, sigma: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms and group intercepts after a Newton step at ``sigma``, their covariance and variances."""
        cross, own = self.info[:, :, 0], self.info[:, 0, 0] + sigma**-2
        schur = self.info.sum(0) + np.diag(self.ridge) - (cross / own[:, None]).T @ cross
        g_beta, g_u = self.grad.sum(0) - self.ridge * self.beta, self.grad[:, 0] - self.u * sigma**-2
        cov = np.linalg.pinv(schur)
        step = cov @ (g_beta - cross.T @ (g_u / own))
        var = 1 / own + np.einsum("gi,ij,gj->g", cross, cov, cross) / own**2
        return self.beta + step, self.u + (g_u - cross @ step) / own, cov, var

    def spread(self) -> float:
        """The largest sigma whose square is the mean of squared intercepts plus their variances;
        ``SIGMA_FLOOR`` if every sigma is too large."""

        def excess(sigma: float) -> float:
            _, u, _, var = self.solve(sigma)
            return float(np.mean(u * u + var)) / sigma**2 - 1

        grid = np.geomspace(SIGMA_FLOOR, 100.0, 61)
        above = [i for i, s in enumerate(grid) if excess(s) > 0]
        if not above or above[-1] == len(grid) - 1:
            return float(grid[above[-1]]) if above else SIGMA_FLOOR
        lo, hi = grid[above[-1]], grid[above[-1] + 1]
        for _ in range(60):
            mid = float(np.sqrt(lo * hi))
            lo, hi = (mid, hi) if excess(mid) > 0 else (lo, mid)
        return float(np.sqrt(lo * hi))


def random_intercept(
    cells: DataFrame, features: Sequence[str], group: str = "wave", sigma: float | None = None,
    prior_sd: float = 10.0, weight: str = WEIGHT, min_rows: int = 1000, rounds: int = 50, tol: float = 1e-8,
) -> DataFrame | None:
    """(term, coefficient, se, lo, hi) of a logistic model with normal group intercepts, by
    Laplace's approximation; None below ``min_rows``.

    Coefficients are those of scaled columns under a wide normal prior, group intercepts
    (``<group>_<value>``) have standard deviation ``sigma``, which is estimated unless it is given
    and reported as the term ``sigma``. A step is one aggregation of gradient and information per
    group; sigma settles on these blocks between steps. Limits are 95 %, those of sigma on the log
    scale; a sigma at ``SIGMA_FLOOR`` (groups do not differ) has none. The number of groups is that of waves: blocks of all groups are held on the driver.
    """
    rows = cells.na.drop(subset=[*features, "y", group])
    n = rows.agg(F.sum(weight)).first()[0] or 0
    if n < min_rows:
        return None
    scaler = Scaler.fit(rows, features, weight)
    names = ["intercept", *features]
    k = len(names)
    z = [F.lit(1.0), *[F.col(f"_z{j}") for j in range(1, k)]]
    rows = cut_lineage(rows.select(
        group, F.col("y").cast("double").alias("_y"), F.col(weight).cast("double").alias("_w"),
        *[scaler.column(f).alias(f"_z{j}") for j, f in enumerate(features, 1)],
    ))
    groups = [r[0] for r in rows.select(group).distinct().orderBy(group).collect()]  # one row per group
    ridge = np.array([0.0, *[prior_sd**-2] * len(features)])
    beta, u, now = np.zeros(k), np.zeros(len(groups)), sigma or 1.0
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    for _ in range(rounds):
        own = F.create_map(*[x for g, v in zip(groups, u) for x in (F.lit(g), F.lit(float(v)))])[F.col(group)]
        eta = sum((F.lit(float(b)) * c for b, c in zip(beta, z)), own)
        staged = rows.withColumn("_q", 1 / (1 + F.exp(-eta)))
        r, h = F.col("_w") * (F.col("_y") - F.col("_q")), F.col("_w") * F.col("_q") * (1 - F.col("_q"))
        sums = [F.sum(r * z[i]).alias(f"g{i}") for i in range(k)] + [F.sum(h * z[i] * z[j]).alias(f"h{i}_{j}") for i, j in upper]
        got = {s[group]: s for s in staged.groupBy(group).agg(*sums).collect()}  # one row per group
        grad = np.array([[got[g][f"g{i}"] for i in range(k)] for g in groups])
        info = np.array([[[got[g][f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)] for g in groups])
        blocks = GroupBlocks(grad, info, ridge, beta, u)
        before = now
        now = sigma or blocks.spread()
        new_beta, new_u, cov, var = blocks.solve(now)
        moved = max(np.abs(new_beta - beta).max(), np.abs(new_u - u).max(), abs(now - before))
        beta, u = new_beta, new_u
        if moved < tol:
            break
    se = [*np.sqrt(np.diag(cov)), *np.sqrt(var)]
    table = [
        (t, float(b), float(s), float(b - Z95 * s), float(b + Z95 * s))
        for t, b, s in zip([*names, *[f"{group}_{g}" for g in groups]], [*beta, *u], se)
    ]
    if sigma is None:
        if now > SIGMA_FLOOR:
            known = np.sum((1 - var / now**2) ** 2)  # groups' worth of information on the variance
            s = float(now / np.sqrt(2 * known))
            table.append(("sigma", now, s, float(now * np.exp(-Z95 * s / now)), float(now * np.exp(Z95 * s / now))))
        else:  # no spread: the curvature there says nothing
            table.append(("sigma", now, None, None, None))
    return local_rows(cells.sparkSession, table, TERMS)


# ---- additive spline logistic ---------------------------------------------------------------

def spline_basis(
    df: DataFrame, column: str, knots: Sequence[float], name: str
) -> tuple[DataFrame, list[str]]:
    """Linear term and truncated cubic terms, each scaled to the knot range."""
    span = (max(knots) - min(knots)) or 1.0
    base = (F.col(column) - F.lit(float(min(knots)))) / F.lit(span)
    cols = {f"{name}_1": base}
    for i, k in enumerate(knots):
        t = F.greatest((F.col(column) - F.lit(float(k))) / F.lit(span), F.lit(0.0))
        cols[f"{name}_k{i}"] = t * t * t
    return df.withColumns(cols), list(cols)


def additive_logistic(
    cells: DataFrame, smooth: Sequence[str], linear: Sequence[str],
    tensors: Sequence[tuple[str, str]], knots: int = 4, reg: float = 1e-4, weight: str = WEIGHT,
    rounds: int = 100,
) -> DataFrame:
    """(term, coefficient) of a ridge logistic on spline columns and tensor products."""
    needed = sorted({*smooth, *linear, *[c for pair in tensors for c in pair]})
    rows = cells.na.drop(subset=[*needed, "y"])
    probs = [(i + 1) / (knots + 1) for i in range(knots)]
    long = rows.select(weight, *smooth).unpivot([weight], list(smooth), "column", "value")
    q: dict[str, list[float]] = {c: [] for c in smooth}
    for r in quantiles(long, "value", probs, ["column"], weight).collect():  # knots x columns rows
        q[r["column"]].append(r["value"])
    basis: dict[str, list[str]] = {c: [c] for c in linear}
    for c in smooth:
        rows, basis[c] = spline_basis(rows, c, sorted(set(q[c])), f"s_{c}")
    terms = [x for c in (*smooth, *linear) for x in basis[c]]
    for a, b in tensors:
        products = {f"t_{x}_{y}": F.col(x) * F.col(y) for x in basis[a] for y in basis[b]}
        rows = rows.withColumns(products)
        terms += list(products)
    x = assemble(rows, terms).select(
        "features", F.col("y").cast("double").alias("label"), F.col(weight).cast("double").alias("_w")
    )
    m = LogisticRegression(weightCol="_w", regParam=reg, maxIter=rounds, tol=1e-8).fit(x)
    table = [("intercept", float(m.intercept)), *zip(terms, map(float, m.coefficients))]
    return local_rows(cells.sparkSession, table, "term string, coefficient double")


# ---- relative importance --------------------------------------------------------------------

def moments(df: DataFrame, columns: Sequence[str], weight: str = WEIGHT) -> DataFrame:
    """Weighted covariance of all column pairs (a, b, cov) over complete rows, in two passes."""
    columns = list(columns)
    rows = df.na.drop(subset=columns)
    w = F.col(weight).cast("double")
    means = rows.agg(F.sum(w).alias("n"), *[(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in columns]).first()
    centred = {c: F.col(c) - F.lit(means[c]) for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = rows.agg(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("a"), F.lit(b).alias("b"),
                    (F.sum(w * centred[a] * centred[b]) / F.sum(w)).alias("cov"),
                )
                for a, b in pairs
            ]
        ).alias("m")
    )
    return wide.select(F.explode("m").alias("e")).select("e.*")


def subset_r2(cov: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """(mask, size, r2) of the linear fit on every subset of the features.

    The covariance matrix is (p+1) squared numbers; the 2^p subsets are rows spread over the
    cluster, each solved from that matrix.
    """
    features = list(features)
    at = {c: i for i, c in enumerate([*features, target])}
    g = np.zeros((len(at), len(at)))
    for r in cov.collect():
        g[at[r["a"]], at[r["b"]]] = g[at[r["b"]], at[r["a"]]] = r["cov"]
    p = len(features)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for mask in batch["id"]:
                idx = [i for i in range(p) if mask >> i & 1]
                r2 = 0.0
                if idx:
                    c = g[idx, p]
                    r2 = float(c @ np.linalg.lstsq(g[np.ix_(idx, idx)], c, rcond=None)[0] / g[p, p])
                out.append((int(mask), len(idx), r2))
            yield pd.DataFrame(out, columns=["mask", "size", "r2"])

    return cov.sparkSession.range(1 << p).mapInPandas(solve, "mask bigint, size int, r2 double")


def dominance(subsets: DataFrame, features: Sequence[str]) -> DataFrame:
    """(term, incremental_r2): gain of a feature averaged within, then over, subset sizes."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(i).alias("bit"), F.lit(f).alias("term")) for i, f in enumerate(features)])
    ).alias("f")
    power = F.expr("shiftleft(cast(1 as bigint), f.bit)")
    without = subsets.select("mask", "size", "r2", pairs).withColumn("_b", power).filter(
        F.col("mask").bitwiseAND(F.col("_b")) == 0
    )
    bigger = subsets.select(F.col("mask").alias("_m"), F.col("r2").alias("_r2"))
    gain = without.withColumn("_m", F.col("mask").bitwiseOR(F.col("_b"))).join(bigger, "_m")
    by_size = gain.groupBy("f.term", "size").agg(F.avg(F.col("_r2") - F.col("r2")).alias("g"))
    return by_size.groupBy("term").agg(F.avg("g").alias("incremental_r2"))


# ---- feature attribution ----------------------------------------------------------------------

def linear_contributions(
    cells: DataFrame, terms: Sequence[tuple[str, float]], scaler: Scaler, weight: str = WEIGHT
) -> DataFrame:
    """(feature, mean_abs): mean |coefficient * (x - mean)| of a logistic fit on scaled columns."""
    w = F.col(weight)
    wide = cells.agg(
        *[
            (F.sum(w * F.abs(F.lit(b) * scaler.column(f))) / F.sum(w)).alias(f)
            for f, b in terms
        ]
    )
    return wide.unpivot([], [f for f, _ in terms], "feature", "mean_abs")


SLOTS = 256  # slots of [0, 1) by which draws meet the steps of a value table


def permutation_importance(
    rows: DataFrame, features: Sequence[str], score, row_id: str = "row_id", seed: int = 42
) -> DataFrame:
    """(feature, auc, drop): AUC after a feature's values are redrawn from its own distribution.

    A row's new value is picked by its hash from the feature's value table, which keeps the
    marginal distribution without a shuffle of rows. Value tables and the AUC of the given values come
    from cells; draws meet their steps by an equi-join on the feature and the draw's slot of [0, 1).
    All features share one exploded pass, reduced to cells before ``score`` (frame -> frame with
    score) runs.
    """
    features = list(features)
    given = small_table(rows.groupBy("y", *features).agg(F.count("*").alias(WEIGHT)))
    long = F.explode(
        F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("level")) for f in features])
    ).alias("p")
    counts = given.select(long, WEIGHT).groupBy("p.feature", "p.level").agg(F.sum(WEIGHT).alias("n"))
    whole = Window.partitionBy("feature")
    ordered = whole.orderBy(F.asc_nulls_first("level"))
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = counts.withColumn("_hi", F.sum("n").over(running) / F.sum("n").over(whole))
    steps = steps.withColumn("_lo", F.coalesce(F.lag("_hi").over(ordered), F.lit(0.0)))
    slot = lambda u: F.floor(u * SLOTS).cast("int")
    slots = F.sequence(slot(F.col("_lo")), F.least(slot(F.col("_hi")), F.lit(SLOTS - 1)))
    table = small_table(steps.select("feature", F.col("level").alias("_level"), "_lo", "_hi", F.explode(slots).alias("_slot")))
    which = F.explode(F.array(*[F.lit(f) for f in features]))
    tagged = rows.select(row_id, "y", *features, which.alias("feature"))
    u = hex_slice(
        F.md5(F.concat(F.lit(f"{seed}:"), F.col("feature"), F.lit(":"), F.col(row_id).cast("string"))), 1, 8
    ) / F.lit(4294967296.0)
    drawn = tagged.withColumn("_u", u).withColumn("_slot", slot(F.col("_u")))
    drawn = drawn.join(table, ["feature", "_slot"]).filter((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    mixed = drawn.select(
        "feature", "y",
        *[F.when(F.col("feature") == f, F.col("_level")).otherwise(F.col(f)).alias(f) for f in features],
    )
    cells = mixed.groupBy("feature", "y", *features).agg(F.count("*").alias(WEIGHT))
    cells = cells.unionByName(given.withColumn("feature", F.lit("none")))
    result = auc(score(cells), "score", "y", ["feature"], WEIGHT).select("feature", "auc")
    everything = Window.partitionBy(F.lit(0))  # one row per feature
    base = F.max(F.when(F.col("feature") == "none", F.col("auc"))).over(everything)
    return result.select("feature", "auc", (base - F.col("auc")).alias("drop"))
