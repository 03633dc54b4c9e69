"""Fitted models, on whole waves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions.codes import BASIC5, FULL9
from tidegauge.operators import attribution, boosting, bootstrap, calibrate, inference, learners, nets, penalised, sampling, stats
from tidegauge.operators.cells import WEIGHT, compress
from tidegauge.plans import grid as grid_plan
from tidegauge.plans import rolling, single_wave, transport
from tidegauge.registry.base import query
from tidegauge.registry.inputs import CTES, ERA_CUT, FOCUS
from tidegauge.registry.scoring import auc_sql
from tidegauge.registry.studies import GRID, TESTS, card_sql, scored_sql
from tidegauge.session import cut_lineage, local_rows

ROUNDS, NET_ROUNDS = 150, 500


def trees(cells, features):
    return boosting.fit_one(cells, features, rounds=ROUNDS)


def logistic(cells, features):
    return learners.fit_logistic(cells, features)


# ---- within wave --------------------------------------------------------------------------------

CTES["split_basic"] = "select row_id, wave, cast(y as integer) as y, is_test, " + ", ".join(BASIC5) + " from splitted"
CTES["split_long"] = " union all ".join(
    f"select wave, y, '{f}' as feature, {f} as level from split_basic where not is_test" for f in BASIC5
)
CTES["split_cards"] = card_sql("split_long", "wave")
CTES["split_scores"] = scored_sql("split_basic b", "split_cards", "{c}.wave = b.wave", "b.wave, b.is_test")
CTES["split_counts"] = "select wave, is_test, s, cast(sum(y) as double) as p, cast(sum(1-y) as double) as n from split_scores group by all"
CTES["split_thr"] = """select wave, thr from (select wave, s as thr, row_number() over (partition by wave order by 2*tp/(tp+fp+tot) desc, s) as rn from
  (select wave, s, sum(p) over (partition by wave order by s desc rows between unbounded preceding and current row) as tp,
     sum(n) over (partition by wave order by s desc rows between unbounded preceding and current row) as fp, sum(p) over (partition by wave) as tot
   from split_counts where not is_test) as r) as k where rn = 1"""


@query("within_wave_scorecard", "wave:int auc:double sensitivity:double specificity:double n_positive:long n_total:long",
       "with c as (select wave, s, p, n from split_counts where is_test), a as (" + auc_sql("c", "wave") + """)
       select a.wave, a.auc, a.n_positive, a.n_total, r.sensitivity, r.specificity from a join
       (select c.wave, sum(case when s >= thr then p else 0 end)/sum(p) as sensitivity, sum(case when s < thr then n else 0 end)/sum(n) as specificity
        from c join split_thr h on c.wave = h.wave group by c.wave) as r on a.wave = r.wave""")
def _(t):
    return single_wave.within_wave_scorecard(t.clean, BASIC5)


@query("within_wave_calibrated_trees", "feature_set:string wave:int auc:double sensitivity:double specificity:double n_positive:long n_total:long threshold:double cv_mean:double cv_sd:double")
def _(t):
    """The basic features in every wave, all features in the focus wave."""
    basic = single_wave.within_waves(t.clean, BASIC5, rounds=ROUNDS).withColumn("feature_set", F.lit("BASIC5"))
    return basic.unionByName(single_wave.within_waves(t.clean, FULL9, [FOCUS], ROUNDS).withColumn("feature_set", F.lit("FULL9")))


# ---- grids and transport with other learners -------------------------------------------------------

def _logistic_grid_sql() -> str:
    """Coordinate-wise Newton steps in recursive SQL, then the grid of the scorecard over its scores."""
    k = len(BASIC5)
    med = ", ".join(f"quantile_cont({f}, 0.5) as m{j}" for j, f in enumerate(BASIC5, 1))
    fill = ", ".join(f"coalesce({f}, m{j}) as f{j}" for j, f in enumerate(BASIC5, 1))
    moments = ", ".join(f"avg(f{j}) as a{j}, case when stddev_pop(f{j}) < 1e-12 then 1 else stddev_pop(f{j}) end as d{j}" for j in range(1, k + 1))
    z = ", ".join(f"(f{j} - a{j})/d{j} as z{j}" for j in range(1, k + 1))
    eta = "b0 + " + " + ".join(f"b{j}*z{j}" for j in range(1, k + 1))
    betas = ", ".join(f"b{j}" for j in range(k + 1))
    zs = ["1.0e0", *[f"z{j}" for j in range(1, k + 1)]]
    moves = ", ".join(
        f"b{j} + case when k % {k + 1} = {j} then sum(w*(y - q)*{zs[j]})/sum(w*q*(1 - q)*{zs[j]}*{zs[j]}) else 0 end as b{j}" for j in range(k + 1)
    )
    cross = ", ".join(f"(coalesce(b.{f}, p.m{j}) - p.a{j})/p.d{j} as z{j}" for j, f in enumerate(BASIC5, 1))
    table = CTES["grid_table"]
    for name in ("grid_auc", "grid_counts", "grid_thr"):
        table = table.replace(name, "l" + name)
    thr = CTES["grid_thr"].replace("grid_counts", "lgrid_counts")
    return f"""with recursive lmed as (select wave, {med} from analytic group by wave),
    lfill as (select a.wave, cast(y as double) as y, {fill} from analytic a join lmed m on m.wave = a.wave),
    lmom as (select f.wave, {moments} from lfill f group by f.wave),
    lprep as (select * from lmed join lmom using (wave)),
    lz as (select f.wave, y, cast(count(*) as double) as w, {z} from lfill f join lmom m on m.wave = f.wave group by all),
    lit as (select wave, 0 as k, {", ".join(f"0.0e0 as b{j}" for j in range(k + 1))} from (select distinct wave from lz) as s
      union all
      select wave, k + 1 as k, {moves} from (select i.wave, i.k, {betas}, y, w, {", ".join(zs[1:])}, 1/(1 + exp(-({eta}))) as q from lit i join lz on lz.wave = i.wave where i.k < 300) as e
      group by wave, k, {betas}),
    lbeta as (select * from lit where k = 300),
    lcells as (select wave, cast(y as integer) as y, cast(count(*) as double) as w, {", ".join(BASIC5)} from analytic group by all),
    lpairs as (select u.train_wave, b.wave as test_wave, b.y, b.w, {cross} from lcells b cross join usable u join lprep p on p.wave = u.train_wave),
    lgrid_counts as (select train_wave, test_wave, round(1/(1 + exp(-({eta}))), 9) as s, sum(w*y) as p, sum(w*(1 - y)) as n from lpairs join lbeta on lbeta.wave = lpairs.train_wave group by all),
    lgrid_auc as ({auc_sql("lgrid_counts", "train_wave, test_wave")}),
    lgrid_thr as ({thr})
    {table}"""


@query("logistic_grid", GRID, _logistic_grid_sql(), digits=6)
def _(t):
    return grid_plan.logistic_grid(t.clean)


@query("boosted_tree_grid", GRID)
def _(t):
    return grid_plan.boosted_grid(t.clean, rounds=ROUNDS)


@query("boosted_tree_rolling", "strategy:string test_wave:int auc:double n_test:long n_test_pos:long n_train:long n_train_pos:long")
def _(t):
    return rolling.boosted_rolling(grid_plan.wave_cells(t.clean, BASIC5), TESTS, rounds=ROUNDS)


@query("boosted_tree_prospective", "auc:double n_positive:long n_total:long")
def _(t):
    return transport.prospective(grid_plan.wave_cells(t.clean, BASIC5), ERA_CUT, trees)


@query("boosted_tree_leave_one_out", "wave:int auc:double n_positive:long n_total:long")
def _(t):
    """Every wave under the trees of all other waves."""
    from tidegauge.operators.ranking import auc

    cells = grid_plan.wave_cells(t.clean, BASIC5)
    scored = transport.boosted_leave_one_out(cells, grid_plan.estimable_waves(cells, BASIC5), rounds=ROUNDS)
    return auc(scored, "score", "y", ["wave"], WEIGHT)


@query("boosted_tree_audit", "group:string n:long n_pos:long auc:double sens:double spec:double")
def _(t):
    """Trees trained on all other waves, audited on one wave's subgroups."""
    from tidegauge.operators.subgroups import audit

    train, _ = transport.leave_wave_out(grid_plan.wave_cells(t.clean, BASIC5), FOCUS)
    rows = t.analytic.filter(F.col("wave") == FOCUS).select("y", *BASIC5, "lgbtq", "income")
    return audit(trees(train, BASIC5).score(rows), "score")


# ---- one wave ---------------------------------------------------------------------------------------

MODEL = "model:string features:string auc:double sensitivity:double specificity:double threshold:double"


@query("nested_net_ladder", MODEL)
def _(t):
    return single_wave.ladder(t.clean, FOCUS, NET_ROUNDS)


@query("ladder_and_trees", MODEL)
def _(t):
    return single_wave.compare_with_trees(t.clean, FOCUS, NET_ROUNDS, ROUNDS)


@query("method_comparison_document", "model:string auc:double")
def _(t):
    """The comparison written as JSON documents and read back."""
    from tidegauge.registry.schemas import scratch
    from tidegauge.sources.sinks import metrics_to_json, write_document

    table = single_wave.compare_with_trees(t.clean, FOCUS, NET_ROUNDS, ROUNDS)
    path = write_document(metrics_to_json(table), scratch(t, "comparison"))
    return t.spark.read.schema("model string, auc double").json(path)


@query("both_model_predictions", "row_id:long y:int age_band:string male:double p_trees:double p_net:double")
def _(t):
    return single_wave.both_predictions(t.clean, FOCUS, NET_ROUNDS, ROUNDS)


@query("models_at_fixed_specificity", "model:string threshold:double sens:double spec:double auc:double n:long")
def _(t):
    return single_wave.at_fixed_specificity(t.clean, FOCUS, net_rounds=NET_ROUNDS, tree_rounds=ROUNDS)


@query("saved_model_scores", "wave:int n:long same:bool")
def _(t):
    """A model that is loaded from disk alone scores like the model that was saved."""
    from tidegauge.registry.schemas import scratch

    cells = grid_plan.wave_cells(t.clean, BASIC5)
    fitted = logistic(cells, BASIC5)
    loaded = learners.Fitted.load(fitted.save(scratch(t, "model")))
    both = loaded.score(fitted.score(cells, "a"), "b")
    return both.groupBy("wave").agg(F.sum(WEIGHT).alias("n"), F.bool_and(F.abs(F.col("a") - F.col("b")) < 1e-12).alias("same"))


INTERVALS = "metric:string mean:double lo:double hi:double"
TREE_REFITS = 50
NET_REFITS = 50


def _focus_rows(t):
    return t.analytic.filter(F.col("wave") == FOCUS).select("row_id", "y", *BASIC5)


@query("refit_intervals_by_cells", INTERVALS)
def _(t):
    """Mean and 95 % interval of five metrics over 1,000 refits of the scorecard."""
    return stats.percentile_interval(bootstrap.refit_scorecard_by_cells(_focus_rows(t), "row_id", BASIC5, "y", 1000), bootstrap.METRICS)


@query("refit_bootstrap_trees", "replicate:int auc:double sens:double spec:double ppv:double npv:double n_positive:long n_total:long")
def _(t):
    """Trees of 150 rounds refitted on resamples of one wave, all replicates grown together."""
    return bootstrap.refit_boosted_by_cells(_focus_rows(t), "row_id", BASIC5, "y", TREE_REFITS, rounds=ROUNDS)


@query("refit_bootstrap_nets", "replicate:int auc:double sens:double spec:double ppv:double npv:double n_positive:long n_total:long")
def _(t):
    """Nets refitted on resamples of one wave, all replicates in one fit."""
    return bootstrap.refit_nets_by_cells(_focus_rows(t), "row_id", BASIC5, 5, NET_REFITS, rounds=NET_ROUNDS)


# ---- calibration ------------------------------------------------------------------------------------

def newton_sql(source: str, x: str, start: str = "0.0e0") -> str:
    """Two-parameter logistic regression by Newton steps in recursive SQL."""
    return f"""with recursive cc as (select model, {x} as x, cast(sum(y) as double) p, cast(count(*) as double) n from {source} group by all),
    it as (select model, 0 as k, 0.0e0 as a, 0.0e0 as b from (select distinct model from cc) as m
      union all
      select model, k+1, a + (h11*g0 - h01*g1)/(h00*h11 - h01*h01), b + (h00*g1 - h01*g0)/(h00*h11 - h01*h01) from (
        select it.model, it.k, it.a, it.b, sum(p - n*q) g0, sum((p - n*q)*x) g1, sum(n*q*(1-q)) h00, sum(n*q*(1-q)*x) h01, sum(n*q*(1-q)*x*x) h11
        from it join (select cc.*, it2.k as kk, 1/(1+exp(-(it2.a + it2.b*cc.x))) as q from cc join it it2 on cc.model = it2.model) as e on e.model = it.model and e.kk = it.k
        where it.k < 25 group by it.model, it.k, it.a, it.b) as s)
    select model, a as intercept, b as slope from it where k = 25"""


@query("calibration_intercept_slope", "model:string intercept:double slope:double",
       newton_sql("long_preds", "ln((score + 1e-12)/(1 - score + 1e-12))"), digits=5)
def _(t):
    rows = []
    for m in ("new", "old"):
        part = t.long_preds.filter(F.col("model") == m)
        rows.append((m, *calibrate.intercept_slope(part, "score", "y")))
    return local_rows(t.spark, rows, "model string, intercept double, slope double")


@query("grouped_sigmoid_calibration", "model:string intercept:double slope:double",
       """with recursive cc as (select model, score as x, cast(sum(y) as double) as pos, cast(sum(1 - y) as double) as neg from long_preds group by all),
       tot as (select model, sum(pos) as n1, sum(neg) as n0 from cc group by model),
       tt as (select cc.model, x, pos + neg as n, pos*(n1 + 1)/(n1 + 2) + neg/(n0 + 2) as p from cc join tot on tot.model = cc.model),
       it as (select model, 0 as k, ln((n1 + 1)/(n0 + 1)) as a, 0.0e0 as b from tot
         union all
         select model, k + 1, a + (h11*g0 - h01*g1)/(h00*h11 - h01*h01), b + (h00*g1 - h01*g0)/(h00*h11 - h01*h01) from (
           select model, k, a, b, sum(p - n*q) as g0, sum((p - n*q)*x) as g1, sum(n*q*(1-q)) as h00, sum(n*q*(1-q)*x) as h01, sum(n*q*(1-q)*x*x) as h11
           from (select it.model, k, a, b, x, n, p, 1/(1 + exp(-(a + b*x))) as q from it join tt on tt.model = it.model where k < 25) as e group by model, k, a, b) as s)
       select model, a as intercept, b as slope from it where k = 25""", digits=6)
def _(t):
    """Smoothed sigmoids of all models in one grouped Newton fit."""
    from tidegauge.operators.ranking import score_counts

    curves = calibrate.sigmoid_by(score_counts(t.long_preds, "score", "y", ["model"]), ["model"])
    return local_rows(t.spark, [(*g, *ab) for g, ab in curves.items()], "model string, intercept double, slope double")


@query("calibration_on_probability_scale", "model:string brier:double intercept:double slope:double")
def _(t):
    from tidegauge.operators.reclass import brier

    a, b = calibrate.intercept_slope(t.preds, "p_new", "y", scale="probability", ridge=1.0)
    return brier(t.preds, "p_new", "y").select(
        F.lit("new").alias("model"), "brier", F.lit(a).alias("intercept"), F.lit(b).alias("slope")
    )


@query("recalibration_summary", "model:string intercept:double slope:double brier_before:double brier_after:double auc_before:double auc_after:double",
       newton_sql("long_preds", "ln((score + 1e-12)/(1 - score + 1e-12))").replace("select model, a as intercept, b as slope from it where k = 25", "")
       + """, f as (select model, a as intercept, b as slope from it where k = 25),
       c as (select model, score as s, cast(sum(y) as double) p, cast(sum(1-y) as double) n from long_preds group by model, score),
       """ + "ar as (" + auc_sql("c", "model") + """)
       select f.model, intercept, slope, bb.brier_before, bb.brier_after, ar.auc as auc_before, ar.auc as auc_after from f join ar on ar.model = f.model join
       (select l.model, avg((score-y)*(score-y)) brier_before, avg(power(1/(1+exp(-(intercept + slope*ln((score + 1e-12)/(1 - score + 1e-12))))) - y, 2)) brier_after
        from long_preds l join f on f.model = l.model group by l.model) as bb on bb.model = f.model""", digits=5)
def _(t):
    parts = [
        calibrate.recalibration_summary(t.long_preds.filter(F.col("model") == m), "score", "y", m) for m in ("new", "old")
    ]
    return parts[0].unionByName(parts[1])


# ---- regressions --------------------------------------------------------------------------------------

def appendix_cells(t, extra=()):
    rows = inference.appendix_terms(t.analytic).select("row_id", "wave", "y", *inference.APPENDIX_TERMS)
    rows = rows.na.drop(subset=[*inference.APPENDIX_TERMS, "y"])
    if "fold" in extra:
        rows = sampling.folds(rows, "row_id", ["y"])
    return compress(rows, [*extra, *inference.APPENDIX_TERMS, "y"])


@query("wald_selection", "term:string coefficient:double se:double z:double selected:bool")
def _(t):
    cells = compress(t.analytic, [*FULL9, "y"])
    table = learners.wald_table(cells, FULL9)
    return local_rows(t.spark, table, "term string, coefficient double, se double, z double").withColumn(
        "selected", F.abs("z") > single_wave.Z_LIMIT
    )


@query("design_weighted_logistic", "term:string coefficient:double se:double z:double")
def _(t):
    rows = inference.appendix_terms(t.analytic)
    return inference.design_logistic(rows, inference.APPENDIX_TERMS, "y", "strat", "psu", "wgt")


def _elastic(t):
    return penalised.elastic_net_path(appendix_cells(t, ["fold"]), inference.APPENDIX_TERMS)


@query("elastic_net_coefficients", "term:string coefficient:double")
def _(t):
    path = _elastic(t)
    return local_rows(t.spark, path.coefficients if path else [], "term string, coefficient double")


@query("elastic_net_fold_auc", "fold:int step:int penalty:double auc:double chosen:bool")
def _(t):
    """Ten penalties by five folds left out."""
    path = _elastic(t)
    if path is None:
        return local_rows(t.spark, [], "fold int, step int, penalty double, auc double, chosen boolean")
    penalties = F.array(*[F.lit(path.penalty(i)) for i in range(len(path.strengths))])
    return path.scores.select("fold", "step", penalties[F.col("step")].alias("penalty"), "auc", (F.col("step") == path.chosen).alias("chosen"))


@query("random_intercept_by_wave", "term:string coefficient:double se:double lo:double hi:double")
def _(t):
    cells = cut_lineage(appendix_cells(t, ["wave"]))
    table = inference.random_intercept(cells, inference.APPENDIX_TERMS)
    return local_rows(t.spark, [], inference.TERMS) if table is None else table  # too few rows


@query("additive_spline_logistic", "term:string coefficient:double")
def _(t):
    """Six smooth terms and the tensor products of the fourth and sixth, second and fifth."""
    terms = inference.APPENDIX_TERMS
    return inference.additive_logistic(appendix_cells(t), terms[:6], [], [(terms[3], terms[5]), (terms[1], terms[4])])


DOM = ("male", "age", "veteran", "drug_use", "work_hours", "k6_score", "married", "lgbtq", "mental_health_tx")


@query("covariance_moments", "a:string b:string cov:double",
       " union all ".join(
           f"select '{a}' as a, '{b}' as b, covar_pop({a}, {b}) as cov from (select * from analytic where "
           + " and ".join(f"{c} is not null" for c in (*DOM, "y")) + ") as r"
           for i, a in enumerate((*DOM, "y")) for b in (*DOM, "y")[i:]
       ), digits=8)
def _(t):
    return inference.moments(compress(t.analytic, [*DOM, "y"]), [*DOM, "y"])


@query("dominance_analysis", "term:string incremental_r2:double")
def _(t):
    terms = inference.APPENDIX_TERMS
    cov = inference.moments(appendix_cells(t), [*terms, "y"])
    return inference.dominance(inference.subset_r2(cov, "y", terms), terms)


@query("subset_r2", "mask:long size:int r2:double")
def _(t):
    cov = inference.moments(compress(t.analytic, [*BASIC5, "y"]), [*BASIC5, "y"])
    return inference.subset_r2(cov, "y", BASIC5)


@query("gain_importance", "feature:string gain:double rank:int")
def _(t):
    fitted = trees(compress(t.analytic.filter(F.col("wave") == FOCUS), [*FULL9, "y"]), FULL9)
    rows = [(f, g, i + 1) for i, (f, g) in enumerate(fitted.gain_table())]
    return local_rows(t.spark, rows, "feature string, gain double, rank int")


@query("linear_contributions", "feature:string mean_abs:double")
def _(t):
    cells = compress(t.analytic, [*FULL9, "y"])
    fitted = logistic(cells, FULL9)
    return inference.linear_contributions(cells, learners.coefficients(fitted)[1:], fitted.scaler)


CTES["attr_cells"] = "select " + ", ".join(f"cast({f} as double) as {f}" for f in BASIC5) + ", count(*) as w from analytic group by all"
CTES["attr_long"] = " union all ".join(f"select cast(y as integer) as y, '{f}' as feature, cast({f} as double) as level from analytic" for f in BASIC5)
CTES["attr_cards"] = card_sql("attr_long", "")
CTES["attr_background"] = "select count(*)/sum(count(*)) over () as share, " + ", ".join(f"quantile_cont(cast({f} as double), 0.5) as {f}" for f in BASIC5) + " from analytic group by wave"
CTES["attr_mixed"] = (
    "select 0 as y, c.w, s.m, g.share, " + ", ".join(f"c.{f} as own_{f}" for f in BASIC5) + ", "
    + ", ".join(f"case when s.m & {1 << j} <> 0 then c.{f} else g.{f} end as {f}" for j, f in enumerate(BASIC5))
    + f" from attr_cells c cross join (select unnest(range({1 << len(BASIC5)})) as m) as s cross join attr_background g"
)
CTES["attr_scores"] = scored_sql("attr_mixed b", "attr_cards", "true", "b.w, b.m, b.share, " + ", ".join(f"b.own_{f}" for f in BASIC5))


def _phi_sql(j: int) -> str:
    inside, outside = attribution.set_weights(len(BASIC5))
    sizes = range(len(BASIC5) + 1)
    a, b = (" ".join(f"when {s} then {w[s]!r}e0" for s in sizes) for w in (inside, outside))
    return f"sum(share/(1 + exp(-s))*case when m & {1 << j} <> 0 then (case bit_count(m) {a} end) else -(case bit_count(m) {b} end) end)"


CTES["attr_phi"] = (
    "select w, " + ", ".join(f"own_{f}" for f in BASIC5) + ", " + ", ".join(f"{_phi_sql(j)} as phi_{f}" for j, f in enumerate(BASIC5))
    + " from attr_scores group by w, " + ", ".join(f"own_{f}" for f in BASIC5)
)


@query("shapley_of_scorecard", "feature:string mean_abs:double mean:double",
       " union all ".join(f"select '{f}' as feature, sum(w*abs(phi_{f}))/sum(w) as mean_abs, sum(w*phi_{f})/sum(w) as mean from attr_phi" for f in BASIC5), digits=7)
def _(t):
    """Risk on the probability scale against the median respondent of every wave."""
    from tidegauge.operators import scorecard

    rows = compress(t.analytic.select("wave", "y", *[F.col(f).cast("double").alias(f) for f in BASIC5]), ["wave", *BASIC5, "y"])
    cells = cut_lineage(rows)
    model = scorecard.fit(cells, BASIC5, weight=WEIGHT)

    def risk(df):
        return scorecard.score(df, model, BASIC5).withColumn("score", 1 / (1 + F.exp(-F.col("score"))))

    table = attribution.shapley(cells, BASIC5, risk, attribution.background_medians(cells, BASIC5, ["wave"]))
    return attribution.shapley_summary(table, BASIC5)


def _focus_cells(t):
    """Every cell of the focus wave: all 512 sets of its features meet the median respondent."""
    return cut_lineage(compress(t.analytic.filter(F.col("wave") == FOCUS), [*FULL9, "y"]))


SHAPLEY = " ".join(f"{f}:double" for f in FULL9) + " w:long base:double score:double " + " ".join(f"phi_{f}:double" for f in FULL9)


@query("shapley_of_trees", SHAPLEY)
def _(t):
    cells = _focus_cells(t)
    return attribution.shapley_by_sets(cells, FULL9, trees(cells, FULL9).set_scores, attribution.background_medians(cells, FULL9))


@query("shapley_of_net", SHAPLEY)
def _(t):
    cells = _focus_cells(t)
    net = nets.fit_one(cells, FULL9, 8, rounds=NET_ROUNDS)
    return attribution.shapley(cells, FULL9, net.score, attribution.background_medians(cells, FULL9))


CTES["full_rows"] = "select row_id, cast(y as integer) as y, " + ", ".join(FULL9) + " from analytic"
CTES["full_long"] = " union all ".join(f"select row_id, y, '{f}' as feature, {f} as level from full_rows" for f in FULL9)
CTES["full_cards"] = card_sql("full_long", "")
CTES["full_steps"] = """select feature, level, cum, coalesce(lag(cum) over (partition by feature order by cum), 0) as lo from
  (select feature, level, sum(n) over (partition by feature order by level nulls first)/sum(n) over (partition by feature) as cum from
   (select feature, level, cast(count(*) as double) as n from full_long group by feature, level) as c) as d"""
CTES["redrawn"] = """select l.feature, l.row_id, s.level from (select feature, row_id,
  cast(cast('0x'||substr(md5(concat('42:', feature, ':', cast(row_id as varchar))), 1, 8) as bigint) as double)/4294967296.0e0 as u from full_long) as l
  join full_steps s on s.feature = l.feature and l.u >= s.lo and l.u < s.cum"""
CTES["permuted"] = " union all ".join(
    f"select '{g}' as feature, r.row_id, r.y, " + ", ".join(f"d.level as {f}" if f == g else f"r.{f}" for f in FULL9)
    + f" from full_rows r join redrawn d on d.row_id = r.row_id and d.feature = '{g}'"
    for g in FULL9
) + " union all select 'none' as feature, row_id, y, " + ", ".join(FULL9) + " from full_rows"
CTES["permuted_scores"] = scored_sql("permuted b", "full_cards", "true", "b.feature", FULL9)


@query("permutation_importance", "feature:string auc:double drop:double",
       "with c as (select feature, s, cast(sum(y) as double) as p, cast(sum(1-y) as double) as n from permuted_scores group by all), a as ("
       + auc_sql("c", "feature") + ") select feature, auc, max(case when feature = 'none' then auc end) over () - auc as drop from a")
def _(t):
    from tidegauge.operators import scorecard

    rows = t.analytic.select("row_id", "y", *FULL9)
    model = scorecard.fit(compress(rows, [*FULL9, "y"]), FULL9, weight=WEIGHT)
    return inference.permutation_importance(rows, FULL9, lambda cells: scorecard.score(cells, model, FULL9))
