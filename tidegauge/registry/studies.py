"""Splits, preparation, scorecard studies and grid summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions.codes import BASIC5
from tidegauge.functions.hashing import POISSON1_CDF
from tidegauge.operators import bootstrap, grid_stats, prep, sampling, scorecard, stats, subgroups, verify
from tidegauge.operators.cells import WEIGHT, compress
from tidegauge.operators.ranking import auc
from tidegauge.plans import grid as grid_plan
from tidegauge.plans import rolling, transport
from tidegauge.registry.base import query
from tidegauge.registry.inputs import CTES, ERA_CUT, FOCUS, WAVES
from tidegauge.registry.scoring import auc_sql

# ---- splits and preparation -------------------------------------------------------------

CTES["ranked"] = """select *, row_number() over (partition by wave, y order by md5(concat('42:', cast(row_id as varchar))), row_id) as rk,
  count(*) over (partition by wave, y) as n_stratum from analytic"""
CTES["splitted"] = "select *, rk <= ceil(cast(n_stratum as double)*3/10) as is_test from ranked"


@query("stratified_holdout", "row_id:long wave:int y:int is_test:bool", "select row_id, wave, y, is_test from splitted")
def _(t):
    return sampling.holdout(t.analytic, "row_id", ["wave", "y"])


@query("holdout_sizes", "wave:int y:int n:long n_test:long",
       "select wave, y, count(*) n, count(case when is_test then 1 end) n_test from splitted group by wave, y")
def _(t):
    return sampling.holdout(t.analytic, "row_id", ["wave", "y"]).groupBy("wave", "y").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("n_test")
    )


@query("stratified_folds", "row_id:long wave:int y:int fold:int", "select row_id, wave, y, (rk - 1) % 5 as fold from ranked")
def _(t):
    return sampling.folds(t.analytic, "row_id", ["wave", "y"])


U_SQL = (
    "cast(cast('0x'||substr(md5(concat('42:', cast(cast(floor(rep/4) as integer) as varchar), ':', cast(row_id as varchar))), "
    "cast(rep%4*8+1 as integer), 8) as bigint) as double)/4294967296.0e0"
)
POISSON_SQL = "case " + " ".join(
    f"when u < {edge!r}e0 then {k}"
    for k, edge in enumerate(POISSON1_CDF)
) + " else 12 end"


def draws_sql(source: str, replicates: int) -> str:
    return f"""u as (select p.*, rep, {U_SQL} as u from {source} p cross join (select range as rep from range({replicates})) as r),
    d as (select *, {POISSON_SQL} as times from u)"""


@query(
    "resample_weights", "replicate:int wave:int rows_drawn:long distinct_rows:long",
    f"with {draws_sql('preds', 8)} select rep as replicate, wave, sum(times) as rows_drawn, count(case when times > 0 then 1 end) as distinct_rows from d group by rep, wave",
)
def _(t):
    return sampling.resample_weights(t.preds, "row_id", 8).groupBy("replicate", "wave").agg(
        F.sum("times").alias("rows_drawn"), F.count("*").alias("distinct_rows")
    )


BOOT_THR = 0.3
BOOT_SQL = f"""with {draws_sql('preds', 40)},
  c as (select rep, p_new as s, cast(sum(y*times) as double) as p, cast(sum((1-y)*times) as double) as n from d where times > 0 group by rep, p_new),
  a as ({auc_sql('c', 'rep')}),
  m as (select rep, sum(case when s >= {BOOT_THR}e0 then p else 0 end) tp, sum(case when s >= {BOOT_THR}e0 then n else 0 end) fp,
    sum(case when s < {BOOT_THR}e0 then p else 0 end) fn, sum(case when s < {BOOT_THR}e0 then n else 0 end) tn from c group by rep),
  r as (select m.rep as replicate, auc, tp/(tp+fn) sens, tn/(tn+fp) spec, case when tp+fp > 0 then tp/(tp+fp) else 0 end ppv,
    case when tn+fn > 0 then tn/(tn+fn) else 0 end npv from m join a on m.rep = a.rep)"""


@query("bootstrap_replicates", "replicate:int auc:double sens:double spec:double ppv:double npv:double", BOOT_SQL + " select * from r")
def _(t):
    return bootstrap.replicate_metrics(t.preds, "row_id", "p_new", "y", BOOT_THR, 40)


@query(
    "bootstrap_intervals", "metric:string mean:double lo:double hi:double",
    BOOT_SQL + " " + " union all ".join(
        f"select '{m}' as metric, avg({m}) as mean, quantile_cont({m}, 0.025) as lo, quantile_cont({m}, 0.975) as hi from r"
        for m in ("auc", "sens", "spec", "ppv", "npv")
    ),
)
def _(t):
    reps = bootstrap.replicate_metrics(t.preds, "row_id", "p_new", "y", BOOT_THR, 40)
    return stats.percentile_interval(reps, bootstrap.METRICS)


@query("bootstrap_intervals_by_cells", "metric:string mean:double lo:double hi:double")
def _(t):
    """The same intervals from Poisson(n) draws per (score, outcome) cell: no row is copied."""
    reps = bootstrap.replicate_metrics_by_cells(t.preds, "p_new", "y", BOOT_THR, 1000)
    return stats.percentile_interval(reps, bootstrap.METRICS)


def _prep_sql(f: str) -> str:
    return (
        f"select wave, '{f}' as feature, median as median, avg(coalesce(x, median)) as mean, "
        f"case when stddev_pop(coalesce(x, median)) < 1e-12 then 1 else stddev_pop(coalesce(x, median)) end as sd "
        f"from (select wave, {f} as x, quantile_cont({f}, 0.5) over (partition by wave) as median from splitted where not is_test) as m group by wave, median"
    )


@query("median_imputation_and_scaling", "wave:int feature:string median:double mean:double sd:double",
       " union all ".join(_prep_sql(f) for f in BASIC5))
def _(t):
    train = sampling.holdout(t.analytic, "row_id", ["wave", "y"]).filter(~F.col("is_test"))
    cells = compress(train, ["wave", *BASIC5])
    return prep.fit_prep(cells, BASIC5, ["wave"], WEIGHT)


@query("distributed_medians", "wave:int k6_score:double work_hours:double p_new:double",
       """select c.wave, quantile_cont(k6_score, 0.5) k6_score, quantile_cont(work_hours, 0.5) work_hours, quantile_cont(p_new, 0.5) p_new
       from clean c join preds p on p.row_id = c.row_id group by c.wave""")
def _(t):
    """Medians of columns with any number of distinct values."""
    rows = t.clean.select("row_id", "wave", "k6_score", "work_hours").join(t.preds.select("row_id", "p_new"), "row_id")
    return prep.medians(rows, ["k6_score", "work_hours", "p_new"], ["wave"])


def _scaled_sql(absent: tuple[str, ...] = ()) -> str:
    filled = {f: f"s_{f}.median" if f in absent else f"coalesce(t.{f}, s_{f}.median)" for f in BASIC5}
    return (
        "with " + ", ".join(f"s_{f} as ({_prep_sql(f)})" for f in BASIC5)
        + " select t.row_id, " + ", ".join(f"({filled[f]} - s_{f}.mean)/s_{f}.sd as {f}" for f in BASIC5)
        + " from splitted t " + " ".join(f"join s_{f} on s_{f}.wave = {FOCUS}" for f in BASIC5)
        + f" where t.is_test and t.wave = {FOCUS}"
    )


def holdout_matrix(t, absent: tuple[str, ...] = ()):
    """Hold-out rows of one wave, filled and scaled with training medians and moments."""
    parts = sampling.holdout(t.analytic.filter(F.col("wave") == FOCUS), "row_id", ["y"])
    scaler = prep.Scaler.fit(compress(parts.filter(~F.col("is_test")), list(BASIC5)), BASIC5, WEIGHT)
    rows = parts.filter("is_test").select("row_id", *[f for f in BASIC5 if f not in absent])
    return scaler.apply(rows).select("row_id", *BASIC5)


MATRIX = "row_id:long male:double age:double veteran:double drug_use:double work_hours:double"


@query("standardised_holdout_features", MATRIX, _scaled_sql())
def _(t):
    """The hold-out feature matrix, written and read again."""
    from tidegauge.registry.schemas import scratch
    from tidegauge.sources.sinks import write_table

    return t.spark.read.parquet(write_table(holdout_matrix(t), scratch(t, "matrix")))


@query("reindexed_features", MATRIX, _scaled_sql(("age", "drug_use")))
def _(t):
    """Rows that lack two training features: those are filled from the training medians."""
    return holdout_matrix(t, ("age", "drug_use"))


@query("class_weights", "wave:int n_neg:long n_pos:long pos_weight:double",
       "select wave, count(*) - sum(y) as n_neg, sum(y) as n_pos, (count(*) - sum(y))/greatest(sum(y), 1) as pos_weight from splitted where not is_test group by wave")
def _(t):
    train = sampling.holdout(t.analytic, "row_id", ["wave", "y"]).filter(~F.col("is_test"))
    return prep.class_weights(train, "y", ["wave"])


@query("demographics_join", "row_id:long y:int age_band:string score:double male:double",
       """with te as (select row_id from splitted where is_test)
       select a.row_id, a.y, case when a.age between 0 and 2 then '18‑25' when a.age > 2 and a.age <= 5 then '26‑49' when a.age > 5 and a.age <= 100 then '50+' end as age_band,
       p_new as score, a.male from te join preds p on te.row_id = p.row_id join clean a on a.row_id = te.row_id""")
def _(t):
    """Hold-out scores aligned with demographics by row id."""
    from tidegauge.functions.recode import age_band_a

    held = sampling.holdout(t.analytic, "row_id", ["wave", "y"]).filter("is_test").select("row_id")
    scores = t.preds.select("row_id", F.col("p_new").alias("score"))
    demo = t.clean.select("row_id", "y", "male", age_band_a(F.col("age")).alias("age_band"))
    return held.join(scores, "row_id").join(demo, "row_id")


# ---- scorecard grid -----------------------------------------------------------------------

CTES["basic_rows"] = "select row_id, wave, cast(y as integer) as y, " + ", ".join(BASIC5) + " from analytic"
CTES["basic_long"] = " union all ".join(
    f"select wave, y, '{f}' as feature, {f} as level from basic_rows" for f in BASIC5
)


def card_sql(levels: str, by: str) -> str:
    """(by, feature, level, n1, n0, woe) from rows (by, y, feature, level)."""
    lead = f"{by}, " if by else ""
    part = f"partition by {by}, feature" if by else "partition by feature"
    return (
        f"select *, ln((n1 + 0.5e0)/(sum(n1) over ({part}) + 1)) - ln((n0 + 0.5e0)/(sum(n0) over ({part}) + 1)) as woe from "
        f"(select {lead}feature, level, cast(sum(y) as double) as n1, cast(sum(1-y) as double) as n0 from {levels} group by all) as lv"
    )


CTES["cards"] = card_sql("basic_long", "wave")


def scored_sql(tests: str, cards: str, on: str, lead: str, features=BASIC5) -> str:
    joins = " ".join(
        f"left join (select * from {cards} where feature = '{f}') as c_{f} on c_{f}.level is not distinct from b.{f} and {on.format(c='c_' + f)}"
        for f in features
    )
    total = " + ".join(f"coalesce(c_{f}.woe, 0)" for f in features)
    return f"select {lead}, b.y, round({total}, 9) as s from {tests} {joins}"


CTES["usable"] = "select wave as train_wave from basic_rows group by wave having sum(y) >= 10"
CTES["grid_scores"] = scored_sql("basic_rows b cross join usable u", "cards", "{c}.wave = u.train_wave", "u.train_wave, b.wave as test_wave")
CTES["grid_counts"] = (
    "select train_wave, test_wave, s, cast(sum(y) as double) as p, cast(sum(1-y) as double) as n from grid_scores group by all"
)
CTES["grid_auc"] = auc_sql("grid_counts", "train_wave, test_wave")
CTES["grid_thr"] = """select train_wave, thr from (select train_wave, s as thr, row_number() over (partition by train_wave order by f1 desc, s) as rn from
  (select train_wave, s, 2*tp/(tp+fp+tot) as f1 from (select train_wave, s,
     sum(p) over (partition by train_wave order by s desc rows between unbounded preceding and current row) as tp,
     sum(n) over (partition by train_wave order by s desc rows between unbounded preceding and current row) as fp,
     sum(p) over (partition by train_wave) as tot from grid_counts where train_wave = test_wave) as run) as f) as k where rn = 1"""
CTES["grid_table"] = """select a.train_wave, a.test_wave, a.auc, r.sensitivity, r.specificity, a.n_positive, a.n_total from grid_auc a join
  (select c.train_wave, c.test_wave, sum(case when s >= thr then p else 0 end)/sum(p) as sensitivity, sum(case when s < thr then n else 0 end)/sum(n) as specificity
   from grid_counts c join grid_thr h on c.train_wave = h.train_wave group by c.train_wave, c.test_wave) as r
  on a.train_wave = r.train_wave and a.test_wave = r.test_wave"""

GRID = "train_wave:int test_wave:int auc:double sensitivity:double specificity:double n_positive:long n_total:long"


def the_grid(t):
    """Grid of the default scorecard."""
    return grid_plan.scorecard_grid(t.clean)


@query("scorecard_grid", GRID, "select * from grid_table")
def _(t):
    return the_grid(t)


@query("scorecard_levels", "wave:int feature:string level:double n1:long n0:long woe:double", "select * from cards")
def _(t):
    return scorecard.fit(compress(t.analytic, ["wave", *BASIC5, "y"]), BASIC5, by=["wave"], weight=WEIGHT)


@query("grid_json_document", GRID, "select * from grid_table")
def _(t):
    """Grid written as one nested JSON document and read back."""
    from tidegauge.registry.schemas import scratch
    from tidegauge.sources.sinks import grid_from_json, grid_to_json, read_document, write_document

    return grid_from_json(read_document(t.spark, write_document(grid_to_json(the_grid(t)), scratch(t, "grid"))))


@query("same_and_cross_wave", "kind:string n:long mean:double sd:double sd_pop:double min:double max:double",
       """select case when train_wave = test_wave then 'same' else 'cross' end as kind, count(*) n, avg(auc) mean, stddev_samp(auc) sd, stddev_pop(auc) sd_pop, min(auc) as "min", max(auc) as "max"
       from grid_table group by 1""")
def _(t):
    return grid_stats.same_cross(the_grid(t))


@query("same_cross_gap", "gap:double", "select avg(case when train_wave = test_wave then auc end) - avg(case when train_wave <> test_wave then auc end) as gap from grid_table")
def _(t):
    return grid_stats.gap(the_grid(t))


_PAIR = "with a as (select case when train_wave = test_wave then auc end as s, case when train_wave <> test_wave then auc end as c from grid_table) "


@query("auc_summary_table", "metric:string same_year:double cross_year:double difference:double",
       _PAIR + " union all ".join(f"select '{n}' as metric, {f}(s) as same_year, {f}(c) as cross_year, {f}(s)-{f}(c) as difference from a"
                                   for n, f in (("Mean", "avg"), ("SD", "stddev_samp"), ("Min", "min"), ("Max", "max")))
       + " union all select 'Range', max(s)-min(s), max(c)-min(c), null from a")
def _(t):
    return grid_stats.summary_table(the_grid(t))


@query("mean_auc_by_distance", "distance:int mean_auc:double n:long",
       "select abs(train_wave - test_wave) as distance, avg(auc) mean_auc, count(*) n from grid_table where train_wave <> test_wave group by 1")
def _(t):
    return grid_stats.mean_by_distance(the_grid(t))


def fit_sql(x: str, y: str, source: str) -> str:
    return (
        f"select regr_slope({y}, {x}) slope, regr_intercept({y}, {x}) intercept, regr_r2({y}, {x}) r_squared, "
        f"sqrt((1 - regr_r2({y}, {x}))*regr_syy({y}, {x})/((regr_count({y}, {x}) - 2)*regr_sxx({y}, {x}))) se, regr_count({y}, {x}) n from {source}"
    )


@query("distance_decay", "slope:double intercept:double r_squared:double se:double n:long",
       "with d as (select abs(train_wave - test_wave) as x, auc as y from grid_table where train_wave <> test_wave) " + fit_sql("x", "y", "d"))
def _(t):
    return grid_stats.distance_decay(the_grid(t), p_value=False)


def t_p_sql(t: str, dof: str) -> str:
    """Two-sided Student-t p-value for whole degrees of freedom by the finite angle series."""
    angle = f"atan(abs({t})/sqrt({dof}))"
    even = (
        f"1 - sin({angle})*list_sum(list_transform(range(cast(({dof})/2 as bigint)), "
        f"lambda k: exp(lgamma(k + 0.5e0) - lgamma(k + 1.0e0))/sqrt(pi())*power(cos({angle}), 2*k)))"
    )
    odd = (
        f"1 - 2/pi()*({angle} + sin({angle})*coalesce(list_sum(list_transform(range(cast((({dof})-1)/2 as bigint)), "
        f"lambda k: sqrt(pi())/2*exp(lgamma(k + 1.0e0) - lgamma(k + 1.5e0))*power(cos({angle}), 2*k + 1))), 0))"
    )
    return f"case when ({dof}) % 2 = 0 then {even} else {odd} end"


@query("distance_decay_p_value", "slope:double se:double p_value:double",
       "with d as (select abs(train_wave - test_wave) as x, auc as y from grid_table where train_wave <> test_wave), f as ("
       + fit_sql("x", "y", "d") + ") select slope, se, " + t_p_sql("slope/se", "n - 2") + " as p_value from f")
def _(t):
    return grid_stats.distance_decay(the_grid(t))


CTES["eras"] = f"""select auc, case when train_wave < {ERA_CUT} and test_wave >= {ERA_CUT} then 'pre_to_post' when train_wave >= {ERA_CUT} and test_wave < {ERA_CUT} then 'post_to_pre' end as direction
  from grid_table where (train_wave < {ERA_CUT}) <> (test_wave < {ERA_CUT})"""


@query("era_transport", "direction:string n:long mean:double sd:double",
       "select direction, count(*) n, avg(auc) mean, stddev_samp(auc) sd from eras group by direction")
def _(t):
    return grid_stats.era_transport(the_grid(t), ERA_CUT)


@query("era_transport_test", "mean_first:double mean_second:double difference:double t:double dof:long",
       """with s as (select avg(case when direction='pre_to_post' then auc end) m1, avg(case when direction='post_to_pre' then auc end) m2,
         var_samp(case when direction='pre_to_post' then auc end) v1, var_samp(case when direction='post_to_pre' then auc end) v2,
         count(case when direction='pre_to_post' then 1 end) n1, count(case when direction='post_to_pre' then 1 end) n2 from eras)
       select m1 mean_first, m2 mean_second, m1-m2 as difference, (m1-m2)/sqrt(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2)*(1.0e0/n1+1.0e0/n2)) as t, n1+n2-2 as dof from s""")
def _(t):
    return grid_stats.era_test(the_grid(t), ERA_CUT, p_value=False)


@query("prevalence_trend", "slope:double r_squared:double relative_change_pct:double total_n:long n_waves:long",
       """with c as (select test_wave as x, 100.0e0*n_positive/n_total as y, n_total from grid_table where train_wave = test_wave)
       select regr_slope(y, x) slope, regr_r2(y, x) r_squared, 100*(arg_max(y, x) - arg_min(y, x))/arg_min(y, x) relative_change_pct,
         sum(n_total) total_n, count(distinct x) n_waves from c""")
def _(t):
    return grid_stats.prevalence_trend(the_grid(t), p_value=False)


@query("sample_characteristics", "wave:int n:long n_pos:long prevalence_pct:double sensitivity:double specificity:double auc:double",
       "select test_wave as wave, n_total n, n_positive n_pos, 100*n_positive/n_total prevalence_pct, sensitivity, specificity, auc from grid_table where train_wave = test_wave")
def _(t):
    return grid_stats.sample_characteristics(the_grid(t))


@query("auc_matrix", "train_wave:int " + " ".join(f"{w}:double" for w in WAVES),
       "select train_wave, " + ", ".join(f'max(case when test_wave = {w} then auc end) as "{w}"' for w in WAVES) + " from grid_table group by train_wave")
def _(t):
    return grid_stats.auc_pivot(the_grid(t), WAVES)


# ---- rolling windows ------------------------------------------------------------------------

TESTS = tuple(w for w in WAVES if w - 3 >= WAVES[0])
_TESTS = "(" + ",".join(str(w) for w in TESTS) + ")"
CTES["served"] = (
    f"select 'rolling' as strategy, t.tw as test_wave, b.* from basic_rows b join (select unnest({list(TESTS)}) as tw) as t on b.wave between t.tw - 3 and t.tw - 1 "
    f"union all select 'single' as strategy, t.tw as test_wave, b.* from basic_rows b join (select unnest({list(TESTS)}) as tw) as t on b.wave = t.tw - 1"
)
CTES["rolling_long"] = " union all ".join(
    f"select strategy, test_wave, y, '{f}' as feature, {f} as level from served" for f in BASIC5
)
CTES["rolling_cards"] = card_sql("rolling_long", "strategy, test_wave")
CTES["rolling_scores"] = scored_sql(
    f"basic_rows b join (select unnest(['rolling','single']) as strategy) as st on b.wave in {_TESTS}", "rolling_cards",
    "{c}.strategy = st.strategy and {c}.test_wave = b.wave", "st.strategy, b.wave as test_wave",
)
CTES["rolling_counts"] = "select strategy, test_wave, s, cast(sum(y) as double) as p, cast(sum(1-y) as double) as n from rolling_scores group by all"
CTES["rolling_auc"] = auc_sql("rolling_counts", "strategy, test_wave")
CTES["rolling_sizes"] = "select strategy, test_wave, count(*) as n_train, sum(y) as n_train_pos from served group by strategy, test_wave"


def the_rolling(t):
    return rolling.scorecard_rolling(grid_plan.wave_cells(t.clean, BASIC5), TESTS)


@query("rolling_window_training", "strategy:string test_wave:int auc:double n_test:long n_test_pos:long n_train:long n_train_pos:long",
       "select a.strategy, a.test_wave, auc, n_total n_test, n_positive n_test_pos, n_train, n_train_pos from rolling_auc a join rolling_sizes z on a.strategy = z.strategy and a.test_wave = z.test_wave")
def _(t):
    return the_rolling(t)


@query("rolling_window_sizes", "strategy:string test_wave:int n_train:long n_train_pos:long", "select * from rolling_sizes")
def _(t):
    return rolling.window_sizes(compress(t.analytic, ["wave", "y"]), TESTS)


@query("rolling_window_counts", "wave:int n_window:long n_pos_window:long",
       "with c as (select wave, count(*) n, sum(y) p from analytic group by wave) select a.wave, sum(b.n) n_window, sum(b.p) n_pos_window from c a join c b on b.wave between a.wave-3 and a.wave-1 group by a.wave")
def _(t):
    """Pooled counts over the three earlier waves by a range window on wave totals."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(0)).orderBy("wave").rangeBetween(-3, -1)  # one row per wave
    counts = t.analytic.groupBy("wave").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    return counts.select("wave", F.sum("n").over(w).alias("n_window"), F.sum("p").over(w).alias("n_pos_window")).filter(
        F.col("n_window").isNotNull()
    )


CTES["rolling_pairs"] = "select test_wave, max(case when strategy='rolling' then auc end) as rolling, max(case when strategy='single' then auc end) as single from rolling_auc group by test_wave"


@query("rolling_vs_single_test", "mean_new:double mean_old:double mean_difference:double all_positive:bool n:long t:double",
       """select avg(rolling) mean_new, avg(single) mean_old, avg(rolling-single) mean_difference, bool_and(rolling-single > 0) all_positive, count(*) n,
       avg(rolling-single)/(stddev_samp(rolling-single)/sqrt(count(*))) as t from rolling_pairs""")
def _(t):
    return stats.paired_t(rolling.paired(the_rolling(t)), "rolling", "single", p_value=False)


@query("rolling_vs_single_p_value", "n:long t:double p_value:double",
       """with s as (select count(*) n, avg(rolling-single)/(stddev_samp(rolling-single)/sqrt(count(*))) as t from rolling_pairs)
       select n, t, """ + t_p_sql("t", "n - 1") + " as p_value from s")
def _(t):
    return stats.paired_t(rolling.paired(the_rolling(t)), "rolling", "single")


@query("training_strategy_table", "test_wave:int single_auc:double rolling_auc:double improvement:double",
       "select test_wave, round(single,3) single_auc, round(rolling,3) rolling_auc, round(rolling,3)-round(single,3) improvement from rolling_pairs")
def _(t):
    return grid_stats.strategy_table(the_rolling(t))


# ---- transport --------------------------------------------------------------------------------

CTES["before_long"] = f"select y, feature, level from basic_long where wave < {ERA_CUT}"
CTES["before_cards"] = card_sql("before_long", "")
CTES["after_scores"] = scored_sql(f"(select * from basic_rows where wave >= {ERA_CUT}) b", "before_cards", "true", "b.wave")


@query("prospective_holdout", "auc:double n_positive:long n_total:long",
       "with c as (select s, cast(sum(y) as double) as p, cast(sum(1-y) as double) as n from after_scores group by s) " + auc_sql("c", ""))
def _(t):
    return transport.prospective(grid_plan.wave_cells(t.clean, BASIC5), ERA_CUT)


@query("temporal_split_sizes", "part:string n:long n_pos:long",
       f"select case when wave < {ERA_CUT} then 'train' else 'test' end as part, count(*) n, sum(y) n_pos from analytic group by 1")
def _(t):
    cells = compress(t.analytic, ["wave", "y"])
    train, test = transport.temporal_split(cells, ERA_CUT)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.sum(WEIGHT).alias("n"), F.sum(F.col("y") * F.col(WEIGHT)).alias("n_pos"))


CTES["other_long"] = f"select t.tw as wave, y, feature, level from basic_long b join (select unnest({list(WAVES)}) as tw) as t on b.wave <> t.tw"
CTES["other_cards"] = card_sql("other_long", "wave")
CTES["other_scores"] = scored_sql("basic_rows b", "other_cards", "{c}.wave = b.wave", "b.wave, b.row_id")


@query("leave_one_wave_out", "wave:int auc:double n_positive:long n_total:long",
       "with c as (select wave, s, cast(sum(y) as double) as p, cast(sum(1-y) as double) as n from other_scores group by all) " + auc_sql("c", "wave"))
def _(t):
    return transport.leave_one_out_all(grid_plan.wave_cells(t.clean, BASIC5), WAVES)


AUDIT_SQL = {
    "Female": "male = 0", "Male": "male = 1", "Veteran": "veteran = 1", "Civilians": "veteran = 0",
    "LGBTQ": "lgbtq = 1", "Non-LGBTQ": "lgbtq = 0", "Age18-25": "age <= 2", "Age26-49": "age between 3 and 5",
    "Age50+": "age >= 6", "LowInc": "income <= q1", "HighInc": "income >= q3",
}


@query("leave_one_wave_out_audit", "group:string n:long n_pos:long auc:double sens:double spec:double",
       f"""with sc as (select a.*, 1/(1+exp(-o.s)) as p_new from other_scores o join analytic a on a.row_id = o.row_id where o.wave = {FOCUS}),
       cut as (select sc.*, q1, q3 from sc cross join (select quantile_cont(income, 0.25) q1, quantile_cont(income, 0.75) q3 from sc) as q),
       g as ({' union all '.join(f"select '{k}' as grp, round(p_new, 9) as s, y from cut where {v}" for k, v in AUDIT_SQL.items())}),
       gc as (select grp, s, cast(sum(y) as double) p, cast(sum(1-y) as double) n from g group by all), a as ({auc_sql('gc', 'grp')}),
       m as (select grp, count(*) n, sum(y) n_pos, count(case when s >= 0.5e0 and y=1 then 1 end)/nullif(sum(y),0) sens, count(case when s < 0.5e0 and y=0 then 1 end)/nullif(sum(1-y),0) spec from g group by grp)
       select m.grp as "group", m.n, m.n_pos, auc, coalesce(sens,0) sens, coalesce(spec,0) spec from m join a on m.grp = a.grp where m.n >= 20""")
def _(t):
    """Subgroups of one wave under the card of all other waves, score on the probability scale."""
    rows = t.analytic.select("wave", "y", *BASIC5, "lgbtq", "income")
    card = scorecard.fit_excluding(grid_plan.wave_cells(t.clean, BASIC5), BASIC5, WAVES)
    scored = scorecard.score(rows.filter(F.col("wave") == FOCUS), card, BASIC5, ["wave"])
    scored = scored.withColumn("score", F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("score"))), 9))
    return subgroups.audit(scored, "score")


# ---- refit bootstrap --------------------------------------------------------------------------

REFITS = 20
CTES["refit_draws"] = "with " + draws_sql("splitted", REFITS) + " select rep, cast(y as integer) as y, is_test, times, " + ", ".join(BASIC5) + f" from d where times > 0 and wave = {FOCUS}"
CTES["refit_long"] = " union all ".join(
    f"select rep, y, times, '{f}' as feature, {f} as level from refit_draws where not is_test" for f in BASIC5
)
CTES["refit_cards"] = (
    "select *, ln((n1 + 0.5e0)/(sum(n1) over (partition by rep, feature) + 1)) - ln((n0 + 0.5e0)/(sum(n0) over (partition by rep, feature) + 1)) as woe from "
    "(select rep, feature, level, cast(sum(y*times) as double) as n1, cast(sum((1-y)*times) as double) as n0 from refit_long group by all) as lv"
)
CTES["refit_all_scores"] = scored_sql("refit_draws b", "refit_cards", "{c}.rep = b.rep", "b.rep, b.is_test, b.times")
CTES["refit_counts"] = "select rep, is_test, s, cast(sum(y*times) as double) as p, cast(sum((1-y)*times) as double) as n from refit_all_scores group by all"
CTES["refit_test_counts"] = "select rep, s, p, n from refit_counts where is_test"
CTES["refit_auc"] = auc_sql("refit_test_counts", "rep")
CTES["refit_thr"] = """select rep, thr from (select rep, s as thr, row_number() over (partition by rep order by f1 desc, s) as rn from
  (select rep, s, 2*tp/(tp+fp+tot) as f1 from (select rep, s,
     sum(p) over (partition by rep order by s desc rows between unbounded preceding and current row) as tp,
     sum(n) over (partition by rep order by s desc rows between unbounded preceding and current row) as fp,
     sum(p) over (partition by rep) as tot from refit_counts where not is_test) as run) as f) as k where rn = 1"""
CTES["refit_metrics"] = """select m.rep as replicate, auc, tp/(tp+fn) as sens, tn/(tn+fp) as spec, case when tp+fp > 0 then tp/(tp+fp) else 0 end as ppv,
  case when tn+fn > 0 then tn/(tn+fn) else 0 end as npv, n_positive, n_total from (
  select c.rep, sum(case when s >= thr then p else 0 end) as tp, sum(case when s >= thr then n else 0 end) as fp,
    sum(case when s < thr then p else 0 end) as fn, sum(case when s < thr then n else 0 end) as tn
  from refit_test_counts c join refit_thr h on h.rep = c.rep group by c.rep) as m join refit_auc a on a.rep = m.rep"""


def refits(t):
    """Resample, fit and evaluate per replicate; the split comes first, so no row is on both sides."""
    rows = t.analytic.filter(F.col("wave") == FOCUS).select("row_id", "y", *BASIC5)
    return bootstrap.refit_scorecard(rows, "row_id", BASIC5, "y", REFITS)


@query("bootstrap_with_refit", "replicate:int auc:double sens:double spec:double ppv:double npv:double n_positive:long n_total:long",
       "select * from refit_metrics")
def _(t):
    return refits(t)


@query("refit_intervals", "metric:string mean:double lo:double hi:double",
       " union all ".join(
           f"select '{m}' as metric, avg({m}) as mean, quantile_cont({m}, 0.025) as lo, quantile_cont({m}, 0.975) as hi from refit_metrics"
           for m in ("auc", "sens", "spec", "ppv", "npv")
       ))
def _(t):
    """Mean and 95 % interval of the five metrics over the refits."""
    return stats.percentile_interval(refits(t), bootstrap.METRICS)


# ---- checks -----------------------------------------------------------------------------------

@query("tolerance_checks", "metric:string value:double expected:double tolerance:double passed:bool",
       """with s as (select avg(case when train_wave = test_wave then auc end) a, avg(case when train_wave <> test_wave then auc end) b from grid_table),
       m as (select 'same_year_mean' as metric, a as value from s union all select 'cross_year_mean', b from s union all select 'gap', a-b from s),
       e(metric, expected, tolerance) as (values ('same_year_mean', 0.62e0, 0.05e0), ('cross_year_mean', 0.55e0, 0.05e0), ('gap', 0.0e0, 0.001e0), ('full_auc', 0.8721e0, 0.01e0))
       select e.metric, value, expected, tolerance, coalesce(abs(value-expected) <= tolerance, false) as passed from e left join m on e.metric = m.metric""")
def _(t):
    same, cross = F.col("train_wave") == F.col("test_wave"), F.col("train_wave") != F.col("test_wave")
    wide = the_grid(t).agg(
        F.avg(F.when(same, F.col("auc"))).alias("same_year_mean"), F.avg(F.when(cross, F.col("auc"))).alias("cross_year_mean")
    ).withColumn("gap", F.col("same_year_mean") - F.col("cross_year_mean"))
    actual = wide.unpivot([], ["same_year_mean", "cross_year_mean", "gap"], "metric", "value")
    return verify.tolerance_checks(
        actual, {"same_year_mean": (0.62, 0.05), "cross_year_mean": (0.55, 0.05), "gap": (0.0, 0.001), "full_auc": (0.8721, 0.01)}
    )


@query("exact_checks", "check:string found:long passed:bool",
       """with n as (select count(*) as n from analytic), g as (select count(distinct test_wave) w, count(*) c, sum(case when train_wave = test_wave then n_total end) t from grid_table)
       select 'total_n' as "check", t as found, t = -1 as passed from g
       union all select 'wave_set', w, (select list(distinct wave order by wave) from clean) = (select list(distinct test_wave order by test_wave) from grid_table) from g
       union all select 'grid_cells', c, c = (select count(distinct wave) from clean) * w from g""")
def _(t):
    """Expected total is off by design, so one check fails."""
    return verify.exact_checks(the_grid(t), -1, WAVES)


@query("missing_grid_cells", "train_wave:int test_wave:int",
       f"with w as (select unnest({[*WAVES, 2002]}) as wave) select a.wave as train_wave, b.wave as test_wave from w a cross join w b where not exists (select 1 from grid_table g where g.train_wave = a.wave and g.test_wave = b.wave)")
def _(t):
    return verify.missing_cells(the_grid(t), (*WAVES, 2002))


@query("row_count_check", "n_rows:long passed:bool", "select count(*) n_rows, count(*) >= 2 as passed from grid_table")
def _(t):
    return verify.row_count_check(the_grid(t), 2)


@query("expected_count_check", "wave:int expected_n:long n:long passed:bool",
       "with e(wave, expected_n) as (values (1995, 1777), (1996, 1752), (1997, 1788), (1998, 1704), (1999, 1802), (2000, 1841), (2001, 1), (2002, 5)), c as (select wave, count(*) n from analytic group by wave) "
       "select coalesce(e.wave, c.wave) as wave, expected_n, n, coalesce(n = expected_n, false) as passed from e full outer join c on e.wave = c.wave")
def _(t):
    want = {1995: 1777, 1996: 1752, 1997: 1788, 1998: 1704, 1999: 1802, 2000: 1841, 2001: 1, 2002: 5}
    return verify.expected_counts(t.analytic.groupBy("wave").agg(F.count("*").alias("n")), want)


@query("documented_vs_run", "test_wave:int auc:double documented:double difference:double ok:bool",
       "select r.test_wave, r.auc, s.auc documented, r.auc - s.auc as difference, abs(r.auc - s.auc) < 0.003e0 as ok from rolling_auc r join rolling_auc s on r.test_wave = s.test_wave where r.strategy = 'rolling' and s.strategy = 'single'")
def _(t):
    both = the_rolling(t)
    return verify.documented_vs_run(
        both.filter(F.col("strategy") == "rolling"), both.filter(F.col("strategy") == "single"), ["test_wave"]
    )
