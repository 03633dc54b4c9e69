"""Confusion counts, curves, thresholds, subgroups and reclassification of scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions.codes import FIXED_SPEC_TARGET, HIGH_SPEC_TARGET, SENSITIVITY_BAND, SENSITIVITY_TARGET
from tidegauge.functions.rates import rate_columns
from tidegauge.operators import ranking, reclass, subgroups, thresholds
from tidegauge.registry.base import query
from tidegauge.registry.inputs import CTES


def counts_sql(source: str, score: str, by: str) -> str:
    lead = f"{by}, " if by else ""
    return (
        f"select {lead}{score} as s, cast(sum(y) as double) as p, cast(sum(1-y) as double) as n "
        f"from {source} group by all"
    )


def auc_sql(counts: str, by: str) -> str:
    """AUC select over a relation (by, s, p, n)."""
    part = f"partition by {by} " if by else ""
    lead = f"{by}, " if by else ""
    tail = f" group by {by}" if by else ""
    return (
        f"select {lead}case when sum(p)*sum(n) > 0 then sum(p*(b + n/2))/(sum(p)*sum(n)) end as auc, "
        f"sum(p) as n_positive, sum(p+n) as n_total from (select *, coalesce(sum(n) over ({part}order by s "
        f"rows between unbounded preceding and 1 preceding), 0) as b from {counts}) as ranked{tail}"
    )


# curve points by falling score, shared by several queries
CTES["pred_counts"] = counts_sql("preds", "p_new", "wave")
CTES["pred_run"] = """select wave, s, p, n,
  sum(p) over (partition by wave order by s desc rows between unbounded preceding and current row) as tp,
  sum(n) over (partition by wave order by s desc rows between unbounded preceding and current row) as fp,
  sum(p) over (partition by wave) as tot_p, sum(n) over (partition by wave) as tot_n,
  lead(p) over (partition by wave order by s desc) as np, lead(n) over (partition by wave order by s desc) as nn,
  row_number() over (partition by wave order by s desc) as rn from pred_counts"""


@query("auc_by_wave", "wave:int auc:double n_positive:long n_total:long", auc_sql("pred_counts", "wave"))
def _(t):
    return ranking.auc(t.preds, "p_new", "y", ["wave"])


@query(
    "auc_overall", "model:string auc:double n_positive:long n_total:long",
    "with c as (" + counts_sql("long_preds", "score", "model") + ") " + auc_sql("c", "model"),
)
def _(t):
    return ranking.auc(t.long_preds, "score", "y", ["model"])


@query(
    "auc_of_document_length", "auc:double n_positive:long n_total:long",
    "with j as (select cast(n_chars as double) as score, quality as y from documents join labels using (doc_id)), "
    "c as (" + counts_sql("j", "score", "") + ") " + auc_sql("c", ""),
)
def _(t):
    """Ungrouped form, on a natural outcome."""
    joined = t.table("documents").select("doc_id", F.col("n_chars").cast("double").alias("score")).join(
        t.table("labels").select("doc_id", F.col("quality").alias("y")), "doc_id"
    )
    return ranking.auc(joined, "score", "y")


@query(
    "confusion_at_threshold", "wave:int tp:long fp:long fn:long tn:long sens:double spec:double ppv:double npv:double",
    """with c as (select wave, count(case when p_new >= 0.3e0 and y=1 then 1 end) tp, count(case when p_new >= 0.3e0 and y=0 then 1 end) fp,
      count(case when p_new < 0.3e0 and y=1 then 1 end) fn, count(case when p_new < 0.3e0 and y=0 then 1 end) tn from preds group by wave)
    select wave, tp, fp, fn, tn, tp/(tp+fn) sens, tn/(tn+fp) spec, case when tp+fp > 0 then tp/(tp+fp) else 0 end ppv,
      case when tn+fn > 0 then tn/(tn+fn) else 0 end npv from c""",
)
def _(t):
    rates = rate_columns()
    return thresholds.confusion(t.preds, "p_new", "y", 0.3, ["wave"]).withColumns(rates)


@query(
    "rates_with_empty_groups", "threshold:double ppv_zero:double ppv_null:double npv_zero:double npv_null:double",
    """with t(threshold) as (values (0.0e0), (5.0e0)),
    c as (select threshold, count(case when p_new >= threshold and y=1 then 1 end) tp, count(case when p_new >= threshold and y=0 then 1 end) fp,
      count(case when p_new < threshold and y=1 then 1 end) fn, count(case when p_new < threshold and y=0 then 1 end) tn
      from preds cross join t group by threshold)
    select threshold, case when tp+fp > 0 then tp/(tp+fp) else 0 end ppv_zero, case when tp+fp > 0 then tp/(tp+fp) end ppv_null,
      case when tn+fn > 0 then tn/(tn+fn) else 0 end npv_zero, case when tn+fn > 0 then tn/(tn+fn) end npv_null from c""",
)
def _(t):
    """Both conventions for an empty denominator, at thresholds that accept all or nothing."""
    zero, null = rate_columns("zero"), rate_columns("null")
    out = None
    for thr in (0.0, 5.0):
        row = thresholds.confusion(t.preds, "p_new", "y", thr).select(
            F.lit(thr).alias("threshold"),
            *[r[k].alias(f"{k}_{n}") for n, r in (("zero", zero), ("null", null)) for k in ("ppv", "npv")],
        )
        out = row if out is None else out.unionByName(row)
    return out


def grid_sql(lo: str, delta: str, size: int, source: str = "preds", score: str = "p_new") -> str:
    """(wave, i, thr, tp, fp, fn, tn) by the direct definition: every score against every threshold."""
    return (
        f"select wave, i, {lo} + i*{delta} as thr, "
        f"cast(sum(case when s >= {lo} + i*{delta} then p else 0 end) as bigint) as tp, "
        f"cast(sum(case when s >= {lo} + i*{delta} then n else 0 end) as bigint) as fp, "
        f"cast(sum(case when s < {lo} + i*{delta} then p else 0 end) as bigint) as fn, "
        f"cast(sum(case when s < {lo} + i*{delta} then n else 0 end) as bigint) as tn "
        f"from pred_counts cross join (select cast(range as double) as i from range({size})) as g group by wave, i"
    )


RATES = "case when tp+fn > 0 then tp/(tp+fn) else 0 end as sens, case when tn+fp > 0 then tn/(tn+fp) else 0 end as spec"
STEP05 = "((0.0e0+0.05e0)-0.0e0)"
STEP01 = "((0.05e0+0.01e0)-0.05e0)"
DEC = "((0.99e0-0.01e0)/98)"
TEN = "((0.99e0-0.01e0)/9)"


@query(
    "threshold_sweep", "wave:int thr:double tp:long fp:long fn:long tn:long sens:double spec:double",
    f"with g as ({grid_sql('0.0e0', STEP05, 21)}) select *, {RATES} from g",
)
def _(t):
    return thresholds.sweep(t.preds, "p_new", "y", by=["wave"])


@query(
    "confusion_on_fine_grid", "wave:int i:int thr:double tp:long fp:long fn:long tn:long",
    grid_sql("0.0e0", "(1.0e0/1000)", 1001),
)
def _(t):
    return thresholds.grid_confusion(t.preds, "p_new", "y", thresholds.FINE, ["wave"])


def nearest_sql(grid: str, target: float) -> str:
    return f"""with g as ({grid}), r as (select *, {RATES},
      case when tp+fp > 0 then tp/(tp+fp) else 0 end as ppv, case when tn+fn > 0 then tn/(tn+fn) else 0 end as npv from g),
    k as (select *, row_number() over (partition by wave order by abs(spec - {target}e0), thr) as rn from r)
    select *, thr as threshold, tp+fp+fn+tn as n, 'test' as tuned_on from k where rn = 1"""


POINT = (
    "wave:int threshold:double sens:double spec:double ppv:double npv:double tp:long fp:long fn:long "
    "tn:long n:long tuned_on:string"
)


@query("nearest_specificity_threshold", POINT, nearest_sql(grid_sql("0.0e0", "(1.0e0/1000)", 1001), FIXED_SPEC_TARGET))
def _(t):
    return thresholds.nearest_specificity(t.preds, "p_new", "y", FIXED_SPEC_TARGET, by=["wave"])


@query("high_specificity_point", POINT, nearest_sql(grid_sql("0.05e0", STEP01, 86), HIGH_SPEC_TARGET))
def _(t):
    return thresholds.nearest_specificity(
        t.preds, "p_new", "y", HIGH_SPEC_TARGET, thresholds.HIGH_SPEC, ["wave"], default_thr=None
    )


@query(
    "target_sensitivity_scan", "wave:int thr:double sens:double spec:double near_target:bool",
    f"with g as ({grid_sql('0.01e0', TEN, 10)}), r as (select *, {RATES} from g) "
    f"select *, abs(sens - {SENSITIVITY_TARGET}e0) < {SENSITIVITY_BAND}e0 as near_target from r",
)
def _(t):
    return thresholds.sensitivity_scan(
        t.preds, "p_new", "y", SENSITIVITY_TARGET, SENSITIVITY_BAND, ["wave"]
    )


@query(
    "decision_curve", "wave:int thr:double net_benefit:double",
    f"with g as ({grid_sql('0.01e0', DEC, 99)}) select wave, thr, "
    "tp/(tp+fp+fn+tn) - fp/(tp+fp+fn+tn)*(thr/(1-thr)) as net_benefit from g",
)
def _(t):
    return thresholds.decision_curve(t.preds, "p_new", "y", ["wave"])


ROC_SQL = """select wave, fp/tot_n as fpr, tp/tot_p as tpr, s as thr from pred_run
  where np is null or rn = 1 or p <> np or n <> nn
  union all select distinct wave, 0.0e0, 0.0e0, cast(null as double) from pred_run"""


@query("roc_curve", "wave:int fpr:double tpr:double thr:double", ROC_SQL)
def _(t):
    return ranking.roc_curve(t.preds, "p_new", "y", ["wave"])


@query(
    "roc_curve_all_points", "wave:int fpr:double tpr:double thr:double",
    """select wave, fp/tot_n as fpr, tp/tot_p as tpr, s as thr from pred_run
    union all select distinct wave, 0.0e0, 0.0e0, cast(null as double) from pred_run""",
)
def _(t):
    return ranking.roc_curve(t.preds, "p_new", "y", ["wave"], drop_intermediate=False)


@query(
    "roc_trapezoid_area", "wave:int area:double",
    "with c as (" + auc_sql("pred_counts", "wave") + ") select wave, auc as area from c",
)
def _(t):
    return ranking.curve_area(t.preds, "p_new", "y", ["wave"])


@query(
    "precision_recall_curve", "wave:int thr:double precision:double recall:double",
    'select wave, s as thr, tp/(tp+fp) as "precision", tp/tot_p as recall from pred_run',
)
def _(t):
    return ranking.pr_curve(t.preds, "p_new", "y", ["wave"])


@query(
    "max_f1_threshold", "wave:int thr:double f1:double",
    """with f as (select wave, s, 2*tp/(tp+fp+tot_p) as f1 from pred_run)
    select wave, thr, f1 from (select wave, s as thr, f1, row_number() over (partition by wave order by f1 desc, s) as rn from f) where rn = 1""",
)
def _(t):
    return ranking.best_f1(t.preds, "p_new", "y", ["wave"])


QUANTS = (0.025, 0.25, 0.5, 0.75, 0.975)


@query(
    "score_quantiles", "model:string prob:double value:double",
    " union all ".join(f"select model, {q}e0 as prob, quantile_cont(score, {q}) as value from long_preds group by model" for q in QUANTS),
)
def _(t):
    return ranking.quantiles(t.long_preds, "score", QUANTS, ["model"])


@query(
    "reliability_curve", "wave:int bin:int mean_score:double observed:double n:long",
    """with e as (select wave, quantile_cont(p_new, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) as q from preds group by wave),
    b as (select p.wave, y, p_new, len(list_filter(q, lambda x: x < p_new)) as bin from preds p join e on p.wave = e.wave)
    select wave, bin, avg(p_new) mean_score, avg(y) observed, count(*) n from b group by wave, bin""",
)
def _(t):
    return reclass.reliability(t.preds, "p_new", "y", ["wave"])


@query("brier_score", "wave:int model:string brier:double n:long",
       "select wave, model, avg((score-y)*(score-y)) as brier, count(*) n from long_preds group by wave, model")
def _(t):
    return reclass.brier(t.long_preds, "score", "y", ["wave", "model"])


@query(
    "net_reclassification", "wave:int up_events:long down_events:long up_nonevents:long down_nonevents:long nri_standard:double nri_reference:double",
    """with c as (select wave, count(case when p_new > p_old and y=1 then 1 end) up_events, count(case when p_new < p_old and y=1 then 1 end) down_events,
      count(case when p_new > p_old and y=0 then 1 end) up_nonevents, count(case when p_new < p_old and y=0 then 1 end) down_nonevents,
      sum(y) n1, sum(1-y) n0 from preds group by wave)
    select *, (up_events-down_events)/n1 + (down_nonevents-up_nonevents)/n0 as nri_standard,
      (up_events-down_events)/n1 + (up_nonevents-down_nonevents)/n0 as nri_reference from c""",
)
def _(t):
    return reclass.nri(t.preds, "p_new", "p_old", "y", ["wave"])


@query(
    "integrated_discrimination", "wave:int idi:double",
    """select wave, (avg(case when y=1 then p_new end)-avg(case when y=0 then p_new end))
     - (avg(case when y=1 then p_old end)-avg(case when y=0 then p_old end)) as idi from preds group by wave""",
)
def _(t):
    return reclass.idi(t.preds, "p_new", "p_old", "y", ["wave"])


GROUPS = {
    "Female": "male = 0", "Male": "male = 1", "18–25": "age in (1,2)", "26–49": "age in (3,4)", "50+": "age in (5,6)",
}


def subgroup_sql(groups: dict[str, str], source: str, thr: str, extra: str = "") -> str:
    rows = " union all ".join(
        f"select {i} as pos, '{g}' as grp, p_new as s, y from {source} where {cond}"
        for i, (g, cond) in enumerate(groups.items())
    )
    return f"""with {extra}g as ({rows}), gc as (select grp, s, cast(sum(y) as double) p, cast(sum(1-y) as double) n from g group by all),
    a as ({auc_sql('gc', 'grp')}),
    m as (select pos, grp, count(*) n, sum(y) n_pos, count(case when s >= {thr} and y=1 then 1 end)/nullif(sum(y),0) sens,
      count(case when s < {thr} and y=0 then 1 end)/nullif(sum(1-y),0) spec, avg(y) prevalence from g group by pos, grp)"""


@query(
    "subgroup_table", "pos:int group:string n:long prevalence_pct:double auc:double sens_pct:double spec_pct:double",
    subgroup_sql(GROUPS, "preds", "0.18e0")
    + ' select m.pos, m.grp as "group", m.n, 100*prevalence as prevalence_pct, auc, 100*sens as sens_pct, 100*spec as spec_pct from m join a on m.grp = a.grp',
)
def _(t):
    return subgroups.sex_age_table(t.preds, "p_new")


YOUNG = {k: f"{v} and age <= 4" for k, v in GROUPS.items()}


@query(
    "subgroup_table_empty_band", "pos:int group:string n:long prevalence_pct:double auc:double sens_pct:double spec_pct:double",
    subgroup_sql(YOUNG, "preds", "0.18e0")
    + """ select m.pos, m.grp as "group", m.n, 100*prevalence as prevalence_pct, auc, 100*sens as sens_pct, 100*spec as spec_pct from m join a on m.grp = a.grp
    union all select 4, '50+', 0, null, null, null, null""",
)
def _(t):
    """A population without the oldest band keeps that band as an empty row."""
    return subgroups.sex_age_table(t.preds.filter(F.col("age") <= 4), "p_new")


AUDIT = {
    "Female": "male = 0", "Male": "male = 1", "Veteran": "veteran = 1", "Civilians": "veteran = 0",
    "LGBTQ": "lgbtq = 1", "Non-LGBTQ": "lgbtq = 0", "Age18-25": "age <= 2", "Age26-49": "age between 3 and 5",
    "Age50+": "age >= 6", "LowInc": "income <= q1", "HighInc": "income >= q3",
}


@query(
    "subgroup_audit", "group:string n:long n_pos:long auc:double sens:double spec:double",
    subgroup_sql(
        AUDIT, "cut", "0.5e0",
        "cut as (select p.*, q1, q3 from preds p cross join (select quantile_cont(income, 0.25) q1, quantile_cont(income, 0.75) q3 from preds) as q), ",
    )
    + ' select m.grp as "group", m.n, m.n_pos, auc, coalesce(sens,0) sens, coalesce(spec,0) spec from m join a on m.grp = a.grp where m.n >= 20',
)
def _(t):
    return subgroups.audit(t.preds, "p_new")


@query(
    "income_cut_points", "wave:int q25:double q75:double",
    "select wave, quantile_cont(income, 0.25) q25, quantile_cont(income, 0.75) q75 from preds group by wave",
)
def _(t):
    q = ranking.quantiles(t.preds, "income", [0.25, 0.75], ["wave"])
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("value")))
    return q.groupBy("wave").agg(at(0.25).alias("q25"), at(0.75).alias("q75"))


@query(
    "paired_curve_table", "wave:int idx:long fpr_new:double tpr_new:double fpr_old:double tpr_old:double",
    """with oc as (select wave, p_old as s, cast(sum(y) as double) as p, cast(sum(1-y) as double) as n from preds group by all),
    orun as (select wave, s, p, n, sum(p) over (partition by wave order by s desc rows between unbounded preceding and current row) as tp,
      sum(n) over (partition by wave order by s desc rows between unbounded preceding and current row) as fp,
      sum(p) over (partition by wave) as tot_p, sum(n) over (partition by wave) as tot_n,
      lead(p) over (partition by wave order by s desc) as np, lead(n) over (partition by wave order by s desc) as nn,
      row_number() over (partition by wave order by s desc) as rn from oc),
    ra as (select wave, fp/tot_n as fpr, tp/tot_p as tpr from pred_run where np is null or rn = 1 or p <> np or n <> nn union all select distinct wave, 0.0e0, 0.0e0 from pred_run),
    rb as (select wave, fp/tot_n as fpr, tp/tot_p as tpr from orun where np is null or rn = 1 or p <> np or n <> nn union all select distinct wave, 0.0e0, 0.0e0 from orun),
    na as (select *, row_number() over (partition by wave order by fpr, tpr) - 1 as idx from ra),
    nb as (select *, row_number() over (partition by wave order by fpr, tpr) - 1 as idx from rb)
    select coalesce(na.wave, nb.wave) as wave, coalesce(na.idx, nb.idx) as idx, na.fpr fpr_new, na.tpr tpr_new, nb.fpr fpr_old, nb.tpr tpr_old
    from na full outer join nb on na.wave = nb.wave and na.idx = nb.idx""",
)
def _(t):
    from tidegauge.sources.sinks import paired_curves

    return paired_curves(t.long_preds, "score", "y", "model", ["new", "old"], ["wave"])
