"""Recodes, filters and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import recode as rc
from tidegauge.functions.codes import LADDER
from tidegauge.operators import clean, prep, profile
from tidegauge.registry.base import query

CLEAN_COLS = (
    "row_id:long wave:int employment:double y:double male:double married:double lgbtq:double "
    "veteran:double drug_use:double mental_health_tx:double criminal:double k6_score:double "
    "work_hours:double sick_days:double income:double education:double age:double "
    "overall_health:double health_insurance:double"
)


@query(
    "prevalence_by_wave", "wave:int n:long n_pos:long pct:double",
    "select wave, count(*) as n, sum(y) as n_pos, 100*sum(y)/count(*) as pct from analytic group by wave",
)
def _(t):
    return profile.prevalence(t.analytic)


@query("clean_table", CLEAN_COLS, "select * from clean")
def _(t):
    return t.clean


@query(
    "binary_recode", "wave:int n_suicide:long n_drug:long n_tx:long n_criminal:long s_suicide:long s_drug:long s_tx:long s_criminal:long",
    """select wave, count(y) n_suicide, count(drug_use) n_drug, count(mental_health_tx) n_tx, count(criminal) n_criminal,
    sum(y) s_suicide, sum(drug_use) s_drug, sum(mental_health_tx) s_tx, sum(criminal) s_criminal from clean group by wave""",
)
def _(t):
    coded = t.raw.select(
        "wave",
        rc.binary(F.col("suicide")).alias("suicide"),
        rc.binary(F.col("drug_use")).alias("drug"),
        rc.binary(F.col("mental_health_tx")).alias("tx"),
        rc.binary(F.col("criminal")).alias("criminal"),
    )
    names = ("suicide", "drug", "tx", "criminal")
    return coded.groupBy("wave").agg(
        *[F.count(c).alias(f"n_{c}") for c in names], *[F.sum(c).alias(f"s_{c}") for c in names]
    )


@query(
    "skip_code_nulling", "feature:string n_raw:long n_kept:long total:long",
    " union all ".join(
        f"select '{c}' as feature, count({c}) as n_raw, "
        f"count(case when {c} not in (85,89,94,97,98,99) then 1 end) as n_kept, "
        f"sum(case when {c} not in (85,89,94,97,98,99) then {c} end) as total from raw"
        for c in ("k6_score", "work_hours", "sick_days", "income", "education", "age", "overall_health")
    ),
)
def _(t):
    names = ["k6_score", "work_hours", "sick_days", "income", "education", "age", "overall_health"]
    pairs = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("feature"),
                    F.col(c).cast("double").alias("r"),
                    rc.skip_to_null(F.col(c)).alias("k"),
                )
                for c in names
            ]
        )
    ).alias("p")
    return t.raw.select(pairs).groupBy("p.feature").agg(
        F.count("p.r").alias("n_raw"), F.count("p.k").alias("n_kept"), F.sum("p.k").alias("total")
    )


@query(
    "equality_flags", "sex:int marital:int male:double married:double n:long",
    """select sex, marital, case when sex = 1 then 1 else 0 end as male,
    case when marital in (85,89,94,97,98,99) then null when marital = 1 then 1 else 0 end as married, count(*) n
    from raw group by all""",
)
def _(t):
    return t.raw.groupBy("sex", "marital").agg(F.count("*").alias("n")).select(
        "sex", "marital", rc.equals_flag(F.col("sex"), 1).alias("male"),
        rc.married_flag(F.col("marital")).alias("married"), "n",
    )


@query(
    "orientation_map", "sexual_orientation:int lgbtq:double n:long",
    """select sexual_orientation, case sexual_orientation when 94 then null when 1 then 0 when 2 then 1 when 3 then 1
    else sexual_orientation end as lgbtq, count(*) as n from raw group by all""",
)
def _(t):
    return t.raw.groupBy("sexual_orientation").agg(F.count("*").alias("n")).withColumn(
        "lgbtq", rc.orientation_flag(F.col("sexual_orientation"))
    )


@query(
    "veteran_flag", "military:int veteran:double n:long",
    """select military, case when military in (85,94,97,98) then null when military in (2,3) then 1 else 0 end as veteran,
    count(*) as n from raw group by all""",
)
def _(t):
    return t.raw.groupBy("military").agg(F.count("*").alias("n")).withColumn(
        "veteran", rc.veteran_flag(F.col("military"))
    )


@query(
    "age_midpoints", "wave:int age:double n:long",
    """with top as (select wave, max(age) as top from analytic group by wave)
    select a.wave, case when top <= 6 then case a.age when 1 then 14.5 when 2 then 21.5 when 3 then 30 when 4 then 42
      when 5 then 57 when 6 then 72.5 end else null end as age, count(*) as n
    from analytic a join top on a.wave = top.wave group by all""",
)
def _(t):
    return clean.rolling_age(t.analytic).groupBy("wave", "age").agg(F.count("*").alias("n"))


@query(
    "age_midpoints_long_coding", "age_code:double age:double n:long",
    """with coded as (select row_id % 17 + 1 as age_code from clean)
    select age_code, case when age_code = 12 then 27.5 when age_code <= 10 then age_code + 11
      else cast(list_extract([23, 27.5, 32, 37, 42, 52, 62], cast(age_code - 10 as integer)) as double) end as age,
      count(*) n from coded group by all""",
)
def _(t):
    code = (F.col("row_id") % 17 + 1).cast("double")
    coded = t.clean.select("wave", code.alias("age"), code.alias("age_code"))
    return clean.rolling_age(coded).groupBy("age_code", "age").agg(F.count("*").alias("n"))


@query(
    "age_bands", "age:double band_a:string band_b:string band_c:string n:long",
    """select age,
    case when age between 0 and 2 then '18‑25' when age > 2 and age <= 5 then '26‑49' when age > 5 and age <= 100 then '50+' end as band_a,
    case when age in (1,2) then '18–25' when age in (3,4) then '26–49' when age in (5,6) then '50+' end as band_b,
    case when age <= 2 then '18‑25' when age between 3 and 5 then '26‑49' when age >= 6 then '50+' end as band_c,
    count(*) as n from clean group by all""",
)
def _(t):
    return t.clean.groupBy("age").agg(F.count("*").alias("n")).select(
        "age", rc.age_band_a(F.col("age")).alias("band_a"), rc.age_band_b(F.col("age")).alias("band_b"),
        rc.age_band_c(F.col("age")).alias("band_c"), "n",
    )


@query(
    "employment_fallback", "wave:int n:long n_employed:long",
    """with masked as (select wave, case when wave = 1995 then null else employment end as employment, work_hours from clean)
    select wave, count(*) n, count(case when (case when wave = 1995 then work_hours > 0 else employment = 1 end) then 1 end) as n_employed
    from masked group by wave""",
)
def _(t):
    """The first wave has no employment answer: inferred from hours."""
    masked = t.clean.withColumn("employment", F.when(F.col("wave") != 1995, F.col("employment")))
    return clean.infer_employment(masked).groupBy("wave").agg(
        F.count("*").alias("n"), F.count_if(F.col("employment") == 1).alias("n_employed")
    )


@query(
    "population_filter", "wave:int n_all:long n_employed:long n_analytic:long",
    """select wave, count(*) n_all, count(case when employment = 1 then 1 end) n_employed,
    count(case when employment = 1 and y in (0,1) then 1 end) n_analytic from clean group by wave""",
)
def _(t):
    from tidegauge.operators.cells import analytic

    everyone = t.clean.groupBy("wave").agg(
        F.count("*").alias("n_all"), F.count_if(F.col("employment") == 1).alias("n_employed")
    )
    return everyone.join(
        analytic(t.clean).groupBy("wave").agg(F.count("*").alias("n_analytic")), "wave"
    )


@query(
    "outcome_filter_all_adults", "wave:int n:long n_pos:long",
    "select wave, count(*) n, sum(y) n_pos from clean where y in (0,1) group by wave",
)
def _(t):
    from tidegauge.operators.cells import analytic

    return analytic(t.clean, employed_only=False).groupBy("wave").agg(
        F.count("*").alias("n"), F.sum("y").alias("n_pos")
    )


@query(
    "estimability_guards", "wave:int n_pos:long n_features:long estimable:bool",
    """select wave, cast(sum(y) as bigint) as n_pos,
    cast(count(male) > 0 as integer) + cast(count(age) > 0 as integer) + cast(count(veteran) > 0 as integer)
      + cast(count(drug_use) > 0 as integer) + cast(count(work_hours) > 0 as integer) as n_features,
    sum(y) >= 10 as estimable from analytic group by wave""",
)
def _(t):
    from tidegauge.plans.guards import estimable

    return estimable(t.analytic, ("male", "age", "veteran", "drug_use", "work_hours"))


@query("complete_case_filter", "wave:int n:long", """select wave, count(*) n from analytic
  where k6_score is not null and male is not null and age is not null and married is not null and lgbtq is not null
  and veteran is not null and drug_use is not null and mental_health_tx is not null and work_hours is not null group by wave""")
def _(t):
    from tidegauge.functions.codes import FULL9

    return clean.complete_cases(t.analytic, FULL9).groupBy("wave").agg(F.count("*").alias("n"))


@query(
    "logit_transform", "row_id:long logit_new:double logit_old:double",
    """select row_id, ln((p_new + 1e-12)/(1 - p_new + 1e-12)) as logit_new, ln((p_old + 1e-12)/(1 - p_old + 1e-12)) as logit_old from preds""",
)
def _(t):
    return t.preds.select(
        "row_id", rc.logit(F.col("p_new")).alias("logit_new"), rc.logit(F.col("p_old")).alias("logit_old")
    )


@query(
    "threshold_flag", "wave:int y:int flag:int n:long",
    "select wave, y, cast(p_new >= 0.3e0 as integer) as flag, count(*) n from preds group by all",
)
def _(t):
    return t.preds.groupBy("wave", "y", rc.flag_at(F.col("p_new"), 0.3).alias("flag")).agg(
        F.count("*").alias("n")
    )


@query(
    "interaction_columns", "wave:int n_drug_tx:long s_drug_tx:double n_age_hours:long s_age_hours:double",
    """select wave, count(drug_use*mental_health_tx) n_drug_tx, sum(drug_use*mental_health_tx) s_drug_tx,
    count(age*work_hours) n_age_hours, sum(age*work_hours) s_age_hours from analytic group by wave""",
)
def _(t):
    a = t.analytic.select(
        "wave",
        rc.interaction(F.col("drug_use"), F.col("mental_health_tx")).alias("a"),
        rc.interaction(F.col("age"), F.col("work_hours")).alias("b"),
    )
    return a.groupBy("wave").agg(
        F.count("a").alias("n_drug_tx"), F.sum("a").alias("s_drug_tx"),
        F.count("b").alias("n_age_hours"), F.sum("b").alias("s_age_hours"),
    )


@query(
    "raw_prevalence", "wave:int n_yes:long n_no:long prevalence:double",
    """select wave, count(case when suicide=1 then 1 end) n_yes, count(case when suicide=2 then 1 end) n_no,
    count(case when suicide=1 then 1 end)/count(case when suicide in (1,2) then 1 end) as prevalence from raw group by wave""",
)
def _(t):
    return profile.raw_prevalence(t.raw, "suicide")


@query(
    "employment_share", "wave:int n_employed:long share:double",
    "select wave, count(case when employment=1 then 1 end) n_employed, count(case when employment=1 then 1 end)/count(*) as share from raw group by wave",
)
def _(t):
    return profile.employment_share(t.raw)


VALUE_FEATURES = ("y", "k6_score", "male", "age", "drug_use", "mental_health_tx", "veteran", "lgbtq", "married")
_COUNTS = " union all ".join(
    f"select '{c}' as feature, cast({c} as double) as value, count(*) as n from clean group by {c}" for c in VALUE_FEATURES
)


@query(
    "value_counts_by_frequency", "feature:string rank:int value:double n:long",
    f"""with c as ({_COUNTS}) select * from (select feature, value, n,
    row_number() over (partition by feature order by n desc, value nulls last) as rank from c) where rank <= 10""",
)
def _(t):
    return profile.value_counts(t.clean, VALUE_FEATURES)


@query(
    "value_counts_by_value", "feature:string rank:int value:double n:long",
    f"""with c as ({_COUNTS}) select * from (select feature, value, n,
    row_number() over (partition by feature order by value nulls last) as rank from c) where rank <= 10""",
)
def _(t):
    return profile.value_counts(t.clean, VALUE_FEATURES, order="value")


@query(
    "null_rates", "feature:string null_rate:double",
    " union all ".join(
        f"select '{c}' as feature, avg(case when {c} is null then 1.0e0 else 0.0e0 end) as null_rate from clean"
        for c in VALUE_FEATURES
    ),
)
def _(t):
    return profile.null_rates(t.clean, VALUE_FEATURES)


def _funnel_sql() -> str:
    stages = {"all": "true", "employed": "employment = 1", "with_outcome": "employment = 1 and y is not null"}
    for name, (features, _) in LADDER.items():
        stages[name] = stages["with_outcome"] + "".join(f" and {f} is not null" for f in features)
    return " union all ".join(
        f"select wave, '{k}' as stage, count(case when {v} then 1 end) as n from clean group by wave"
        for k, v in stages.items()
    )


@query("sample_funnel", "wave:int stage:string n:long", _funnel_sql())
def _(t):
    return profile.funnel(t.clean, {k: v[0] for k, v in LADDER.items()}, by=["wave"])


@query(
    "feature_availability", "wave:int feature:string n_present:long",
    " union all ".join(
        f"select wave, '{c}' as feature, count(case when not (wave = 2001 and '{c}' = 'k6_score') then {c} end) as n_present from clean group by wave"
        for c in ("k6_score", "male", "age", "married", "lgbtq", "veteran", "drug_use", "mental_health_tx", "work_hours")
    ),
)
def _(t):
    from tidegauge.functions.codes import FULL9

    masked = t.clean.withColumn("k6_score", F.when(F.col("wave") != 2001, F.col("k6_score")))
    return prep.availability(masked, FULL9)


@query(
    "availability_report", "wave:int n_available:long n_template:long missing:string",
    "with f as (" + " union all ".join(
        f"select wave, '{c}' as feature, count(case when not (wave = 2001 and '{c}' = 'k6_score') then {c} end) as n from clean group by wave"
        for c in ("k6_score", "male", "age", "married", "lgbtq", "veteran", "drug_use", "mental_health_tx", "work_hours")
    ) + """) select wave, count(case when n > 0 then 1 end) as n_available, count(*) as n_template,
    coalesce(string_agg(case when n = 0 then feature end, ',' order by feature), '') as missing from f group by wave""",
)
def _(t):
    from tidegauge.functions.codes import FULL9

    masked = t.clean.withColumn("k6_score", F.when(F.col("wave") != 2001, F.col("k6_score")))
    return prep.availability_report(masked, FULL9)


@query(
    "gated_features", "feature:string n_present:long",
    "with f as (select * from clean where wave = 2001) select 'age' as feature, count(age) as n_present from f "
    "union all select 'male', count(male) from f union all select 'work_hours', count(work_hours) from f",
)
def _(t):
    """Features of the last wave that survive the availability gate (the other two are blanked)."""
    last = t.clean.filter(F.col("wave") == 2001).withColumns(
        {c: F.lit(None).cast("double") for c in ("veteran", "drug_use")}
    )
    from tidegauge.functions.codes import BASIC5

    names = prep.usable_features(last, BASIC5)
    return prep.availability(last, names).select("feature", "n_present")
