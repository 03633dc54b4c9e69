"""Schema resolution, wave files and streams on a name-drift variant of the respondents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.codes import CATALOGUE, FAMILIES, PER_WAVE
from tidegauge.operators import clean, resolve
from tidegauge.registry import scoring  # noqa: F401  (curve relations used below)
from tidegauge.registry.base import query
from tidegauge.registry.cleaning import CLEAN_COLS
from tidegauge.registry.inputs import CTES, WAVES, clean_select
from tidegauge.session import attach, local_rows, new_folder
from tidegauge.sources import manifest, waves
from tidegauge.streaming import incremental


def header(wave: int) -> dict[str, str]:
    """Physical name -> answer column, in file order."""
    cols = {"row_id": "row_id"}
    if wave != 1995:
        cols["WRKSTATWK2"] = "employment"
    if wave == 1996:
        cols["WRKHRSUS2"] = "education"  # a second hit of the hours family, earlier in the file
    cols |= {"IRSEX": "sex", "CATAGE": "age", "IRMARIT": "marital"}
    cols["EDUHIGHCAT" if wave <= 1999 else "IREDUHIGHST2"] = "education"
    cols |= {"INCOME": "income", "IRINSUR4": "health_insurance"}
    cols["MILSTAT" if wave <= 2000 else "SERVICE"] = "military"
    cols["ILLYR" if wave <= 1998 else "IRILLYR"] = "drug_use"
    cols[{1995: "TXEVRRCVD2", 1998: "AMHTXRC3", 2000: "MHTRTPY"}[max(k for k in (1995, 1998, 2000) if k <= wave)]] = "mental_health_tx"
    cols |= {"SEXIDENT": "sexual_orientation", "HEALTH": "overall_health"}
    if wave <= 2000:
        cols["WRKSICKMO" if wave <= 1997 else "WRKSICKDY"] = "sick_days"
    cols |= {"BOOKED": "criminal", "WRKDHRSWK2": "work_hours"}
    cols["K6SCMON" if wave <= 1998 else "K6SCYR"] = "k6_score"
    cols["SUICTHNK" if wave <= 1997 else "MHSUITHK"] = "suicide"
    return cols | {"VESTR": "strat", "VEREP": "psu", "ANALWT_C": "wgt"}


def frames(t) -> dict[int, DataFrame]:
    """One frame per wave under its own names; the later outcome is coded 1/0."""
    out = {}
    for w in WAVES:
        rows = t.raw.filter(F.col("wave") == w)
        if w > 1997:
            rows = rows.withColumn("suicide", F.when(F.col("suicide") == 2, 0).otherwise(F.col("suicide")))
        out[w] = rows.select(*[F.col(src).alias(name) for name, src in header(w).items()])
    return out


def present(t) -> DataFrame:
    """(wave, name, n_present) of every physical column."""
    out = None
    for w, df in frames(t).items():
        counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).unpivot([], df.columns, "name", "n_present")
        part = counts.withColumn("wave", F.lit(w))
        out = part if out is None else out.unionByName(part)
    return out


def columns(t) -> DataFrame:
    return resolve.header_table(t.spark, {w: list(header(w)) for w in WAVES})


def with_counts(t, resolved: DataFrame) -> DataFrame:
    return resolved.join(present(t).withColumnRenamed("name", "physical"), ["wave", "physical"])


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(v) if not isinstance(v, str) else "'" + v + "'" for v in r) + ")" for r in rows)


CTES["header"] = "select * from (values " + _values(
    (w, name, i, src) for w in WAVES for i, (name, src) in enumerate(header(w).items())
) + ") as h(wave, name, pos, src)"
CTES["aliases"] = "select * from (values " + _values(
    (k, a, i) for k, names in CATALOGUE.items() for i, a in enumerate(names)
) + ") as a(logical, alias, priority)"
CTES["name_families"] = "select * from (values " + _values(FAMILIES.items()) + ") as f(logical, pattern)"
_SRC = sorted({s for w in WAVES for s in header(w).values()})
CTES["present"] = "select h.wave, h.name as physical, c.n_present from header h join (" + " union all ".join(
    f"select wave, '{s}' as src, count({s}) as n_present from raw group by wave" for s in _SRC
) + ") as c on h.wave = c.wave and h.src = c.src"
CTES["alias_hits"] = "select wave, logical, arg_min(name, priority) as physical from header join aliases on name = alias group by wave, logical"
CTES["family_hits"] = "select wave, logical, arg_min(name, pos) as physical from header join name_families on regexp_matches(name, '^(?:' || pattern || ')', 'i') group by wave, logical"
CTES["resolved"] = "select * from family_hits union all select * from alias_hits where logical not in (select logical from name_families)"
_PER_WAVE = "(" + ", ".join(f"'{p}'" for p in PER_WAVE) + ")"
CTES["winners"] = f"""select logical, physical, n_waves from (select logical, physical, count(*) as n_waves,
  row_number() over (partition by logical order by count(*) desc, max(wave) desc) as rn from resolved where logical not in {_PER_WAVE} group by logical, physical) as w where rn = 1"""
CTES["cascade"] = f"""select wave, logical, physical, rule from (select *, row_number() over (partition by wave, logical order by rank) as rn from (
  select wave, logical, physical, 'override' as rule, 0 as rank from resolved where logical in {_PER_WAVE}
  union all select h.wave, w.logical, w.physical, 'winner', 1 from winners w join header h on h.name = w.physical
  union all select wave, logical, physical, 'alias', 2 from alias_hits) as u) as k where rn = 1"""

RES = "wave:int logical:string physical:string n_present:long"


@query("alias_resolution", RES, "select a.*, n_present from alias_hits a join present p on a.wave = p.wave and a.physical = p.physical")
def _(t):
    return with_counts(t, resolve.by_alias(columns(t), resolve.alias_table(t.spark)))


@query("family_resolution", RES, "select a.*, n_present from family_hits a join present p on a.wave = p.wave and a.physical = p.physical")
def _(t):
    return with_counts(t, resolve.by_family(columns(t)))


@query("missing_variable_report", "wave:int n_found:int missing:string n_rows:long",
       """with l as (select distinct logical from aliases), n as (select wave, count(*) n_rows from raw group by wave),
       w as (select wave, logical, exists(select 1 from resolved r where r.wave = n.wave and r.logical = l.logical) as hit from n cross join l)
       select w.wave, count(case when hit then 1 end) n_found, coalesce(string_agg(case when not hit then logical end, ',' order by logical), '') as missing, max(n_rows) n_rows from w join n on n.wave = w.wave group by w.wave""")
def _(t):
    cols = columns(t)
    resolved = resolve.resolve(cols, resolve.alias_table(t.spark))
    report = resolve.missing_report(resolved, resolve.logical_table(t.spark), cols)
    return report.join(t.raw.groupBy("wave").agg(F.count("*").alias("n_rows")), "wave")


@query("canonical_choice", "logical:string physical:string n_waves:long n_present:long",
       "select w.logical, w.physical, n_waves, sum(n_present) n_present from winners w join present p on p.physical = w.physical group by all")
def _(t):
    chosen = resolve.canonical_choice(resolve.resolve(columns(t), resolve.alias_table(t.spark)))
    counts = present(t).groupBy(F.col("name").alias("physical")).agg(F.sum("n_present").alias("n_present"))
    return chosen.join(counts, "physical")


@query("wave_overrides", RES, f"select r.*, n_present from resolved r join present p on r.wave = p.wave and r.physical = p.physical where logical in {_PER_WAVE}")
def _(t):
    return with_counts(t, resolve.wave_overrides(resolve.resolve(columns(t), resolve.alias_table(t.spark))))


def cascade(t) -> DataFrame:
    cols, aliases = columns(t), resolve.alias_table(t.spark)
    return resolve.mapping_table(cols, aliases, resolve.resolve(cols, aliases))


@query("resolution_cascade", RES + " rule:string", "select c.*, n_present from cascade c join present p on c.wave = p.wave and c.physical = p.physical")
def _(t):
    return with_counts(t, cascade(t))


# the drifting files cleaned: no employment in the first wave, no sick days in the last
CTES["drift_clean"] = (
    "select * replace (case when wave = 1995 then case when work_hours > 0 then 1 end else employment end as employment, "
    "case when wave = 2001 then null else sick_days end as sick_days) from (" + clean_select("raw") + ") as c"
)


@query("cleaned_drifting_waves", CLEAN_COLS, "select * from drift_clean")
def _(t):
    """Resolve, recode and union all waves."""
    return waves.load_clean(t.spark, frames(t))


def scratch(t, name: str) -> str:
    """A new folder below the cluster's shared folder."""
    return new_folder(t.spark, name)


def write_wave_files(t) -> dict[int, str]:
    folder = scratch(t, "waves")
    paths = waves.wave_paths(folder, WAVES)
    for w, df in frames(t).items():
        df.write.option("sep", "\t").option("header", True).csv(paths[w])
    return paths


@query("wave_file_scan", CLEAN_COLS, "select * from drift_clean")
def _(t):
    """The same through tab-separated files on disk."""
    return waves.load_clean(t.spark, waves.scan_waves(t.spark, write_wave_files(t)))


@query("pruned_wave_scan", "wave:int n:long hours:double",
       "select wave, count(*) n, sum(case when work_hours not in (85,89,94,97,98,99) then work_hours end) as hours from raw where wave <> 1996 group by wave")
def _(t):
    """Header first, then two columns; a listed wave without a file is skipped."""
    from tidegauge.functions.recode import numeric, skip_to_null

    paths = write_wave_files(t)
    del paths[1996]
    found = waves.scan_waves(t.spark, paths | {1890: paths[1995] + ".absent"})
    mapping = waves.resolve_frames(t.spark, found)
    out = None
    for w, df in found.items():
        part = df.select(F.lit(w).alias("wave"), skip_to_null(numeric(F.col(mapping[w]["work_hours"]))).alias("h"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("wave").agg(F.count("*").alias("n"), F.sum("h").alias("hours"))


@query("landed_wave_table", "wave:int n:long n_pos:long", "select wave, count(*) n, sum(y) n_pos from clean where wave >= 1999 group by wave")
def _(t):
    """Clean table stored once by wave; a study of three waves reads three partitions."""
    table = waves.land(t.clean, scratch(t, "clean"))
    return table.filter(F.col("wave") >= 1999).groupBy("wave").agg(F.count("*").alias("n"), F.sum("y").alias("n_pos"))


@query("union_of_waves", CLEAN_COLS, "select * from clean")
def _(t):
    """Bag union of per-wave frames."""
    out = None
    for w in WAVES:
        part = t.clean.filter(F.col("wave") == w)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


@query("fixed_output_schema", "wave:int n:long n_k6:long n_married:long",
       "select wave, count(*) n, count(case when wave <> 2001 then k6_score end) n_k6, count(married) n_married from clean group by wave")
def _(t):
    """Waves with different columns meet in one schema; what a wave lacks is null."""
    last = t.clean.filter(F.col("wave") == 2001).drop("k6_score")
    rest = t.clean.filter(F.col("wave") != 2001)
    both = rest.unionByName(last, allowMissingColumns=True)
    return both.groupBy("wave").agg(F.count("*").alias("n"), F.count("k6_score").alias("n_k6"), F.count("married").alias("n_married"))


@query("mapping_document", "wave:int logical:string physical:string n:long",
       "select m.wave, logical, physical, n from cascade m join (select wave, count(*) as n from clean group by wave) as c on c.wave = m.wave")
def _(t):
    """Mapping written as one JSON document, read back, with the rows of each wave."""
    from tidegauge.sources.sinks import mapping_to_json, write_document

    path = write_document(mapping_to_json(cascade(t)), scratch(t, "mapping"))
    doc = t.spark.read.text(path).select(F.from_json("value", "map<string, map<string, string>>").alias("d"))
    rows = doc.select(F.explode("d").alias("wave", "m")).select(F.col("wave").cast("int").alias("wave"), F.explode("m").alias("logical", "physical"))
    return rows.join(t.clean.groupBy("wave").agg(F.count("*").alias("n")), "wave")


@query("prediction_table_roundtrip", "row_id:long wave:int y:int model:string score:double", "select * from long_preds")
def _(t):
    from tidegauge.sources.sinks import read_predictions, write_table

    return read_predictions(t.spark, write_table(t.long_preds, scratch(t, "preds"), ["model"]))


@query("holdout_predictions_csv", "y_true:int n:long p_sum:double", "select y as y_true, count(*) n, sum(p_new) as p_sum from preds group by y", digits=6)
def _(t):
    from tidegauge.sources.sinks import write_holdout_csv

    path = write_holdout_csv(t.preds, scratch(t, "csv"), score="p_new")
    back = t.spark.read.option("header", True).schema("y_true int, p_hat double").csv(path)
    return back.groupBy("y_true").agg(F.count("*").alias("n"), F.sum("p_hat").alias("p_sum"))


@query("curve_documents", "wave:int n_points:long first_thr_missing:bool fpr_last:double",
       """with r as (select wave, fp/tot_n as fpr from pred_run where np is null or rn = 1 or p <> np or n <> nn)
       select wave, count(*) + 1 as n_points, true as first_thr_missing, max(fpr) fpr_last from r group by wave""")
def _(t):
    from tidegauge.operators.ranking import roc_curve
    from tidegauge.sources.sinks import curves_to_json

    docs = curves_to_json(roc_curve(t.preds, "p_new", "y", ["wave"]), ["wave"], per_document=200)
    folder = scratch(t, "curves")
    docs.write.partitionBy("wave", "part").text(folder)
    docs = t.spark.read.text(folder)
    d = F.from_json("value", "fpr array<double>, tpr array<double>, thr array<double>")
    return docs.select("wave", "part", d.alias("d")).groupBy("wave").agg(
        F.sum(F.size("d.fpr")).alias("n_points"),
        F.bool_or((F.col("part") == 0) & F.col("d.thr")[0].isNull()).alias("first_thr_missing"),
        F.max(F.array_max("d.fpr")).alias("fpr_last"),
    )


@query("metric_documents", "wave:int brier:double n:long", "select wave, avg((p_new-y)*(p_new-y)) as brier, count(*) n from preds group by wave")
def _(t):
    from tidegauge.operators.reclass import brier
    from tidegauge.sources.sinks import metrics_to_json, write_document

    path = write_document(metrics_to_json(brier(t.preds, "p_new", "y", ["wave"])), scratch(t, "metrics"))
    return t.spark.read.schema("wave int, brier double, n bigint").json(path)


@query("file_checksums", "path:string sha256:string")
def _(t):
    """SHA-256 inventory of the data folder."""
    return manifest.checksums(t.spark, t.path, "*.parquet")


@query("checksum_drift", "path:string sha256:string previous:string")
def _(t):
    """Inventory against an earlier one in which the part table had another hash."""
    now = manifest.checksums(t.spark, t.path, "*.parquet")
    old = now.withColumn("sha256", F.when(F.col("path").endswith("/part.parquet"), F.lit("0")).otherwise(F.col("sha256")))
    path = manifest.write_manifest(old, scratch(t, "manifest"))
    return manifest.drift(now, manifest.read_manifest(t.spark, path))


NEEDED = ("wave", "y", "k6_score", "income", "region")


@query("required_columns", "name:string present:bool n_values:long",
       " union all ".join(
           f"select '{c}' as name, true as present, count({c}) as n_values from clean" if c != "region" else f"select '{c}', false, cast(0 as bigint)"
           for c in NEEDED
       ))
def _(t):
    """Which needed columns a table has, and their filled values; a table that lacks one is refused."""
    from tidegauge.operators.resolve import has_columns, require_columns

    have = [c for c in NEEDED if has_columns(t.clean, [c])]
    require_columns(t.clean, have)
    counts = t.clean.agg(*[F.count(c).alias(c) for c in have]).unpivot([], have, "name", "n_values").withColumn("present", F.lit(True))
    absent = [(c, False, 0) for c in NEEDED if c not in have]
    return counts.unionByName(local_rows(t.spark, absent, "name string, present boolean, n_values long"))


@query("required_outputs", "name:string found:bool n_waves:long",
       "select 'clean' as name, true as found, count(distinct wave) as n_waves from clean union all select 'grid', false, count(distinct wave) from clean")
def _(t):
    from tidegauge.operators.verify import required_outputs
    from tidegauge.sources.artifacts import table_exists

    folder = scratch(t, "outputs")
    table = waves.land(t.clean, f"{folder}/clean")
    names = ["clean", "grid"]
    report = required_outputs(t.spark, [n for n in names if table_exists(t.spark, f"{folder}/{n}")], names)
    return attach(report, table.agg(F.count_distinct("wave").alias("n_waves")), [])


@query("stored_result_reuse", "wave:int n:long n_pos:long pct:double",
       "select wave, count(*) as n, sum(y) as n_pos, 100*sum(y)/count(*) as pct from analytic group by wave")
def _(t):
    """The second call reads the stored table; its compute step would fail if it ran."""
    from tidegauge.operators.profile import prevalence
    from tidegauge.sources.artifacts import stored_or_computed

    path = scratch(t, "prevalence")
    stored_or_computed(t.spark, path, lambda: prevalence(t.analytic))

    def refuse():
        raise AssertionError("stored table was not used")

    return stored_or_computed(t.spark, path, refuse)


@query("semi_join_on_keys", "row_id:long y:int", "select row_id, y from preds where row_id in (select row_id from clean where k6_score >= 12)")
def _(t):
    kept = t.clean.filter(F.col("k6_score") >= 12).select("row_id")
    return t.preds.select("row_id", "y").join(kept, "row_id", "left_semi")


# ---- streams ------------------------------------------------------------------------------------

def run_stream(q) -> None:
    q.awaitTermination()


@query("streaming_wave_cleaning", CLEAN_COLS, "select * from clean")
def _(t):
    """File stream of respondents in several batches through the batch recode, appended per batch."""
    schema = t.raw.schema
    stream = incremental.file_stream(t.spark, t.raw_folder, schema, max_files=24)
    out = scratch(t, "stream")
    run_stream(incremental.append_clean(stream, clean.recode, f"{out}/rows", f"{out}/state"))
    return t.spark.read.parquet(f"{out}/rows")


EVENT_P = "least(value / cast(100 as double), cast(1 as double))"


def events(t) -> DataFrame:
    schema = t.table("events").schema
    stream = incremental.file_stream(t.spark, t.path, schema, "events.parque[t]")  # a glob may match a file or a folder
    return stream.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").alias("outcome"), F.expr(EVENT_P).alias("score"))


@query("streaming_prevalence", "day:string n:long n_pos:long",
       "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*) n, count(case when event_type='purchase' then 1 end) n_pos from events group by 1")
def _(t):
    out = scratch(t, "stream")
    aggs = incremental.prevalence_aggs(F.col("outcome"))
    run_stream(incremental.write_counts(events(t), "ts", "1 day", aggs, f"{out}/rows", f"{out}/state"))
    return incremental.merged(t.spark, f"{out}/rows", ["window_start"]).withColumn("day", F.date_format("window_start", "yyyy-MM-dd"))


@query("streaming_score_monitor", "day:string tp:long fp:long fn:long tn:long brier:double",
       f"""with e as (select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, {EVENT_P} as s, cast(event_type='purchase' as integer) as y from events)
       select day, count(case when s >= 0.5e0 and y=1 then 1 end) tp, count(case when s >= 0.5e0 and y=0 then 1 end) fp, count(case when s < 0.5e0 and y=1 then 1 end) fn,
       count(case when s < 0.5e0 and y=0 then 1 end) tn, avg((s-y)*(s-y)) brier from e group by day""")
def _(t):
    out = scratch(t, "stream")
    aggs = incremental.monitor_aggs(F.col("score"), F.col("outcome"), 0.5)
    run_stream(incremental.write_counts(events(t), "ts", "1 day", aggs, f"{out}/rows", f"{out}/state"))
    sums = incremental.merged(t.spark, f"{out}/rows", ["window_start"])
    brier = F.col("squared_error") / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return sums.select("*", F.date_format("window_start", "yyyy-MM-dd").alias("day"), brier.alias("brier"))


@query("streaming_grid_auc", "auc:double n_positive:long n_total:long",
       f"""with e as (select {EVENT_P} as p, event_type, floor({EVENT_P}*1000) as g from events),
       c as (select case when (g+1)*(1.0e0/1000) <= p then g+1 when g*(1.0e0/1000) <= p then g else g-1 end as s, cast(count(case when event_type='purchase' then 1 end) as double) p, cast(count(case when event_type<>'purchase' then 1 end) as double) n from e group by 1)
       select sum(p*(b+n/2))/(sum(p)*sum(n)) as auc, sum(p) n_positive, sum(p+n) n_total from (select *, coalesce(sum(n) over (order by s rows between unbounded preceding and 1 preceding),0) b from c) as r""", digits=6)
def _(t):
    """AUC of a stream at grid resolution from running cell counts."""
    from tidegauge.operators.ranking import auc_from_counts
    from tidegauge.operators.thresholds import FINE

    out = scratch(t, "stream")
    cell, aggs = incremental.grid_count_aggs(F.col("score"), F.col("outcome"), FINE)
    rows = events(t).withColumn("cell", cell)
    run_stream(incremental.write_counts(rows, "ts", "1 day", aggs, f"{out}/rows", f"{out}/state", ["cell"]))
    counts = incremental.merged(t.spark, f"{out}/rows", ["cell"]).select(F.col("cell").cast("double").alias("score"), "pos", "neg")
    return auc_from_counts(counts)
