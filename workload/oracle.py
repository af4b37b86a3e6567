"""DuckDB SQL for the registered queries, over the same Parquet tables."""

from __future__ import annotations

# Fixed values, as in the library: bins, labels and thresholds.
AGE_BINS = [
    (30, "<30"), (40, "30-40"), (50, "40-50"), (55, "50-55"),
    (60, "55-60"), (65, "60-65"), (70, "65-70"), (100, ">70"),
]
RISK_STEPS = [(0.2, "Low Risk"), (0.4, "Moderate Risk"), (0.6, "High Risk")]
STRICT = [(0.1, "Low Risk"), (0.3, "Moderate Risk"), (0.5, "High Risk")]
CONFIDENCE_STEPS = [(0.2, "Very Low"), (0.4, "Low"), (0.6, "Medium"), (0.8, "High")]


def _age_group(age: str) -> str:
    bins = " ".join(f"when {age} <= {upper} then '{label}'" for upper, label in AGE_BINS)
    return f"case when {age} <= 0 then null {bins} end"


def _steps(value: str, steps: list, last: str) -> str:
    tests = " ".join(f"when {value} < {limit} then '{label}'" for limit, label in steps)
    return f"case {tests} else '{last}' end"


RISK = _steps("probability", RISK_STEPS, "Very High Risk")
CONFIDENCE = _steps("probability", CONFIDENCE_STEPS, "Very High")

PREDICTIONS = """
pr as (
  select event_id as id, user_id as patient_id, event_type as model_name,
         value / (value + 50.0) as probability,
         case when value / (value + 50.0) >= 0.5 then 1 else 0 end as prediction,
         cast(ts as timestamp) as created_at
  from events
)"""

PATIENTS = f"""
pa0 as (
  select c_custkey as id, cast(30 + c_custkey * 7 % 50 as int) as age,
         cast(c_nationkey % 2 as int) as sex,
         cast(90 + cast(floor(abs(c_acctbal)) as bigint) % 90 as int) as trestbps,
         cast(150 + (c_custkey * 31 + c_nationkey) % 150 as int) as chol,
         cast(60 + cast(floor(abs(c_acctbal)) as bigint) % 60 as int) as thalach,
         case when (cast(floor(abs(c_acctbal)) as bigint) + c_nationkey) % 5 < 3
              then 1 else 0 end as target,
         c_mktsegment as cp_type,
         case when c_custkey % 7 = 0 then 'Yes' else 'No' end as fbs,
         case c_custkey % 3 when 0 then 'normal' when 1 then 'abnormal' end as restecg_type,
         case when c_nationkey % 3 = 0 then 'Yes' else 'No' end as exang,
         cast(floor(abs(c_acctbal)) as bigint) % 63 as oldpeak,
         case when c_nationkey % 2 = 0 then 'up' else 'flat' end as slope_type,
         cast(c_custkey % 4 as int) as ca_count,
         case c_custkey % 5 when 0 then 'fixed' when 1 then 'reversible' end as thal_type
  from customer
), extremes as (
  select min(trestbps) as bp0, max(trestbps) as bp1, min(chol) as ch0, max(chol) as ch1,
         min(thalach) as hr0, max(thalach) as hr1, min(oldpeak) as op0, max(oldpeak) as op1
  from pa0
), pa as (
  select pa0.* exclude (oldpeak), {_age_group("age")} as age_group,
         cast(trestbps - bp0 as double) / nullif(bp1 - bp0, 0) as trestbps_normalized,
         cast(chol - ch0 as double) / nullif(ch1 - ch0, 0) as chol_normalized,
         cast(thalach - hr0 as double) / nullif(hr1 - hr0, 0) as thalach_normalized,
         cast(oldpeak - op0 as double) / nullif(op1 - op0, 0) as oldpeak_normalized
  from pa0, extremes
)"""

MEASURES = """
ms as (
  select cast(29 + l_quantity as int) as age, cast(l_linenumber % 2 as int) as sex,
         cast(nullif(90 + l_partkey % 90, 97) as double) as trestbps,
         cast(nullif(150 + l_orderkey % 150, 155) as double) as chol,
         cast(nullif(60 + l_suppkey % 60, 63) as double) as thalach,
         case when l_returnflag = 'R' then 1 else 0 end as target
  from lineitem
)"""

METRICS = """
mm as (
  select event_type as model_name, user_id % 3 as third,
         max(cast(json_extract_string(props, '$.k') as int)) as most,
         min(cast(json_extract_string(props, '$.k') as int)) as least
  from events group by all
), entries as (
  select distinct model_name, most, least from mm
), fi as (
  select model_name, 'k' as feature_name, most / 100.0::double as importance from entries
  union all
  select model_name, 'user', least / 100.0::double from entries
)"""

JOINED = f"""{PATIENTS}, {PREDICTIONS},
j as (
  select pa.*, pr.model_name, pr.prediction, pr.probability, pr.created_at,
         {RISK} as risk_category, {CONFIDENCE} as confidence_level,
         prediction = target as hit
  from pa join pr on pa.id = pr.patient_id
)"""

ATTRIBUTES = """age_group, sex, cp_type, trestbps_normalized, chol_normalized, fbs,
  restecg_type, thalach_normalized, exang, oldpeak_normalized, slope_type, ca_count, thal_type"""

CLINICAL = ("age_group", "sex", "cp_type", "fbs", "restecg_type", "exang", "slope_type",
            "thal_type")

FACTORS = """case
    when age > 50 and age <= 100 and probability > 0.6 then 'High Risk Age Group'
    when exang = 'Yes' and probability > 0.6 then 'High Risk with Exercise Angina'
    else 'Standard Risk' end"""

ANALYSIS = f"""id, {ATTRIBUTES}, target as actual_outcome, model_name,
  prediction as predicted_outcome, probability as risk_score"""

PROFILE = f"""{ANALYSIS}, risk_category,
  case when hit then 'Correct' else 'Incorrect' end as prediction_accuracy"""


def _with(tables: str, query: str) -> str:
    return f"with {tables}\n{query}"


def _trends(grain: str) -> str:
    return _with(JOINED, f"""
select cast(date_trunc('{grain}', created_at) as timestamp) as prediction_date, model_name,
       count(*) as total_predictions, round(avg(cast(hit as int)), 6) as accuracy,
       round(avg(probability), 6) as avg_risk_score
from j group by 1, 2""")


SCORE = """2 * (coalesce(trestbps > 130, false)::int + coalesce(trestbps > 140, false)::int
    + coalesce(chol > 200, false)::int + coalesce(chol > 240, false)::int
    + coalesce(thalach > 100, false)::int + coalesce(thalach > 120, false)::int)
  + 3 * (age > 55)::int + 2 * (sex = 1)::int"""

LEVEL = """case when risk_score <= q[1] then 'Low' when risk_score <= q[2] then 'Medium'
    when risk_score <= q[3] then 'High' else 'Very High' end"""

IMPUTED = f"""{MEASURES}, d as (select distinct * from ms),
md as (
  select median(trestbps)::double as bp, median(chol)::double as ch, median(thalach)::double as hr
  from d
), cl as (
  select age, sex, coalesce(trestbps::double, bp) as trestbps, coalesce(chol::double, ch) as chol,
         coalesce(thalach::double, hr) as thalach, target
  from d, md
)"""

FEATURES = _with(f"""{IMPUTED}, sc as (
  select *, ({SCORE})::int as risk_score, {_age_group("age")} as age_group,
         sin(age * 0.1::double) * cos(trestbps * 0.05::double) * sin(chol * 0.02::double) as qp,
         trestbps between 90 and 120 as healthy_bp, chol between 120 and 200 as healthy_chol,
         thalach between 60 and 100 as healthy_hr
  from cl
), qs as (
  select quantile_cont(risk_score, [0.25, 0.5, 0.75]) as q from sc
)""", f"""
select age, sex, trestbps, chol, thalach, target, age_group,
       trestbps * age as bp_age_interaction, chol * age as chol_age_interaction,
       thalach * trestbps as hr_bp_interaction,
       (trestbps > 130)::int as high_bp_risk, (chol > 200)::int as high_chol_risk,
       (thalach > 100)::int as high_hr_risk, risk_score,
       (age * age)::double as age_squared, trestbps * trestbps as bp_squared,
       chol * chol as chol_squared,
       trestbps / nullif(chol, 0) as bp_chol_ratio, thalach / nullif(trestbps, 0) as hr_bp_ratio,
       round(qp, 6) + 0 as quantum_pattern, round(qp * qp, 6) as quantum_pattern_squared,
       round(qp * qp * qp, 6) + 0 as quantum_pattern_cubed,
       sex || '_' || coalesce(age_group, 'nan') as sex_age_group, {LEVEL} as risk_level,
       healthy_bp, healthy_chol, healthy_hr,
       healthy_bp::int + healthy_chol::int + healthy_hr::int as health_score
from sc, qs""")


def _rank_code(column: str) -> str:
    text = f"coalesce(cast({column} as varchar), 'None')"
    return f"dense_rank() over (order by {text}) - 1 as {column}"


SHUFFLED = f"""{PATIENTS}, sh as (
  select id, target, count(*) over (partition by target) as n,
         row_number() over (partition by target order by md5(id || ':42'), id) as place
  from pa
)"""

# Rows of the stratified fifth that is held out, and what must hold of each as a model scores it.
IN_TEST = "(place <= floor(n * 0.2 + 0.5))"


def _newton(steps: int = 20) -> str:
    """Newton's steps for a logistic regression on two measures, one after another."""
    parts = [
        """
wt as (
  select target, (select count(*) from pa) / (2.0 * count(*)) as w from pa group by target
), z as (
  select (chol - 225) / 75.0 as x1, (trestbps - 135) / 45.0 as x2, 2.0 * target - 1 as s, w
  from pa join wt using (target)
), s0 as (
  select c, 0.0::double as b0, 0.0::double as b1, 0.0::double as b2
  from (select unnest([0.1, 1.0, 10.0])::double as c)
)"""
    ]
    for i in range(steps):
        parts.append(f"""
g{i} as (
  select c, b0, b1, b2,
         b0 - c * sum(w * s * p) as d0, b1 - c * sum(w * s * p * x1) as d1,
         b2 - c * sum(w * s * p * x2) as d2,
         1 + c * sum(w * p * (1 - p)) as h00, c * sum(w * p * (1 - p) * x1) as h01,
         c * sum(w * p * (1 - p) * x2) as h02, 1 + c * sum(w * p * (1 - p) * x1 * x1) as h11,
         c * sum(w * p * (1 - p) * x1 * x2) as h12, 1 + c * sum(w * p * (1 - p) * x2 * x2) as h22
  from (select *, 1 / (1 + exp(s * (b0 + b1 * x1 + b2 * x2))) as p from s{i}, z)
  group by c, b0, b1, b2
), s{i + 1} as (
  select c,
         b0 - (d0 * (h11 * h22 - h12 * h12) - h01 * (d1 * h22 - h12 * d2)
               + h02 * (d1 * h12 - h11 * d2)) / det as b0,
         b1 - (h00 * (d1 * h22 - h12 * d2) - d0 * (h01 * h22 - h12 * h02)
               + h02 * (h01 * d2 - d1 * h02)) / det as b1,
         b2 - (h00 * (h11 * d2 - d1 * h12) - h01 * (h01 * d2 - d1 * h02)
               + d0 * (h01 * h12 - h11 * h02)) / det as b2
  from (select *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02)
               + h02 * (h01 * h12 - h11 * h02) as det from g{i})
)""")
    return ",".join(parts)


HELD_OUT = """id as patient_id, '{}' as model_name, target, true as probability_in_range,
       true as class_follows_probability"""

# The features that models are trained on.
TRAINED = (
    "age", "sex", "trestbps", "chol", "thalach", "age_group", "bp_age_interaction",
    "chol_age_interaction", "hr_bp_interaction", "high_bp_risk", "high_chol_risk", "high_hr_risk",
    "risk_score", "age_squared", "bp_squared", "chol_squared", "bp_chol_ratio", "hr_bp_ratio",
    "quantum_pattern", "quantum_pattern_squared", "quantum_pattern_cubed", "sex_age_group",
    "healthy_bp", "healthy_chol", "healthy_hr", "health_score", "risk_level",
)

CELLS = """
cells as (
  select model_name, count(*) filter (target = 1 and prediction = 1) as tp,
         count(*) filter (target = 0 and prediction = 1) as fp,
         count(*) filter (target = 1 and prediction = 0) as fn,
         count(*) filter (target = 0 and prediction = 0) as tn
  from j group by model_name
)"""

ORACLE: dict[str, str] = {
    "risk_assessment": _with(JOINED, f"""
select j.* exclude (probability, created_at, confidence_level, hit),
       probability as risk_score,
       case when hit then 'Correct' else 'Incorrect' end as prediction_accuracy,
       {FACTORS} as risk_factors,
       round(probability / nullif(avg(probability) over (partition by age_group), 0), 6)
         as age_adjusted_risk
from j"""),
    "patient_risk_analysis": _with(JOINED, f"select {ANALYSIS} from j"),
    "patient_profiles": _with(JOINED, f"select {PROFILE} from j"),
    "dash_filtered": _with(JOINED, f"""
select {PROFILE} from j
where created_at >= timestamp '2024-01-05' and created_at < timestamp '2024-01-20'
  and model_name in ('click', 'view') and risk_category in ('High Risk', 'Very High Risk')
  and age_group in ('40-50', '50-55', '>70') and sex = 1"""),
    "model_performance": _with(PREDICTIONS, """
select model_name, count(*) as total_predictions,
       count(*) filter (prediction = 1) as positive_predictions,
       count(*) filter (prediction = 0) as negative_predictions,
       round(avg(probability), 6) as avg_probability,
       min(probability) as min_probability, max(probability) as max_probability
from pr group by model_name"""),
    "risk_score_distribution": _with(PREDICTIONS, f"""
select model_name, {RISK} as risk_category, count(*) as patient_count from pr group by 1, 2"""),
    "patient_demographics": _with(PATIENTS, """
select age_group, sex, count(*) as total_patients,
       count(*) filter (target = 1) as heart_disease_cases,
       round(avg((target = 1)::int), 6) as heart_disease_rate
from pa group by age_group, sex"""),
    "model_trends": _trends("day"),
    "model_trends_weekly": _trends("week"),
    "demographic_risk": _with(JOINED, """
select age_group, sex, count(*) as total_patients,
       count(*) filter (target = 1) as heart_disease_cases,
       round(avg((target = 1)::int), 6) as heart_disease_rate,
       round(avg(probability), 6) as avg_risk_score,
       min(probability) as min_risk_score, max(probability) as max_risk_score
from j group by age_group, sex"""),
    "prediction_confidence": _with(JOINED, """
select model_name, confidence_level, count(*) as prediction_count,
       round(avg(hit::int), 6) as accuracy_rate
from j group by 1, 2"""),
    "model_comparison": _with(PREDICTIONS, """
select a.patient_id, a.model_name as model1_name, b.model_name as model2_name,
       a.prediction as model1_prediction, b.prediction as model2_prediction,
       round(avg(a.probability), 6) as model1_probability,
       round(avg(b.probability), 6) as model2_probability,
       if(a.prediction = b.prediction, 'Agreement', 'Disagreement') as prediction_agreement,
       count(*) as pair_count
from pr a join pr b on a.patient_id = b.patient_id and a.model_name < b.model_name
group by a.patient_id, a.model_name, b.model_name, a.prediction, b.prediction"""),
    "feature_correlations": _with(PATIENTS, """
select feature1, 'target' as feature2, round(correlation, 6) as correlation, sample_size
from (select corr(age, target) as age, corr(trestbps_normalized, target) as trestbps_normalized,
             count(*) as sample_size from pa)
unpivot (correlation for feature1 in (age, trestbps_normalized))"""),
    "feature_importance_json": _with(METRICS, """
select *, rank() over (partition by model_name order by importance desc) as rank from fi"""),
    "dash_feature_rank": _with(METRICS, """
select model_name, feature_name, importance,
       1 + (select count(*) from fi o
            where o.model_name = fi.model_name and o.importance > fi.importance) as rank
from fi"""),
    "top_features": _with(METRICS, """
select *, rank() over (partition by model_name order by importance desc) as rank from fi
order by importance desc, model_name, feature_name limit 10"""),
    "model_training_data": _with(PATIENTS, f"select {ATTRIBUTES}, target from pa"),
    "registered_views": _with(f"{JOINED}, {METRICS}", """
select 'model_training_data' as view, count(*) as n from pa
union all select 'model_performance', count(distinct model_name) from pr
union all select 'feature_importance', count(*) from fi
union all select 'patient_risk_analysis', count(*) from j
union all select 'risk_score_distribution', count(distinct (model_name, risk_category)) from j
union all select 'model_comparison', (
  select count(*) from (
    select distinct a.patient_id, a.model_name, b.model_name, a.prediction, b.prediction
    from pr a join pr b on a.patient_id = b.patient_id and a.model_name < b.model_name))
union all select 'patient_demographics', count(distinct (age_group, sex)) from pa
union all select 'feature_correlations', 2
union all select 'tableau_model_trends',
  count(distinct (date_trunc('day', created_at), model_name)) from j
union all select 'tableau_patient_profiles', count(*) from j
union all select 'tableau_demographic_risk', count(distinct (age_group, sex)) from j
union all select 'tableau_prediction_confidence',
  count(distinct (model_name, confidence_level)) from j
union all select 'tableau_risk_assessment', count(*) from j"""),
    "dash_accuracy_by_model": _with(JOINED, """
select model_name, cast(count(*) as bigint) as total_predictions,
       round(avg(hit::int), 6) as accuracy
from j group by model_name"""),
    "dash_correct_by_category": _with(JOINED, """
select case when hit then 'Correct' else 'Incorrect' end as prediction_accuracy,
       risk_category, count(*) as count
from j group by 1, 2"""),
    "dash_age_distribution": _with(JOINED, """
select age_group, count(*) as total_patients,
       count(*) filter (target = 1) as heart_disease_cases,
       round(avg((target = 1)::int), 6) as heart_disease_rate
from j group by age_group"""),
    "dash_sex_by_category": _with(JOINED, """
select sex, risk_category, count(*) as count from j group by 1, 2"""),
    "dash_score_histogram": _with(JOINED, """
select cast(least(floor(probability * 20), 19) as bigint) as bin,
       round(least(floor(probability * 20), 19) / 20, 6) as bin_start, count(*) as count
from j group by 1, 2"""),
    "dash_score_by_category": _with(JOINED, """
select risk_category, count(*) as count, round(avg(probability), 6) as avg_risk_score
from j group by 1"""),
    "dash_risk_factors": _with(JOINED, f"""
select {FACTORS} as risk_factors, count(*) as count from j group by 1"""),
    "csv_scan": _with(MEASURES, """
select age, sex, trestbps, chol, thalach, age / 8 as quantum_pattern_raw, target from ms"""),
    "dedup_clean": _with(MEASURES, "select distinct * from ms"),
    "median_impute": _with(IMPUTED, "select * from cl"),
    "engineer_features": FEATURES,
    "age_binning": _with(MEASURES, f"""
select age, {_age_group("age")} as age_group, count(*) as n from ms group by 1, 2"""),
    "risk_level_quartiles": _with(f"""{MEASURES}, sc as (
  select ({SCORE})::int as risk_score from (select distinct * from ms)
), qs as (
  select quantile_cont(risk_score, [0.25, 0.5, 0.75]) as q from sc
)""", f"""
select risk_score, {LEVEL} as risk_level, count(*) as n from sc, qs group by 1, 2"""),
    "probability_quartiles": _with(f"""{PREDICTIONS}, qs as (
  select quantile_cont(probability, [0.25, 0.5, 0.75]) as q from pr
)""", """
select id, probability,
       case when probability <= q[1] then 'Q1' when probability <= q[2] then 'Q2'
            when probability <= q[3] then 'Q3' else 'Q4' end as quartile
from pr, qs"""),
    "minmax_normalize": _with(MEASURES, """
select ms.*, (trestbps - bp0)::double / nullif(bp1 - bp0, 0) as trestbps_normalized,
       (chol - ch0)::double / nullif(ch1 - ch0, 0) as chol_normalized,
       (thalach - hr0)::double / nullif(hr1 - hr0, 0) as thalach_normalized
from ms, (select min(trestbps) as bp0, max(trestbps) as bp1, min(chol) as ch0, max(chol) as ch1,
                 min(thalach) as hr0, max(thalach) as hr1 from ms)"""),
    "code_decode": """
select c_custkey as id, c_nationkey % 4 as cp, c_custkey % 3 as slope,
       case c_nationkey % 4 when 0 then 'typical' when 1 then 'atypical'
            when 2 then 'non-anginal' end as cp_type,
       case c_custkey % 3 when 0 then 'up' when 1 then 'flat' when 2 then 'down' end
         as slope_type
from customer""",
    "surrogate_ids": _with(MEASURES, """
select row_number() over () as id, cast(1 as bigint) as n from (select distinct * from ms)"""),
    "patients_store": _with(PATIENTS, """
select id, age, sex, target, age_group, cp_type, chol_normalized,
       cast(null as varchar) as risk_level, timestamp '2024-01-01' as created_at
from pa"""),
    "predictions_store": _with(PREDICTIONS, "select * from pr"),
    "orphan_predictions": _with(f"""{PATIENTS}, {PREDICTIONS}, shifted as (
  select case when id % 10 = 0 then patient_id + 100000000 else patient_id end as patient_id from pr
)""", """
select patient_id, count(*) as predictions from shifted
where patient_id not in (select id from pa)
group by patient_id"""),
    "surrogate_rows": _with(MEASURES, """
select *, true as in_range, true as own_id from (select distinct * from ms)"""),
    "quantiles_with_infinities": """
with v as (
  select case user_id % 50 when 0 then 'inf'::double when 1 then '-inf'::double else value end as x
  from events
), ranked as (
  select x, row_number() over (order by x) - 1 as place, count(*) over () - 1 as last from v
), p as (
  select unnest([0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]::double[]) as prob
), found as (
  select prob, l.x as low, h.x as high, prob * l.last - l.place as share
  from p join ranked l on l.place = floor(prob * l.last)
         join ranked h on h.place = ceil(prob * h.last)
), q as (
  select prob, case when share = 0 or low = high then low when isinf(high) then high
                    when isinf(low) then low else low * (1 - share) + high * share end as x
  from found
)
select prob, case when isinf(x) then null else round(x, 6) end as value,
       case when isinf(x) then cast(sign(x) as int) else 0 end as infinite from q""",
    "prepared_patients": _with(IMPUTED, f"""
select age, sex, round(trestbps)::int as trestbps, round(chol)::int as chol,
       round(thalach)::int as thalach, target, {_age_group("age")} as age_group,
       round((trestbps - bp0) / (bp1 - bp0), 6) as trestbps_normalized,
       round((chol - ch0) / (ch1 - ch0), 6) as chol_normalized,
       round((thalach - hr0) / (hr1 - hr0), 6) as thalach_normalized, 2 as correlations
from cl, (select min(trestbps) as bp0, max(trestbps) as bp1, min(chol) as ch0, max(chol) as ch1,
                 min(thalach) as hr0, max(thalach) as hr1 from cl)"""),
    "csv_importances": _with(METRICS, "select * from fi"),
    "codes_store": _with(PATIENTS, " union all ".join(f"""
select '{c}' as feature, value, row_number() over (order by value) - 1 as code
from (select distinct coalesce({c}::varchar, 'None') as value from pa)"""
        for c in ("age_group", "cp_type", "thal_type"))),
    "metrics_store": _with(METRICS, """
select model_name, sum(most) as most, count(*) as runs from mm group by model_name"""),
    "ordered_demographics": _with(PATIENTS, """
select row_number() over (order by age_group nulls first, sex nulls first) as position,
       age_group, sex from (select distinct age_group, sex from pa)"""),
    "views_with_thresholds": _with(JOINED, f"""
select 'tableau_risk_assessment' as view, {_steps("probability", STRICT, "Very High Risk")}
       as risk_category, count(*) as n from j group by all
union all
select 'tableau_patient_profiles', {_steps("probability", STRICT, "Very High Risk")}, count(*)
from j group by all
union all
select 'risk_score_distribution', {_steps("probability", STRICT, "Very High Risk")}, count(*)
from pr group by all"""),
    "dash_filtered_demographics": _with(JOINED, """
select age_group, sex, count(*) as total_patients,
       count(*) filter (target = 1) as heart_disease_cases,
       round(avg((target = 1)::int), 6) as heart_disease_rate,
       round(avg(probability), 6) as avg_risk_score,
       min(probability) as min_risk_score, max(probability) as max_risk_score
from j where created_at >= timestamp '2024-01-05' and model_name in ('click', 'view') and sex = 1
group by age_group, sex"""),
    "label_encode": _with(PATIENTS, f"""
select id, {_rank_code("age_group")}, {_rank_code("cp_type")}, {_rank_code("fbs")},
       {_rank_code("thal_type")}
from pa"""),
    "clinical_encode": _with(PATIENTS, f"""
select id, {", ".join(_rank_code(c) for c in CLINICAL)}, ca_count, target from pa"""),
    "class_weights": _with(PATIENTS, """
select target, count(*) as n,
       round((select count(*) from pa) / ((select count(distinct target) from pa) * count(*)), 6)
         as weight
from pa group by target"""),
    "stratified_split": _with(SHUFFLED, """
select id, target, place <= floor(n * 0.2 + 0.5) as in_test from sh"""),
    "stratified_folds": _with(SHUFFLED, """
select id, target,
       (place > floor(n * 0.2 + 0.5))::int + (place > floor(n * 0.4 + 0.5))::int
       + (place > floor(n * 0.6 + 0.5))::int + (place > floor(n * 0.8 + 0.5))::int as fold
from sh"""),
    "train_lr_score": _with(SHUFFLED, f"""
select {HELD_OUT.format("logistic_regression")}, true as at_rest
from sh where {IN_TEST}"""),
    "model_store": _with(SHUFFLED, f"""
select id as patient_id, true as same_probability from sh where {IN_TEST}"""),
    "kernel_equal_rows": _with(PATIENTS, """
select age, sex, count(*) as patients, cast(1 as bigint) as different from pa group by all"""),
    "logistic_coefficients": _with(f"{PATIENTS}, {_newton()}", """
select c as "C", term, round(coefficient, 5) as coefficient
from (select c, b0 as intercept, b1 as chol, b2 as trestbps from s20)
unpivot (coefficient for term in (intercept, chol, trestbps))"""),
    "tree_root": _with(PATIENTS, """
, st as (
  select target, unnest(['age_step', 'chol_step', 'bp_step', 'hr_step']) as feature,
         unnest([floor(age / 10.0), floor(chol / 25.0), floor(trestbps / 15.0),
                 floor(thalach / 10.0)]) as value
  from pa
), steps as (
  select feature, value, (value + lead(value) over (partition by feature order by value)) / 2
         as threshold
  from (select distinct feature, value from st)
), sides as (
  select s.feature, s.threshold, count(*) filter (t.value <= s.threshold) as ln,
         count(*) filter (t.value <= s.threshold and target = 1) as lc,
         count(*) filter (t.value > s.threshold) as rn,
         count(*) filter (t.value > s.threshold and target = 1) as rc
  from steps s join st t on s.feature = t.feature
  where s.threshold is not null group by all
), gains as (
  select *, 2.0 * (lc + rc) * (ln + rn - lc - rc) / (ln + rn) / (ln + rn)
         - (2.0 * lc * (ln - lc) / ln + 2.0 * rc * (rn - rc) / rn) / (ln + rn) as gain
  from sides
)
select feature, threshold, round(gain, 6) as gain, ln as left_rows, lc as left_cases,
       rn as right_rows, rc as right_cases
from gains order by gain desc limit 1"""),
    "svm_score": _with(SHUFFLED, f"""
select id as patient_id, 'svm' as model_name, target, true as probability_in_range
from sh where {IN_TEST}"""),
    "voting_score": _with(SHUFFLED, f"""
select {HELD_OUT.format("voting_classifier")}, true as vote_is_mean, true as class_is_majority
from sh where {IN_TEST}"""),
    "stacking_score": _with(SHUFFLED, f"""
select id as patient_id, target, cast(0 as bigint) as times_scored,
       cast(null as integer) as left_out, true as probability_in_range
from sh where {IN_TEST}
union all
select id, target, cast(1 as bigint),
       (later > floor(m * 0.2 + 0.5))::int + (later > floor(m * 0.4 + 0.5))::int
       + (later > floor(m * 0.6 + 0.5))::int + (later > floor(m * 0.8 + 0.5))::int, true
from (select id, target, place - floor(n * 0.2 + 0.5) as later, n - floor(n * 0.2 + 0.5) as m
      from sh where not {IN_TEST})"""),
    "search_metrics": _with(SHUFFLED, f"""
select 'decision_tree' as model_name, count(*) as held_out,
       count(*) filter (target = 1) as positives, true as accuracy_fits, true as cv_in_range,
       true as chosen_from_grid
from sh where {IN_TEST}"""),
    "forest_importance": f"""
select unnest([{", ".join(f"'{name}'" for name in TRAINED)}]) as feature, true as in_range,
       1.0::double as total, cast({len(TRAINED) * (len(TRAINED) + 1) // 2} as bigint)
       as sum_of_places, true as trees_as_chosen""",
    "classification_metrics": _with(f"{JOINED}, {CELLS}", """
select model_name, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy,
       coalesce(round(tp / nullif(tp + fp, 0), 6), 0) as precision,
       coalesce(round(tp / nullif(tp + fn, 0), 6), 0) as recall,
       coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 6), 0) as f1, tp, fp, fn, tn
from cells"""),
    "confusion_matrix": _with(f"{JOINED}, {CELLS}", """
select model_name, tn, fp, fn, tp from cells"""),
}

ORACLE["dash_filtered_assessment"] = f"""
select * from ({ORACLE["risk_assessment"]})
where model_name in ('click', 'view') and risk_category in ('High Risk', 'Very High Risk')
  and age_group in ('40-50', '50-55', '>70') and sex = 1"""

# The kept sums have the rows of the views that read all predictions.
KEPT = {
    "performance": "model_performance", "distribution": "risk_score_distribution",
    "trends": "model_trends", "trends_weekly": "model_trends_weekly",
    "demographic_risk": "demographic_risk", "confidence": "prediction_confidence",
    "accuracy_by_model": "dash_accuracy_by_model", "correct_by_category": "dash_correct_by_category",
    "age_distribution": "dash_age_distribution", "sex_by_category": "dash_sex_by_category",
    "score_histogram": "dash_score_histogram", "score_by_category": "dash_score_by_category",
    "risk_factors": "dash_risk_factors",
}
ORACLE |= {f"kept_{name}": ORACLE[view] for name, view in KEPT.items()}

ORACLE |= {
    "model_pairs": _with(PREDICTIONS, """
select a.patient_id, a.model_name as model1_name, b.model_name as model2_name,
       a.prediction as model1_prediction, b.prediction as model2_prediction,
       round(a.probability, 6) as model1_probability,
       round(b.probability, 6) as model2_probability,
       if(a.prediction = b.prediction, 'Agreement', 'Disagreement') as prediction_agreement
from pr a join pr b on a.patient_id = b.patient_id and a.model_name < b.model_name"""),
    "repeated_run": _with(PREDICTIONS, """
select model_name, count(*) as n, count(distinct id) as ids from pr group by model_name"""),
    "bad_lines": _with(MEASURES, """
select case age % 9 when 0 then '8 fields, not 7' when 1 then 'Age is no int' else 'read' end
       as kind, count(*) as n
from ms group by all"""),
    "laid_out": _with(PREDICTIONS, """
select 'day' as kept_by, id, patient_id, model_name, prediction, created_at from pr
where created_at >= timestamp '2024-01-05' and created_at < timestamp '2024-01-06'
union all
select 'patient', id, patient_id, model_name, prediction, created_at from pr where patient_id = 7"""),
    "stamped": _with(PATIENTS, """
select id, true as in_time from pa"""),
    "sorted_correlations": _with(PATIENTS, """
select row_number() over (order by abs(correlation) desc) as position, feature1,
       round(correlation, 6) as correlation
from (select corr(age, target) as age, corr(chol, target) as chol,
             corr(thalach, target) as thalach, corr(trestbps, target) as trestbps,
             corr(sex, target) as sex from pa)
unpivot (correlation for feature1 in (age, chol, thalach, trestbps, sex))"""),
}
