"""Queries over screening events."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewell.functions.decisions import reconcile
from gradewell.operators import sessions as S
from gradewell.plans.decisions import SCREENED, screened
from gradewell.plans.registry import CATALOG
from gradewell.plans.tools import tidy

query = CATALOG.query


@query("s01_session_summary", "shots", f"""with {SCREENED}, x as (select *, coalesce(case when quality_ok and available then p_ref end,0) as p from screen),
g as (select session_id, count(*) as image_count, count(*) filter (not quality_ok) as poor_quality_count, max(p) as strongest_probability,
  max(grade) as max_grade, count(*) filter (quality_ok) as us, count(*) filter (quality_ok and result='referable') as po, count(*) filter (quality_ok and result='non_referable') as ne from x group by session_id),
f as (select session_id, event_id as strongest_image from (select *, row_number() over (partition by session_id order by p desc, event_id) as rn from x) where rn=1)
select session_id, image_count, poor_quality_count, round(strongest_probability,6) as strongest_probability, strongest_image, max_grade,
  case when poor_quality_count*2>image_count then 'uncertain' when po>0 then 'referable' when us>0 and ne=us then 'non_referable' else 'uncertain' end as session_result from g join f using (session_id)""")
def session_summary(fx):
    return tidy(S.session_summary(screened(fx), ["session_id"], "event_id", "event_id"))


@query("s02_mean_probabilities", "shots", f"""with {SCREENED}, e as (select session_id, 'Referable' as k, p_ref as v from screen where quality_ok and available
  union all select session_id, 'Non-Referable', 1-p_ref from screen where quality_ok and available and event_id%3<>0)
select session_id, max(case when k='Referable' then m end) as referable, max(case when k='Non-Referable' then m end) as non_referable
from (select session_id, k, (x//1000000 + case when x%1000000>500000 or (x%1000000=500000 and (x//1000000)%2=1) then 1 else 0 end)/1000000.0::double as m
  from (select session_id, k, cast(round(avg(v)*1000000000000) as bigint) as x from e group by session_id, k)) group by session_id""")
def mean_probabilities(fx):
    """Some images lack a key; it is averaged over the others."""
    p = F.col("positive_probability")
    known = F.map_filter(F.create_map(F.lit("Referable"), p, F.lit("Non-Referable"), 1 - p),
                         lambda k, v: v.isNotNull() & ((k == "Referable") | (F.col("event_id") % 3 != 0)))
    means = S.mean_probabilities(screened(fx).select("session_id", "event_id", known.alias("probabilities")), ["session_id"], "probabilities")
    m = F.col("average_probabilities")
    return tidy(means.select("session_id", F.try_element_at(m, F.lit("Referable")).alias("referable"),
                             F.try_element_at(m, F.lit("Non-Referable")).alias("non_referable")))


@query("s03_session_guard", "shots", """
with c as (select session_id, count(*) as n from shots group by session_id)
select event_id, session_id from shots join c using (session_id) where n<=3""")
def session_guard(fx):
    kept, _ = S.guard_sizes(fx.shots, ["session_id"], 3)
    return kept.select("event_id", "session_id")


@query("s03_rejected_sessions", "shots", "select session_id, count(*) as image_count from shots group by session_id having count(*)>9")
def rejected_sessions(fx):
    return S.guard_sizes(fx.shots, ["session_id"])[1]


@query("s04_content_ids", "files", "select content_id, first_doc from (select left(sha,16) as content_id, min(doc_id) as first_doc from files group by 1)")
def content_ids(fx):
    return S.distinct_content(fx.files, "sha", "doc_id").select("content_id", F.col("doc_id").alias("first_doc"))


@query("s05_gap_sessions", "", """
with o as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval 30 minute then 0 else 1 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from o)
select user_id, min(ts) as start, max(ts) + interval 30 minute as "end", count(*) as n from s group by user_id, k""")
def gap_sessions(fx):
    return S.gap_sessions(fx.table("events"), "user_id", "ts", 1800)


WINDOWED = "count(*) as n, round(avg(rating),6) as mean_rating, round(avg(seconds),6) as mean_seconds"


@query("s06_feedback_daily", "feedback", f"""select date_trunc('day', ts)::timestamp as start, date_trunc('day', ts)::timestamp + interval 1 day as "end", {WINDOWED} from feedback group by date_trunc('day', ts)""")
def feedback_daily(fx):
    return tidy(S.feedback_metrics(fx.feedback, "ts", "1 day"))


@query("s06_feedback_sliding", "feedback", f"""with w as (select time_bucket(interval 6 hour, ts) - interval (i * 6) hour as start, * from feedback cross join (select unnest([0,1,2,3]) as i))
select start, start + interval 1 day as "end", {WINDOWED} from w group by start""")
def feedback_sliding(fx):
    return tidy(S.feedback_metrics(fx.feedback, "ts", "1 day", "6 hours"))


@query("s06_feedback_from_json", "", """
select date_trunc('day', ts)::timestamp as start, warning, count(*) as n from (select ts, unnest(json_keys(props)) as warning from events where event_type='purchase') group by all""")
def feedback_from_json(fx):
    """Payload keys of the JSON events stand in for the warnings of a feedback document."""
    keys = F.map_keys(F.from_json("props", "map<string,string>"))
    rows = fx.table("events").filter("event_type = 'purchase'").select("ts", keys.alias("warnings"))
    return S.warning_counts(rows, "ts", "warnings", "1 day")


@query("s07_task_states", "", """
with u as (select user_id as task_id, ts, event_id, case event_id%4 when 0 then 'PENDING' when 1 then 'STARTED' when 2 then 'SUCCESS' else 'FAILURE' end as state from events)
select task_id, ts, state from (select *, row_number() over (partition by task_id order by ts desc, event_id desc) as rn from u) where rn=1""")
def task_states(fx):
    names = F.array(*[F.lit(s) for s in S.TASK_STATES])
    updates = fx.table("events").select(F.col("user_id").alias("task_id"), "ts", "event_id", names[(F.col("event_id") % 4).cast("int")].alias("state"))
    return S.latest_states(updates, "task_id", "ts", "event_id", ["state"])


@query("s08_recent_history", "shots", f"""with {SCREENED} select user_id, event_id, result, position from (select *, row_number() over (partition by user_id order by ts desc, event_id desc)::int as position from screen) where position<=12""")
def recent_history(fx):
    recent = S.recent_history(screened(fx), "user_id", [F.desc("ts"), F.desc("event_id")])
    return recent.select("user_id", "event_id", "result", "position")
