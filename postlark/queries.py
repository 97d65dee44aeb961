"""Queries of the job-posting operators over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import batch, candidates, catalog, contract, eda, guards, inference, ingest, matching, plugins, pointers, profile, profiles, publish, reliability, run, sketches, stages, sync
from .plans.jobs import JOBS_SQL, jobs
from .plans.records import AT, NORMALIZED_SQL, REF, raw_records
from .sources.ordinals import parquet_in_order
from .sources.shared import kept, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = "2026-01-15 00:00:00"
CANDIDATE = matching.Candidate(skills=("python", "sql", "c++", "machine learning"), titles=("data engineer", "ml engineer", "C"), locations=("en",), work_modes=("remote",), seniority=("senior", "staff"), salary_minimum=20000.0, requires_sponsorship=True, authorized_locations=("fr", "remote"))


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_PLAIN = _STRIP.format("regexp_replace(description_html, '(?is)<[^>]*>', ' ', 'g')")
CLEAN_SQL = f"{JOBS_SQL}, clean as (select * replace (case when description_html is not null then {_PLAIN} else {_STRIP.format('description_text')} end as description_text) from jobs)"
LABEL_SQL = f"""{CLEAN_SQL}, labelled as (select *,
    case when regexp_matches(title, '(?i)intern|junior|entry') then 'junior' when regexp_matches(title, '(?i)senior|staff|principal') then 'senior' else 'mid' end as label_seniority,
    case when regexp_matches(title, '(?i)data') then 'data' when regexp_matches(title, '(?i)machine learning|ml|ai') then 'ml' when regexp_matches(title, '(?i)backend|platform|infra') then 'backend' else 'other' end as label_role_category,
    list_sort(list_distinct(regexp_extract_all(lower(title || ' ' || description_text), 'python|sql|aws|gcp|java|rust|typescript|docker'))) as label_tech_stack
    from clean)"""
RATE_SQL = f"""{LABEL_SQL}, rated as (select *, (1 + (company is not null)::int + (description_text <> '')::int + (apply_url <> '')::int) / 4.0::double as rate_completeness, least(1.0::double, length(description_text) / 1500.0::double) as rate_quality from labelled)"""


@query(f"with {JOBS_SQL} select id, remote, list_filter(list_transform(skills, lambda s: trim(s)), lambda s: s <> '') as skills, salary_min, salary_max, posted_at from jobs")
def normalize_contract(spark, sf_dir):
    """Columns made text again, then brought onto the canonical types."""
    raw = jobs(spark, sf_dir).withColumns({"remote": F.when(F.col("remote"), " Yes ").otherwise("onsite"), "skills": F.array_join("skills", " , "), "salary_min": F.format_number("salary_min", 1)})
    return contract.conform(raw).select("id", "remote", "skills", "salary_min", "salary_max", "posted_at")


@query("""with raw as (select event_id, case event_id % 5 when 0 then '1,200' when 1 then 'x' when 2 then ' n/a ' when 3 then '7.5' else null end as pay, case event_id % 3 when 0 then 'YES' when 1 then 'off' else 'no' end as flag, null as day from events)
    select event_id, case event_id % 5 when 0 then 1200.0::double when 3 then 7.5::double end as salary_min, case event_id % 3 when 0 then true when 2 then false end as remote, case event_id % 8 when 0 then '2026-01-10' when 4 then '2026-01-10 07:05:00' when 1 then '10/11/2026' when 5 then '05/01/2026' end as posted_at from raw""")
def adapter(spark, sf_dir):
    return _adapted(spark, sf_dir)[0].select("event_id", "salary_min", "remote", "posted_at")


@query("select count(*) filter (event_id % 5 = 1) as salary_min_errors, count(*) filter (event_id % 3 = 1) as remote_errors, count(*) filter (event_id % 4 = 2) as posted_at_errors from events")
def adapter_errors(spark, sf_dir):
    return _adapted(spark, sf_dir)[1]


def _adapted(spark, sf_dir):
    i = F.col("event_id")
    raw = read(spark, sf_dir, "events").select("event_id", F.when(i % 5 == 0, "1,200").when(i % 5 == 1, "x").when(i % 5 == 2, " n/a ").when(i % 5 == 3, "7.5").alias("pay"), F.when(i % 3 == 0, "YES").when(i % 3 == 1, "off").otherwise("no").alias("flag"), F.when(i % 8 == 0, "2026-01-10").when(i % 8 == 4, "2026-1-10 7:5:00").when(i % 8 == 1, "10/11/2026").when(i % 8 == 5, "5/1/2026").when(i % 4 == 2, "31/02/2026").alias("day"))
    return contract.adapt(raw, {"salary_min": contract.Field(("salary", "pay"), "float"), "remote": contract.Field(("flag",), "bool"), "posted_at": contract.Field(("day",), "date_string")})


@query("""with o as (select event_id, row_number() over () as o from events) select * from (select 'salary_min' as field, 'pay' as source, 'x' || event_id as value, 'float_parse_failed' as reason from o where event_id % 5 = 1 order by o limit 7)""")
def adapter_error_samples(spark, sf_dir):
    i = F.col("event_id")
    raw = parquet_in_order(spark, f"{sf_dir}/events.parquet").select("ordinal", F.when(i % 5 == 1, F.concat(F.lit("x"), i)).otherwise("1").alias("pay"), F.when(i % 3 == 1, "off").otherwise("no").alias("flag"))
    return contract.error_samples(raw, {"salary_min": contract.Field(("salary", "pay"), "float"), "remote": contract.Field(("flag",), "bool")}, "ordinal", 7)


@query("select count(*) filter (doc_id % 10 = 0) as location_conflicts, count(*) filter (doc_id % 4 = 0) as remote_conflicts from documents")
def alias_conflicts(spark, sf_dir):
    i = F.col("doc_id")
    raw = read(spark, sf_dir, "documents").select(F.upper("lang").alias("location"), F.when(i % 10 == 0, "xx").otherwise(F.col("lang")).alias("location_raw"), F.lit(True).alias("remote"), F.when(i % 4 == 0, "maybe").when(i % 4 == 1, "y").otherwise("remote").alias("remote_flag"))
    return contract.resolve_aliases(raw)[1]


@query(f"select page_id, {_STRIP.format(chr(39).join(['regexp_replace(html, ', '(?is)<[^>]*>', ', ', ' ', ', ', 'g', ')']))} as body from pages")
def clean_html(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", stages.plain_text(F.col("html")).alias("body"))


@query(f"with {CLEAN_SQL} select id, salary_min from clean where remote and coalesce(salary_min, salary_max) >= 15000 and contains(lower(title || ' ' || description_text), 'python')")
def filter_jobs(spark, sf_dir):
    return stages.keep(stages.clean(jobs(spark, sf_dir)), remote_only=True, min_salary=15000, keywords=("Python ", "")).select("id", "salary_min")


@query(f"with {LABEL_SQL} select id, label_seniority, label_role_category, label_tech_stack from labelled")
def labels_of_jobs(spark, sf_dir):
    return stages.label(stages.clean(jobs(spark, sf_dir))).select("id", "label_seniority", "label_role_category", "label_tech_stack")


@query(f"with {RATE_SQL} select id, rate_completeness, rate_quality, (rate_completeness + rate_quality) / 2 as rate_composite from rated")
def rate_scores(spark, sf_dir):
    return stages.rate(stages.label(stages.clean(jobs(spark, sf_dir)))).select("id", "rate_completeness", "rate_quality", "rate_composite")


@query(f"""with {RATE_SQL}, top as (select *, (rate_completeness + rate_quality) / 2 as fit_score from rated order by fit_score desc, id limit 400)
    select row_number() over (order by fit_score desc, id) as fit_rank, title, company, apply_url, fit_score, case label_seniority when 'senior' then 25 when 'junior' then 12 else 15 end as estimated_effort_minutes from top""")
def match_topk(spark, sf_dir):
    return stages.plan(stages.match(stages.rate(stages.label(stages.clean(jobs(spark, sf_dir)))), top_k=400))


@query(f"with {JOBS_SQL} select unnest(['company', 'salary_min', 'posted_at', 'title']) as column, unnest([avg(100.0 * (company is null)::int), avg(100.0 * (salary_min is null)::int), avg(100.0 * (posted_at is null)::int), 0.0]) as null_pct from jobs")
def quality_nulls(spark, sf_dir):
    return profile.null_percentages(jobs(spark, sf_dir).select("company", "salary_min", "posted_at", "title"))


@query(f"with {JOBS_SQL} select count(*) as row_count, 100 - (2.5 * avg(100.0 * (company is null)::int) + 1.5 * avg(100.0 * (posted_at is null)::int)) / 16.5 as score_percent from jobs")
def quality_score(spark, sf_dir):
    return profile.quality_score(jobs(spark, sf_dir))


@query("select event_type as value, count(*) as count, count(*) * 100.0 / sum(count(*)) over () as pct from events group by 1 order by 2 desc, 1 limit 3")
def top_values(spark, sf_dir):
    return profile.top_values(read(spark, sf_dir, "events"), "event_type", 3)


@query("""select 'c_mktsegment' as column, count(*) filter (c_mktsegment is null) as null_count, count(*) filter (trim(c_mktsegment) = '') as empty_count, count(*) filter (lower(c_mktsegment) in ('unknown', 'n/a', 'na', 'none', 'null')) as sentinel_count, count(distinct c_mktsegment) as distinct_count from customer
    union all select 'c_nationkey', count(*) filter (c_nationkey is null), 0, 0, count(distinct c_nationkey) from customer""")
def column_profile_exact(spark, sf_dir):
    return profile.column_profile(read(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey"), exact=True)


@query(f"with {JOBS_SQL} select source, count(*) as rows, avg(case when posted_at is not null then 100.0 else 0 end) as posted_at_pct, avg(case when remote then 100.0 else 0 end) as remote_pct from jobs group by source")
def source_profile(spark, sf_dir):
    return profile.source_profile(jobs(spark, sf_dir))


@query(f"with {JOBS_SQL} select source, count(*) as rows, count(*) filter (title = company) as title_is_company, count(*) filter (salary_min > salary_max) as salary_inverted from jobs group by source")
def consistency_by_source(spark, sf_dir):
    return profile.consistency(jobs(spark, sf_dir), by="source")


@query(f"""with {JOBS_SQL}, n as (select source, count(*) as rows, avg(100.0 * (company is null)::int) as c, avg(100.0 * (posted_at is null)::int) as p from jobs group by source)
    select source, rows, 100 - (2.5 * c + 1.5 * p) / 16.5 as score_percent, array_to_string(list_transform(list_slice(list_sort([{{'p': -c, 'c': 'company'}}, {{'p': -p, 'c': 'posted_at'}}, {{'p': 0.0, 'c': 'apply_url'}}, {{'p': 0.0, 'c': 'description_text'}}, {{'p': 0.0, 'c': 'location'}}]), 1, 3), lambda x: x.c), ',') as worst_fields from n""")
def quality_by_source(spark, sf_dir):
    return profile.quality_by_source(jobs(spark, sf_dir)).withColumn("worst_fields", F.array_join("worst_fields", ","))


_SHARES = "avg(100.0 * (company is null)::int) as company, avg(100.0 * (posted_at is null)::int) as posted_at, avg(100.0 * (salary_min is null)::int) as salary_min, avg(100.0 * (salary_max is null)::int) as salary_max, avg(100.0 * (description_html is null)::int) as html"


@query(f"with {JOBS_SQL}, n as (select count(*) as row_count, {_SHARES} from jobs) select 'strict_recruiting' as profile, row_count, 100 - (2 * company + 1.5 * posted_at + 2 * salary_min + 2 * salary_max + 3 * 100) / 19.5 as score_percent from n union all select 'equal_weight_all', row_count, 100 - (company + posted_at + salary_min + salary_max + html) / 14.0 from n union all select 'overridden', row_count, 100 - (10 * company + 1.5 * posted_at) / 24.0 from n")
def quality_profiles(spark, sf_dir):
    j = jobs(spark, sf_dir)
    named = {"strict_recruiting": profile.quality_weights("strict_recruiting"), "equal_weight_all": profile.quality_weights("equal_weight_all", j.columns), "overridden": profile.quality_weights(overrides={"company": 10.0})}
    parts = [profile.quality_score(j, w).withColumn("profile", F.lit(n)) for n, w in named.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""with ranked as (select 'l_extendedprice' as column, l_extendedprice as value, row_number() over (order by l_extendedprice) - 1 as k, count(*) over () as n from lineitem
    union all select 'l_quantity', l_quantity, row_number() over (order by l_quantity) - 1, count(*) over () from lineitem)
    select r.column, q / 10.0::double as quantile, value from ranked r join range(11) t(q) on k = floor(q / 10.0::double * (n - 1) + 0.5)""")
def deciles(spark, sf_dir):
    return profile.deciles(read(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"])


@query("""with counts as (select p_type as value, count(*) as count from part group by 1), ranked as (select *, row_number() over (order by count desc, value) as r from counts)
    select value, count from ranked where r <= 3 union all select '__other__', sum(count)::bigint from ranked where r > 3 having count(*) > 0""")
def categorical_other(spark, sf_dir):
    return profile.distribution_with_rest(read(spark, sf_dir, "part"), "p_type", 3)


@query("select strftime(o_orderdate, '%Y-%m') as month, count(*) as count from orders group by 1")
def monthly_counts(spark, sf_dir):
    return profile.monthly(read(spark, sf_dir, "orders"), "o_orderdate")


@query("""with a as (select * from orders where o_orderkey % 2 = 0), b as (select * from orders where o_orderkey % 2 = 1),
    p as (select o_orderpriority as v, count(*) / sum(count(*)) over ()::double as p from a group by 1), q as (select o_orderpriority as v, count(*) / sum(count(*)) over ()::double as q from b group by 1),
    m as (select coalesce(p, 0) as p, coalesce(q, 0) as q, (coalesce(p, 0) + coalesce(q, 0)) / 2 as m from p full join q using (v))
    select 0.5 * sum(case when p > 0 then p * ln((p + 1e-12) / (m + 1e-12)) else 0 end) + 0.5 * sum(case when q > 0 then q * ln((q + 1e-12) / (m + 1e-12)) else 0 end) as jsd from m""")
def drift_jsd(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return profile.jensen_shannon(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_orderpriority")


_PSI_SQL = """with r as (select o_orderkey % 2 as side, o_totalprice as v, row_number() over (partition by o_orderkey % 2 order by o_totalprice) - 1 as k, count(*) over (partition by o_orderkey % 2) as n from orders),
    curve as (select side, q, v from r join range(11) t(q) on k = floor(q / 10.0::double * (n - 1) + 0.5)),
    x as (select q, v, lag(v) over (order by q) as u from curve where side = 0),
    segs as (select side, q / 10.0::double as b_q, v as b, lag(q) over (partition by side order by q) / 10.0::double as a_q, lag(v) over (partition by side order by q) as a from curve),
    points as (select distinct q, e from (select q, v as e from x where q > 0 union all select q, u from x where q > 0)),
    below as (select s.side, p.q, p.e, case when p.e < (select min(v) from curve c where c.side = s.side) then 0.0
        else coalesce((select a_q + (p.e - a) / (b - a) * (b_q - a_q) from segs g where g.side = s.side and g.a is not null and p.e < g.b order by g.b_q limit 1), 1.0) end as f from points p, (select distinct side from curve) s),
    shares as (select x.q, hi0.f - lo0.f as p, hi1.f - lo1.f as c from x join below hi0 on hi0.side = 0 and hi0.q = x.q and hi0.e = x.v join below lo0 on lo0.side = 0 and lo0.q = x.q and lo0.e = x.u
        join below hi1 on hi1.side = 1 and hi1.q = x.q and hi1.e = x.v join below lo1 on lo1.side = 1 and lo1.q = x.q and lo1.e = x.u where x.q > 0)
    select sum(case when p <= 1e-9 and c <= 1e-9 then 0 else (greatest(p, 1e-9) - greatest(c, 1e-9)) * ln(greatest(p, 1e-9) / greatest(c, 1e-9)) end) as psi from shares"""


@query(_PSI_SQL)
def drift_psi(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return profile.stability_index(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_totalprice")


@query(f"with {JOBS_SQL}, a as (select * from jobs where doc_id % 2 = 0), b as (select * from jobs where doc_id % 2 = 1) select 'company' as column, (select avg(100.0 * (company is null)::int) from a) as base_pct, (select avg(100.0 * (company is null)::int) from b) as candidate_pct, (select avg(100.0 * (company is null)::int) from b) - (select avg(100.0 * (company is null)::int) from a) as delta_pct union all select 'title', 0, 0, 0")
def null_diff(spark, sf_dir):
    j = jobs(spark, sf_dir).select("doc_id", "company", "title")
    return profile.null_diff(j.where("doc_id % 2 = 0").drop("doc_id"), j.where("doc_id % 2 = 1").drop("doc_id"))


@query("""with t as (select doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 2))) as token from documents)
    select token, (('0x' || substr(sha256(token), 1, 2))::int) % 16 as shard, doc_id::varchar as job_id from t""")
def token_postings(spark, sf_dir):
    """The jobs of all blocks, a row each."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("job_id"), text.tokens(F.col("text")).alias("tokens"))
    return matching.postings(docs).select("token", "shard", F.explode("job_ids").alias("job_id"))


@query("select 'c_mktsegment' as name, lower(trim(c_mktsegment)) as value, count(*) as count from customer group by 2 union all select 'c_nationkey', c_nationkey::varchar, count(*) from customer group by 2")
def facets(spark, sf_dir):
    return matching.facets(read(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"])


_SQL_TOKENS = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda x: length(x) >= 2)"
_SKILLS = "['python', 'sql', 'c++', 'machine learning']"
_IX_SQL = f"""tok as (select *, case when remote or contains(lower(location), 'remote') then 'remote' else 'onsite' end as work_mode,
    case when contains(lower(title), 'principal') or contains(lower(title), 'staff') then 'staff' when contains(lower(title), 'senior') then 'senior' when contains(lower(title), 'intern') then 'junior' else 'mid' end as seniority,
    greatest(salary_min, salary_max) as pay, list_distinct({_SQL_TOKENS.format("title")}) as tt,
    list_sort(list_distinct(list_concat({_SQL_TOKENS.format("title || ' ' || description_text")}, list_filter(list_transform(skills, lambda s: lower(trim(s))), lambda s: s <> '')))) as skill_tokens from jobs),
    ix as (select *, list_sort(list_distinct(list_concat(skill_tokens, {_SQL_TOKENS.format("coalesce(company, '') || ' ' || location")}))) as tokens from tok)"""
_INDEX_SQL = f"""{JOBS_SQL}, {_IX_SQL},
    sig as (select *, (contains(lower(location), 'en') or contains(lower(location), 'fr') or work_mode = 'remote') as ok_place, work_mode = 'remote' as ok_mode, coalesce(pay >= 20000, false) as ok_pay,
        len(list_filter({_SKILLS}, lambda s: list_contains(tokens, s))) / 4.0::double as s_skills,
        greatest(len(list_intersect(['data', 'engineer'], tt)) / len(list_distinct(list_concat(['data', 'engineer'], tt)))::double, len(list_intersect(['ml', 'engineer'], tt)) / len(list_distinct(list_concat(['ml', 'engineer'], tt)))::double) as s_title,
        case when seniority in ('senior', 'staff') then 1.0 else 0.0 end as s_level,
        coalesce(exp(-ln(2) * greatest(0, epoch(timestamp '{NOW}' - posted_at::timestamp) / 86400.0::double) / 90), 0) as s_age,
        case when pay is null then 0.0 when pay >= 20000 then 1.0 else pay / 20000 end as s_pay from ix),
    total as (select *, (ok_place::int + ok_mode::int) / 2.0::double as s_place, round(least(1, 0.35 * s_skills + 0.2 * s_title + 0.15 * (ok_place::int + ok_mode::int) / 2.0 + 0.1 * s_level + 0.1 * s_age + 0.1 * s_pay), 6) as score,
        list_filter({_SKILLS}, lambda s: not list_contains(skill_tokens, s)) as lacks,
        list_filter([case when company is null then 'MISSING_COMPANY' end, case when posted_at is null then 'MISSING_POSTED_AT' end], lambda x: x is not null) as flags from sig)"""


@query(f"with {_INDEX_SQL} select id as job_id, skill_tokens, tokens from ix")
def index_tokens(spark, sf_dir):
    return matching.index_jobs(jobs(spark, sf_dir)).select("job_id", "skill_tokens", "tokens")


@query(f"with {_INDEX_SQL} select id as job_id, list_filter([case when not ok_place then 'FILTER_LOCATION' end, case when not ok_mode then 'FILTER_WORK_MODE' end, case when not ok_pay then 'FILTER_SALARY' end], lambda x: x is not null) as exclude_reasons from sig")
def hard_filters(spark, sf_dir):
    return matching.scored(matching.index_jobs(jobs(spark, sf_dir)), CANDIDATE, NOW).select("job_id", "exclude_reasons")


@query(f"with {_INDEX_SQL} select id as job_id, score from total")
def match_scores(spark, sf_dir):
    return matching.scored(matching.index_jobs(jobs(spark, sf_dir)), CANDIDATE, NOW).select("job_id", "score")


@query(f"with {_INDEX_SQL} select id as job_id, score from total where ok_place and ok_mode and ok_pay order by score desc, posted_at desc nulls last, id limit 25")
def match_jobs(spark, sf_dir):
    return matching.best_matches(matching.index_jobs(jobs(spark, sf_dir)), CANDIDATE, NOW).select("job_id", "score")


_SQL_REASONS = """list_transform(list_slice(list_sort([
        {{'o': -round(s_skills * w_skills, 6), 'n': 0, 'code': 'SIGNAL_SKILLS', 'value': round(s_skills, 6), 'weight': round(w_skills, 6)}},
        {{'o': -round(s_title * w_title, 6), 'n': 1, 'code': 'SIGNAL_TITLE', 'value': round(s_title, 6), 'weight': round(w_title, 6)}},
        {{'o': -round(s_place * w_place, 6), 'n': 2, 'code': 'SIGNAL_LOCATION_WORK_MODE', 'value': round(s_place, 6), 'weight': round(w_place, 6)}},
        {{'o': -round(s_level * w_level, 6), 'n': 3, 'code': 'SIGNAL_SENIORITY', 'value': round(s_level, 6), 'weight': round(w_level, 6)}},
        {{'o': -round(s_age * w_age, 6), 'n': 4, 'code': 'SIGNAL_RECENCY', 'value': round(s_age, 6), 'weight': round(w_age, 6)}},
        {{'o': -round(s_pay * w_pay, 6), 'n': 5, 'code': 'SIGNAL_COMPENSATION', 'value': round(s_pay, 6), 'weight': round(w_pay, 6)}}]), 1, 3), lambda r: {{'code': r.code, 'value': r.value, 'weight': r.weight, 'contribution': -r.o}})"""
_WEIGHTS_SQL = "0.35::double as w_skills, 0.2::double as w_title, 0.15::double as w_place, 0.1::double as w_level, 0.1::double as w_age, 0.1::double as w_pay"


def _reason_rows(df):
    """Reasons a row each: comparing nested structs would compare their printing."""
    return df.select("job_id", F.array_join("required_missing_skills", ",").alias("missing"), F.array_join("quality_flags", ",").alias("flags"), F.posexplode("match_reasons").alias("pos", "r")).select("job_id", "missing", "flags", "pos", "r.code", "r.value", "r.weight", "r.contribution")


_REASON_SQL = "select job_id, missing, flags, unnest(range(3))::int as pos, unnest(rs).code as code, unnest(rs).value as value, unnest(rs).weight as weight, unnest(rs).contribution as contribution from (select id as job_id, array_to_string(list_sort(lacks), ',') as missing, array_to_string(flags, ',') as flags, {reasons} as rs from {frm})"


@query(f"with {_INDEX_SQL} " + _REASON_SQL.format(reasons=_SQL_REASONS.format(), frm=f"(select *, {_WEIGHTS_SQL} from total)"))
def match_reasons(spark, sf_dir):
    return _reason_rows(matching.scored(matching.index_jobs(jobs(spark, sf_dir)), CANDIDATE, NOW))


#: A candidate as a caller would send it, and a policy that overrides two weights.
CANDIDATE_JSON = """{"profile_id": "P1", "skills": ["Python", "SQL", "c++", "machine learning"], "titles": ["Data Engineer", "ML-Engineer"], "locations": ["en"], "work_mode_preferences": ["remote"], "seniority_targets": ["senior", "staff"],
    "salary_targets": {"minimum": 20000}, "visa_work_auth": {"requires_sponsorship": "true", "authorized_locations": ["fr", "remote"]}}"""
POLICY_JSON = """{"weights": {"skills": 0.45, "title": "0.1", "recency": "x"}, "reason_limit": "3"}"""
_PUBLISHED_SQL = f"""{_INDEX_SQL}, pub as (select * replace (case when len(list_intersect(['data', 'engineer', 'ml'], tt)) > 0 then 1.0::double else 0.0 end as s_title,
        case when not ok_place and not ok_mode then 0.0::double when ok_place and ok_mode and ok_pay then 1.0 else 0.5 end as s_place,
        len(list_filter({_SKILLS}, lambda s: list_contains(skill_tokens, s))) / 4.0::double as s_skills, least(1.0::double, s_age) as s_age),
        0.45 * 1.2::double as w_skills, 0.1::double as w_title, 0.15 * 0.5::double as w_place, 0.1::double as w_level, 0.1::double as w_age, 0.1::double as w_pay, not (ok_place and ok_mode and ok_pay) as excluded from total),
    ranked as (select * replace (case when excluded then 0.0 else round(least(1, s_skills * w_skills + s_title * w_title + s_place * w_place + s_level * w_level + s_age * w_age + s_pay * w_pay), 6) end as score) from pub order by excluded, score desc, posted_at desc nulls last, id limit 400)"""


def _published(spark, sf_dir):
    """Ranked jobs with a profile's multipliers, one of which is clamped; another entry has expired."""
    live, features = publish.job_features(jobs(spark, sf_dir))
    c, policy = publish.candidate_from_json(CANDIDATE_JSON, POLICY_JSON)
    rows = [("p1", {"skills": 1.2, "location_work_mode": 0.2}, None), ("p2", {"skills": 0.5}, None), ("p1", {"title": 1.4}, "2026-01-01 00:00:00")]
    weights = spark.createDataFrame(rows, "profile_id string, multipliers map<string,double>, expires_at string").withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    return publish.ranked_jobs(live, features, c, NOW, policy, weights, top_k=400, include_excluded=True)


@query(f"with {_PUBLISHED_SQL} select id as job_id, score, array_to_string(list_sort(lacks), ',') as missing, apply_url, posted_at, source, array_to_string(flags, ',') as flags, excluded, concat_ws(',', case when not ok_place then 'FILTER_LOCATION' end, case when not ok_mode then 'FILTER_WORK_MODE' end, case when not ok_pay then 'FILTER_SALARY' end) as exclude_reasons from ranked")
def match_jobs_v1(spark, sf_dir):
    joined = lambda c, n: F.array_join(c, ",").alias(n)
    return _published(spark, sf_dir).select("job_id", "score", joined("required_missing_skills", "missing"), "apply_url", F.date_format("posted_at", "yyyy-MM-dd").alias("posted_at"), "source", joined("quality_flags", "flags"), "excluded", joined("exclude_reasons", "exclude_reasons"))


@query(f"with {_PUBLISHED_SQL} " + _REASON_SQL.format(reasons=_SQL_REASONS.format(), frm="ranked"))
def match_jobs_v1_reasons(spark, sf_dir):
    return _reason_rows(_published(spark, sf_dir))


@query("""with r as (select user_id as case_id, event_id as job_id, row_number() over (partition by user_id order by value desc, event_id) as rank from events),
    rel as (select user_id as case_id, event_id as job_id from events where event_id % 3 = 0), k as (select unnest([10, 25, 50]) as k),
    c as (select case_id, count(*) as n from rel group by 1)
    select k::int as k, avg(h / k::double) as precision, avg(h / n::double) as recall from (select k, c.case_id, n, (select count(*) from r join rel using (case_id, job_id) where r.case_id = c.case_id and r.rank <= k.k) as h from k, c) group by k""")
def precision_recall(spark, sf_dir):
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("job_id"), "value")
    ranked = e.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("value"), "job_id")))
    return matching.relevance(ranked, e.where("job_id % 3 = 0").select("case_id", "job_id"))

def _by_key(n, *values):
    return F.element_at(F.array(*values), (F.col("s_suppkey") % n + 1).cast("int"))


def _candidates(spark, sf_dir):
    """A candidate for each supplier, with wishes of all kinds, none, and some that nothing meets."""
    words = lambda *w: F.array(*[F.lit(x) for x in w]).cast("array<string>")
    i = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        i.cast("string").alias("profile_id"),
        _by_key(5, words("python", "sql", "aws"), words("java"), words(), words("c++", "machine learning", "rust"), words("docker", "typescript", "nothing", "nowhere")).alias("skills"),
        _by_key(4, words("Data Engineer", "ML engineer"), words("backend developer"), words(), words("manager", "C")).alias("titles"),
        _by_key(6, words("en"), words(), words("fr", "de"), words("remote"), words("xx"), words()).alias("locations"),
        _by_key(3, words("remote"), words(), words("onsite", "remote")).alias("work_modes"),
        _by_key(4, words(), words("senior", "staff"), words(), words("junior")).alias("seniority"),
        _by_key(7, words("full_time"), words("contract", "internship"), *[words()] * 5).alias("employment"),
        F.when(i % 3 == 0, 15000.0).alias("salary_minimum"), F.when(i % 5 != 0, i % 2 == 0).alias("requires_sponsorship"),
    )


def _offers(spark, sf_dir):
    """Jobs with kinds of employment, and some that say that they give no visa."""
    i = F.col("doc_id")
    kind = F.when(i % 4 == 0, "full-time").when(i % 4 == 1, "contract").when(i % 4 == 3, "Full time")
    visa = F.when(i % 6 == 0, " No sponsorship.").when(i % 6 == 1, " We do NOT sponsor").otherwise("")
    return matching.index_jobs(jobs(spark, sf_dir).withColumns({"employment_type": kind, "description_text": F.concat("description_text", visa)}))


_NO_WORDS = "[]::varchar[]"
_BATCH_SQL = f"""{JOBS_SQL.replace("jobs as (", "plain as (", 1)}, jobs as (select * replace (description_text || case doc_id % 6 when 0 then ' No sponsorship.' when 1 then ' We do NOT sponsor' else '' end as description_text), case doc_id % 4 when 0 then 'full_time' when 1 then 'contract' else 'unknown' end as kind from plain), {_IX_SQL},
    c as (select s_suppkey as i, case i % 5 when 0 then ['python', 'sql', 'aws'] when 1 then ['java'] when 3 then ['c++', 'machine learning', 'rust'] when 4 then ['docker', 'typescript', 'nothing', 'nowhere'] else {_NO_WORDS} end as wanted,
        case i % 4 when 0 then [['data', 'engineer'], ['ml', 'engineer']] when 1 then [['backend', 'developer']] when 3 then [['manager']] else []::varchar[][] end as sets, case i % 6 when 0 then ['en'] when 2 then ['fr', 'de'] when 3 then ['remote'] when 4 then ['xx'] else {_NO_WORDS} end as places,
        case i % 3 when 0 then ['remote'] when 2 then ['onsite', 'remote'] else {_NO_WORDS} end as modes, case i % 4 when 1 then ['senior', 'staff'] when 3 then ['junior'] else {_NO_WORDS} end as levels, case i % 7 when 0 then ['full_time'] when 1 then ['contract', 'internship'] else {_NO_WORDS} end as kinds,
        case when i % 3 = 0 then 15000.0::double end as least, coalesce(i % 5 <> 0 and i % 2 = 0, false) as visa from supplier),
    pairs as (select i, id as job_id, posted_at, id, doc_id, round(least(1, 0.35::double * case when len(wanted) > 0 then len(list_filter(wanted, lambda s: list_contains(tokens, s))) / len(wanted)::double else 0.5 end
            + 0.2::double * case when len(sets) > 0 then list_max(list_transform(sets, lambda t: len(list_intersect(t, tt)) / len(list_distinct(list_concat(t, tt)))::double)) else 0.5 end + 0.15::double
            + 0.1::double * case when len(levels) = 0 then 0.5 when list_contains(levels, seniority) then 1 else 0 end + 0.1::double * coalesce(exp(-ln(2) * greatest(0, epoch(timestamp '{NOW}' - posted_at::timestamp) / 86400.0::double) / 90), 0)
            + 0.1::double * case when least is null then 0.5 else 1 end), 6) as score,
            list_filter(wanted, lambda s: not list_contains(skill_tokens, s)) as lacks
        from c, ix where (len(places) = 0 or len(list_filter(places, lambda p: contains(lower(location), p))) > 0 or (work_mode = 'remote' and list_contains(places, 'remote'))) and (len(modes) = 0 or list_contains(modes, work_mode))
            and (len(kinds) = 0 or list_contains(kinds, kind)) and (least is null or coalesce(pay >= least, false)) and not (visa and (contains(lower(description_text), 'no sponsorship') or contains(lower(description_text), 'not sponsor')))),
    best as (select *, row_number() over (partition by i order by score desc, posted_at desc nulls last, job_id) as rank from pairs)"""


@query(f"with {_BATCH_SQL} select i::varchar as profile_id, rank::int as rank, job_id, score, array_to_string(list_sort(lacks), ',') as missing from best where rank <= 10")
def match_batch(spark, sf_dir):
    """The first ten jobs of every candidate."""
    out = batch.best_matches(_offers(spark, sf_dir), _candidates(spark, sf_dir), NOW, top_k=10)
    return out.select("profile_id", "rank", "job_id", "score", F.array_join("required_missing_skills", ",").alias("missing"))


#: Candidates as texts: a good one and seven with something wrong.
_TEXTS = (
    '{"profile_id": " P# ", "skills": ["Python", "python ", " "], "work_mode_preferences": ["Remote"], "salary_targets": {"minimum": "50000.5", "currency": " eur "}, "visa_work_auth": {"requires_sponsorship": true}}',
    '{"profile_id": "p#", "seniority_targets": "senior", "skills": ""}', '{"profile_id": "p#", "work_mode_preferences": ["remote", "moon", "Mars"]}', '{"profile_id": "p#", "skills": [1, "a"], "titles": null}',
    '{"profile_id": "p#", "years_experience": true, "salary_targets": []}', '{"profile_id": " ", "skills": ["c++"]}', "not json #", '{"profile_id": "p#", "visa_work_auth": {"requires_sponsorship": "yes"}, "salary_targets": {"minimum": "lots", "maximum": 70000}}',
)


@query("""select s_suppkey as key, case when s_suppkey % 8 not in (5, 6) then 'p' || s_suppkey end as profile_id, case s_suppkey % 8 when 0 then 'python' when 5 then 'c++' else '' end as skills, case s_suppkey % 8 when 0 then 'remote' else '' end as work_modes,
    case s_suppkey % 8 when 0 then 50000.5::double end as salary_minimum, case s_suppkey % 8 when 0 then 'EUR' end as salary_currency, case s_suppkey % 8 when 0 then true end as requires_sponsorship,
    case s_suppkey % 8 when 1 then 'seniority_targets must be an array of strings' when 2 then 'work_mode_preferences contains unsupported values: mars, moon' when 3 then 'skills entries must be strings' when 4 then 'years_experience must be numeric;salary_targets must be an object'
        when 5 then 'profile_id must be non-empty' when 6 then ' must be an object' when 7 then 'salary_targets.minimum must be numeric;visa_work_auth.requires_sponsorship must be boolean' else '' end as errors from supplier""")
def candidate_texts(spark, sf_dir):
    """Candidates read from JSON, with what is wrong with each."""
    i = F.col("s_suppkey")
    raw = F.element_at(F.array(*[F.lit(t) for t in _TEXTS]), (i % 8 + 1).cast("int"))
    out = candidates.parsed_candidates(read(spark, sf_dir, "supplier").select(i.alias("key"), F.replace(raw, F.lit("#"), i.cast("string")).alias("raw")))
    said = F.transform("errors", lambda e: F.concat(e["field"], F.lit(" "), e["problem"]))
    return out.select("key", "profile_id", F.array_join("skills", ",").alias("skills"), F.array_join("work_modes", ",").alias("work_modes"), "salary_minimum", "salary_currency", "requires_sponsorship", F.array_join(said, ";").alias("errors"))


_CASES_SQL = f"""{_BATCH_SQL}, wished as (select c.i, doc_id::varchar as job_id from c, documents where doc_id % 10 = c.i % 10 and c.i % 4 <> 2 and doc_id < 400), sizes as (select i, count(*) as n from wished group by 1),
    figures as (select k::int as k, avg(h / k::double) as precision, avg(h / n::double) as recall from (select k.k, s.n, (select count(*) from best b join wished w on w.i = b.i and w.job_id = b.job_id where b.i = s.i and b.rank <= k.k) as h from sizes s, (select unnest([10, 25, 50]) as k) k) group by k)"""


def _measured(spark, sf_dir):
    """Cases: jobs whose number ends like the candidate's suit; a quarter of the candidates have none."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda n: (n * 10 + F.col("profile_id").cast("long") % 10).cast("string"))
    suit = read(spark, sf_dir, "documents").where("doc_id < 400").select(F.col("doc_id").cast("string").alias("id")).agg(F.collect_set("id").alias("known"))
    cases = _candidates(spark, sf_dir).join(F.broadcast(suit)).withColumn("relevant", F.when(F.col("profile_id").cast("long") % 4 == 2, F.array(F.lit(" "))).otherwise(F.array_intersect(ids, "known")))
    return batch.evaluated(_offers(spark, sf_dir), cases.drop("known"), NOW)


@query(f"with {_CASES_SQL} select k, precision, recall from figures")
def relevance_of_cases(spark, sf_dir):
    """Matching of every case, and how much of what suits is found."""
    return _measured(spark, sf_dir)



@query("select user_id as profile_id, event_type as event, count(*) as count from events group by 1, 2")
def feedback_counts(spark, sf_dir):
    return matching.feedback_counts(read(spark, sf_dir, "events").select(F.col("user_id").alias("profile_id"), F.col("event_type").alias("event")))


@query("select profile_id, event, count(*) as count from (select user_id::varchar as profile_id, event_type as event from events) group by grouping sets ((profile_id, event), (event), ())")
def feedback_totals(spark, sf_dir):
    return matching.feedback_totals(read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("profile_id"), F.col("event_type").alias("event")))


@query("""with o as (select *, row_number() over () as ordinal from events), e as (select user_id % 50 as p, event_id % 40 as j, (event_id % 3) as k, ordinal, ordinal <= 5000 as old from o),
    log as (select p, j, k, row_number() over (order by ordinal desc) as back from e where old), new as (select p, j, k, min(ordinal) as ordinal from e where not old group by all)
    select 'p' || p as profile_id, 'j' || j as job_id, case k when 0 then 'not_relevant' when 1 then 'applied' else 'interviewed' end as event, ordinal - 1 as ordinal from new where not exists (select 1 from log where log.back <= 1000 and log.p = new.p and log.j = new.j and log.k = new.k)""")
def feedback_recorded(spark, sf_dir):
    """Events that the end of the log doesn't have yet; their meta has its keys in changing order."""
    i, kinds = F.col("event_id"), F.array(*[F.lit(k) for k in matching.FACTORS])
    e = parquet_in_order(spark, f"{sf_dir}/events.parquet").select(F.concat(F.lit(" P"), F.col("user_id") % 50).alias("profile_id"), F.concat(F.lit("j"), i % 40, F.lit(" ")).alias("job_id"), F.element_at(kinds, (i % 3 + 1).cast("int")).alias("event"), F.when(i % 2 == 0, '{"a": 1, "b": 2}').otherwise('{"b":2,"a":1}').alias("meta"), "ordinal")
    tidy = e.withColumns({"profile_id": F.lower(F.trim("profile_id")), "job_id": F.trim("job_id")})
    log = tidy.where("ordinal < 5000").select(matching.event_hash().alias("event_hash"), "ordinal")
    return matching.recorded(log, e.where("ordinal >= 5000")).select("profile_id", "job_id", "event", "ordinal")


_FACTORS_SQL = ", ".join(f"('{s}', {', '.join(str(float(f[n])) for f in matching.FACTORS.values())})" for n, s in enumerate(matching.WEIGHTS))


@query(f"""with e as (select user_id as profile_id, list(event_id % 3 order by ts, event_id) as kinds from events group by 1), s(signal, f0, f1, f2) as (values {_FACTORS_SQL})
    select profile_id, signal, round(list_reduce(list_prepend(1.0::double, list_transform(kinds, lambda k: (case k when 0 then f0 when 1 then f1 else f2 end)::double)), lambda w, f: greatest(0.5::double, least(1.5::double, w * f))), 9) as weight from e, s""")
def feedback_weights(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    kinds = F.element_at(F.array(*[F.lit(k) for k in matching.FACTORS]), (F.col("event_id") % 3 + 1).cast("int"))
    return matching.feedback_weights(e.select(F.col("user_id").alias("profile_id"), F.col("ts").alias("recorded_at"), "event_id", kinds.alias("event"))).withColumn("weight", F.round("weight", 9))


_PAGES = "select page_id, 'HTTPS://Jobs.example/p/' || (page_id % 40) || '/?utm_source=a' || page_id || '&GH_JID=' || (page_id % 50) || '#top' as address from pages"


def _addresses(spark, sf_dir):
    i = F.col("page_id")
    return read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("HTTPS://Jobs.example/p/"), i % 40, F.lit("/?utm_source=a"), i, F.lit("&GH_JID="), i % 50, F.lit("#top")).alias("address"))


@query(f"select page_id, 'https://jobs.example/p/' || (page_id % 40) || '/?gh_jid=' || (page_id % 50) as url_key from ({_PAGES})")
def url_key(spark, sf_dir):
    return _addresses(spark, sf_dir).select("page_id", text.url_key(F.col("address")).alias("url_key"))


@query("select min(page_id) as page_id, 'https://jobs.example/p/' || (page_id % 40) || '/?gh_jid=' || (page_id % 50) as k from pages group by page_id % 40, page_id % 50")
def dedup_keep_first(spark, sf_dir):
    return catalog.keep_first(_addresses(spark, sf_dir).select("page_id", text.url_key(F.col("address")).alias("k")), "k", "page_id")


@query("select event_id from events where ts > timestamp '2024-01-10 00:00:00' and event_id % 7 <> 0")
def incremental_filter(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("source_job_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("posted_at"), F.lit(None).cast("string").alias("source_updated_at"))
    seen = read(spark, sf_dir, "events").where("event_id % 7 = 0").select(F.col("event_id").alias("source_job_id"))
    return catalog.newer(e, "2024-01-10 00:00:00", seen).select(F.col("source_job_id").alias("event_id"))


def _catalog(spark, sf_dir, policy):
    o = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    old = o.where("o_orderkey % 3 <> 0").select(key.alias("stable_key"), F.lit("2025-01-01").alias("first_seen_at_utc"), F.when(F.col("o_orderkey") % 5 == 0, "2025-01-01").otherwise("2026-01-01").alias("last_seen_at_utc"), (F.col("o_orderkey") % 2 == 0).alias("is_active"), F.lit("h1").alias("last_payload_hash"), F.lit("2025-06-01").alias("latest_posted_at"), F.lit(None).cast("string").alias("latest_updated_at"), F.lit("{}").alias("latest_record_json"))
    new = o.where("o_orderkey % 4 <> 0").select(key.alias("stable_key"), F.when(F.col("o_orderkey") % 7 == 0, "h1").otherwise("h2").alias("payload_hash"), F.when(F.col("o_orderkey") % 11 < 5, "2025-07-01").otherwise("2025-05-01").alias("posted_at"), F.lit(None).cast("string").alias("updated_at"), F.lit("{}").alias("record_json"))
    return catalog.merge(old, new, "2026-01-15", True, policy).select("stable_key", "is_active", "last_payload_hash", "change")


_CATALOG_SQL = """with s as (select o_orderkey as k, o_orderkey % 3 <> 0 as old, o_orderkey % 4 <> 0 as new from orders), c as (select *, new and (not old or (k % 7 <> 0 and {wins})) as takes from s where old or new)
    select k::varchar as stable_key, new as is_active, case when takes then case when k % 7 = 0 then 'h1' else 'h2' end else 'h1' end as last_payload_hash,
    case when new and not old then 'new' when takes then 'updated' when new then 'unchanged' when k % 2 = 0 then 'tombstoned' else 'kept' end as change
    from c where new or k % 5 <> 0"""


@query(_CATALOG_SQL.format(wins="k % 11 < 5"))
def catalog_merge_updated_hash(spark, sf_dir):
    return _catalog(spark, sf_dir, "updated_hash")


@query(_CATALOG_SQL.format(wins="true"))
def catalog_merge_last_seen(spark, sf_dir):
    return _catalog(spark, sf_dir, "last_seen")


@query(_CATALOG_SQL.format(wins="false"))
def catalog_merge_first_seen(spark, sf_dir):
    return _catalog(spark, sf_dir, "first_seen")


@query("""with s as (select o_orderkey as k, o_orderkey % 3 <> 0 as old, o_orderkey % 4 <> 0 as new from orders), c as (select *, new and (not old or (k % 7 <> 0 and k % 11 < 5)) as takes from s where old or new)
    select k::varchar as stable_key, new as is_active, case when takes and k % 7 <> 0 then 'h2' else 'h1' end as last_payload_hash, case when takes then '{"from": "second"}' else '{"from": "first"}' end as latest_record_json from c""")
def catalog_of_pointers(spark, sf_dir):
    """Two merges into a catalog that moves keys only, read with its texts."""
    o, folder = read(spark, sf_dir, "orders"), f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}"
    key, none = F.col("o_orderkey").cast("string").alias("stable_key"), F.lit(None).cast("string").alias("updated_at")
    first = o.where("o_orderkey % 3 <> 0").select(key, F.lit("h1").alias("payload_hash"), F.lit("2025-06-01").alias("posted_at"), none, F.lit('{"from": "first"}').alias("record_json"))
    second = o.where("o_orderkey % 4 <> 0").select(key, F.when(F.col("o_orderkey") % 7 == 0, "h1").otherwise("h2").alias("payload_hash"), F.when(F.col("o_orderkey") % 11 < 5, "2025-07-01").otherwise("2025-05-01").alias("posted_at"), none, F.lit('{"from": "second"}').alias("record_json"))
    pointers.merge(spark, folder, first, "2026-01-01", True)
    pointers.merge(spark, folder, second, "2026-01-15", True)
    return pointers.read(spark, folder).select("stable_key", "is_active", "last_payload_hash", "latest_record_json")


@query("select count(*) filter (o_orderkey % 3 = 0 and o_orderkey % 4 <> 0) as inserts, count(*) filter (o_orderkey % 3 <> 0 and o_orderkey % 4 <> 0) as updates, count(*) filter (o_orderkey % 3 <> 0 and o_orderkey % 4 = 0) as missing from orders")
def upsert_counts(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return catalog.upsert_counts(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 4 <> 0"), "o_orderkey")


@query("""select o_orderkey, o_orderkey % 4 <> 0 as is_active, case when o_orderkey % 4 <> 0 then 's' else 't' end as side, case when o_orderkey % 3 <> 0 and (o_orderkey % 4 <> 0) = (o_orderkey % 5 <> 0) then 'before' else 'now' end as changed_at,
    o_orderkey % 4 <> 0 as has_features from orders where o_orderkey % 3 <> 0 or o_orderkey % 4 <> 0""")
def published_jobs(spark, sf_dir):
    """What a publication leaves: jobs that went are inactive, features of inactive jobs are gone."""
    o = read(spark, sf_dir, "orders").select("o_orderkey")
    target = o.where("o_orderkey % 3 <> 0").withColumns({"side": F.lit("t"), "is_active": F.col("o_orderkey") % 5 != 0, "changed_at": F.lit("before")})
    out = catalog.published(target, o.where("o_orderkey % 4 <> 0").withColumn("side", F.lit("s")), "o_orderkey", "now")
    left = catalog.without_orphans(o, out, "o_orderkey").withColumn("has_features", F.lit(True))
    return out.join(left, "o_orderkey", "left").withColumn("has_features", F.coalesce("has_features", F.lit(False)))


@query("""with e as (select case when o_orderkey % 11 <> 0 then o_custkey % 997 end as cust, o_totalprice as price, case when o_orderkey % 7 = 0 then ' N/A ' when o_orderkey % 7 = 1 then '' else o_orderpriority end as word, o_orderkey % 5 as day from orders where o_orderkey % 5 < 3)
    select 'cust' as column, count(*) as rows, count(*) - count(cust) as null_count, 0 as empty_count, 0 as sentinel_count, true as distinct_ok, true as deciles_ok from e union all select 'price', count(*), 0, 0, 0, true, true from e
    union all select 'word', count(*), 0, count(*) filter (word = ''), count(*) filter (word = ' N/A '), true, true from e""")
def merged_profile(spark, sf_dir):
    """A profile of three days of five from their sketches, and whether what they estimate is as near to the exact figures as they promise."""
    i = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select((i % 5).alias("day"), F.when(i % 11 != 0, F.col("o_custkey") % 997).alias("cust"), F.col("o_totalprice").cast("double").alias("price"), F.when(i % 7 == 0, " N/A ").when(i % 7 == 1, "").otherwise(F.col("o_orderpriority")).alias("word"))
    stored = kept(sketches.sketched(rows, ["day"], ["cust", "price", "word"], ("price",)), "sketches")
    part = kept(sketches.merged(stored.where("day < 3"), []), "merged")
    exact = rows.where("day < 3").agg(*[F.count_distinct(c).alias(c) for c in ("cust", "price", "word")])
    known = profile.long_form(exact, ["cust", "price", "word"], "column", "exact")
    curve = sketches.curve_of(part).where("column = 'price'")
    ranks = rows.where("day < 3").join(F.broadcast(curve), F.col("price") <= F.col("value")).groupBy("quantile").count()
    total = rows.where("day < 3").agg(F.count(F.lit(1)).alias("n"))
    good = ranks.crossJoin(F.broadcast(total)).agg(F.bool_and(F.abs(F.col("count") / F.col("n") - F.col("quantile")) < 0.03).alias("deciles_ok"))
    out = sketches.profile_of(part).join(known, "column").crossJoin(F.broadcast(good))
    near = F.abs(F.col("distinct_count") - F.col("exact")) <= F.greatest(F.lit(3.0), F.col("exact") * 0.06)
    return out.select("column", "rows", "null_count", "empty_count", "sentinel_count", near.alias("distinct_ok"), "deciles_ok")


@query(f"with {JOBS_SQL} select count(*) as rows, 0.0 as title_missing, avg((company is null)::int) as company_missing, avg((posted_at is null)::int) as posted_at_missing, avg((apply_url = '')::int) as apply_url_missing, 1.0 as place_share, 1.0 as readable_share, date_diff('day', max(posted_at)::date, date '2026-01-15') as newest_age_days from jobs")
def ingest_quality(spark, sf_dir):
    return catalog.ingest_checks(jobs(spark, sf_dir), NOW)


# -- ingest ---------------------------------------------------------------------------------------------


def _normalized(spark, sf_dir, source):
    return ingest.normalized(raw_records(spark, sf_dir, source), source, REF, AT)


@query(NORMALIZED_SQL)
def ingest_normalized(spark, sf_dir):
    """Records of four boards and of one without rules of its own."""
    columns = ["source", "id", "title", "company", "location", "remote", "description_text", "salary_min", "apply_url", "job_url", "posted_at", "source_updated_at", "work_mode", "employment_type", "seniority"]
    parts = [_normalized(spark, sf_dir, s).select(*columns) for s in (*ingest.SOURCES, "other")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""select doc_id, sha256('{"a": [1, ' || doc_id || '], "b": {"c": "\\u00e9", "d": null}}') as payload_hash from documents""")
def payload_hashes(spark, sf_dir):
    raw = F.concat(F.lit('{"b": {"d": null, "c": "é"},   "a": [1,'), F.col("doc_id"), F.lit("]}"))
    return read(spark, sf_dir, "documents").select("doc_id", ingest.payload_hash(raw).alias("payload_hash"))


@query("""with g as (select count(*) as n, avg((doc_id % 4 = 0)::int) as x from documents), c(n, code, value, "limit", bad) as (
    select 0, 'REQUIRED_COLUMNS', 0.0::double, 0.0::double, false union all select 1, 'MIN_ROWS', n::double, 1.0, false from g union all select 2, 'NULL_RATE_APPLY_URL', 0, 0, false union all select 3, 'NULL_RATE_COMPANY', 0, 0.05, false
    union all select 4, 'NULL_RATE_DESCRIPTION_TEXT', 0, 0.1, false union all select 5, 'NULL_RATE_ID', 0, 0, false union all select 6, 'NULL_RATE_POSTED_AT', 0, 0.1, false union all select 7, 'NULL_RATE_SOURCE_JOB_ID', 0, 0, false
    union all select 8, 'NULL_RATE_TITLE', 0, 0, false union all select 9, 'LOCATION_OR_REMOTE_SIGNAL', 1, 0.85, false union all select 10, 'POSTED_AT_PARSEABLE', 0, 0, false
    union all select 11, 'POSTED_AT_FRESHNESS', 4, 365, false union all select 12, 'SOURCE_UPDATED_AT_PARSEABLE', 0, 0, false union all select 13, 'SOURCE_UPDATED_AT_FRESHNESS', 4, 730, false)
    select n, 'INGEST_QUALITY_' || code as code, value, "limit", case when bad then 'fail' else 'pass' end as status from c""")
def ingest_checks_of_board(spark, sf_dir):
    return ingest.quality_checks(_normalized(spark, sf_dir, "greenhouse"), AT)


@query(f"""with {JOBS_SQL}, k as (select source, count(*) as n, round(100.0 * count(company) / count(*), 3) as c, round(100.0 * count(posted_at) / count(*), 3) as p from jobs group by source)
    select round(sum(c * n) / sum(n), 3) as company_non_null_pct, round(sum(p * n) / sum(n), 3) as posted_at_non_null_pct, 100.0 as description_text_non_null_pct, 100.0 as location_or_remote_signal_pct from k""")
def completeness_over_sources(spark, sf_dir):
    return ingest.completeness_over_sources(ingest.key_completeness(jobs(spark, sf_dir), by=["source"]))


@query("select strftime(timestamp '2026-01-01 00:00:00' + to_seconds(max(doc_id)), '%Y-%m-%dT%H:%M:%S+00:00') as high_posted_at, strftime(timestamp '2026-01-01 00:00:00' + to_seconds(max(doc_id)), '%Y-%m-%dT%H:%M:%S+00:00') as high_source_updated_at from documents")
def ingest_watermarks(spark, sf_dir):
    return ingest.watermarks(_normalized(spark, sf_dir, "lever"))


@query("""with s as (select doc_id, 'url:https://g.example/' || doc_id as k from documents)
    select k as stable_key, true as is_active, case when doc_id % 3 = 0 then 'unchanged' when doc_id % 3 = 1 then 'updated' else 'new' end as change from s where doc_id % 10 <> 0
    union all select k, false, 'tombstoned' from s where doc_id % 10 = 0 and doc_id % 3 <> 2""")
def ingest_sync(spark, sf_dir):
    """A whole pull into a catalog that has two thirds of the board, a third of it unchanged; a tenth is gone from the board."""
    raw = raw_records(spark, sf_dir, "greenhouse").where("doc_id % 10 <> 0")
    url, whole = F.concat(F.lit("url:https://g.example/"), F.col("doc_id")), raw_records(spark, sf_dir, "greenhouse")
    known = whole.where("doc_id % 3 <> 2").select(url.alias("stable_key"), F.lit("2026-01-01").alias("first_seen_at_utc"), F.lit("2026-01-01").alias("last_seen_at_utc"), F.lit(True).alias("is_active"), F.when(F.col("doc_id") % 3 == 0, ingest.payload_hash(F.col("raw"))).otherwise("0").alias("last_payload_hash"), F.lit("2025-12-01").alias("latest_posted_at"), F.lit("2025-12-01").alias("latest_updated_at"), F.lit("{}").alias("latest_record_json"))
    nothing = spark.createDataFrame([], sync.STATE)
    return sync.synced(sync.Pull("greenhouse", REF, raw, max_jobs=None), known, nothing, AT).catalog.select("stable_key", "is_active", "change")


def _twice(spark, sf_dir):
    """Two pulls of a board in a row: two thirds of its postings, then all, a quarter of them with later dates. The second one was cut short."""
    numbers = parquet_in_order(spark, f"{sf_dir}/documents.parquet").select("doc_id", "ordinal")
    board = raw_records(spark, sf_dir, "lever").join(numbers, "doc_id")
    later = F.regexp_replace("raw", '"createdAt":1767', '"createdAt":1768')
    first = sync.Pull("lever", REF, board.where("doc_id % 3 <> 0"))
    second = sync.Pull("lever", REF, board.withColumn("raw", F.when(F.col("doc_id") % 4 == 0, later).otherwise(F.col("raw"))), requests=25)
    one = sync.synced(first, spark.createDataFrame([], sync.CATALOG), spark.createDataFrame([], sync.STATE), "2026-01-14T00:00:00+00:00")
    known, state = kept(one.catalog.drop("change"), "catalog"), kept(one.state, "state")
    return sync.synced(second, known, state, AT)


_TWICE_SQL = """b as (select doc_id as i, row_number() over () - 1 as ordinal from documents), first as (select *, row_number() over (order by ordinal desc) as back from b where i % 3 <> 0),
    mark as (select max(i) as top from first), t as (select b.*, i + case when i % 4 = 0 then 1000000 else 0 end as secs, f.i is not null as known, coalesce(back <= 500, false) as seen, top from b left join first f using (i), mark),
    came as (select * from t where not seen and secs > top)"""


@query(f"with {_TWICE_SQL} select 'url:https://l.example/' || i as stable_key, case when i in (select i from came) then '2026-01-15T00:00:00+00:00' else '2026-01-14T00:00:00+00:00' end as last_seen_at_utc, case when i not in (select i from came) then 'kept' when known then 'updated' else 'new' end as change from t where known or i in (select i from came)")
def sync_twice(spark, sf_dir):
    """The catalog after the second pull: only what the state of the first one doesn't rule out was taken."""
    return _twice(spark, sf_dir).catalog.select("stable_key", "last_seen_at_utc", "change")


@query(f"""with {_TWICE_SQL}, ids as (select i, 0 as pull, ordinal from first where back <= 500 union all select i, 1, ordinal from came), last as (select *, row_number() over (order by pull desc, ordinal desc) as back from ids)
    select source, source_ref, strftime(timestamp '2026-01-01' + to_seconds(greatest((select max(secs) from came), top)), '%Y-%m-%dT%H:%M:%S+00:00') as high_posted_at, strftime(timestamp '2026-01-01' + to_seconds(greatest((select max(secs) from came), top)), '%Y-%m-%dT%H:%M:%S+00:00') as high_updated_at, '2026-01-15T00:00:00+00:00' as last_success_at_utc,
    false as last_coverage_complete, (select string_agg('L' || i, ',' order by back desc) from last where back <= 500) as recent_ids from (select 'lever' as source, 'acme' as source_ref, top from mark)""")
def sync_state(spark, sf_dir):
    """The board's state after both pulls: merged watermarks and the last 500 ids in order of arrival."""
    return _twice(spark, sf_dir).state.withColumn("recent_ids", F.array_join("recent_ids", ","))


@query("select doc_id, row_number() over () - 1 as ordinal from documents")
def input_ordinals(spark, sf_dir):
    """The place of every row in its file."""
    return parquet_in_order(spark, f"{sf_dir}/documents.parquet").select("doc_id", "ordinal")


@query("select n_chars % 50 as k, arg_min(doc_id, o) as doc_id from (select *, row_number() over () as o from documents) group by 1")
def dedup_in_input_order(spark, sf_dir):
    """The first row of each key in the order of the input."""
    docs = parquet_in_order(spark, f"{sf_dir}/documents.parquet").select((F.col("n_chars") % 50).alias("k"), "doc_id", "ordinal")
    return catalog.keep_first(docs, "k", "ordinal").select("k", "doc_id")


# -- composites -----------------------------------------------------------------------------------------


@query(f"""with {RATE_SQL}, kept as (select *, (rate_completeness + rate_quality) / 2 as c from rated where remote and coalesce(salary_min, salary_max) >= 15000)
    select row_number() over (order by c desc, id) as fit_rank, id, c as fit_score, label_role_category from kept order by c desc, id limit 50""")
def configured_run(spark, sf_dir):
    """From a source with other names to ranked postings, by a configuration."""
    raw = jobs(spark, sf_dir).withColumnsRenamed({"location": "location_raw", "salary_min": "pay_from"}).withColumn("remote_flag", F.when(F.col("remote"), "yes").otherwise("no")).drop("remote")
    config = run.Config(fields={"salary_min": contract.Field(("pay_from",), "float")}, filter={"remote_only": True, "min_salary": 15000}, top_k=50)
    return run.run(raw, config).scored.select("fit_rank", "id", "fit_score", "label_role_category")


def _two_halves(spark, sf_dir):
    """Two data sets: one whole half, and one that lacks dates and has places that say unknown."""
    j = jobs(spark, sf_dir)
    worse = {"posted_at": F.when(F.col("doc_id") % 3 != 0, F.col("posted_at")), "location": F.when(F.col("doc_id") % 5 < 2, "Unknown").otherwise(F.col("location")), "salary_min": F.col("salary_min") * 2.5, "title": F.when(F.col("doc_id") % 13 == 1, F.concat(F.col("company"), F.lit(" "))).otherwise(F.col("title"))}
    return j.where("doc_id % 2 = 0"), j.where("doc_id % 2 = 1").withColumns(worse)


_HALVES_SQL = f"""{JOBS_SQL}, a as (select * from jobs where doc_id % 2 = 0), b as (select * replace (case when doc_id % 3 <> 0 then posted_at end as posted_at, case when doc_id % 5 < 2 then 'Unknown' else location end as location, salary_min * 2.5 as salary_min, case when doc_id % 13 = 1 then company || ' ' else title end as title) from jobs where doc_id % 2 = 1),
    whole as (select 100 - (3 * avg(100.0 * (title is null)::int) + 2.5 * avg(100.0 * (company is null)::int) + 1.5 * avg(100.0 * (posted_at is null)::int)) / 16.5 as score, count(*) filter (salary_min > salary_max) as inverted, avg(100.0 * coalesce(trim(title) = trim(company), false)::int) as same, avg(100.0 * (posted_at is not null)::int) as dated, avg(100.0 * (location = 'Unknown')::int) as nowhere from b),
    each as (select source, 100 - (3 * avg(100.0 * (title is null)::int) + 2.5 * avg(100.0 * (company is null)::int) + 1.5 * avg(100.0 * (posted_at is null)::int)) / 16.5 as score, count(*) filter (salary_min > salary_max) as inverted, round(avg(100.0 * coalesce(trim(title) = trim(company), false)::int), 4) as same from b group by source),
    found as (select * from (
        select case when score < 90 then 'P1' else 'P2' end as severity, null as source, case when score < 90 then 'Low weighted quality score' else 'Quality score below target' end as title, round(score, 4) as value from whole where score < 95
        union all select 'P0', null, 'Invalid salary ranges detected', inverted from whole where inverted > 0 union all select 'P1', null, 'Title appears to contain company names', round(same, 4) from whole where same >= 5
        union all select 'P1', null, 'Low posted_at coverage', round(dated, 4) from whole where dated < 80 union all select 'P1', null, 'Large unknown location share', round(nowhere, 4) from whole where nowhere >= 30
        union all select case when score < 90 then 'P1' else 'P2' end, source, case when score < 90 then 'Low source quality score' else 'Source quality below target' end, round(score, 4) from each where score < 95
        union all select 'P0', source, 'Invalid salary ranges in source', inverted from each where inverted > 0 union all select 'P1', source, 'Title/company contamination in source', same from each where same >= 5))"""


@query(f"with {_HALVES_SQL} select severity, source, title, value::double as value from found")
def eda_findings(spark, sf_dir):
    _, b = _two_halves(spark, sf_dir)
    return eda.findings(b, b)


@query(f"with {_HALVES_SQL} select 'failure' as level, 'finding_count' as type, 'P0' as subject, count(*)::double as value, 0.0 as threshold from found where severity = 'P0' having count(*) > 0 union all select 'warning', 'finding_count', 'P1', count(*)::double, 999999.0 from found where severity = 'P1' having count(*) > 0")
def eda_gate(spark, sf_dir):
    _, b = _two_halves(spark, sf_dir)
    return eda.gate(eda.findings(b, b))


@query(f"""with {_HALVES_SQL}, s as (select source, count(*) as n, avg(100.0 * (posted_at is not null)::int) as p, avg(100.0 * remote::int) as r from a group by 1), t as (select source, count(*) as n, avg(100.0 * (posted_at is not null)::int) as p, avg(100.0 * remote::int) as r from b group by 1)
    select source, coalesce(s.n, 0) as base_rows, coalesce(s.p, 0) as base_posted_at_pct, coalesce(s.r, 0) as base_remote_pct, coalesce(t.n, 0) as candidate_rows, coalesce(t.p, 0) as candidate_posted_at_pct, coalesce(t.r, 0) as candidate_remote_pct,
        coalesce(t.n, 0) - coalesce(s.n, 0) as delta_rows, coalesce(t.p, 0) - coalesce(s.p, 0) as delta_posted_at_pct, coalesce(t.r, 0) - coalesce(s.r, 0) as delta_remote_pct from s full join t using (source)""")
def source_profile_diff(spark, sf_dir):
    a, b = _two_halves(spark, sf_dir)
    return profile.source_diff(profile.source_profile(a), profile.source_profile(b))


_JSD = """(select 0.5 * sum(case when p > 0 then p * ln((p + 1e-12) / ((p + q) / 2 + 1e-12)) else 0 end) + 0.5 * sum(case when q > 0 then q * ln((q + 1e-12) / ((p + q) / 2 + 1e-12)) else 0 end) from (select coalesce(x.n, 0) / (select count(*) from a)::double as p, coalesce(y.n, 0) / (select count(*) from b)::double as q
    from (select {0}::varchar as v, count(*) as n from a group by 1) x full join (select {0}::varchar as v, count(*) as n from b group by 1) y on x.v is not distinct from y.v))"""


@query(f"""with {_HALVES_SQL}, m(c, value) as (select 'location', {_JSD.format("location")} union all select 'remote', {_JSD.format("remote")} union all select 'company', {_JSD.format("company")} union all select 'source', {_JSD.format("source")})
    select c as column, 'categorical' as kind, 'jsd' as metric, round(value, 4) as value, 0.1 as warn_threshold, 0.2 as fail_threshold, case when value >= 0.2 then 'fail' when value >= 0.1 then 'warn' else 'pass' end as status from m""")
def eda_drift(spark, sf_dir):
    """Of categories; ``drift_psi`` has the figure of numbers."""
    a, b = _two_halves(spark, sf_dir)
    return eda.drift(a, b, eda.Rules(numeric=()))


@query(f"""with {_HALVES_SQL} select coalesce(x.source, y.source) as source, coalesce(n, 0) as rows_raw, coalesce(m, 0) as rows_runtime, coalesce(t, 0) as title_is_company, coalesce(i, 0) as salary_inverted, round(coalesce(100.0 * t / n, 0), 4) as title_is_company_pct, round(coalesce(100.0 * i / m, 0), 4) as salary_inverted_pct
    from (select source, count(*) as n, count(*) filter (trim(title) = trim(company)) as t from b group by 1) x full join (select source, count(*) as m, count(*) filter (salary_min > salary_max) as i from a group by 1) y on x.source = y.source""")
def consistency_of_both(spark, sf_dir):
    a, b = _two_halves(spark, sf_dir)
    return profile.consistency_of_both(b, a)


@query(f"with {JOBS_SQL}, n as (select count(*) as n from jobs) select c.field, c.k as non_null_count, round(100.0 * c.k / n, 4) as non_null_pct from (select unnest(['id', 'title', 'company', 'location', 'remote', 'description_text', 'posted_at', 'apply_url', 'nowhere']) as field, unnest([count(id), count(title), count(company), count(location), count(remote), count(description_text), count(posted_at), count(apply_url), 0]) as k from jobs) c, n")
def key_fields(spark, sf_dir):
    return profile.key_fields(jobs(spark, sf_dir), ("id", "title", "company", "location", "remote", "description_text", "posted_at", "apply_url", "nowhere"))


@query("select 'word' as column, 100.0 * count(*) filter (event_id % 7 < 2) / count(*) as sentinel_pct from events union all select 'other', 100.0 * count(*) filter (event_id % 9 = 0) / count(*) from events")
def high_sentinels(spark, sf_dir):
    i = F.col("event_id")
    e = read(spark, sf_dir, "events").select("event_id", F.when(i % 7 == 0, " N/A ").when(i % 7 == 1, "Unknown").otherwise("x").alias("word"), F.when(i % 9 == 0, "none").alias("other"))
    return profile.high_sentinels(e)


@query("select min(o_orderdate)::timestamp as first, max(o_orderdate)::timestamp as last from orders")
def time_range(spark, sf_dir):
    return profile.time_range(read(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")), "o_orderdate")


@query(f"""with {JOBS_SQL}, n as (select count(*) as n, (date '2026-01-15' - max(posted_at)::date)::double as age from jobs)
    select * from (select 1 as n, 'INPUT_SAMPLE_READ' as code, 'pass' as status, n::double as value from n union all select 2, 'INPUT_CANONICAL_CONTRACT', 'pass', 0 union all select 3, 'INPUT_CONTENT_READINESS', 'pass', n from n union all select 4, 'POLICY_MIN_ROWS', 'pass', n from n
    union all select 5, 'POLICY_REQUIRED_COLUMNS', 'warn', 1 union all select 6, 'POLICY_NULL_RATE', 'warn', 1 union all select 7, 'POLICY_FRESHNESS', 'pass', age from n)""")
def reliability_checks(spark, sf_dir):
    policy = reliability.Policy(required=("title", "wage"), max_null_pct={"title": 10.0, "posted_at": 10.0})
    return reliability.evaluate(jobs(spark, sf_dir), NOW, policy).where("n > 0")


@query(f"with {JOBS_SQL} select count(*) as row_count, round(100.0 * count(company) / count(*), 4) as company_non_null_pct, round(100.0 * count(posted_at) / count(*), 4) as posted_at_non_null_pct, 100.0 as description_text_non_null_pct from jobs")
def index_summary(spark, sf_dir):
    return matching.index_summary(matching.index_jobs(jobs(spark, sf_dir)))


@query(f"""with {_CASES_SQL}, m(code, value, least) as (select 'EVAL_PRECISION_AT_10_BELOW_THRESHOLD', (select round(precision, 6) from figures where k = 10), 0.6::double union all select 'EVAL_RECALL_AT_25_BELOW_THRESHOLD', (select round(recall, 6) from figures where k = 25), 0.7::double)
    select code, value, least, case when value < least then 'fail' else 'pass' end as status from m""")
def relevance_checks(spark, sf_dir):
    return batch.evaluation_checks(_measured(spark, sf_dir))


@query("""with t as (select doc_id, case doc_id % 4 when 0 then 'Senior Data Engineer, 7+ years of Python and SQL; London or remote. $120,000 a year. Requires sponsorship' when 1 then 'analyst $95 hybrid, no sponsorship' when 2 then 'sponsorship unclear' else ' ' end as t from documents)
    select 'p' || doc_id as profile_id, case doc_id % 4 when 0 then 'python,sql' else '' end as skills, case doc_id % 4 when 0 then 'data engineer' when 1 then 'analyst' else '' end as titles, case doc_id % 4 when 0 then 'london' else '' end as locations,
        case doc_id % 4 when 0 then 'remote' when 1 then 'hybrid' else '' end as work_modes, case doc_id % 4 when 0 then 'senior' else '' end as seniority, case doc_id % 4 when 0 then 7.0::double end as years_experience, case doc_id % 4 when 0 then 120000.0::double when 1 then 95000.0 end as salary_minimum,
        case doc_id % 4 when 0 then true when 1 then false end as requires_sponsorship, case doc_id % 4 when 1 then 'salary_interval_unspecified' when 2 then 'visa_signal_ambiguous' else '' end as unknown, case doc_id % 4 when 0 then 1.0 when 1 then 0.45 else 0.25 end as confidence from t where doc_id % 4 <> 3""")
def resumes(spark, sf_dir):
    i = F.col("doc_id")
    said = F.when(i % 4 == 0, "Senior Data Engineer, 7+ years of Python and SQL; London or remote. $120,000 a year. Requires sponsorship").when(i % 4 == 1, "analyst $95 hybrid, no sponsorship").when(i % 4 == 2, "sponsorship unclear").otherwise(" ")
    out = profiles.parsed_resumes(read(spark, sf_dir, "documents").select(F.concat(F.lit(" P"), i).alias("profile_id"), said.alias("text")))
    return out.withColumns({c: F.array_join(c, ",") for c in ("skills", "titles", "locations", "work_modes", "seniority", "unknown")})


@query("""with n as (select count(*) as n, count(*) filter (event_id % 5 <> 1) as good from events) select 'salary_min' as field, 'min_salary' as column, round(0.5 * 0.95 + 0.2 * 0.6 + 0.3 * good / n, 4) as score, 0.95 as name_score, 0.6 as type_score, round(good::double / n, 4) as parse_score from n
    union all select 'remote', 'wfh', round(0.5 * 0.95 + 0.2 * 1.0 + 0.3, 4), 0.95, 1.0, 1.0 from n union all select 'title', 'job_title', round(0.5 * 0.5 + 0.2 + 0.3, 4), 0.5, 1.0, 1.0 from n union all select 'posted_at', 'created_at', round(0.5 * 0.95 + 0.2 * 0.8 + 0.3 * 0.5, 4), 0.95, 0.8, 0.5 from n""")
def adapter_inference(spark, sf_dir):
    i = F.col("event_id")
    raw = read(spark, sf_dir, "events").select(F.when(i % 5 == 1, "x").otherwise("1,200").alias("min_salary"), (i % 2 == 0).alias("wfh"), F.lit("t").alias("job_title"), F.lit(" n/a ").alias("created_at"))
    pairs = [("salary_min", "min_salary"), ("remote", "wfh"), ("title", "job_title"), ("posted_at", "created_at")]
    best = inference.suggestions(raw, 10_000_000)
    return best.where(F.struct("field", "column").isin(*[F.struct(F.lit(f).alias("field"), F.lit(c).alias("column")) for f, c in pairs]))


@query("select event_id::varchar as run_id, ts::varchar as started_at_utc from events where event_id % 2 = 0 and event_id % 3 = 0 and event_id % 5 = 0 and ts >= timestamp '2024-01-02 00:00:00' order by ts desc limit 20")
def past_runs(spark, sf_dir):
    i = F.col("event_id")
    records = read(spark, sf_dir, "events").select(i.cast("string").alias("run_id"), F.when(i % 2 == 0, "pass").otherwise("fail").alias("status"), F.when(i % 3 == 0, "run").otherwise("eda").alias("command"), F.col("ts").cast("string").alias("started_at_utc"), F.when(i % 5 == 0, F.array(F.lit("POLICY_FRESHNESS"))).alias("check_codes"))
    return guards.past_runs(records, 20, "pass", "run", "2024-01-02T00:00:00Z", "POLICY_FRESHNESS").select("run_id", "started_at_utc")


@query("with t as (select o_orderstatus as s, count(*) as n from orders group by 1) select s, n from t where n > 0")
def read_only_query(spark, sf_dir):
    return guards.select(spark, "WITH t AS (SELECT o_orderstatus AS s, count(*) AS n FROM {orders} GROUP BY 1) SELECT s, n FROM t WHERE n > 0 -- delete", orders=read(spark, sf_dir, "orders"))


def salaries_known(df: DataFrame, context: plugins.Context) -> DataFrame:
    """A plugin: keeps jobs whose lowest salary is known and not below its setting."""
    return df.where(F.col("salary_min") >= context.settings["least"])


def brief(df: DataFrame, context: plugins.Context) -> DataFrame:
    """A plugin: halves the quality of what is longer than its setting, and may push it out of bounds."""
    return df.withColumn("rate_composite", F.when(F.length("description_text") > context.settings["longest"], F.col("rate_composite") / 2).otherwise(F.col("rate_composite") + 1.0))


@query(f"""with {RATE_SQL}, kept as (select *, case when length(description_text) > 400 then (rate_completeness + rate_quality) / 4 else 1.0 end as c from rated where salary_min >= 9000)
    select row_number() over (order by c desc, id) as fit_rank, id, c as fit_score from kept order by c desc, id limit 40""")
def run_with_plugins(spark, sf_dir):
    manifest = [
        {"name": "brief", "kind": "rate", "callable": "postlark.queries:brief", "settings": {"longest": 400}},
        {"name": "off", "kind": "rate", "callable": "nowhere:nothing", "enabled": False},
        {"name": "known", "kind": "filter", "callable": salaries_known, "settings": {"least": 9000}},
    ]
    return run.run(jobs(spark, sf_dir), run.Config(plugins=plugins.load(manifest), top_k=40)).scored.select("fit_rank", "id", "fit_score")
