"""Raw records as boards send them, made from the driver's documents: JSON texts with odd, missing and empty fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AT, REF = "2026-01-15T00:00:00+00:00", "acme"


def _places():
    i = F.col("doc_id")
    return F.when(i % 3 == 0, "Remote - EU").when(i % 3 == 1, "Hybrid, Paris").otherwise(F.col("lang"))


def raw_records(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """(doc_id, raw) of one board; absent fields are those that a condition leaves null."""
    i, place = F.col("doc_id"), _places()
    text = lambda *c: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    records = {
        "greenhouse": F.struct(
            i.alias("id"), text("  Engineer ", i, " ").alias("title"), F.struct(place.alias("name")).alias("location"), text("text ", i).alias("content"), text("https://g.example/", i).alias("absolute_url"),
            F.when(i % 4 == 0, "").otherwise("2026-01-10T10:00:00-05:00").alias("first_published"), F.lit("2026-01-11T00:00:00Z").alias("updated_at"), F.when(i % 5 != 0, "Big Co").alias("company_name"),
        ),
        "lever": F.struct(
            text("L", i).alias("id"), text("Analyst ", i).alias("text"), F.struct(place.alias("location"), F.lit("Team").alias("team"), F.lit("Full-time").alias("commitment")).alias("categories"),
            (F.lit(1767225600000) + i * 1000).alias("createdAt"), F.when(i % 2 == 0, 0).otherwise(F.lit(1767225600) + i).alias("updatedAt"), F.lit("").alias("hostedUrl"), text("https://l.example/", i).alias("applyUrl"),
            text("<div>A &amp; B ", i, "</div>").alias("description"), F.when(i % 6 == 2, "onsite").alias("workplaceType"),
        ),
        "ashby": F.struct(
            i.alias("jobId"), F.lit("Designer").alias("jobTitle"), place.alias("locationName"), F.when(i % 4 == 0, F.lit(True)).when(i % 4 == 1, F.lit(False)).alias("isRemote"),
            text("<p>Fish &amp; chips</p>\n <b>&eacute;t&#233; ", i, "</b>").alias("descriptionHtml"), (i * 10.5).alias("salaryMin"), F.lit("x").alias("salaryMax"), F.lit("2026-02-30").alias("publishedDate"), text("https://a.example/", i).alias("jobUrl"),
        ),
        "workable": F.struct(
            text("W", i).alias("shortcode"), F.lit("Clerk").alias("title"), F.when(i % 2 == 0, "Berlin").alias("city"), F.when(i % 2 == 0, "DE").alias("country"), F.when(i % 4 == 1, F.array(F.struct(F.lit("Rome").alias("name")), F.struct(F.lit("Oslo").alias("name")))).alias("locations"),
            F.when(i % 3 == 0, "Yes").when(i % 3 == 1, "no").alias("telecommuting"), text("https://w.example/", i).alias("url"), F.lit("2026-01-05").alias("published_on"), F.lit(" Mid ").alias("experience"), F.lit("<i>d</i>").alias("description"),
        ),
        "other": F.struct(i.alias("id"), F.lit("Any").alias("title"), place.alias("location"), F.lit("").alias("apply_url"), text("https://o.example/", i).alias("url"), F.lit("soon").alias("posted_at"), F.lit("120.5").alias("salary_min")),
    }
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.to_json(records[source]).alias("raw"))


_PLACE = "case doc_id % 3 when 0 then 'Remote - EU' when 1 then 'Hybrid, Paris' else lang end"
_FAR = "case doc_id % 3 when 0 then true when 1 then false end"
_MODE = "case doc_id % 3 when 0 then 'remote' when 1 then 'hybrid' else 'unknown' end"
_LATER = "strftime(timestamp '2026-01-01 00:00:00' + to_seconds(doc_id), '%Y-%m-%dT%H:%M:%S+00:00')"
NORMALIZED_SQL = f"""
select 'greenhouse' as source, doc_id::varchar as id, 'Engineer ' || doc_id as title, case when doc_id % 5 <> 0 then 'Big Co' else '{REF}' end as company, {_PLACE} as location, {_FAR} as remote, 'text ' || doc_id as description_text,
    null::double as salary_min, 'https://g.example/' || doc_id as apply_url, 'https://g.example/' || doc_id as job_url, case when doc_id % 4 = 0 then '2026-01-11T00:00:00+00:00' else '2026-01-10T15:00:00+00:00' end as posted_at,
    '2026-01-11T00:00:00+00:00' as source_updated_at, {_MODE} as work_mode, null as employment_type, null as seniority from documents
union all select 'lever', 'L' || doc_id, 'Analyst ' || doc_id, 'Team', {_PLACE}, case when doc_id % 6 = 2 then false else {_FAR} end, '<div>A &amp; B ' || doc_id || '</div>', null, 'https://l.example/' || doc_id, 'https://l.example/' || doc_id, {_LATER},
    {_LATER}, case when doc_id % 6 = 2 then 'onsite' else {_MODE} end, 'Full-time', null from documents
union all select 'ashby', doc_id::varchar, 'Designer', '{REF}', {_PLACE}, case doc_id % 4 when 0 then true when 1 then false else {_FAR} end, 'Fish & chips été ' || doc_id, doc_id * 10.5::double, 'https://a.example/' || doc_id, 'https://a.example/' || doc_id, '2026-02-30',
    null, {_MODE}, null, null from documents
union all select 'workable', 'W' || doc_id, 'Clerk', '{REF}', case when doc_id % 2 = 0 then 'Berlin, DE' when doc_id % 4 = 1 then 'Rome, Oslo' end, case doc_id % 3 when 0 then true when 1 then false end, '<i>d</i>', null, 'https://w.example/' || doc_id, 'https://w.example/' || doc_id,
    '2026-01-05T00:00:00+00:00', '2026-01-05T00:00:00+00:00', case doc_id % 3 when 0 then 'remote' else 'unknown' end, null, 'Mid' from documents
union all select 'other', doc_id::varchar, 'Any', '{REF}', {_PLACE}, {_FAR}, null, 120.5, 'https://o.example/' || doc_id, 'https://o.example/' || doc_id, 'soon', null, {_MODE}, null, null from documents
"""
