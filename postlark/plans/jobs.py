"""Job postings made from the driver's tables, with words that the operators look for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TITLES = ("Senior Data Engineer", "Intern Analyst", "Staff ML Engineer", "Backend Developer", "Retail Manager", "Principal Platform Lead", "International Sales", "C")
WORDS = ("python sql", "aws docker python", "java", "", "rust TypeScript")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pick = lambda words, n: F.get(F.array(*[F.lit(w) for w in words]), (F.col("doc_id") % n).cast("int"))
    i = F.col("doc_id")
    return docs.select(
        i.cast("string").alias("id"),
        pick(TITLES, 8).alias("title"),
        F.when(i % 35 == 3, "Python C++").when(i % 7 != 0, F.col("source")).alias("company"),
        F.col("lang").alias("location"),
        (F.col("lang") == "en").alias("remote"),
        F.concat("text", F.lit(" "), pick(WORDS, 5)).alias("description_text"),
        F.when(i % 3 == 0, F.concat(F.lit("<p>"), F.col("text"), F.lit("</p> <b>python</b>"))).alias("description_html"),
        F.when(i % 4 == 0, F.array(F.lit("python"), F.lit("sql"))).when(i % 4 == 1, F.array(F.lit(" C++ "), F.lit("Machine Learning"), F.lit(""), F.lit("R"))).otherwise(F.array().cast("array<string>")).alias("skills"),
        F.when(i % 5 != 0, F.col("n_chars") * 10.0).alias("salary_min"),
        F.when(i % 6 != 0, F.col("n_chars") * 20.0).alias("salary_max"),
        F.when(i % 11 == 0, "").otherwise(F.concat(F.lit("https://jobs.example/"), i.cast("string"))).alias("apply_url"),
        F.when(i % 9 != 0, F.date_format(F.date_sub(F.lit("2026-01-10").cast("date"), (i % 300).cast("int")), "yyyy-MM-dd")).alias("posted_at"),
        "source",
        "doc_id",
    )


_TITLE_CASE = " ".join(f"when {n} then '{t}'" for n, t in enumerate(TITLES))
_WORD_CASE = " ".join(f"when {n} then '{t}'" for n, t in enumerate(WORDS))
JOBS_SQL = f"""jobs as (
    select doc_id::varchar as id, case doc_id % 8 {_TITLE_CASE} end as title, case when doc_id % 35 = 3 then 'Python C++' when doc_id % 7 <> 0 then source end as company, lang as location, lang = 'en' as remote,
        text || ' ' || case doc_id % 5 {_WORD_CASE} end as description_text,
        case when doc_id % 3 = 0 then '<p>' || text || '</p> <b>python</b>' end as description_html,
        case when doc_id % 4 = 0 then ['python', 'sql'] when doc_id % 4 = 1 then [' C++ ', 'Machine Learning', '', 'R'] else []::varchar[] end as skills,
        case when doc_id % 5 <> 0 then n_chars * 10.0::double end as salary_min, case when doc_id % 6 <> 0 then n_chars * 20.0::double end as salary_max,
        case when doc_id % 11 = 0 then '' else 'https://jobs.example/' || doc_id end as apply_url,
        case when doc_id % 9 <> 0 then strftime(date '2026-01-10' - (doc_id % 300)::int, '%Y-%m-%d') end as posted_at, source, doc_id
    from documents
)"""
