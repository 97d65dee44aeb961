"""Times the headline queries, each twice after a warm-up of the session, and prints one line of JSON with the better times."""

import json
import os
import time

from pyspark.sql import SparkSession

from postlark.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = ("normalize_contract", "clean_html", "labels_of_jobs", "rate_scores", "match_topk", "column_profile_exact", "source_profile", "deciles", "drift_psi", "token_postings", "match_jobs", "match_jobs_v1", "catalog_merge_updated_hash", "precision_recall")


def seconds(spark: SparkSession, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds(spark, "source_profile")
    best = {name: round(min(seconds(spark, name) for _ in range(2)), 3) for name in HEADLINE}
    print(json.dumps({"metric": "headline queries", "value": round(sum(best.values()), 3), "unit": "sec", "queries": best, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
