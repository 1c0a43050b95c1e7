"""Time the headline queries: one JSON line, seconds per query.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the scale.
"""

import json
import os
import re
import time

from tomewise.plans.queries import QUERIES
from tomewise.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = (
    "rating_counts",
    "rating_describe",
    "rating_histogram",
    "rating_sparsity",
    "rating_mode",
    "top_rated_books",
    "active_users",
    "dedupe_ratings",
    "rmse_fixed",
    "lookup_load",
    "ratings_load",
    "profile_view",
    "book_search",
    "xml_books",
    "alloc_user_ids",
    "ingest_ratings",
    "fixed_factor_topk",
    "fixed_factor_unseen_exact",
    "recs_serving",
    "als_holdout_rmse",
    "als_grid",
    "als_recs_filter_after",
    "als_recs_unseen",
    "stream_refresh",
)


def main() -> None:
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    # Start-up of the JVM, the Python workers and the code generator is not a query's cost.
    QUERIES["fixed_factor_topk"](spark, "/root/testdata/sf0.001").count()
    seconds = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        # A sink that takes every row, unlike count(), which prunes the columns away.
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    scale = re.search(r"sf([\d.]+)", SF_DIR)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
