"""Time the headline queries; prints one JSON line."""

import json
import os
import time

from tagloom.plans import load_all
from tagloom.plans.registry import QUERIES
from tagloom.session import local_session

HEADLINE = (
    "keyword_export", "tagging_run", "tag_canonicalize", "precision_filter", "head_score", "alias_canonical_join",
    "vector_topk_join", "character_resolve", "attribute_profile", "mean_pairwise_similarity", "library_audit_summary",
    "identity_filter", "match_key", "metadata_tokens", "library_search", "identity_fuzzy_join", "priority_merge",
    "unseen_first_page", "queue_append", "provider_payload_anilist", "stream_latest_by_key",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cores)
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    QUERIES[HEADLINE[0]](spark, folder).write.format("noop").mode("overwrite").save()  # code is compiled, workers run
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": folder.rstrip("/").split("sf")[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
