"""Times the headline ledger queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from quillon.plans import registry
from quillon.session import local_session

HEADLINE = ("agg_summary", "agg_period_monthly", "agg_category_spend", "agg_merchant_spend", "agg_category_changes", "jn_refund_links", "win_daily_strip", "anm_outliers", "rec_series", "top_explorer_page")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    found = registry.queries()
    found[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "ledger_headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
