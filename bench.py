"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

# One query per kind of work of the forecasting path.
HEADLINE = [
    "x01_series_batch", "q01_complete_days", "i03_interpolate_linear", "i11_winsorize", "w02_rolling_features", "w09_loess",
    "w10_wavelet_haar", "e01_metrics", "e05_metrics_cube", "e08_wilcoxon", "e14_ks_two_sample", "e18_rank_models",
    "e25_error_distribution", "h07_bottom_up", "h14_reconcile_ols", "k02_train_gbt", "k06_fit_daily_ar", "k12_profile_ratios", "k27_predict_job", "m02_combine_weighted",
    "m32_corr_pairs", "r01_psi", "r06_cusum", "t03_backtest", "b02_correction_factors", "x01_stream_load",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.log.level", "ERROR").getOrCreate()
    )
    from wattline.plans.registry import QUERIES

    names = sys.argv[1:] or HEADLINE
    QUERIES["x01_series_batch"](spark, root).count()  # start the workers before timing
    times: dict[str, float] = {}
    for n in names:
        t0 = time.perf_counter()
        QUERIES[n](spark, root).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(root.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
