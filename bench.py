"""Headline queries at one scale; prints one JSON line.

Tables that are derived once per catalogue (element history, pair samples) are
landed as Parquet first, as they would be in use; deriving the samples is a
timed query of its own.
"""

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from orbitframe.operators import (  # noqa: E402
    anomaly, conjunction, decay, elements as el, maneuver, proximity, trajectory)
from orbitframe.plans.adapters import view  # noqa: E402
from orbitframe.plans.registry import registry  # noqa: E402
from orbitframe.session import prepare  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
BY_NAME = ["detect_maneuvers", "classify_campaigns", "changepoints", "predict_decay",
           "launch_breakups", "latest_per_object", "country_rollup", "apply_filter_specs",
           "proximity_episodes", "serial_inspectors", "nearest_epoch_join", "propagate_at",
           "recommend_actions", "diff_states", "verify_texts", "unbacked_numbers"]


def main() -> None:
    spark = prepare(
        SparkSession.builder.master(f"local[{CPUS}]").appName("orbitframe-bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    landing = tempfile.mkdtemp(prefix="orbitframe-bench-")
    for name in ("elements", "satcat", "history", "neighbour_pairs"):
        view(spark, SF_DIR, name).write.mode("overwrite").parquet(f"{landing}/{name}")
    land = lambda name: spark.read.parquet(f"{landing}/{name}")
    trajectory.pair_samples(trajectory.aligned_pairs(
        land("neighbour_pairs"), land("history"))).write.parquet(f"{landing}/pair_samples")

    jobs = {name: (lambda q: lambda: q.run(spark, SF_DIR))(registry()[name]) for name in BY_NAME}
    jobs |= {
        "classify_regime": lambda: el.classify_regime(land("elements")),
        "screening_summary": lambda: conjunction.screening_summary(land("elements")),
        "screen_conjunctions": lambda: conjunction.screen_conjunctions(land("elements")),
        "anomaly_ranking": lambda: anomaly.fit_anomaly_model(land("satcat")).top_anomalies(),
        "pair_residuals": lambda: maneuver.pair_residuals(land("history")),
        "perigee_decay": lambda: decay.predict_decay(el.mean_elements(land("history")).select(
            "norad_id", "epoch", "perigee_km")),
        "pair_samples": lambda: trajectory.pair_samples(
            trajectory.aligned_pairs(land("neighbour_pairs"), land("history"))),
        "pair_assessment": lambda: proximity.rpo_summary(land("pair_samples")),
    }
    times = {}
    for name, build in jobs.items():
        best = None
        for _ in range(2):
            start = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": float(SF_DIR.rstrip("/").rsplit("sf", 1)[-1])}))
    spark.stop()


if __name__ == "__main__":
    main()
