"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ["v_constraint_report", "v_unique_report", "v_fk_orphans", "v_check_report", "v_lifecycle_order", "gen_people", "gen_moments", "gen_uuid", "gen_nouns_web", "fk_draw_simple", "fk_identity", "lit_escape"]
#: Rows of each of the fourteen generated tables; the plan is written out in full.
GENERATED = (50, 1_000, 100_000)


def main() -> None:
    from gneiss.plans import synthesis
    from gneiss.queries import QUERIES
    from gneiss.sources.catalog import SHOP
    from gneiss.sources.shared import at_once

    with tempfile.TemporaryDirectory() as scratch:
        spark = (
            SparkSession.builder.master(f"local[{CPUS}]")
            .config("spark.sql.shuffle.partitions", CPUS)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", "12g")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
            .getOrCreate()
        )
        spark.sparkContext.setLogLevel("ERROR")
        spark.sparkContext.setCheckpointDir(f"{scratch}/checkpoints")
        spark.range(1_000_000).selectExpr("sum(id)").collect()
        took: dict[str, float] = {}
        for name in NAMES:
            began = time.perf_counter()
            QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
        for rows in GENERATED:
            began = time.perf_counter()
            # Rows depend on no other table's rows, so all tables are written at once.
            at_once(synthesis.generate(spark, SHOP, dict.fromkeys(SHOP, rows)), lambda _, df: df.write.format("noop").mode("overwrite").save())
            took[f"generate_14_tables_{rows}_rows"] = round(time.perf_counter() - began, 3)
        spark.stop()
    sf = os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
