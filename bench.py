"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the cores. Every query is run twice to
warm up and then ``BENCH_REPEATS`` times; the median is reported. All result rows and columns are computed
(``noop`` sink).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from formlake import catalog, fixtures, schema
from formlake.operators import audit, context, history
from formlake.plans import features
from formlake.session import spark_session


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = spark_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")

    # Inputs are stored tables, as they are for the reference pipeline.
    results = fixtures.results(spark, sf)
    tables = catalog.feature_tables(spark, sf)
    featured = catalog.featured(spark, sf)
    newest = results.select("horse").distinct()  # every horse is asked for

    queries = {
        "assemble_matrix_fused": lambda: features.build_matrix(results),
        "assemble_matrix_joined": lambda: features.assemble_matrix(
            results, tables["synergy"], tables["course"], tables["form"], tables["class"], tables["micro"]
        ),
        "build_features": lambda: features.build_features(results).select(
            "id", *catalog.ALL_FEATURE_COLUMNS
        ),
        "recent_form": lambda: history.recent_form(results),
        "class_moves": lambda: history.class_moves(results),
        "entity_place_stats": lambda: history.entity_place_stats(results),
        "pair_trailing_stats": lambda: history.pair_trailing_stats(results),
        "micro_features": lambda: history.micro_features(results),
        "data_audit": lambda: audit.data_audit(results),
        "latest_context": lambda: context.latest_context(newest, featured),
        "top_pick": lambda: catalog.QUERIES["top_pick"](spark, sf),
        "auc": lambda: catalog.QUERIES["auc"](spark, sf),
    }
    seconds = {}
    for name, build in queries.items():
        times = []
        for _ in range(repeats + 2):
            started = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times[2:]), 3)
    rows = results.count()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
        "rows": rows, "features_rows_per_sec": round(rows / seconds["build_features"]),
        "matrix_columns": len(schema.MATRIX_COLUMNS),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
