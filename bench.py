"""Headline benchmark: prints one JSON line with per-query wall seconds.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_EVENT_LOG_DIR (optional: write Spark's event log there for stage times).
Every query runs to completion through the ``noop`` sink (no collect), after
one warm-up query so JVM start-up is not charged to the first query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from evalspark.operators import compare as C  # noqa: E402
from evalspark.operators import errors as E  # noqa: E402
from evalspark.operators import groups as G  # noqa: E402
from evalspark.operators import metrics as M  # noqa: E402
from evalspark.operators import sample as SA  # noqa: E402
from evalspark.operators import text as T  # noqa: E402
from evalspark.session import local_session  # noqa: E402
from evalspark.sources.fixtures import Fixtures  # noqa: E402


class SpreadFixtures(Fixtures):
    """Fixtures over test files of one row group, dealt out to all cores."""

    def table(self, name):
        df = super().table(name)
        target = self.spark.sparkContext.defaultParallelism
        return df if df.rdd.getNumPartitions() >= target else df.repartition(target)


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    extra = {"spark.sql.shuffle.partitions": str(max(8, int(cpus) * 2))}
    log_dir = os.environ.get("BENCH_EVENT_LOG_DIR")  # stage and task times, written to a scratch folder
    if log_dir:
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir})
    spark = local_session(cpus, "evalspark-bench", extra)
    fx = SpreadFixtures(spark, sf_dir)
    run(fx.table("region"))  # warm-up

    def metrics_by_group():
        run(M.metrics_by_group(fx.predictions3))

    def full_evaluation():
        cells = M.confusion_cells(fx.predictions3, prob_col="none").cache()
        run(M.full_report(cells))
        run(M.metrics_by_group(cells))
        gs = G.group_stats(cells)
        run(G.group_dispersion(gs))
        run(G.best_worst_groups(gs))
        run(E.error_types(cells))
        cells.unpersist()

    def compare_all_2000():
        run(C.compare_all(fx.predictions3, fx.registry, reps=2000, method="multinomial", with_p=True))

    def compare_8_pairs_2000():
        # the shape of the reference's published run: eight paired comparisons,
        # 2000 replicates each, on the labelled-sample predictions
        pairs = [("A", "B"), ("A", "C"), ("B", "C"), ("B", "A"), ("C", "A"), ("C", "B"), ("A", "B"), ("B", "C")]
        reg = spark.createDataFrame([(i + 1, a, b, f"{a} vs {b}", "bench") for i, (a, b) in enumerate(pairs)],
                                    "pair_id int, model_a string, model_b string, name string, category string")
        run(C.compare_all(fx.predictions, reg, reps=2000, method="multinomial", with_p=True))

    def compare_all_text_key():
        tagged = C.tag_sides(fx.predictions, fx.registry, "text")
        run(C.mcnemar(C.paired_contingency(C.paired_cells(tagged, "text", "text"))))

    def tfidf_documents():
        docs = fx.table("documents").select(F.col("doc_id").alias("row_id"), "text")
        run(T.tfidf(docs, max_features=50_000))

    def split_documents():
        d = fx.table("documents").select("doc_id", "lang")
        run(SA.split_stratified(d, 0.2, "lang", "doc_id"))

    def error_suite():
        p = fx.predictions
        run(E.error_table(p, fx.samples))
        run(E.top_failures(p, 50))
        run(E.error_summary_by_group(p))

    qs = {"metrics_by_group": metrics_by_group, "full_evaluation": full_evaluation,
          "compare_all_2000": compare_all_2000, "compare_8_pairs_2000": compare_8_pairs_2000,
          "compare_all_text_key": compare_all_text_key,
          "tfidf_documents": tfidf_documents, "split_documents": split_documents, "error_suite": error_suite}
    times = {}
    for name, fn in qs.items():
        t0 = time.time()
        fn()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_wall_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
