import random

import corpus_pipeline
from evalspark.llm.queries import ORACLE, QUERIES

from .helpers import frame, prose
from .test_dedup import brute_join

SF = "/root/testdata/sf0.001"


def test_queries_of_all_operators():
    import __spark_entry__ as se

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)
    names = se.queries()
    assert set(QUERIES) <= set(names) and "pipeline" in names


def test_stages_keep_the_columns_and_drop_what_they_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, kept = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, SF)
        if name != "pack":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        seen[name] = {r.doc_id for r in out.select("doc_id").collect()}
        kept = out
    order = [n for n, _ in corpus_pipeline.STAGES]
    assert order == ["quality", "lines", "near_duplicates", "decontaminate", "pack"]
    assert seen["quality"] == seen["lines"] >= seen["near_duplicates"] >= seen["decontaminate"] == seen["pack"]
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    assert len(bad & seen["quality"]) <= 0.1 * len(bad)


def test_run_on_an_empty_table(spark, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_links_five_word_shingles_from_80_percent(spark):
    rnd = random.Random(8)
    rows = []
    for g, n in enumerate((60, 150, 400)):
        base = prose(200 + g, n, 2000).split()
        rows.append((1000 * g, " ".join(base)))
        for c in range(1, 25):
            copy = list(base)
            if c % 2:  # scattered words
                for k in rnd.sample(range(n), max(1, round(n * c / 1000))):
                    copy[k] = f"n{rnd.randrange(10**6)}"
            else:  # one stretch
                k, m = rnd.randrange(n // 2), max(1, round(n * c / 200))
                copy[k:k + m] = [f"n{rnd.randrange(10**6)}" for _ in range(m)]
            rows.append((1000 * g + c, " ".join(copy)))
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows).repartition(4), SF).collect()}
    want = {i: first for i, _, first, _ in brute_join(rows, 5, 80)}
    assert got == {i for i, first in want.items() if i == first}
    looser = {i for i, _, first, _ in brute_join(rows, 3, 90) if i == first}
    assert got < looser and len(looser - got) >= 10 and len(got) > 3  # pairs between the two settings, pairs below both


def test_lines_of_a_group_of_copies_stay(spark):
    def text(k):
        return f"menu\n{prose(f'a{k}', 30, 2000)}\n{prose(f'b{k}', 30, 2000)}"

    rows = [(i, text("copied"), "a") for i in range(30)] + [(100 + i, text(i), "a") for i in range(60)]
    out = corpus_pipeline.lines(spark, frame(spark, rows).repartition(4), SF)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {i: t.removeprefix("menu\n") for i, t, _ in rows}  # the line of all texts goes from every row
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, out, SF).select("doc_id").collect()}
    assert left == {0, *range(100, 160)}


def test_near_duplicates_do_not_shuffle_the_documents(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "ngram_jaccard_join", lambda docs, **limits: docs.select(
        "doc_id", (docs["doc_id"] - docs["doc_id"] % 2).alias("component_id")))
    docs = frame(spark, [(k, prose(k, 30)) for k in range(40)])
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for more ids than Spark sends by itself
    try:
        out = corpus_pipeline.near_duplicates(spark, docs, SF)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and sorted(r.doc_id for r in out.collect()) == list(range(0, 40, 2))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
