"""Input tables derived from the given parquet tables (schemas in FIXTURES.md).

Each fixture is a lazy DataFrame over the parquet scans, so Catalyst prunes
columns and pushes filters into the scans of whatever query uses it. The
same derivations are written as DuckDB SQL in :mod:`evalspark.plans.oracle`.

Small constant tables (model flip rates, the comparison registry) are
expanded with ``explode`` over a literal array instead of being joined, so
no plan contains a cross join.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.columns import hash_uniform

# Fixed values of the fixture definitions: model names and flip rates.
MODELS = (("A", 0.15), ("B", 0.25), ("C", 0.40))
# Comparison registry (pair_id, model_a, model_b, name, category).
REGISTRY = (
    (1, "A", "B", "A vs B", "baseline"),
    (2, "A", "C", "A vs C", "ablation"),
    (3, "B", "C", "B vs C", "ablation"),
)


def _models_col():
    return F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(float(f)).alias("flip")) for m, f in MODELS
    ])).alias("m")


def _u(*parts) -> F.Column:
    return hash_uniform(F.concat(*[p if isinstance(p, F.Column) else F.lit(p) for p in parts]))


class Fixtures:
    """Lazily built fixture DataFrames for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def samples(self) -> DataFrame:
        lab = self.table("labels").select("doc_id", "quality", "toxic")
        doc = self.table("documents").select("doc_id", "text", "source")
        label = (F.when(F.col("toxic") == 1, "stereotype")
                 .when(F.col("quality") == 1, "neutral").otherwise("unrelated"))
        return lab.join(doc, "doc_id").select(
            F.col("doc_id").alias("row_id"), "text", label.alias("label"),
            F.col("source").alias("grp"), F.lit("docs").alias("data_name"))

    @cached_property
    def samples_null(self) -> DataFrame:
        """samples with a null label in every ninth row."""
        return self.samples.withColumn("label", F.when(F.col("row_id") % 9 != 0, F.col("label")))

    @cached_property
    def predictions(self) -> DataFrame:
        x = self.samples.withColumn("actual", (F.col("label") == "stereotype").cast("int"))
        x = x.select("*", _models_col()).select("*", "m.model", "m.flip").drop("m")
        rid = F.col("row_id").cast("string")
        flip = _u(F.col("model"), ":", rid) < F.col("flip")
        return x.select(
            "model", "row_id", "text", F.col("actual").alias("actual_label"),
            F.when(flip, 1 - F.col("actual")).otherwise(F.col("actual")).alias("predicted_label"),
            (F.lit(0.5) + F.lit(0.5) * _u("p", F.col("model"), ":", rid)).alias("predicted_probability"),
            "grp", F.col("data_name").alias("dataset_name"))

    @cached_property
    def predictions3(self) -> DataFrame:
        o = self.table("orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
        y = (F.when(F.col("o_orderstatus") == "F", 0)
             .when(F.col("o_orderstatus") == "O", 1).otherwise(2))
        o = o.select("o_orderkey", "o_orderpriority", y.alias("y"), _models_col())
        o = o.select("*", "m.model", "m.flip").drop("m")
        flip = _u(F.col("model"), ":", F.col("o_orderkey").cast("string")) < F.col("flip")
        return o.select(
            "model", F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("grp"),
            F.col("y").alias("actual_label"),
            F.when(flip, (F.col("y") + 1) % 3).otherwise(F.col("y")).alias("predicted_label"))

    @cached_property
    def pairs(self) -> DataFrame:
        c = self.table("conversations").select("conv_id", "turn", "text")
        u = c.alias("u")
        v = c.select(F.col("conv_id").alias("v_conv"), (F.col("turn") - 1).alias("v_prev"),
                     F.col("text").alias("v_text"))
        j = u.join(v, (F.col("u.conv_id") == F.col("v_conv")) & (F.col("u.turn") == F.col("v_prev")))
        cid = F.col("u.conv_id")
        return j.select(
            (cid * 100 + F.col("u.turn")).alias("row_id"),
            F.col("u.text").alias("sent_more"), F.col("v_text").alias("sent_less"),
            F.when(cid % 11 == 0, F.lit(None).cast("string"))
             .when(cid % 2 == 0, "stereo").otherwise("antistereo").alias("stereo_antistereo"),
            F.when(cid % 7 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("g"), (cid % 5).cast("string"))).alias("bias_type"))

    @cached_property
    def responses(self) -> DataFrame:
        d = self.table("documents").select("doc_id", "source", "text")
        k = F.col("doc_id") % 5
        line = F.replace("text", F.lit("\n"), F.lit(" "))  # the whole text in one line
        resp = (F.when(k == 0, F.concat(F.lit("NEUTRE: "), line))
                .when(k == 1, F.concat(F.lit("  Neutre: a: b \n SANS_RAPPORT:  "), line))
                .when(k == 2, F.concat(F.lit("NEUTRE: first\nNEUTRE: second\nSans rapport: "), line))
                .when(k == 3, F.concat(F.lit("no marker "), "text")))
        return d.select(F.col("doc_id").alias("row_id"), F.col("source").alias("grp"),
                        resp.alias("response"))

    @cached_property
    def token_weights(self) -> DataFrame:
        d = self.table("documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("p", "token"))
        k = F.col("p") + 1
        w = F.lit(2.0) * _u("w:", F.col("doc_id").cast("string"), ":", k.cast("string")) - F.lit(1.0)
        return d.select(F.col("doc_id").alias("row_id"), k.alias("pos"), "token", w.alias("weight"))

    @cached_property
    def registry(self) -> DataFrame:
        return self.spark.createDataFrame(
            list(REGISTRY), "pair_id int, model_a string, model_b string, name string, category string")

    @cached_property
    def scores(self) -> DataFrame:
        """Per-row score lists for model A: the predicted label carries the
        predicted probability, the other label the rest."""
        p = self.predictions.where(F.col("model") == "A")
        s1 = F.when(F.col("predicted_label") == 1, F.col("predicted_probability")).otherwise(
            1.0 - F.col("predicted_probability"))
        return p.select("row_id", "actual_label", F.array(
            F.struct(F.lit("LABEL_0").alias("label"), (1.0 - s1).alias("score")),
            F.struct(F.lit("LABEL_1").alias("label"), s1.alias("score"))).alias("scores"))
