"""Token attributions.

The perturbation explainers send an instance's words to the tasks a fixed
number of times (once per block of samples, or once per permutation), never
once per perturbed text: the texts are made inside the scoring batches, and
only scores and bitmaps leave them. They are scored there by a user's
predictor, or by a Spark ML model's ``transform`` in the same stage, and cut
from their lineage with ``checkpoint()`` (the shared checkpoint folder) so a
lost executor does not re-score everything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.columns import hash_key, r6, snippet
from evalspark.operators.text import beside_rows
from evalspark.session import reliable_checkpoint

# Word split of the perturbation explainers: runs of non-word characters.
WORD_SPLIT = r"[^\p{L}\p{N}_]+"


def _strip_lower(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def lime_top_words(weights: DataFrame, n: int = 20) -> DataFrame:
    """Words lower-cased and trimmed; positive weights summed, |negative|
    (and zero) weights summed separately; top n of each (ties: word)."""
    w = weights.select(_strip_lower(F.col("token")).alias("word"), "weight")
    d = F.when(F.col("weight") > 0, "positive").otherwise("negative")
    s = w.groupBy(d.alias("direction"), "word").agg(F.sum(F.abs("weight")).alias("total"))
    rank = F.row_number().over(Window.partitionBy("direction").orderBy(F.col("total").desc(), F.col("word")))
    return s.select("direction", "word", r6("total").alias("total"), rank.alias("rank")).where(F.col("rank") <= n)


def _strongest(weights: DataFrame, k: int, key: str) -> DataFrame:
    """The rows of (key, pos, token, weight) that are among the k strongest of their key within an Arrow batch: no
    other can be among the k strongest of all, so no other needs to be sorted or shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strength = np.abs(batch.column(3).cast(pa.float64()).to_numpy(zero_copy_only=False))
            null = batch.column(3).is_null().to_numpy(zero_copy_only=False)
            below_nan = ~np.isnan(strength) | null  # descending: NaN, then numbers, then nulls
            strength[null] = -1.0
            pos = batch.column(1).cast(pa.int64()).fill_null(-2 ** 63).to_numpy(zero_copy_only=False)
            code = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            order = np.lexsort((pos, -strength, below_nan, code))
            starts = np.flatnonzero(np.append(True, np.diff(code[order]) != 0)) if len(order) else np.empty(0, np.int64)
            rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
            yield batch.take(pa.array(np.sort(order[rank < k])))

    x = weights.select(key, "pos", "token", "weight")
    return x.mapInArrow(run, x.schema)


def lime_digest(weights: DataFrame, k: int = 5, key: str = "row_id", examples: DataFrame | None = None,
                label: str = "label", length: int = 100) -> DataFrame:
    """Per instance the k strongest words (by |weight|, ties: position)
    with their direction. With ``examples`` (key, text, label) every row
    also has the first ``length`` characters of its text and its true label; null
    for an instance that is not among them. Tasks keep the k strongest words of their rows
    before the words of an instance are brought together."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.abs("weight").desc(), F.col("pos")))
    d = F.when(F.col("weight") > 0, "Stereotype").otherwise("Non-Stereotype")
    out = _strongest(weights, k, key).select(key, "token", r6("weight").alias("weight"), d.alias("direction"), rank.alias("rank")) \
                 .where(F.col("rank") <= k)
    if examples is None:
        return out
    return out.join(examples.select(key, snippet("text", length).alias("snippet"), F.col(label).alias("label")), key, "left")


def group_digest(picked: DataFrame, group: str = "grp", key: str = "row_id", seed: int = 42, length: int = 80) -> DataFrame:
    """X5 (summary): the analysed examples of each group, numbered in their sample order, with the
    first ``length`` characters of the text and the number of examples of the group. ``picked`` is a
    bounded sample per group (SA5)."""
    own = Window.partitionBy(group)
    number = F.row_number().over(own.orderBy(hash_key(seed, key), F.col(key)))
    return picked.select(group, F.count(F.lit(1)).over(own).alias("n_examples"), number.alias("number"), key,
                         snippet("text", length).alias("snippet"))


def linear_shap(features: DataFrame, coef: DataFrame, docs: DataFrame, key: str = "row_id") -> DataFrame:
    """X4 (a): exact Shapley values of a linear model with independent
    features: phi = coef x (x - mean x), mean over all documents.

    Present terms get their own rows; the terms absent from a document (x = 0)
    are summed into one '<absent>' row, -(sum_all coef*mean - sum_present
    coef*mean), so the output stays sparse. Per document the values sum to
    f(x) - E f(x). ``features`` is (key, term, weight), ``coef`` (term, coef),
    ``docs`` lists every document key."""
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    mean = features.groupBy("term").agg((F.sum("weight") / F.lit(n_docs)).alias("mean"))
    # read three times below, a pass over all features each: written once
    cm = beside_rows(coef.join(mean, "term", "left").select("term", "coef", F.coalesce("mean", F.lit(0.0)).alias("mean")))
    s_all = cm.select(F.sum(F.col("coef") * F.col("mean"))).scalar()
    j = features.join(cm, "term")
    present = j.select(key, "term", (F.col("coef") * (F.col("weight") - F.col("mean"))).alias("phi"),
                       (F.col("coef") * F.col("mean")).alias("_cm"))
    per_doc = present.groupBy(key).agg(F.sum("_cm").alias("_pcm"))
    absent = docs.select(key).join(per_doc, key, "left").select(
        key, F.lit("<absent>").alias("term"), (-(F.lit(s_all) - F.coalesce("_pcm", F.lit(0.0)))).alias("phi"))
    return present.drop("_cm").unionByName(absent)


# ---------------------------------------------------------------- perturbations

# Samples of an instance that are made and scored from one copy of its words.
SAMPLE_BLOCK = 50
# Perturbed texts that are held at once: at most this many, and no more once they have this many letters.
BATCH_TEXTS, BATCH_CHARS = 64, 1 << 20
# Words whose mask bits are unpacked at once in a fit.
FIT_COLUMNS = 512


def _words(df: DataFrame, col: str, key: str, seed: int) -> DataFrame:
    """Every instance that has words, with its words in order and the number its random choices start from."""
    tok = F.filter(F.split(F.col(col), WORD_SPLIT), lambda t: t != "")
    start = F.xxhash64(F.lit(seed), F.col(key)).bitwiseAND(F.lit((1 << 62) - 1))
    return df.select(key, tok.alias("_tok"), start.alias("_start")).where(F.size("_tok") > 0)


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by their keys in as many tasks as a shuffle has: they are few bytes but much work, so
    they aren't left to be merged by their size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _coded(tok) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words in order of first occurrence, and for every word of the text its place among them."""
    place: dict[str, int] = {}
    ids = np.fromiter((place.setdefault(t, len(place)) for t in tok), dtype=np.int64, count=len(tok))
    return np.array(list(place), dtype=object), ids


def _scored_rows(rows: DataFrame, expand: Callable, scorer, schema: str) -> DataFrame:
    """The rows of ``schema`` that ``expand(row)`` yields as (values, text) pairs, with ``_score``, the
    scorer's probability of class 1 for the text. A predictor factory (T9 hook) scores
    in the batch that makes the texts, which then go no further."""
    names = [part.split()[0] for part in schema.split(", ")]
    factory = None if isinstance(scorer, PipelineModel) else scorer

    def batches_of(pdf: pd.DataFrame) -> Iterator[tuple[list, list]]:
        values, texts, chars = [], [], 0
        for row in pdf.itertuples(index=False, name=None):
            for value, text in expand(dict(zip(pdf.columns, row))):
                values.append(value)
                texts.append(text)
                chars += len(text)
                if len(texts) >= BATCH_TEXTS or chars >= BATCH_CHARS:
                    yield values, texts
                    values, texts, chars = [], [], 0
        if texts:
            yield values, texts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = factory and factory()
        for pdf in batches:
            for values, texts in batches_of(pdf):
                out = pd.DataFrame(values, columns=names)
                if predict is None:
                    out["text"] = texts
                else:
                    out["_score"] = [next((float(e["score"]) for e in row if e["label"] == "LABEL_1"), None)
                                     for row in predict(texts)]
                yield out

    if factory is not None:
        return rows.mapInPandas(run, schema + ", _score double")
    made = rows.mapInPandas(run, schema + ", text string")
    return scorer.transform(made).select(*names, vector_to_array("probability")[1].alias("_score"))


def _lime_samples(num_samples: int, kernel_width: float, key: str) -> Callable:
    def expand(row: dict) -> Iterator[tuple[tuple, str]]:
        words, ids = _coded(row["_tok"])
        tok, d = np.array(row["_tok"], dtype=object), len(words)
        for s in range(row["_first"], min(row["_first"] + SAMPLE_BLOCK, num_samples)):
            kept = np.ones(d, dtype=bool)
            if s > 0 and d > 1:
                rng = np.random.default_rng([int(row["_start"]), s])
                kept[rng.choice(d, int(rng.integers(1, d)), replace=False)] = False
            distance = (1.0 - np.sqrt(kept.sum() / d)) * 100.0
            kernel = float(np.sqrt(np.exp(-(distance * distance) / kernel_width ** 2)))
            yield ((row[key], s, np.packbits(kept).tobytes(), kernel, list(words) if s == 0 else None),
                   " ".join(tok[kept[ids]]))
    return expand


def weighted_ridge(masks: np.ndarray, d: int, y: np.ndarray, w: np.ndarray, alpha: float) -> np.ndarray:
    """Coefficients of a ridge fit with weights and an intercept that is not penalised. ``masks``
    holds the 0/1 features of a sample as packed bits. With more features than
    samples the fit is solved in the samples: their Gram matrix is the sum of those of blocks of
    features, so never more than a block is unpacked."""
    total, root = w.sum(), np.sqrt(w)
    yc = (y - (w @ y) / total) * root

    def block(first: int, last: int) -> np.ndarray:
        x = np.unpackbits(masks[:, first // 8:(last + 7) // 8], axis=1)[:, :last - first].astype(float)
        x -= (w @ x) / total
        x *= root[:, None]
        return x

    if d <= len(y):
        x = block(0, d)
        return np.linalg.solve(x.T @ x + alpha * np.eye(d), x.T @ yc)
    starts = range(0, d, FIT_COLUMNS)
    gram = alpha * np.eye(len(y))
    for first in starts:
        x = block(first, min(first + FIT_COLUMNS, d))
        gram += x @ x.T
    dual = np.linalg.solve(gram, yc)
    return np.concatenate([block(first, min(first + FIT_COLUMNS, d)).T @ dual for first in starts])


def _lime_fit_fn(num_features: int, alpha: float, key: str):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        words = pdf.loc[pdf["s"] == 0, "_feat"].iloc[0]
        d = len(words)
        masks = np.stack([np.frombuffer(m, dtype=np.uint8) for m in pdf["_mask"]])
        y, w = pdf["_score"].to_numpy(float), pdf["_kernel"].to_numpy(float)
        b = weighted_ridge(masks, d, y, w, alpha)
        used = np.argsort(-np.abs(b), kind="stable")[:num_features]
        chosen = np.stack([(masks[:, j // 8] >> (7 - j % 8)) & 1 for j in used], axis=1)
        b = weighted_ridge(np.packbits(chosen, axis=1), len(used), y, w, alpha)
        order = np.argsort(-np.abs(b), kind="stable")
        return pd.DataFrame({key: pdf[key].iloc[0], "pos": np.arange(1, len(order) + 1, dtype=np.int32),
                             "token": [words[used[i]] for i in order], "weight": b[order]})
    return fit


def explain_lime(df: DataFrame, scorer, num_samples: int = 1000, num_features: int = 10, seed: int = 42,
                 kernel_width: float = 25.0, alpha: float = 1.0, col: str = "text", key: str = "row_id") -> DataFrame:
    """LIME-style word attributions for class 1; ``key`` is unique.

    Sample 0 is the instance itself; sample s > 0 removes r in [1, d - 1]
    distinct words (every occurrence), drawn by a generator that starts from (seed, key, s). The
    kernel is sqrt(exp(-(100 * cosine distance)^2 / width^2)); a weighted
    ridge fit selects the ``num_features`` largest coefficients and refits on
    them. A sample reaches the fit as one bit for each distinct word. Null and empty texts
    have no words and no attributions."""
    key_type = df.schema[key].dataType.simpleString()
    blocks = F.explode(F.sequence(F.lit(0), F.lit(num_samples - 1), F.lit(SAMPLE_BLOCK)))
    rows = _spread(_words(df, col, key, seed).select("*", blocks.alias("_first")), key, "_first")
    scored = _scored_rows(rows, _lime_samples(num_samples, kernel_width, key), scorer,
                          f"{key} {key_type}, s int, _mask binary, _kernel double, _feat array<string>")
    schema = f"{key} {key_type}, pos int, token string, weight double"
    return reliable_checkpoint(scored).groupBy(key).applyInPandas(_lime_fit_fn(num_features, alpha, key), schema)


def _coalitions(key: str) -> Callable:
    def expand(row: dict) -> Iterator[tuple[tuple, str]]:
        words, ids = _coded(row["_tok"])
        tok, d = np.array(row["_tok"], dtype=object), len(words)
        order = np.random.default_rng([int(row["_start"]), int(row["p"])]).permutation(d)
        rank = np.empty(d, dtype=np.int64)
        rank[order] = np.arange(d)
        rank = rank[ids]
        for k in range(d + 1):
            added, following = (order[k - 1] if k else None), (order[k] if k < d else None)
            yield ((row[key], *((None, None) if added is None else (int(added) + 1, words[added])),
                    *((None, None) if following is None else (int(following) + 1, words[following]))),
                   " ".join(tok[rank < k]))
    return expand


def explain_shap_sampled(df: DataFrame, scorer, permutations: int = 8, seed: int = 42, col: str = "text",
                         key: str = "row_id") -> DataFrame:
    """X4 (b): sampled permutation Shapley values for a black-box scorer; ``key`` is unique.

    For permutation p of an instance's distinct words (drawn by a generator
    that starts from (seed, key, p)), coalition k holds the first k words; the
    score difference between coalitions k and k-1 is credited to the k-th
    word; values are averaged over permutations. Masked words are removed
    (every occurrence). ``pos`` numbers the distinct words from 1 in order of first occurrence.

    A permutation travels as one row; a score counts for the word its coalition adds and
    against the word added next, so one aggregate by word gives all differences. The
    bytes shuffled are linear in the text. Null and empty texts have no values."""
    key_type = df.schema[key].dataType.simpleString()
    turns = F.explode(F.sequence(F.lit(0), F.lit(permutations - 1)))
    rows = _spread(_words(df, col, key, seed).select("*", turns.alias("p")), key, "p")
    scored = _scored_rows(rows, _coalitions(key), scorer, f"{key} {key_type}, _pos int, _token string, _pos2 int, _token2 string")
    shares = F.explode(F.array(
        F.struct(F.col("_pos").alias("pos"), F.col("_token").alias("token"), F.col("_score").alias("v")),
        F.struct(F.col("_pos2").alias("pos"), F.col("_token2").alias("token"), (-F.col("_score")).alias("v"))))
    sums = scored.select(key, shares.alias("_e")).where(F.col("_e.pos").isNotNull())
    return (sums.groupBy(key, F.col("_e.pos").alias("pos"), F.col("_e.token").alias("token"))
            .agg((F.sum("_e.v") / F.lit(float(permutations))).alias("phi")))


def explain_by_group(df: DataFrame, scorer, top_groups: int = 5, per_group: int = 3, num_samples: int = 1000,
                     num_features: int = 10, seed: int = 42, group: str = "grp", key: str = "row_id") -> DataFrame:
    """Explain ``per_group`` instances of each of the ``top_groups``
    largest groups; attributions carry their group."""
    from evalspark.operators.sample import sample_top_groups
    # read by the explainer and for the groups: worked out once
    picked = reliable_checkpoint(sample_top_groups(df, top_groups, per_group, group, key, seed).select(key, "text", group))
    w = explain_lime(picked.select(key, "text"), scorer, num_samples, num_features, seed, key=key)
    return w.join(picked.select(key, group), key)
