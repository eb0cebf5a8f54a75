"""Projections, filters and scalar logic of dataset preparation (P1-P9,
P13-P16). All are narrow column expressions: no shuffle, pushed into the
scan where the columns come straight from parquet."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.columns import label_display as _label_display
from evalspark.functions.columns import snippet as _snippet
from evalspark.operators.text import tokenize_col


def pick_by_direction(df: DataFrame, more: str = "sent_more", less: str = "sent_less",
                      flag: str = "stereo_antistereo", out: str = "text") -> DataFrame:
    """``more`` when the flag is 'stereo', else ``less`` (null or unknown
    flags take ``less``; null-safe comparison)."""
    return df.withColumn(out, F.when(F.col(flag).eqNullSafe("stereo"), F.col(more)).otherwise(F.col(less)))


def with_constant(df: DataFrame, name: str, value) -> DataFrame:
    """A constant column."""
    return df.withColumn(name, F.lit(value))


def project_rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Select and rename, ``{new_name: existing_column}`` in output order."""
    return df.select(*[F.col(src).alias(dst) for dst, src in mapping.items()])


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in any (or the given) column; empty strings stay."""
    return df.na.drop("any", subset=list(subset) if subset else None)


def pairs_to_samples(pairs: DataFrame, label: str = "stereotype") -> DataFrame:
    """P1 -> P2 -> P3 -> P4: sentence pairs to labelled sentences."""
    x = pick_by_direction(pairs)
    x = with_constant(x, "label", label)
    x = project_rename(x, {"row_id": "row_id", "text": "text", "label": "label", "grp": "bias_type"})
    return drop_incomplete(x, ["text", "label", "grp"])


def binarize_label(df: DataFrame, positive="stereotype", col: str = "label", out: str = "label_int") -> DataFrame:
    """P5: 1 if the label equals ``positive``, else 0; a null label is not the positive one, so 0."""
    return df.withColumn(out, F.col(col).eqNullSafe(F.lit(positive)).cast("int"))


# The three-class encoding.
THREE_CLASS = {"stereotype": 0, "neutral": 1, "unrelated": 2}


def encode_label(df: DataFrame, mapping: Mapping[str, int] = THREE_CLASS, col: str = "label",
                 out: str = "label_id") -> DataFrame:
    """Map lookup; unmapped values give null."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(int(v)))])
    return df.withColumn(out, m[F.col(col)])


def drop_labels(df: DataFrame, values: Sequence, col: str = "label") -> DataFrame:
    """Remove the given labels; null labels are none of them and stay."""
    return df.where(~F.col(col).isin(list(values)) | F.col(col).isNull())


def attach_row_id(df: DataFrame, source_key: str | None = None, out: str = "row_id") -> DataFrame:
    """A row id. Prefer a key of the source (stable across reruns); else
    a unique, non-dense ``monotonically_increasing_id`` (no shuffle, no
    single-partition numbering)."""
    if source_key is not None:
        return df.withColumn(out, F.col(source_key).cast("long"))
    return df.withColumn(out, F.monotonically_increasing_id())


def reorder_columns(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """Move the given columns to the front."""
    first = list(first)
    return df.select(*first, *[c for c in df.columns if c not in first])


def label_display(df: DataFrame, col: str = "actual_label", out: str = "label_name") -> DataFrame:
    """1 -> 'Stereotype', 0 -> 'Non-Stereotype', other values as text."""
    return df.withColumn(out, _label_display(col))


def snippet(df: DataFrame, n: int = 200, col: str = "text", out: str = "snippet") -> DataFrame:
    """First n characters plus '...'."""
    return df.withColumn(out, _snippet(col, n))


def preview(df: DataFrame, n: int = 5, key: str = "row_id") -> DataFrame:
    """The first n rows in key order (a top-k, not a full sort)."""
    return df.orderBy(key).limit(n)


def truncate_tokens(df: DataFrame, n: int, col: str = "text") -> DataFrame:
    """Word tokens cut at n: token count, kept count, whether the row
    was cut and the last kept token (null for a row without tokens)."""
    toks = tokenize_col(F.col(col))
    x = df.withColumn("_t", toks)
    kept = F.slice("_t", 1, n)
    return x.select(*[c for c in df.columns if c != col], F.size("_t").alias("n_tokens"),
                    F.size(kept).alias("n_kept"), (F.size("_t") > n).alias("truncated"),
                    F.try_element_at(kept, F.lit(-1)).alias("last_kept")).drop("_t")


def truncation_share(df: DataFrame, n: int, col: str = "text") -> DataFrame:
    """P16 (summary): rows and share of rows longer than n tokens."""
    t = truncate_tokens(df.select(col), n, col)
    return t.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("truncated").alias("n_truncated"),
                 F.round(F.count_if("truncated") / F.count(F.lit(1)), 6).alias("share_truncated"))
