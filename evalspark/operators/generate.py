"""Variant generation on the data side.

The generator itself is a user callable run in Python workers through
``mapInArrow`` (one call per row, errors caught per row, batches in small parts); everything around
it -- prompt building, response parsing, emitting variant rows, combining
with the originals -- is built-in column logic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from evalspark.session import small_parts

# Response markers (accepted spellings) for the two variants.
NEUTRAL_PREFIXES = ("NEUTRE:", "Neutre:")
UNRELATED_PREFIXES = ("SANS_RAPPORT:", "Sans rapport:")

DEFAULT_TEMPLATE = ("Rewrite the sentence below twice. First a version without any stereotype, on a line "
                    "starting with NEUTRE:. Then an unrelated sentence on the same topic, on a line starting "
                    "with SANS_RAPPORT:.\nSentence: {text}\n")


def _strip(c: Column) -> Column:
    """Trim leading and trailing whitespace (not only spaces)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def build_prompt(df: DataFrame, template: str = DEFAULT_TEMPLATE, col: str = "text",
                 out: str = "prompt") -> DataFrame:
    """V1: template with the sentence inserted at ``{text}``, trimmed."""
    before, _, after = template.partition("{text}")
    return df.withColumn(out, _strip(F.concat(F.lit(before), F.col(col), F.lit(after))))


def generate(df: DataFrame, generator_factory: Callable[[], Callable[[str], str]], col: str = "prompt",
             out: str = "response") -> DataFrame:
    """V2: call a user generator once per row in Python workers.

    ``generator_factory`` is called once per task (load a model or client
    there); the generator maps a prompt to a response. A failing row gets a
    null response and the error text; the job goes on. A worker holds the texts of
    a small part of its batch at a time."""
    schema = StructType([*df.schema.fields, StructField(out, StringType()), StructField("error", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gen = generator_factory()
        for part in (part for batch in batches for part in small_parts(batch)):
            res, err = [], []
            for p in part.column(part.schema.get_field_index(col)).to_pylist():
                try:
                    res.append(None if p is None else gen(p))
                    err.append(None)
                except Exception as e:  # noqa: BLE001 - one bad row must not stop the job
                    res.append(None)
                    err.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(res, pa.string()), pa.array(err, pa.string())],
                                             names=[*part.schema.names, out, "error"])

    return df.mapInArrow(run, schema)


def _last_marked(lines: Column, prefixes: Sequence[str]) -> Column:
    hit = F.filter(lines, lambda ln: F.greatest(*[ln.startswith(p) for p in prefixes])
                   if len(prefixes) > 1 else ln.startswith(prefixes[0]))
    last = F.try_element_at(hit, F.lit(-1))
    return F.coalesce(_strip(F.split(last, ":", 2)[1]), F.lit(""))


def parse_response(df: DataFrame, col: str = "response", neutral_prefixes: Sequence[str] = NEUTRAL_PREFIXES,
                   unrelated_prefixes: Sequence[str] = UNRELATED_PREFIXES) -> DataFrame:
    """V3: per trimmed line, a neutral marker wins over an unrelated one; the
    text after the first ':' (trimmed) of the last marked line is kept;
    no marker or no response gives ''."""
    lines = F.transform(F.split(F.coalesce(F.col(col), F.lit("")), "\n"), _strip)
    neutral_lines = F.filter(lines, lambda ln: F.greatest(*[ln.startswith(p) for p in neutral_prefixes]))
    other_lines = F.filter(lines, lambda ln: ~F.greatest(*[ln.startswith(p) for p in neutral_prefixes]))
    return df.withColumn("neutral", _last_marked(neutral_lines, neutral_prefixes)) \
             .withColumn("unrelated", _last_marked(other_lines, unrelated_prefixes))


def to_variants(parsed: DataFrame, key: str = "row_id", group: str = "grp") -> DataFrame:
    """V4: one row per non-empty variant: (key, origin, text, label, group)."""
    recs = F.array(
        F.struct(F.lit("neutral").alias("origin"), F.col("neutral").alias("text")),
        F.struct(F.lit("unrelated").alias("origin"), F.col("unrelated").alias("text")))
    x = parsed.select(key, group, F.explode(recs).alias("v")).select(key, group, "v.origin", "v.text")
    return x.where(F.col("text") != "").select(key, "origin", "text", F.col("origin").alias("label"), group)


def combine_variants(original: DataFrame, variants: DataFrame) -> DataFrame:
    """Originals and variants stacked by column name (UNION ALL);
    originals get origin 'original'."""
    o = original if "origin" in original.columns else original.withColumn("origin", F.lit("original"))
    return o.unionByName(variants, allowMissingColumns=True)


def offline_generator_factory() -> Callable[[str], str]:
    """A deterministic stand-in generator (no network): the neutral variant
    is the sentence's first half, the unrelated one its second half."""
    def gen(prompt: str) -> str:
        sentence = prompt.split("Sentence:", 1)[-1].strip()
        words = sentence.split()
        half = max(1, len(words) // 2)
        return f"NEUTRE: {' '.join(words[:half])}\nSANS_RAPPORT: {' '.join(words[half:])}"
    return gen
