"""Incremental variant generation as a Structured Streaming job.

New sample files dropped into ``in_dir`` are picked up by the file source,
turned into prompts, sent through the generator (Python workers), parsed
into variant rows and appended to ``out_dir``. The checkpoint records which
files were processed and which output batches were committed, so a restart
after a crash resumes where it stopped and every input file is processed
once (the file sink's log makes the output exactly-once). The checkpoint
location belongs to one stream and must outlive the session, so the caller
names it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from evalspark.operators.generate import build_prompt, generate, parse_response, to_variants

SAMPLES_SCHEMA = "row_id long, text string, label string, grp string"


def expand_incremental(spark: SparkSession, in_dir: str, out_dir: str,
                       generator_factory: Callable[[], Callable[[str], str]],
                       checkpoint: str, schema: str = SAMPLES_SCHEMA, fmt: str = "parquet",
                       max_files_per_trigger: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Start the stream; with ``available_now`` it processes what is there
    (in several batches if ``max_files_per_trigger`` is set) and stops."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.load(in_dir)
    variants = to_variants(parse_response(generate(build_prompt(src), generator_factory)))
    w = (variants.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint)
         .option("path", out_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
