from evalspark.streaming.incremental import expand_incremental  # noqa: F401
