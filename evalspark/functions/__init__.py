from evalspark.functions.columns import (  # noqa: F401
    hash_key,
    hash_uniform,
    label_display,
    r6,
    safe_div,
    safe_partition_name,
    significance_stars,
    snippet,
)
