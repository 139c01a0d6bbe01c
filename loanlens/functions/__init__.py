from loanlens.functions.columns import (  # noqa: F401
    hash_bits,
    hash_number,
    hash_uniform,
    is_missing,
    known,
    log_or_null,
    nan_to_null,
    ratio,
    seeded_hash,
    sentinel_to_null,
    threshold_flag,
    years_from_days,
)
