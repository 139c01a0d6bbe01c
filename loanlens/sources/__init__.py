from loanlens.sources.tables import (  # noqa: F401
    read_csv,
    read_table,
    register,
    sample_rows,
    schema_table,
    select_by_type,
    write_prepared,
)
