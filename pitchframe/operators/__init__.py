"""DataFrame operators: ``f(df, *, columns and parameters) -> DataFrame``, all lazy."""
