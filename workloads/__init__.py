"""The registered queries: operators run over the given tables, with their SQL."""
