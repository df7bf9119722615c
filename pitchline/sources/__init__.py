from pitchline.sources.tables import read_table, matches, MATCHES_SQL  # noqa: F401
