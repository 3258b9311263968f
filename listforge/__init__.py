"""listforge: clean, check, search and recommend from large listing tables on Spark."""
