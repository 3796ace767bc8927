"""The SQL front end: tokens, the dialect beyond Spark's, and statements that change the catalog."""
