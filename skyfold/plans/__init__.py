"""The equation language, the views over the test tables and the queries."""
