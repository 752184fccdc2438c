"""The registered queries, over views of the test tables, each with its SQL."""
