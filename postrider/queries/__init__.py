"""Queries over the shared test tables, each with its SQL; one module for each group of operators."""


class Group:
    """Collects queries: ``@group.add("name", sql)`` above a function of (spark, sf_dir)."""

    def __init__(self):
        self.QUERIES, self.SQL = {}, {}

    def add(self, name, sql=None):
        def put(f):
            self.QUERIES[name] = f
            if sql:
                self.SQL[name] = sql
            return f

        return put
