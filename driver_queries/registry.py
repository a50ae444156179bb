"""One registry of queries and their SQL twins per module."""


def registry():
    queries, sql = {}, {}

    def query(name, text=None):
        def register(fn):
            queries[name] = fn
            if text:
                sql[name] = text
            return fn

        return register

    return queries, sql, query


def rounded(df, keep, digits=4):
    """Keep columns as they are, round the others."""
    return df.selectExpr(*keep, *[f"round(`{c}`, {digits}) as `{c}`" for c in df.columns if c not in keep])


def round_sql(columns, digits=4):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)
