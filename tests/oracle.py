"""Run a registered query and its SQL on the same tables and compare the rows."""

import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def sql_rows(folder, sql):
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = os.path.join(folder, name + ".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    cursor = connection.execute(sql)
    columns = [item[0] for item in cursor.description]
    return columns, cursor.fetchall()


def keyed(columns, rows):
    order = sorted(range(len(columns)), key=lambda index: columns[index])
    plain = sorted(repr(tuple(row[index] for index in order)) for row in rows)
    return [columns[index] for index in order], plain


def difference(frame, folder, sql):
    """None when the results are equal, else a short account of the difference."""
    left_columns, left = keyed(frame.columns, [tuple(row) for row in frame.collect()])
    right_columns, right = keyed(*sql_rows(folder, sql))
    if left_columns != right_columns:
        return f"columns {left_columns} and {right_columns}"
    if left == right:
        return None
    missing = sorted(set(right) - set(left))[:3]
    surplus = sorted(set(left) - set(right))[:3]
    return f"{len(left)} and {len(right)} rows; missing {missing}; surplus {surplus}"
