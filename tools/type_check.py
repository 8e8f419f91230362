"""Compare column types of each Spark query with its DuckDB oracle."""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tollgate.plans.registry import oracle_sql, queries  # noqa: E402
from tollgate.session import get_session  # noqa: E402
from tollgate.sources.views import BASE_TABLES  # noqa: E402

MAP = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
       "timestamp_ntz": "TIMESTAMP", "date": "DATE", "timestamp": "TIMESTAMP WITH TIME ZONE", "float": "FLOAT"}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = get_session("local[4]", 4)
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, orc = queries(), oracle_sql()
    bad = 0
    for n in sorted(qs):
        st = {f.name: MAP.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in qs[n](spark, sf).schema.fields}
        rel = con.sql(orc[n])
        dt = {c: str(t) for c, t in zip(rel.columns, rel.types)}
        diff = {c: (st.get(c), dt.get(c)) for c in set(st) | set(dt) if st.get(c) != dt.get(c)}
        if diff:
            bad += 1
            print(n, diff)
    print("type mismatches:", bad)


if __name__ == "__main__":
    main()
