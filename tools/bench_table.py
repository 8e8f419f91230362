import json
import sys


def render(d: dict) -> str:
    cfg = d.get("config", {})
    q, dd = d["queries"], d.get("duckdb_queries", {})
    lines = [
        "## Our own baseline",
        "",
        f"Measured with `bench.py` at sf{d['sf']} (600,000 `lineitem`, 100,000 `events`, 2,500 `pages` rows):",
        f"Spark {cfg.get('spark')} on local[{cfg.get('cpus')}] (one JVM, driver memory 16 GB), shuffle partitions",
        f"{cfg.get('shuffle_partitions')}, AQE on; {cfg.get('stat')}. DuckDB {d.get('duckdb_version', '2.0.0')} runs each query's",
        "oracle SQL on the same Parquet files in the same container. Both are single-machine figures.",
        "",
        f"* Spark, all {len(q)} registered queries: **{d['value']} s** (sum of medians); headline set "
        f"({', '.join(d.get('headline', []))}): {d.get('headline_sec')} s.",
        f"* DuckDB, same SQL: {d.get('duckdb_value')} s.",
        "",
        "At this size every input table is one Parquet row group (one scan task each) and Spark's fixed",
        "cost per job (planning, stage scheduling, ~0.1–0.3 s per shuffle stage on one machine) dominates;",
        "the plans are built for many-file inputs on a cluster, where the same shuffles run in parallel.",
        "Run-to-run variation on this host is large (about ±30% for the same code and settings, from other",
        "load on the machine: the same 113 queries measured 53 s and 78 s an hour apart); compare queries",
        "within one run rather than across runs.",
        "",
        "| query | Spark s | DuckDB s |",
        "|---|---:|---:|",
    ]
    for name in sorted(q):
        lines.append(f"| {name} | {q[name]:.3f} | {dd.get(name, float('nan')):.3f} |")
    return "\n".join(lines) + "\n"


if __name__ == "__main__":
    data = json.loads(open(sys.argv[1]).read().strip().splitlines()[-1])
    base = open(sys.argv[2]).read()
    head = base.split("## Our own baseline")[0]
    open(sys.argv[2], "w").write(head + render(data))
