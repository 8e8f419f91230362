"""Write docs/PLANS.md: physical plan trees of the headline queries with the
pushed filters and read schemas of their scans (from explain("formatted"))."""
import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tollgate.plans.registry import REGISTRY, queries  # noqa: E402
from tollgate.session import get_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session("local[8]", 8)
    qs = queries()
    out = ["# Physical plans of the headline queries", "",
           f"`explain(\"formatted\")` at {os.path.basename(sf)} on local[8] (AQE on; the plan shown is the",
           "initial adaptive plan). Joins below Spark's size check are broadcast at this scale; above it",
           "they are sort-merge joins. Each scan lists what reached Parquet.", ""]
    for name in sorted(n for n, p in REGISTRY.items() if p.headline):
        buf = io.StringIO()
        with redirect_stdout(buf):
            qs[name](spark, sf).explain("formatted")
        text = buf.getvalue()
        tree = text.split("\n\n")[0].replace("== Physical Plan ==\n", "")
        scans = re.findall(r"\(\d+\) Scan parquet[^\n]*\n(?:[^\n]+\n)*?ReadSchema: [^\n]+", text)
        out += [f"## {name}", "", "```", tree.rstrip(), "```", ""]
        for sc in scans:
            lines = [l for l in sc.splitlines() if l.startswith(("(", "Location", "PushedFilters", "ReadSchema"))]
            out += ["```", *lines, "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
