"""Print the physical plan of registered queries (operator tree plus each
scan's pushed filters and read schema).

    python scripts/explain_plans.py [--sf DIR] name [name ...]
"""

from __future__ import annotations

import argparse
import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from orderflow.plans.queries import QUERIES  # noqa: E402
from orderflow.session import build_session  # noqa: E402


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("names", nargs="+")
    args = ap.parse_args()
    spark = build_session("local[8]", shuffle_partitions=16)
    for name in args.names:
        df = QUERIES[name](spark, args.sf)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        text = buf.getvalue()
        tree, _, details = text.partition("\n\n\n")
        print(f"### {name}\n")
        print("```")
        print(tree.strip())
        for block in re.split(r"\n\n", details):
            if block.lstrip().startswith("(") and "Scan parquet" in block.split("\n")[0]:
                keep = [ln for ln in block.split("\n")
                        if ln.startswith("(") or ln.startswith("PushedFilters")
                        or ln.startswith("ReadSchema") or ln.startswith("PartitionFilters")]
                print("\n".join(keep))
        print("```\n")


if __name__ == "__main__":
    main()
