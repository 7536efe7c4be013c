"""Print compact physical plans of reports as a large cluster would start them.

Broadcast joins by estimate are switched off and AQE is off, so every join
shows as the shuffle join it is at scale (AQE may still pick broadcasts at run
time from measured sizes).

Usage: python scripts/show_plans.py [--stored] [sf_dir] report ...
``--stored`` first writes the tables in the stored layout and plans over them,
so the fixture's own derivation joins do not appear.
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dunning.params import FIXTURE_PARAMS  # noqa: E402
from dunning.plans.reports import REPORTS  # noqa: E402
from dunning.session import local_session  # noqa: E402
from dunning.sources.layout import HIST_PARTITION, write_tables  # noqa: E402
from dunning.sources.tables import from_fixture, from_parquet  # noqa: E402

SKIP = ("Project", "Filter", "ColumnarToRow", "InputAdapter", "WholeStageCodegen", "Sort ", "Generate")


def compact(tree: str) -> list[str]:
    out = []
    for line in tree.splitlines():
        m = re.match(r"^([\s:+\-|]*)(.*)$", line)
        pre, body = m.groups()
        body = re.sub(r"#\d+L?", "", body)
        body = re.sub(r"^\*\(\d+\) ", "", body)
        if not body or body.startswith(SKIP) or body == "Sort":
            continue
        if body.startswith("Exchange"):
            k = re.search(r"hashpartitioning\(([^)]*)\)|rangepartitioning\((.*?), \d+\)|SinglePartition", body)
            body = "Exchange " + (k.group(0).split(", ENSURE")[0] if k else "")
        elif "FileScan" in body:
            tbl = re.search(r"/(\w+_tb)\b", body) or re.search(r"/(\w+)\.parquet", body)
            body = "Scan " + (tbl.group(1) if tbl else "")
        elif body.startswith(("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin")):
            body = body[:110]
        elif body.startswith(("HashAggregate", "SortAggregate", "ObjectHashAggregate")):
            k = re.search(r"keys?=\[([^\]]*)\]", body)
            body = body.split("(")[0] + f" keys=[{k.group(1) if k else ''}]"
        elif body.startswith("WindowGroupLimit"):
            body = "WindowGroupLimit " + ("Partial" if "Partial" in body else "Final")
        elif body.startswith("Window"):
            body = "Window"
        else:
            body = body[:90]
        out.append(pre + body)
    return out


def main() -> None:
    args = sys.argv[1:]
    stored = bool(args) and args[0] == "--stored"
    args = args[1:] if stored else args
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session()
    t = from_fixture(spark, sf_dir)
    if stored:
        root = tempfile.mkdtemp(prefix="dunning-plans-")
        write_tables(t, root, files=4)
        t = from_parquet(spark, root, hist_day=HIST_PARTITION)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    for key in args or list(REPORTS):
        df = REPORTS[key].build(t, FIXTURE_PARAMS)
        print(f"### {key}\n```")
        print("\n".join(compact(df._jdf.queryExecution().executedPlan().treeString())))
        print("```\n")


if __name__ == "__main__":
    main()
