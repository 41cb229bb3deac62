"""``python -m quillstone``: run a named query, or decide questions over a file of states.

    python -m quillstone query NAME DATA_DIR [--out PATH]
    python -m quillstone decide STATES QUESTIONS [--out PATH] [--min-confidence X] [--ensemble N]

STATES is a folder or file of JSON lines with ``state_id`` and ``state``, QUESTIONS a JSON object of questions. Without --out
the first rows are shown; with it all rows are written as JSON lines.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from quillstone import plans
from quillstone.operators import decide as D
from quillstone.sources.io import write_jsonl


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="quillstone", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = p.add_subparsers(dest="command", required=True)
    q = commands.add_parser("query")
    q.add_argument("name", choices=sorted(plans.queries()), metavar="NAME")
    q.add_argument("data")
    d = commands.add_parser("decide")
    d.add_argument("states")
    d.add_argument("questions")
    d.add_argument("--min-confidence", type=float, default=0.0)
    d.add_argument("--ensemble", type=int, default=1)
    for c in (q, d):
        c.add_argument("--out")
        c.add_argument("--rows", type=int, default=20, help="rows shown without --out")
    a = p.parse_args(args)
    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("quillstone").getOrCreate()
    if a.command == "query":
        out: DataFrame = plans.queries()[a.name](spark, a.data)
    else:
        with open(a.questions, encoding="utf-8") as f:
            try:
                questions = D.question_frame(spark, json.load(f))
            except (ValueError, D.QuestionError) as e:
                print(f"{a.questions}: {e}", file=sys.stderr)
                return 2
        states = spark.read.schema("state_id string, state string").json(a.states)
        out = D.decide(states, questions, n=a.ensemble, min_confidence=a.min_confidence).select("state_id", "qid", "answer", "escalate")
    if a.out:
        write_jsonl(out, a.out, compressed=False)
    else:
        out.show(a.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
