"""python -m quarrygraph.cli ROOT COMMAND [ARGS] [--OPTION VALUE]: prints the JSON envelope of an analysis.

Commands are the methods of ``api.Quarry`` that take names, paths, texts and numbers. Searching by vector and embedding
need a model and are called from Python.
"""

from __future__ import annotations

import inspect
import json
import sys

from quarrygraph.api import Quarry, print_envelope

COMMANDS = ["list", "info", "find", "find_with_relations", "graph", "deps", "overview", "topology", "compare", "similar", "import_ndjson", "debt", "drop", "impact_of_diff", "check_files", "git_metrics_of_log", "trends_of", "branch_summary", "update", "provision"]


def _value(text: str) -> object:
    if text in ("true", "false"):
        return text == "true"
    return int(text) if text.lstrip("-").isdigit() else text


def main(argv: list[str]) -> int:
    if len(argv) < 2 or argv[1] not in COMMANDS:
        print(__doc__, "\nCommands:", *COMMANDS)
        return 2
    from pyspark.sql import SparkSession

    args, options, rest = [], {}, iter(argv[2:])
    for a in rest:
        if a.startswith("--"):
            options[a[2:].replace("-", "_")] = _value(next(rest, ""))
        else:
            args.append(a)
    spark = SparkSession.builder.appName("quarrygraph").getOrCreate()
    method = getattr(Quarry(spark, argv[0]), argv[1])
    unknown = options.keys() - inspect.signature(method).parameters.keys()
    if unknown:
        print(json.dumps({"success": False, "error": {"code": "usage", "message": f"unknown options {sorted(unknown)}"}}, ensure_ascii=False))
        return 1
    return 0 if print_envelope(lambda: method(*args, **options), sys.stdout) else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
