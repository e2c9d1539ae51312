"""Commands: `dataset stats PATH`, `dataset to-parquet PATH TARGET`, `recipe check FOLDER`, `schema check FILE`, `query NAME SF_DIR`."""

from __future__ import annotations

import argparse
import json
import sys

from corpusloom import catalog
from corpusloom.html.fields import parse_rules, spark_type
from corpusloom.operators.stats import record_summary
from corpusloom.session import get_session
from corpusloom.sources import recipes, records


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    parser.add_argument("area", choices=("dataset", "recipe", "schema", "query"))
    parser.add_argument("words", nargs="+")
    given = parser.parse_args(arguments)
    area, words = given.area, given.words
    if area == "schema":
        try:
            with open(words[-1], encoding="utf-8-sig") as f:
                print(spark_type(parse_rules(json.load(f))))
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
        return 0
    spark = get_session()
    if area == "dataset":
        found = records.read_lines(spark, words[1])
        if words[0] == "to-parquet":
            records.to_parquet(found, words[2])
        else:
            record_summary(found.where("not _bad")).show(truncate=False)
            print(json.dumps({"bad": found.where("_bad").count()}))
        return 0
    if area == "recipe":
        wrong = recipes.check_folder(spark, words[-1])
        for row in wrong:
            print(": ".join(row))
        return int(any(level == "error" for _, level, _ in wrong))
    catalog.queries()[words[0]](spark, words[1]).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
