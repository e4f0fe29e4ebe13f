"""python -m paperloom train|search|browse|relationship|export ..."""

from __future__ import annotations

import argparse

from paperloom.plans import jobs
from paperloom.session import session
from paperloom.sources import readers, sinks


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="paperloom")
    commands = parser.add_subparsers(dest="command", required=True)
    train = commands.add_parser("train")
    train.add_argument("documents")
    train.add_argument("path")
    train.add_argument("--feature", default="text")
    train.add_argument("--id", default="doc_id")
    train.add_argument("--optimizer", choices=["online", "em"], default="online")
    train.add_argument("--iterations", type=int, default=100)
    train.add_argument("--topics", type=int, nargs="+", default=[2])
    train.add_argument("--lemmas", choices=["none", "rules", "learned"], default="none")
    search = commands.add_parser("search")
    search.add_argument("path")
    search.add_argument("query")
    browse = commands.add_parser("browse")
    browse.add_argument("path")
    browse.add_argument("topic", type=int)
    for command in (search, browse):
        command.add_argument("-n", type=int, default=10)
        command.add_argument("--id", default="doc_id")
        command.add_argument("--labels", help="CSV of topic labels; search then shows the topics of each hit", required=command is browse)
    search.add_argument("--csv", help="folder for the hits as CSV")
    relationship = commands.add_parser("relationship")
    relationship.add_argument("path")
    relationship.add_argument("out")
    relationship.add_argument("--threshold", type=float, default=0.0004795)
    relationship.add_argument("--chi", type=float, default=19.5)
    export = commands.add_parser("export")
    export.add_argument("path")
    export.add_argument("out")
    given = parser.parse_args(args)
    spark = session()
    if given.command == "train":
        docs = spark.read.parquet(given.documents)
        jobs.train(docs, given.path, tuple(given.topics), given.feature, given.id, optimizer=given.optimizer, iterations=given.iterations, lemmas=given.lemmas).show()
    elif given.command == "search":
        if given.labels:
            found = jobs.search_page(spark, given.path, given.query, readers.labels(spark, given.labels), given.n, given.id)
        else:
            found = jobs.search(spark, given.path, given.query, given.n, given.id)
        if given.csv:
            sinks.write_similarities(found, given.csv)
        found.show(5 * given.n, truncate=60)
    elif given.command == "browse":
        jobs.browse(spark, given.path, given.topic, readers.labels(spark, given.labels), given.n, given.id).show(5 * given.n, truncate=60)
    elif given.command == "relationship":
        for name, frame in jobs.relationship(spark, given.path, given.out, given.threshold, given.chi).items():
            print(name)
            frame.show()
    else:
        jobs.export(spark, given.path, given.out)


if __name__ == "__main__":
    main()
