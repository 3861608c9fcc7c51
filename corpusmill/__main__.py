"""python -m corpusmill clean <root> <store> [--dry-run] [--show N] | stats <store> [--sample N]"""

import argparse

from corpusmill.plans.build import clean_corpus
from corpusmill.session import build_session
from corpusmill.sources import store


def main() -> None:
    parser = argparse.ArgumentParser(prog="corpusmill")
    commands = parser.add_subparsers(dest="command", required=True)
    clean = commands.add_parser("clean", help="read files below a folder and write their chunks")
    clean.add_argument("root")
    clean.add_argument("store")
    clean.add_argument("--dry-run", action="store_true", help="count the chunks of each file, write nothing")
    clean.add_argument("--show", type=int, default=0, help="print the first N chunks")
    stats = commands.add_parser("stats", help="count stored chunks")
    stats.add_argument("store")
    stats.add_argument("--sample", type=int, default=None, help="count modes over the first N chunks per file")
    args = parser.parse_args()
    spark = build_session()
    if args.command == "clean":
        clean_corpus(spark, args.root, args.store, dry_run=args.dry_run).orderBy("path").show(10_000, False)
        if args.dry_run:
            return
        if args.show:
            store.load_chunks(spark, args.store).select("id", "text").orderBy("id").show(args.show, False)
    store.store_stats(store.load_chunks(spark, args.store), getattr(args, "sample", None)).show(1000, False)


if __name__ == "__main__":
    main()
