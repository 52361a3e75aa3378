"""Command line: ``python -m glyphflow.cli COMMAND DIR ...`` on a folder of corpus tables.

    queries                         names of all queries
    check DIR                       violations of the sign list
    run DIR NAME [--out PATH]       a query, shown or written as Parquet
    stats DIR                       size and richness of the corpus
    lookup DIR CODE                 a sign of the list by its code
    search DIR [--site S] [--period P] [--material M] [--object T]
    cooccurrence DIR --out PATH     pair counts as CSV
    export DIR --format tei|json|text --out PATH
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plans
from .operators import cooc, corpus, exchange, ngrams
from .sequences import all_tokens
from .sources import writers
from .tables import clean_code, table


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glyphflow", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("queries")
    for name, extra in {"check": [], "run": ["name"], "stats": [], "lookup": ["code"], "search": [], "cooccurrence": [], "export": []}.items():
        c = sub.add_parser(name)
        c.add_argument("dir")
        for x in extra:
            c.add_argument(x)
        c.add_argument("--out")
        if name == "search":
            for x in ("site", "period", "material", "object"):
                c.add_argument(f"--{x}")
        if name == "export":
            c.add_argument("--format", choices=["tei", "json", "text"], default="text")
    return p


def result(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The table that a command shows or writes."""
    d = args.dir
    if args.command == "run":
        return plans.registry()[0][args.name](spark, d)
    if args.command == "check":
        return corpus.dictionary_violations(table(spark, d, "sign_list"))
    if args.command == "stats":
        return corpus.corpus_stats(table(spark, d, "inscriptions"), table(spark, d, "signs")).crossJoin(ngrams.lexical_stats(all_tokens(spark, d)))  # one row each
    if args.command == "lookup":
        return table(spark, d, "sign_list").filter(F.col("bennett_id") == clean_code(F.lit(args.code)))
    if args.command == "search":
        ins = corpus.latest(table(spark, d, "inscriptions").select("id", "gorila_id", "findspot_id", "minoan_period", "material", "object_type", "updated_at"), ["id"], ["updated_at"])
        spots = table(spark, d, "findspots").groupBy("id").agg(F.min("site").alias("site"))
        return corpus.search(ins, spots, args.site, args.period, args.material, args.object)
    return cooc.cooccurrence(all_tokens(spark, d))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(argv)
    if args.command == "queries":
        print("\n".join(sorted(plans.registry()[0])))
        return
    spark = spark or SparkSession.builder.appName("glyphflow").getOrCreate()
    if args.command == "export":
        if not args.out:
            raise SystemExit("export needs --out")
        tokens = all_tokens(spark, args.dir)
        if args.format == "tei":
            writers.tei_xml(exchange.tei_documents(tokens), args.out)
        elif args.format == "json":
            writers.json_documents(writers.plain_text(tokens).withColumnRenamed("seq_id", "id"), args.out, "https://example.org/corpus")
        else:
            writers.write_text(writers.plain_text(tokens), args.out)
        return
    out = result(spark, args)
    if not args.out:
        out.show(50, False)
    elif args.command == "cooccurrence":
        writers.edges_csv(out, args.out)
    else:
        writers.write_table(out, args.out)


if __name__ == "__main__":
    main()
