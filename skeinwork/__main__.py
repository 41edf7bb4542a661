"""python -m skeinwork: seed a stored corpus from text files, or write the index of one."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from skeinwork import session
from skeinwork.operators.index import Index
from skeinwork.sources import corpus as C


def seed(spark, files: str, path: str) -> int:
    """Stores the accepted files as a corpus at path if there is none; the number of its documents."""
    rows = C.read_text_files(spark, files).filter("accepted").drop("path", "length", "suffix", "reason", "accepted")
    good = session.numbered(C.validated(rows).filter("error is null"), "doc_id", "slug", start=1)
    known = [F.lit(None).cast(f.dataType).alias(f.name) for f in C.DOCUMENT if f.name not in good.columns and f.name != "is_published"]
    C.bootstrap(spark, path, good.select("*", F.lit(True).alias("is_published"), *known))
    return spark.read.parquet(path).count()


def reindex(spark, path: str, to: str) -> int:
    """Writes the index of a stored corpus: entries, vocabulary and norms, each a folder; the number of its terms."""
    index = Index(spark.read.parquet(path))
    for name in ("entries", "vocabulary", "norms"):
        getattr(index, name).write.mode("overwrite").parquet(f"{to}/{name}")
    return index.vocabulary.count()


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="skeinwork", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, what, places in (("seed", "text files to a corpus, if there is none", ("files", "corpus")), ("reindex", "a corpus to its index", ("corpus", "index"))):
        command = commands.add_parser(name, help=what)
        for place in places:
            command.add_argument(place)
    asked = parser.parse_args(arguments)
    spark = session.build()
    if asked.command == "seed":
        print(f"{seed(spark, asked.files, asked.corpus)} documents")
    else:
        print(f"{reindex(spark, asked.corpus, asked.index)} terms")


if __name__ == "__main__":
    main()
