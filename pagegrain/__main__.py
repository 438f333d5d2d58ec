"""Commands over one page, a folder of pages or the standard input: text, html, markdown, query, stream, links, title.

python -m pagegrain markdown page.html; python -m pagegrain query 'nav a' < page.html
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.operators import pages
from pagegrain.sources import read_stdin, read_text_files


def output_lines(df: DataFrame, mode: str, selector: str | None = None) -> DataFrame:
    """One column ``line`` of what a command prints for the pages (doc_id, html), in order."""
    if mode == "text":
        return pages.page_text(df).select(F.col("text").alias("line"))
    if mode == "html":
        return pages.page_html(df).select(F.col("html").alias("line"))
    if mode == "markdown":
        return pages.page_markdown(df).select(F.col("markdown").alias("line"))
    if mode == "stream":
        return pages.html_events(df).orderBy("doc_id", "seq").select(F.concat_ws(" ", "kind", "name", "data").alias("line"))
    if mode == "title":
        return pages.matches(df, "title", first=True).select(F.col("text").alias("line"))
    if mode == "links":
        return pages.matches(df, "a[href]").orderBy("doc_id", "match").select(F.concat_ws("\t", F.col("attrs")["href"], F.col("text")).alias("line"))
    return pages.matches(df, selector or "*").orderBy("doc_id", "match").select(F.concat_ws("\t", "name", "text").alias("line"))


def main(args: list[str] | None = None, stream=None) -> int:
    parser = argparse.ArgumentParser(prog="pagegrain")
    parser.add_argument("mode", choices=("text", "html", "markdown", "query", "stream", "links", "title"))
    parser.add_argument("rest", nargs="*", help="a selector first (query), then files; without files the standard input")
    said = parser.parse_args(args)
    selector, files = (said.rest[0], said.rest[1:]) if said.mode == "query" and said.rest else (None, said.rest)
    spark = SparkSession.builder.appName("pagegrain").getOrCreate()
    try:
        df = read_text_files(spark, files).withColumnRenamed("path", "doc_id") if files else read_stdin(spark, stream)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    for row in output_lines(df, said.mode, selector).toLocalIterator():
        print(row.line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
