"""Table functions for SQL: passages of a text, blocks and links of a page, as rows of a LATERAL join."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tessera.functions.passages import split_passages
from tessera.sources import html


@udtf(returnType="number int, start int, end int, passage string", useArrow=True)
class Passages:
    """passages(text, limit): spans of at most limit characters that cross no heading."""

    def eval(self, text: str, limit: int):
        for n, (a, b) in enumerate(split_passages(text or "", limit)):
            yield n, a, b, text[a:b]


@udtf(returnType="number int, key string, kind string, heading string, text string, start_byte int, end_byte int, exclusion string", useArrow=True)
class HtmlBlocks:
    """html_blocks(html): a page's blocks with the bytes that they came from, and why one is navigation."""

    def eval(self, source: str):
        for n, b in enumerate(html.page_blocks(source or "")):
            yield n, b.key, b.kind, b.heading, b.text, b.start, b.end, b.exclusion


@udtf(returnType="number int, target string, fragment string, anchor string, rel string", useArrow=True)
class HtmlLinks:
    """html_links(url, html): a page's links to documents, resolved against its address."""

    def eval(self, url: str, source: str):
        for n, x in enumerate(html.page_links(url, source) if url is not None and source is not None else ()):
            yield n, *x


def register(spark: SparkSession) -> None:
    """Make passages, html_blocks and html_links known to the session's SQL; a second call changes nothing."""
    for name, f in (("passages", Passages), ("html_blocks", HtmlBlocks), ("html_links", HtmlLinks)):
        spark.udtf.register(name, f)
