"""Readers of what the jobs take in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import html, text
from paperloom.session import kept as once

# Columns of stored papers, and of the label file as its header spells them.
PAPERS = "_id long, source string, title string, authors string, abstract string, keywords string, url string, content binary, text string"
LABELS = "Id int, Label string, Ambuguity int"
#: Larger binaries aren't kept.
LARGEST = 3_000_000


def papers(spark: SparkSession, path: str | None = None, form: str = "parquet", **options: str) -> DataFrame:
    """Documents in the schema PAPERS, from files or, by the ``form`` and options of its connector, from a document store."""
    return spark.read.schema(PAPERS).format(form).options(**options).load(path)


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Topic labels from CSV; an empty ambiguity is null."""
    return spark.read.schema(LABELS).csv(path, header=True)


def numbers(spark: SparkSession, path: str) -> DataFrame:
    """(value): one number a line."""
    return spark.read.text(path).select(F.col("value").cast("double").alias("value"))


def edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, weight) from lines like Edge(0,1,12.5)."""
    part = lambda i: F.regexp_extract("value", r"Edge\((\d+),(\d+),([^)]*)\)", i)
    return spark.read.text(path).select(part(1).cast("long").alias("src"), part(2).cast("long").alias("dst"), part(3).cast("double").alias("weight"))


def query_frame(spark: SparkSession, query: str, feature: str = "abstract") -> DataFrame:
    return spark.createDataFrame([(0, query)], f"id int, {feature} string")


# Where each source is entered, by the publishers' own addresses.
SEEDS = {
    "JMLR": ("http://www.jmlr.org/papers/v%d/", 13, 18),
    "NIPS": ["http://papers.nips.cc/book/advances-in-neural-information-processing-systems-25-2012"],
    "SLML": ["https://link.springer.com/journal/10994/106/2/page/1"],
    "IEEE": ["http://ieeexplore.ieee.org/xpl/mostRecentIssue.jsp?punumber=34&isnumber=4359286"],
    "ARXIV": ["https://arxiv.org/list/stat.ML/17?show=2000"],
}


def seeds_of(spark: SparkSession, source: str) -> DataFrame:
    """(url): the addresses at which ``source`` is entered."""
    found = SEEDS[source]
    return seeds(spark, *found) if isinstance(found, tuple) else spark.createDataFrame([(u,) for u in found], "url string")


def seeds(spark: SparkSession, pattern: str, first: int, last: int) -> DataFrame:
    """(url): a printf pattern filled with each number; repeated urls once."""
    return spark.range(first, last + 1).select(F.format_string(pattern, "id").alias("url")).dropDuplicates(["url"])


def binaries(spark: SparkSession, path: str, extract: Callable[[bytes], str]) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): files below LARGEST bytes with the text an extractor finds, and the others with a reason.

    What the extractor makes of the files is written once, as both results read it.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tried = [_attempt(extract, content.as_py()) for content in batch.column("content")]
            made = [pa.array([t[i] for t in tried], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("content"), *made], ["path", "content", "text", "reason"])

    small = once(files.where(F.col("length") < LARGEST).mapInArrow(run, "path string, content binary, text string, reason string"))
    large = files.where(F.col("length") >= LARGEST).select("path", F.lit("too large").alias("reason"))
    return small.where("reason is null").drop("reason"), small.where("reason is not null").select("path", "reason").unionByName(large)


def _attempt(extract: Callable[[bytes], str], content: bytes) -> tuple[str | None, str | None]:
    try:
        return extract(content), None
    except Exception as problem:  # any extractor may fail on any file; the row says how
        return None, f"{type(problem).__name__}: {problem}"


# Publication pages: a frame (url, html) in, one row a paper out.


def journal_index(pages: DataFrame) -> DataFrame:
    """(title, authors, abstract_url, url) of the entries of a volume page: dt, i, and the first two links."""
    entry = F.explode(F.regexp_extract_all("html", F.lit(r"(?s)<dl>(.*?)</dl>"), F.lit(1)))
    rows = pages.select("url", entry.alias("entry"))
    link = lambda i: F.try_element_at(F.regexp_extract_all("entry", F.lit(r'href="?([^"\s>]+)'), F.lit(1)), F.lit(i))
    named = rows.select("url", F.regexp_extract("entry", r"<dt>([^<]*)", 1).alias("title"), F.regexp_extract("entry", r"<i>([^<]*)", 1).alias("authors"), link(1).alias("a"), link(2).alias("p"))
    return named.select(F.lit("JMLR").alias("source"), "title", "authors", html.resolved("url", "a").alias("abstract_url"), html.resolved("url", "p").alias("url"))


def journal_abstract(pages: DataFrame) -> DataFrame:
    """(url, abstract) from the text between the markers of an abstract page."""
    return pages.select("url", text.between_markers(html.all_text("html")).alias("abstract"))


def proceedings_paper(pages: DataFrame, source: str, abstract: tuple[str, str] = ("class", "abstract"), keywords: tuple[str, str] | None = None) -> DataFrame:
    """Citation metadata of paper pages; ``source`` NIPS or SLML, with the attribute that marks their abstract."""
    meta = lambda name: ("meta", ("name", name), "content")
    chosen = {"title": meta("citation_title"), "authors": meta("citation_author"), "url": meta("citation_pdf_url"), "abstract": ("p", abstract)}
    found = pages.select(html.selected(F.col("html"), **chosen, **({"keywords": ("span", keywords)} if keywords else {})).alias("found"))
    first = lambda name: F.try_element_at(f"found.{name}", F.lit(1)).alias(name)
    return found.select(
        F.lit(source).alias("source"),
        first("title"),
        F.array_join("found.authors", ", ").alias("authors"),
        first("abstract"),
        (F.array_join("found.keywords", ", ") if keywords else F.lit("")).alias("keywords"),
        first("url"),
    )


def listed_links(pages: DataFrame, skip: int = 0, keep: int | None = None) -> DataFrame:
    """(url): resolved links of listing pages, without the first ``skip`` and after at most ``keep``."""
    rows = pages.select(F.col("url").alias("page"), F.posexplode(html.hrefs(F.col("html"))).alias("place", "href"))
    rows = rows.where((F.col("place") >= skip) & (F.col("place") < skip + keep if keep is not None else F.lit(True)))
    return rows.select(html.resolved("page", "href").alias("url"))


def preprint(pages: DataFrame) -> DataFrame:
    """Title, authors joined by '; ', and abstract of preprint pages; rows without a title are left out."""
    chosen = {"title": ("h1", ("class", "title")), "authors": ("meta", ("name", "citation_author"), "content"), "abstract": ("blockquote", ("class", "abstract"))}
    found = pages.select("url", html.selected(F.col("html"), **chosen).alias("found"))
    rows = found.select(
        F.lit("ARXIV").alias("source"),
        F.trim(F.array_join("found.title", "")).alias("title"),
        F.array_join("found.authors", "; ").alias("authors"),
        F.trim(F.replace(F.array_join("found.abstract", ""), F.lit("\n"), F.lit(" "))).alias("abstract"),
        F.lit("").alias("keywords"),
        "url",
    )
    return rows.where(F.length("title") > 0)


def journal_listing(pages: DataFrame) -> DataFrame:
    """(source, title, authors, keywords, abstract_url, url) of the entries of an issue page: the second and third control of each.

    Entries are the list items that have a heading in a ``txt`` block; authors are an array.
    """
    entry = F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1)))
    block = lambda name: F.regexp_extract("entry", rf'(?is)<div[^>]*class="[^"]*\b{name}\b[^"]*"[^>]*>(.*?)</div>', 1)
    rows = pages.select("url", entry.alias("entry")).select("url", block("txt").alias("txt"), block("authors").alias("authors"), block("controls").alias("controls"))
    heading = F.regexp_extract("txt", r"(?is)<h3\b[^>]*>(.*?)</h3>", 1)
    found = rows.select(
        "url",
        F.try_element_at(html.select(heading, "a"), F.lit(1)).alias("title"),
        html.select(F.col("authors"), "a").alias("authors"),
        html.select(F.col("controls"), "a", take="href").alias("links"),
    ).where("title is not null")
    link = lambda i: html.resolved("url", F.try_element_at("links", F.lit(i)))
    return found.select(F.lit("IEEE").alias("source"), "title", "authors", F.lit("").alias("keywords"), link(2).alias("abstract_url"), link(3).alias("url"))


def needs_login(page: DataFrame) -> DataFrame:
    """(url, walled): whether a page asks for a login."""
    return page.select("url", F.contains(html.all_text("html"), F.lit("Authentication Required")).alias("walled"))


def as_papers(found: DataFrame) -> DataFrame:
    """``found`` with its key, in the column order of PAPERS as far as it has them."""
    return found.select(text.document_key(F.col("title")).alias("_id"), *found.columns)
