"""The line scan: matches of a request, its pages and its facets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import GlobFilter
from ..functions.regexes import java_pattern
from ..functions.text import ascii_lower, extension, lines, literal_byte_column, py_ascii_lower, regex_byte_column
from ..plans.requests import RESULT_NAMES, SearchRequest
from .trigram import candidates, query_trigrams

RESULT = "repo_id string, repo_name string, path string, line long, column long, snippet string, context_before array<string>, context_after array<string>, score double, blob_sha string, org string, branch string"
CONTEXT = 2


def _among(value: Column, wanted: list[str] | None) -> Column | None:
    """Membership that ignores ASCII case; None: no condition."""
    if wanted is None:
        return None
    return ascii_lower(value).isin([py_ascii_lower(w) for w in wanted]) if wanted else F.lit(False)


def repository_condition(request: SearchRequest) -> list[Column]:
    f = request.filters
    found = [_among(F.col("repo_id"), request.allowed_repo_ids), _among(F.col("repo_id"), f.repo_ids), _among(F.col("org"), f.orgs), _among(F.col("branch"), f.branches)]
    return [c for c in found if c is not None]


def path_condition(request: SearchRequest) -> list[Column]:
    f, path = request.filters, F.col("path")
    found = [None if f.path_prefix is None else F.startswith(path, F.lit(f.path_prefix)), None if f.globs is None else GlobFilter(f.globs).condition(path)]
    if f.file_types is not None:
        found.append(F.coalesce(_among(extension(path), [t.lstrip(".") for t in f.file_types]), F.lit(False)))
    return [c for c in found if c is not None]


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RESULT)


def hit_lines(all_lines: Column, hit: Callable[[Column], Column]) -> Column:
    """Numbers, from 0, of the lines that hit."""
    return F.filter(F.transform(all_lines, lambda x, at: F.when(hit(x), at)), lambda at: at.isNotNull())


def matches(files: DataFrame, request: SearchRequest, postings: DataFrame | None = None) -> DataFrame:
    """Every line of files (repo_id, repo_name, version, org, branch, path, content) that the query hits, once.

    Conditions on repositories and paths come before any content is decoded. A literal query of three bytes
    or more goes through `postings` (which need doc_id in files) if given, else through a test of the whole
    content; both only leave out files without a hit. Content that isn't UTF-8 is skipped. A blank query and
    an invalid pattern match nothing; an invalid glob raises ValueError."""
    spark, query, ignore = files.sparkSession, request.query, request.case_insensitive
    conditions = [*repository_condition(request), *path_condition(request)]
    pattern = java_pattern(spark, query, ignore) if request.regex else None
    if request.blank or (request.regex and pattern is None):
        return _empty(spark)
    for condition in conditions:
        files = files.filter(condition)
    kind = dict(files.dtypes)["content"]
    if kind == "binary":
        files = files.filter(F.is_valid_utf8(F.col("content").cast("string"))).withColumn("content", F.col("content").cast("string"))
    if not request.regex:
        if postings is not None and query_trigrams(query) is not None:
            files = files.join(candidates(postings, query), ["repo_id", "doc_id"], "left_semi")
        files = files.filter(F.contains(F.lower("content"), F.lower(F.lit(query))) if ignore else F.contains("content", F.lit(query)))
    line = F.col("snippet")
    hit_of = lambda x: x.rlike(pattern) if request.regex else F.contains(F.lower(x), F.lower(F.lit(query))) if ignore else F.contains(x, F.lit(query))
    column = regex_byte_column(line, pattern) if request.regex else literal_byte_column(line, query, ignore)
    # lines are tested inside the array, and only hits, with their neighbours, become rows
    found = files.withColumn("all", lines(F.col("content"))).withColumn("hits", hit_lines(F.col("all"), hit_of))
    around = lambda at: F.struct(
        at.alias("at"), F.get("all", at).alias("snippet"), F.slice("all", F.greatest(at - CONTEXT + 1, F.lit(1)), F.least(at, F.lit(CONTEXT))).alias("context_before"), F.slice("all", at + 2, F.lit(CONTEXT)).alias("context_after")
    )
    scanned = found.select("repo_id", "repo_name", "path", "version", "org", "branch", F.explode(F.transform("hits", around)).alias("hit")).select("*", "hit.*")
    return scanned.select(
        "repo_id", "repo_name", "path", (F.col("at") + 1).cast("long").alias("line"), column.alias("column"), "snippet", "context_before", "context_after",
        F.when(F.contains(F.lower("path"), F.lower(F.lit(query))), 0.8).otherwise(0.5).alias("score"), F.col("version").alias("blob_sha"), "org", "branch",
    )


ORDER = [F.desc, "score"], [F.asc, "repo_id"], [F.asc, "path"], [F.asc, "line"]


def page(found: DataFrame, request: SearchRequest) -> DataFrame:
    """Results from the cursor on, in the order score (falling), repository, path, line."""
    return found.orderBy(*(f(c) for f, c in ORDER)).offset(request.offset).limit(request.page_size)


def facets(found: DataFrame) -> DataFrame:
    """(type, name, count) of all matching lines by repository, file type, org and branch, in one pass."""
    ext = extension(F.col("path"))
    kinds = {"repo": F.col("repo_id"), "file_type": F.concat(F.lit("."), ext), "org": F.nullif(F.col("org"), F.lit("")), "branch": F.nullif(F.col("branch"), F.lit(""))}
    pairs = F.array(*(F.struct(F.lit(k).alias("type"), v.alias("name")) for k, v in kinds.items()))
    counted = found.select(F.explode(pairs).alias("f")).filter("f.name is not null").groupBy(F.col("f.type").alias("type"), F.col("f.name").alias("name")).agg(F.count("*").alias("count"))
    return counted.orderBy("type", F.desc("count"), "name")


@dataclass
class SearchResponse:
    results: list[dict]
    next_cursor: str | None
    facets: list[dict]

    def to_json(self) -> dict:
        named = [{RESULT_NAMES[k]: v for k, v in r.items()} for r in self.results]
        return {"results": named, "nextCursor": self.next_cursor, "facets": [{"name": f["name"], "type": f["type"], "count": f["count"]} for f in self.facets]}


def search(files: DataFrame, request: SearchRequest, postings: DataFrame | None = None) -> SearchResponse:
    """A page of results, the cursor of the next one if more remain, and all facets. One result over the page is fetched.

    The page and the facets each scan the files: a common query's matches are most of the corpus, too much to be kept."""
    found = matches(files, request, postings)
    rows = [r.asDict() for r in found.orderBy(*(f(c) for f, c in ORDER)).offset(request.offset).limit(request.page_size + 1).collect()]
    more = len(rows) > request.page_size
    return SearchResponse(rows[: request.page_size], str(request.offset + request.page_size) if more else None, [r.asDict() for r in facets(found).collect()])
