"""Link templates of repositories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import percent_encoded

LINKS = "array<struct<name:string,urlTemplate:string>>"


def parse_links(text: Column) -> Column:
    """Links from JSON; anything else is an empty list."""
    return F.coalesce(F.from_json(text, LINKS), F.array().cast(LINKS))


def resolve_link(template: Column, org: Column, repo_name: Column, branch: Column, version: Column, path: Column, line: Column | None = None) -> Column:
    """Fills {org} {repoName} {branch} {version} {path} {line}; a path is encoded by component, no line is empty."""
    encoded_path = F.array_join(F.transform(F.split(path, "/", -1), lambda part: percent_encoded(part)), "/")
    number = F.lit("") if line is None else F.coalesce(line.cast("string"), F.lit(""))
    for token, value in (("org", percent_encoded(org)), ("repoName", percent_encoded(repo_name)), ("branch", percent_encoded(branch)), ("version", percent_encoded(version)), ("path", encoded_path), ("line", number)):
        template = F.replace(template, F.lit(f"{{{token}}}"), value)
    return template


def resolve_links(links: Column, **tokens: Column) -> Column:
    return F.transform(links, lambda x: F.struct(x["name"].alias("name"), resolve_link(x["urlTemplate"], **tokens).alias("url")))
