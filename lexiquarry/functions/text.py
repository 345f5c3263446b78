"""Column builders for text: lines, byte columns, extensions, ASCII lower case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ASCII letters.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def py_ascii_lower(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def lines(text: Column) -> Column:
    """Lines end at \\n or \\r\\n; an empty last line is dropped, a lone last \\r stays."""
    parts = F.split(text, r"\r?\n", -1)
    return F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def extension(path: Column) -> Column:
    """After the last dot of the last path component; null without one (`.name`, `..` and `name` have none)."""
    name = F.regexp_extract(F.regexp_replace(path, r"(?:/+\.?)*$", ""), r"([^/]*)$", 1)
    at = F.char_length(name) - F.instr(F.reverse(name), ".") + 1  # 1-based place of the last dot
    return F.when((F.instr(name, ".") > 0) & (at > 1) & (name != ".."), F.substring(name, at + 1, F.char_length(name)))


def literal_byte_column(line: Column, query: str, insensitive: bool) -> Column:
    """1-based byte offset of the first hit, in the lower-cased line if case is ignored; 0 without a hit."""
    text, wanted = (F.lower(line), F.lower(F.lit(query))) if insensitive else (line, F.lit(query))
    at = F.instr(text, wanted) if not insensitive else F.call_function("position", wanted, text)
    return F.when(at > 0, F.octet_length(F.substring(text, F.lit(1), at - 1)) + 1).otherwise(0).cast("long")


def regex_byte_column(line: Column, pattern: str) -> Column:
    """1-based byte offset of the leftmost match of a line that matches."""
    flags, body = pattern[: pattern.index(")") + 1], pattern[pattern.index(")") + 1 :]
    return (F.octet_length(F.regexp_extract(line, f"{flags}^(.*?)(?:{body})", 1)) + 1).cast("long")


def percent_encoded(text: Column, keep: str = "!'()*~") -> Column:
    """Percent-encoding that leaves letters, digits, - _ . and the characters of `keep` as they are."""
    out = F.regexp_replace(F.url_encode(text), r"\+", "%20")
    for c in "!'()*~":
        code = f"%{ord(c):02X}"
        out = F.replace(out, F.lit(code), F.lit(c)) if c in keep else F.replace(out, F.lit(c), F.lit(code))
    return out


def escape_html(text: Column) -> Column:
    for c, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(c), F.lit(to))
    return text


def display_name(path: Column) -> Column:
    """The last component (\\ counts as /), its extension in lower case."""
    name = F.substring_index(F.replace(F.regexp_replace(F.trim(path), "^/+", ""), F.lit("\\"), F.lit("/")), "/", -1)
    dot = F.char_length(name) - F.instr(F.reverse(name), ".") + 1
    return F.when((F.instr(name, ".") > 0) & (dot > 1), F.concat(F.substring(name, F.lit(1), dot), F.lower(F.substring(name, dot + 1, F.char_length(name))))).otherwise(name)


def language(name: Column) -> Column:
    """The extension names the language; yml is yaml, none is text."""
    ext = F.lower(extension(name))
    return F.when(ext.isNull() | (ext == ""), "text").when(ext == "yml", "yaml").otherwise(ext)


def csv_set(text: Column) -> Column:
    return F.filter(F.split(text, ",", -1), lambda x: x != "")
