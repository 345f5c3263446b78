"""Patterns of a linear-time dialect (no look-around, no backreferences) as Java patterns."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: POSIX classes, which are ASCII only.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~",
    "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\x0C\r ", "upper": "A-Z", "word": "A-Za-z0-9_", "xdigit": "0-9A-Fa-f",
}
_ESCAPES = set("pPdDsSwWbBAzntrfvaxuU")


def translate(pattern: str) -> str | None:
    """The Java pattern, or None where the dialect has no such pattern."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern):
                return None
            d = pattern[i + 1]
            if d.isalnum() and d not in _ESCAPES:
                return None
            if d == "a":
                out.append(r"\x07")
            elif d == "v":
                out.append(r"\x0B")
            elif d in "xuU" and (m := re.match(r"\\[xuU]\{([0-9A-Fa-f]+)\}", pattern[i:])):
                out.append(f"\\x{{{m[1]}}}")
                i += m.end() - 2
            else:
                out.append(c + d)
            i += 2
            continue
        if depth:
            if m := re.match(r"\[:(\^?)(\w+):\]", pattern[i:]):
                if m[2] not in POSIX:
                    return None
                out.append(f"[{'^' * bool(m[1])}{POSIX[m[2]]}]")
                i += m.end()
                continue
            depth += (c == "[") - (c == "]")
        elif c == "[":
            depth = 1
            if m := re.match(r"\[(\^?)\]", pattern[i:]):  # a first ] is literal
                out.append(f"[{m[1]}\\]")
                i += m.end()
                continue
        elif c == "(" and pattern[i + 1 : i + 2] == "?":
            if m := re.match(r"\(\?P?<[A-Za-z_][\w.\[\]]*>", pattern[i:]):
                out.append("(")
                i += m.end()
                continue
            m = re.match(r"\(\?([imsUux-]*)([:)])", pattern[i:])
            if not m:
                return None
            if "U" in m[1]:  # swaps greediness there, has another meaning in Java
                return None
            out.append(f"(?{m[1]}{m[2]}")
            i += m.end()
            continue
        elif c in "*+?}" and pattern[i + 1 : i + 2] == "+":
            return None  # possessive in Java
        out.append(c)
        i += 1
    return "".join(out)


def java_pattern(spark: SparkSession, pattern: str, insensitive: bool) -> str | None:
    """With flags in front: . matches all but \\n, $ only the end, classes are Unicode. None: invalid."""
    body = translate(pattern)
    if body is None:
        return None
    full = f"(?dsU{'iu' * insensitive}){body}"
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(full)
    except Exception:
        return None
    return full
