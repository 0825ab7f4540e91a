"""Text and path expressions: classification, line ranges, stripping, pattern search."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and names by which files are told apart.
CONFIG_TYPE_EXTENSIONS = (".json", ".yaml", ".yml", ".toml", ".cfg", ".ini", ".conf", ".xml")
DOC_TYPE_EXTENSIONS = (".md", ".rst", ".txt", ".wiki")
BINARY_EXTENSIONS = (".exe", ".dll", ".so", ".dylib", ".bin", ".dat")
CONFIG_CHUNK_EXTENSIONS = (".json", ".toml", ".yaml", ".yml", ".ini", ".cfg")
CONFIG_CHUNK_NAMES = ("requirements.txt", "pyproject.toml", "makefile", "dockerfile", ".gitignore")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """From the last dot of the path on, lower-cased; empty without a dot."""
    return F.lower(F.regexp_extract(path, r"(?s)(\.[^.]*)$", 1))


def name_extension(path: Column) -> Column:
    """The extension of the base name, where leading dots don't start one."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)^\.*[^.].*?(\.[^.]*)$", 1))


def file_type(path: Column) -> Column:
    """test, config, doc or source, by base name and extension."""
    name, ext = basename(path), name_extension(path)
    return (
        F.when(name.rlike(r"^(test_|Test)|(_test|Test)\.py$"), "test")
        .when(ext.isin(*CONFIG_TYPE_EXTENSIONS), "config")
        .when(ext.isin(*DOC_TYPE_EXTENSIONS), "doc")
        .otherwise("source")
    )


def is_config_chunked(path: Column, more_names: tuple[str, ...] = ()) -> Column:
    """Whether a file is cut into blocks of lines."""
    name = F.lower(basename(path))
    return extension(path).isin(*CONFIG_CHUNK_EXTENSIONS) | name.isin(*CONFIG_CHUNK_NAMES, *more_names) | (name.startswith("requirements-") & name.endswith(".txt"))


def line_count(text: Column) -> Column:
    """Newlines, and one more if the text doesn't end with one; 0 for the empty text."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)).cast("long")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_range(all_lines: Column, start: Column, end: Column) -> Column:
    """Lines start..end (from 1, both included, clamped) joined by newlines."""
    first = F.greatest(start, F.lit(1))
    last = F.least(end, F.size(all_lines))
    return F.when(last >= first, F.array_join(F.slice(all_lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")).otherwise("")


#: Characters that Python's str.strip() takes off (fixed values).
_BLANK = r"[\t-\r\x1c-\x20\x85\xa0  -     　]+"


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{_BLANK}", ""), f"{_BLANK}\\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{_BLANK[1:-2]}]")


def posix(path: Column) -> Column:
    return F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def like(text: Column, pattern: str) -> Column:
    """LIKE with live % and _, where A-Z match a-z and a backslash is an ordinary character."""
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in pattern)
    return ascii_lower(text).like(folded.replace("\\", "\\\\"))


def contains(text: Column, part: str) -> Column:
    """Substring search where A-Z match a-z and no character is special."""
    return F.contains(ascii_lower(text), F.lit("".join(c.lower() if "A" <= c <= "Z" else c for c in part)))


def glob_body(pattern: str) -> str:
    """A shell pattern as a regular expression; * and ? also match /."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if end > 0:
            inside = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out.append(f"[^{inside[1:]}]" if inside.startswith("!") else f"[\\{inside}]" if inside.startswith("^") else f"[{inside}]")
            i = end
        else:
            out.append({"*": r"[\s\S]*", "?": r"[\s\S]"}.get(c) or re.sub(r"([.^$+{}()|\[\]\\])", r"\\\1", c))
        i += 1
    return "".join(out)


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression over the whole string."""
    return f"^{glob_body(pattern)}\\z"
