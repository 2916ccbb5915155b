"""Text normalisation columns: comments, directives, compiler extensions, types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims

# The patterns below must equal those whose results we match.
TS_ANNOTATIONS = [
    r":\s*[A-Z][a-zA-Z0-9<>|\[\]]*(\s*=|;|\)|,|\{)",
    r":\s*string(\s*=|;|\)|,|\{)",
    r":\s*number(\s*=|;|\)|,|\{)",
    r":\s*boolean(\s*=|;|\)|,|\{)",
    r":\s*any(\s*=|;|\)|,|\{)",
    r":\s*void(\s*=|;|\)|,|\{)",
]
TS_DECLARATIONS = [
    r"interface\s+\w+\s*\{[^}]*\}",
    r"type\s+\w+\s*=\s*[^;]+;",
    r"<[^>]*>",
    r"export\s+type\s+[^;]+;",
]
FD_MACROS = [
    ("FD_SET(", r"FD_SET\s*\([^)]*\)\s*;?", ";"),
    ("FD_CLR(", r"FD_CLR\s*\([^)]*\)\s*;?", ";"),
    ("FD_ISSET(", r"FD_ISSET\s*\([^)]*\)", "1"),
    ("FD_ZERO(", r"FD_ZERO\s*\([^)]*\)\s*;?", ";"),
]
# Fixed value: what a compile wrapper puts on the first line.
MARKER = "[ccwrap]"


def drop_marker_line(text: Column, marker: str = MARKER) -> Column:
    """Without the first line if a wrapper wrote its own message there."""
    return F.when(
        F.substring_index(text, "\n", 1).contains(marker),
        F.regexp_replace(text, r"^[^\n]*\n?", ""),
    ).otherwise(text)


def strip_c_comments(text: Column) -> Column:
    """Without comments of either sort and without the lines left blank."""
    bare = F.regexp_replace(text, r"/\*(?s:.*?)\*/|//[^\n]*+", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?m)^[ \t]*\n", ""), r"\n[ \t]*$", "")


def drop_c_directives(text: Column) -> Column:
    names = "|".join(dims.C_DIRECTIVES)
    return F.regexp_replace(text, rf"(?m)^[ \t]*#(?:{names})[^\n]*\n?", "")


def strip_gcc_attributes(text: Column) -> Column:
    """Without compiler extensions a plain C reader does not know."""
    words = "|".join(dims.GCC_WORDS)
    calls = "|".join(dims.GCC_CALLS)
    out = F.regexp_replace(text, r"__attribute__\s*\(\([^)]*\)\)", "")
    out = F.regexp_replace(out, rf"__(?:{calls})__?\s*\([^)]*\)", "")
    out = F.regexp_replace(out, rf"__(?:{words})__?\s*", "")
    return F.regexp_replace(out, r"\brestrict\b\s*", "")


def stub_fd_macros(text: Column) -> Column:
    out = F.regexp_replace(text, r"\bfd_set\b", "int")
    for literal, pattern, stub in FD_MACROS:
        out = F.when(out.contains(literal), F.regexp_replace(out, pattern, stub)).otherwise(out)
    return out


def canonical_whitespace(text: Column) -> Column:
    """Single blanks, with a line break after each ``;``, ``{`` and ``}``."""
    out = F.regexp_replace(text, r"\s+", " ")
    out = F.regexp_replace(out, r"\s*;\s*", ";\n")
    out = F.regexp_replace(out, r"\s*\{\s*", " {\n")
    return F.regexp_replace(out, r"\s*\}\s*", "\n}\n")


def strip_ts_types(text: Column) -> Column:
    """TypeScript reduced to plain script: annotations first, then declarations."""
    out = text
    for pattern in TS_ANNOTATIONS:
        out = F.regexp_replace(out, pattern, "$1")
    for pattern in TS_DECLARATIONS:
        out = F.regexp_replace(out, pattern, "")
    return out


def canonical_code(lang: Column, text: Column) -> Column:
    """Comment-free canonical text of one file, for hashing and rule scans."""
    c = canonical_whitespace(
        stub_fd_macros(strip_gcc_attributes(drop_c_directives(strip_c_comments(text))))
    )
    return F.when(lang == "c", c).when(lang == "javascript", strip_ts_types(text)).otherwise(text)
