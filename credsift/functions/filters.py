"""Predicates over paths, contents, lines and values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credsift.functions.text import base_name, file_ext
from credsift.options import LINE_FILTERS
from credsift.rules import to_java

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
SKIPPED_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif",
    ".svg", ".ico", ".pdf", ".zip",
    ".tar", ".gz", ".bz2", ".xz",
    ".exe", ".dll", ".so", ".dylib",
    ".woff", ".woff2", ".ttf", ".eot",
    ".mp4", ".mp3", ".avi", ".mov",
    ".bin", ".dat", ".class", ".pyc",
)
SKIPPED_NAMES = (
    "go.sum", "package-lock.json", "yarn.lock", "Gemfile.lock",
    "Pipfile.lock", "poetry.lock", "composer.lock", "pnpm-lock.yaml",
)
PLACEHOLDER_PATTERN = (
    r"(?i)^(?:xxx+|your[_\-]?(?:password|secret|key|token)|changeme|change_me|placeholder|example|sample|test|dummy"
    r"|todo|<[^>]+>|\*{3,}|null|none|N/A|undefined|false|true|0{4,})$"
)
FALSE_POSITIVE_PATTERN = (
    r"(?i)regexp\.MustCompile|regexp\.Compile|re\.compile|Pattern\s*=|PATTERN\s*=|"
    r"//\s*|#\s*example|#\s*sample|test.*key|fake.*key|dummy.*key|"
    r"example\.com|sample\.com|foo\.com|localhost"
)
# ---------------------------------------------------------------------------

# The documented meaning of ``//`` is "comment"; after a colon it belongs to a URL.
LINE_FILTER_PATTERNS = {
    "as_coded": FALSE_POSITIVE_PATTERN,
    "as_documented": FALSE_POSITIVE_PATTERN.replace(r"//\s*", r"(?:^|[^:])//"),
}


def skip_by_name(path: Column) -> Column:
    return base_name(path).isin(*SKIPPED_NAMES)


def skip_by_extension(path: Column) -> Column:
    return file_ext(path).isin(*SKIPPED_EXTENSIONS)


def skip_path(path: Column) -> Column:
    return skip_by_name(path) | skip_by_extension(path)


def within_size(content: Column, max_bytes: int | None = None) -> Column:
    """Larger files are left out whole, never cut."""
    if max_bytes is None:
        return content.isNotNull()
    return F.octet_length(content) <= max_bytes


def is_binary(content: Column, prefix_bytes: int | None = None) -> Column:
    """A NUL byte among the first ``prefix_bytes`` bytes, or anywhere."""
    raw = content.cast("binary")
    return F.contains(raw if prefix_bytes is None else F.substring(raw, 1, prefix_bytes), F.lit(b"\x00"))


def within_line_length(line: Column, max_bytes: int | None = None) -> Column:
    if max_bytes is None:
        return F.lit(True)
    return F.octet_length(line) <= max_bytes


def false_positive_line(line: Column, mode: str = "as_documented") -> Column:
    """The line looks like code that defines patterns, a comment, a test or an example."""
    if mode not in LINE_FILTERS:
        raise ValueError(f"mode={mode!r}, expected one of {LINE_FILTERS}")
    return line.rlike(to_java(LINE_FILTER_PATTERNS[mode]))


def is_placeholder(value: Column) -> Column:
    """The value as a whole is a dummy such as ``changeme`` or ``<token>``."""
    return value.rlike(to_java(PLACEHOLDER_PATTERN))
