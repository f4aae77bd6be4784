"""Limits and modes of a scan."""

from __future__ import annotations

from dataclasses import dataclass

LINE_FILTERS = ("as_documented", "as_coded")
CONTEXT_MODES = ("redacted", "raw", "none")
ATTRIBUTIONS = ("introducing", "replacing")


@dataclass(frozen=True)
class ScanOptions:
    """Modes, and limits that are off unless set: by default a scan is complete.

    ``line_filter``   ``as_documented``: ``//`` marks a comment unless it follows a
                      colon, so URL rules work.  ``as_coded``: any ``//`` drops the line.
    ``context``       ``redacted``: every secret in the three lines is masked.
                      ``raw``: the lines as they stand.  ``none``: no context.
    ``binary_prefix_bytes``  a NUL byte among so many first bytes marks a binary
                      file; ``None``: a NUL byte anywhere.
    ``exact_cap``     a finding cut by ``max_findings_per_entry`` may still be
                      reported by a later entry of the same path.
    ``attribution``   ``introducing``: a commit is charged with the files it adds or
                      changes.  ``replacing``: with the files it changes or removes,
                      as they were before.
    """

    line_filter: str = "as_documented"
    context: str = "redacted"
    attribution: str = "introducing"
    max_file_bytes: int | None = None
    max_line_bytes: int | None = None
    binary_prefix_bytes: int | None = None
    max_findings_per_entry: int | None = None
    max_findings: int | None = None
    max_entries: int | None = None
    max_commits_per_ref: int | None = None
    exact_cap: bool = True

    def __post_init__(self) -> None:
        for name, value, allowed in (
            ("line_filter", self.line_filter, LINE_FILTERS),
            ("context", self.context, CONTEXT_MODES),
            ("attribution", self.attribution, ATTRIBUTIONS),
        ):
            if value not in allowed:
                raise ValueError(f"{name}={value!r}, expected one of {allowed}")


# The limits of an interactive service, which answers within minutes.  Fixed values.
SERVICE_LIMITS = ScanOptions(
    max_file_bytes=1 << 20, max_line_bytes=4096, binary_prefix_bytes=512, max_findings_per_entry=50,
    max_findings=1000, max_entries=10_000, max_commits_per_ref=50,
)
