"""Text expressions: line-based fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python's str.splitlines and str.strip treat as line ends and as white space.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
WHITE_SPACE = (
    r"[\t\n\x0B\x0C\r\x1C\x1D\x1E\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def fingerprint(column: Column) -> Column:
    """SHA-256 of the text without blank lines, ``#`` lines and trailing white space."""
    lines = F.split(column, LINE_END)
    kept = F.filter(lines, lambda line: ~line.rlike(f"^{WHITE_SPACE}*(#|$)"))
    trimmed = F.transform(kept, lambda line: F.regexp_replace(line, f"{WHITE_SPACE}+$", ""))
    return F.sha2(F.array_join(trimmed, "\n"), 256)
