"""Diagnosis code sets and prefix matching."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col


@dataclass(frozen=True)
class Codebook:
    """Prefixes per code version."""

    v9: tuple[str, ...]
    v10: tuple[str, ...]

    def override(self, v9: Sequence[str] | None = None, v10: Sequence[str] | None = None) -> "Codebook":
        """Replace either list; an empty or absent one keeps the present prefixes."""
        return Codebook(
            tuple(plain_code(p) for p in v9) if v9 else self.v9,
            tuple(plain_code(p) for p in v10) if v10 else self.v10,
        )


# Full-range code sets.
DIABETES = Codebook(
    v9=("249", "250"),
    v10=("E08", "E09", "E10", "E11", "E13"),
)
CARDIOVASCULAR = Codebook(
    v9=("410", "411", "412", "413", "414", "428", "433", "434", "435", "436", "437", "438", "440"),
    v10=("I20", "I21", "I22", "I23", "I24", "I25", "I50",
         "I60", "I61", "I62", "I63", "I64", "I65", "I66", "I67", "I68", "I69", "I70"),
)
FULL_CODEBOOKS = {"diab": DIABETES, "cvd": CARDIOVASCULAR}

# Narrow code sets used by the single-horizon labels and the compact matrix.
DIABETES_NARROW = Codebook(
    v9=("250",),
    v10=("E10", "E11", "E13", "E14"),
)
CARDIOVASCULAR_NARROW = Codebook(
    v9=("410", "411", "412", "413", "414", "428", "433", "434", "436"),
    v10=("I20", "I21", "I22", "I23", "I24", "I25", "I50", "I63", "I64"),
)
NARROW_CODEBOOKS = {"diab": DIABETES_NARROW, "cvd": CARDIOVASCULAR_NARROW}


def plain_code(text: str) -> str:
    return "".join(ch for ch in text.upper() if ch.isalnum())


def normalise_code(c) -> Column:
    """Upper case, letters and digits only."""
    return F.upper(F.regexp_replace(col(c), r"[^\p{L}\p{N}]", ""))


def _starts_with_any(code: Column, prefixes: Sequence[str]) -> Column:
    """Prefixes of one length become one set lookup on a substring."""
    hit = F.lit(False)
    for n in sorted({len(p) for p in prefixes}):
        hit = hit | F.substring(code, 1, n).isin([p for p in prefixes if len(p) == n])
    return hit


def in_codebook(code, version, book: Codebook, normalise: bool = True) -> Column:
    """True when the code carries a prefix listed for its own version.

    The narrow sets compare the upper-cased code without stripping punctuation (normalise=False).
    """
    code = normalise_code(code) if normalise else F.upper(col(code))
    version = col(version).try_cast("int")
    hit = ((version == 9) & _starts_with_any(code, book.v9)) | ((version == 10) & _starts_with_any(code, book.v10))
    return F.coalesce(hit, F.lit(False))
