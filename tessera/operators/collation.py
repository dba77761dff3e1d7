"""Collations: comparison keys by strength and, where asked for, by the value of runs of digits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Collation:
    """Strength 1 ignores accents and case, 2 ignores case, 3 and above compare exactly."""

    locale: str = "simple"
    strength: int = 3
    numeric_ordering: bool = False
    case_level: bool = False

    @classmethod
    def of(cls, spec: dict | None) -> Collation | None:
        if not spec or spec.get("locale") == "simple":
            return None
        # The options of a collation.
        known = {"locale", "caseLevel", "caseFirst", "strength", "numericOrdering", "alternate", "maxVariable", "backwards"}
        if unknown := set(spec) - known:
            raise ValueError(f"unknown collation options: {sorted(unknown)}")
        return cls(spec["locale"], spec.get("strength", 3), spec.get("numericOrdering", False), spec.get("caseLevel", False))

    @property
    def name(self) -> str:
        weak = "" if self.strength >= 3 else "_CI" if self.strength == 2 or not self.case_level else ""
        plain = "_AI" if self.strength == 1 else ""
        return f"UNICODE{weak}{plain}" if self.locale in ("", "root") else f"{self.locale}{weak}{plain}"

    def key(self, column: Column) -> Column:
        """A column that compares and groups as the collation asks."""
        if self.numeric_ordering:  # runs of digits become as wide as any, so that text order is their order
            parts = F.regexp_extract_all(column, F.lit(r"(\d+|\D+)"), 1)
            column = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, r"^0+(?=\d)", ""), 40, "0")).otherwise(p)), "")
        return F.collate(column, self.name)
