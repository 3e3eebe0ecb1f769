"""What a reader sees: numbers that may be missing, narratives, headlines, warnings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "—"


def percent(x: Column, digits: int = 0) -> Column:
    return F.when(x.isNull(), MISSING).otherwise(F.format_string(f"%.{digits}f%%", x.cast("double") * 100))


def shown(x: Column, digits: int = 2, suffix: str = "") -> Column:
    return F.when(x.isNull(), MISSING).otherwise(F.format_string(f"%.{digits}f{suffix}", x.cast("double")))


def iso(moment: Column) -> Column:
    """A timestamp as ISO text in UTC, to the second."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def narrative(captured: Column, n: Column, radius_km: float, cpa_km: Column, cpa_time: Column, factor: Column, codes: Column) -> Column:
    """Why a vessel stands where it does: its place among the drift hypotheses, its closest approach, its behaviour."""
    placed = F.when(captured > 0, F.format_string(f"Within {radius_km:.0f} km of the release in %d of %d hypotheses (%.1f%%).", captured, n, captured * 100.0 / n)).otherwise(
        F.format_string(f"Never within {radius_km:.0f} km of any of the %d release hypotheses.", n)
    )
    nearest = F.when(cpa_km.isNotNull(), F.format_string("Closest approach %.2f km at %s.", cpa_km, iso(cpa_time)))
    conduct = F.when(F.size(codes) > 0, F.format_string("Behaviour raises the odds by %.2f: %s.", factor, F.array_join(codes, ", "))).otherwise("No anomalies on this track.")
    return F.concat_ws(" ", placed, nearest, conduct)


def headline(name: Column, mmsi: Column, posterior: Column, unknown: Column, verdict: Column) -> Column:
    """A case in a sentence; an unknown source wins ties."""
    nobody = F.format_string("No reporting vessel stands out: %.0f%% goes to a source that sent no reports.", unknown * 100)
    someone = F.format_string("Released most likely by %s, MMSI %s (%s evidence): %.0f%%, against %.0f%% for a source that sent no reports.", F.coalesce(name, F.lit("a vessel without a name")), mmsi.cast("string"), verdict, posterior * 100, unknown * 100)
    return F.when(posterior.isNull() | (unknown >= posterior), nobody).otherwise(someone)


def material(flags: Column, least: float = 0.5) -> Column:
    """Flags (code, severity) worth a line in a report, the worst first."""
    worst = F.array_sort(F.transform(F.filter(flags, lambda f: f["severity"] >= least), lambda f: F.struct((-f["severity"]).alias("by"), f["code"].alias("code"))))
    return F.transform(worst, lambda f: f["code"])
