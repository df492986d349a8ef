"""The charts of a report as matplotlib figures, where matplotlib is installed."""

from __future__ import annotations

from accordant.errors import BackendUnavailableError


def _axes(title: str):
    try:
        import matplotlib.pyplot as plt
    except ImportError as e:
        raise BackendUnavailableError("plots need matplotlib") from e
    figure, axes = plt.subplots()
    axes.set_title(title)
    return figure, axes


def _barh(rows, title: str):
    figure, axes = _axes(title)
    axes.barh([str(n) for n, _ in rows][::-1], [v for _, v in rows][::-1])
    return figure


def status(document: dict):
    s = document["summary"]
    return _barh([(k, s[k]) for k in ("matched_records", "value_mismatch_records", "missing_left", "missing_right")], "records by status")


def columns(document: dict):
    return _barh([(c["column"], c["mismatches"]) for c in document["columns"].values()], "differing values by column")


def concentration(document: dict, dimension: str):
    return _barh([(r["level"], r["rate"]) for r in document["analyses"]["concentration"][dimension]["levels"]], f"problem rate by {dimension}")


def distribution(document: dict, column: str):
    d = document["analyses"]["distributions"][column]
    rows = [(r["level"], r["right_share"] - r["left_share"]) for r in d["levels"]] if d["kind"] == "categorical" else list(zip(("p05", "p25", "p50", "p75", "p95"), (b - a for a, b in zip(d["left"]["percentiles"], d["right"]["percentiles"]))))
    return _barh(rows, f"right less left: {column}")


def timeline(document: dict):
    figure, axes = _axes("problem rate by period")
    rows = document["analyses"]["temporal"]["periods"]
    axes.plot([r["period"] for r in rows], [r["rate"] for r in rows])
    return figure


def differences(histogram, column: str):
    """From the rows of ``records.difference_histogram``."""
    figure, axes = _axes(f"differences of {column}")
    rows = histogram.collect()
    axes.bar([r["low"] for r in rows], [r["count"] for r in rows], width=[r["high"] - r["low"] for r in rows], align="edge")
    return figure
