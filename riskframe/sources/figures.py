"""Figures from tables that metrics have made already: a curve has as many points as its table rows. The drawing library is imported when a figure is drawn."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

#: Points of a curve that are drawn; a longer curve is thinned evenly.
MOST_POINTS = 5000


def _axes():
    import matplotlib

    matplotlib.use("Agg")
    from matplotlib import pyplot

    return pyplot.subplots()


def _points(df: DataFrame, x: str, *columns: str) -> list:
    """Rows in the order of x, thinned by place if there are too many; the first and the last stay."""
    n = df.count()
    step = max(1, -(-n // MOST_POINTS))
    if step == 1:
        return df.select(x, *columns).orderBy(x).collect()
    return [r for i, r in enumerate(df.select(x, *columns).orderBy(x).toLocalIterator()) if i % step == 0 or i == n - 1]


def save(figure, name: str, folder: str, kind: str = "pdf", dpi: int = 300) -> str:
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{name}.{kind}")
    figure.savefig(path, format=kind, dpi=dpi, bbox_inches="tight")
    return path


def roc_figure(curve: DataFrame, axes=None):
    """From metrics.roc()."""
    figure, ax = axes or _axes()
    rows = _points(curve, "fpr", "tpr")
    ax.plot([0.0, *(r["fpr"] for r in rows)], [0.0, *(r["tpr"] for r in rows)])
    ax.plot([0, 1], [0, 1], linestyle="--")
    ax.set_xlabel("False positive rate")
    ax.set_ylabel("True positive rate")
    return figure


def calibration_figure(curve: DataFrame, by: str | None = None, axes=None):
    """From metrics.calibration_curve() or calibration_interval(): bounds are drawn where there are any."""
    figure, ax = axes or _axes()
    bounds = [c for c in ("low", "high") if c in curve.columns]
    rows = _points(curve, "mean_score", "share_positive", *bounds, *([by] if by else []))
    for name in sorted({r[by] for r in rows}, key=str) if by else [None]:
        own = [r for r in rows if not by or r[by] == name]
        x, y = [r["mean_score"] for r in own], [r["share_positive"] for r in own]
        ax.plot(x, y, marker="o", label=None if name is None else str(name))
        if bounds:
            ax.fill_between(x, [r["low"] for r in own], [r["high"] for r in own], alpha=0.2)
    ax.plot([0, 1], [0, 1], linestyle="--")
    ax.set_xlabel("Mean score")
    ax.set_ylabel("Share of positives")
    return figure


def histogram_figure(bars: DataFrame, bins: int = 20, axes=None):
    """From metrics.histogram(), without groups."""
    figure, ax = axes or _axes()
    rows = _points(bars, "bin", "percent")
    ax.bar([(r["bin"] + 0.5) / bins for r in rows], [r["percent"] for r in rows], width=1 / bins)
    ax.set_xlabel("Score")
    ax.set_ylabel("Percent of rows")
    return figure


def importance_figure(importance: DataFrame, axes=None):
    """From metrics.importance(), the most important feature on top."""
    figure, ax = axes or _axes()
    rows = _points(importance, "imp_mean", "feature", "imp_std")
    ax.barh([r["feature"] for r in rows], [r["imp_mean"] for r in rows], xerr=[r["imp_std"] for r in rows])
    ax.set_xlabel("Loss of AUC")
    return figure
