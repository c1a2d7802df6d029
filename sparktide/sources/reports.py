"""Figures (SVG) and text reports of results. What reaches the driver is bounded: thinned curves, counts, and one row for each split and subject."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktide.operators import metrics, splits

#: Steps of an axis by which the points of a curve are thinned; each keeps its least and its greatest point.
STEPS = 400
#: Subjects that a report lists, the highest rates first.
LISTED = 50
_SIZE, _EDGE = 480, 56


def thinned(points: DataFrame, x: str, y: str, steps: int = STEPS) -> list[tuple[float, float]]:
    """At most two points for each step of x in [0, 1], by x and y: the least and the greatest y there."""
    at = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.floor(F.col(x) * steps).alias("step"))
    ends = at.agg(F.min(F.struct(y, x)).alias("low"), F.max(F.struct(y, x)).alias("high")).collect()
    return sorted({(float(p[x]), float(p[y])) for r in ends for p in (r.low, r.high)})


def _canvas(title: str, x_title: str, y_title: str, body: list[str]) -> str:
    whole = _SIZE + 2 * _EDGE
    frame = f'<rect x="{_EDGE}" y="{_EDGE}" width="{_SIZE}" height="{_SIZE}" fill="none" stroke="#888"/>'
    ticks = []
    for k in range(0, 11, 2):
        at = _EDGE + _SIZE * k / 10
        ticks += [f'<text x="{at:.1f}" y="{_EDGE + _SIZE + 18}" text-anchor="middle">{k / 10}</text>', f'<text x="{_EDGE - 8}" y="{_EDGE + _SIZE - _SIZE * k / 10 + 4:.1f}" text-anchor="end">{k / 10}</text>']
    names = [
        f'<text x="{whole / 2}" y="24" text-anchor="middle" font-size="16">{escape(title)}</text>', f'<text x="{whole / 2}" y="{whole - 12}" text-anchor="middle">{escape(x_title)}</text>',
        f'<text x="16" y="{whole / 2}" text-anchor="middle" transform="rotate(-90 16 {whole / 2})">{escape(y_title)}</text>',
    ]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{whole}" height="{whole}" font-family="sans-serif" font-size="12">{"".join([frame, *ticks, *names, *body])}</svg>'


def _line(points: list[tuple[float, float]], style: str) -> str:
    at = " ".join(f"{_EDGE + _SIZE * x:.2f},{_EDGE + _SIZE * (1 - y):.2f}" for x, y in points)
    return f'<polyline points="{at}" fill="none" {style}/>'


def _label(text: str, k: int) -> str:
    return f'<text x="{_EDGE + _SIZE - 8}" y="{_EDGE + _SIZE - 12 - 18 * k}" text-anchor="end">{escape(text)}</text>'


_SOLID, _DASHED = 'stroke="#1f5fa8" stroke-width="2"', 'stroke="#777" stroke-dasharray="6 4"'


def roc_figure(scored: DataFrame, y: str = "y", score: str = "proba") -> str:
    """The curve of true over false positive rates, with its area and the diagonal."""
    points = metrics.curve(scored, y, score).persist()
    line = [(0.0, 0.0), *thinned(metrics.roc_points(points), "fpr", "tpr"), (1.0, 1.0)]
    auc = metrics.ranking(points).first().roc_auc
    points.unpersist()
    area = "undefined" if auc is None else f"{auc:.3f}"
    return _canvas("ROC curve", "false positive rate", "true positive rate", [_line([(0, 0), (1, 1)], _DASHED), _line(sorted(set(line)), _SOLID), _label(f"area {area}", 0)])


def precision_recall_figure(scored: DataFrame, y: str = "y", score: str = "proba") -> str:
    """The curve of precision over recall, with its area by trapezoids and the share of positive rows."""
    points = metrics.curve(scored, y, score).persist()
    pr = metrics.precision_recall_points(points)
    line = [(0.0, 1.0), *thinned(pr, "recall", "precision")]
    area, share = metrics.trapezoid(points).first().pr_area, pr.agg(F.max("prevalence")).first()[0]
    points.unpersist()
    base = [] if share is None else [_line([(0, share), (1, share)], _DASHED), _label(f"positive rows {share:.3f}", 1)]
    return _canvas("Precision and recall", "recall", "precision", [*base, _line(line, _SOLID), _label("area undefined" if area is None else f"area {area:.3f}", 0)])


def confusion_figure(scored: DataFrame, y: str = "y", pred: str = "pred") -> str:
    """The four counts, shaded by their share of the rows of their class."""
    c = metrics.confusion(scored, y, pred).first()
    cells = [(0, 0, c.tn, c.tn + c.fp), (0, 1, c.fp, c.tn + c.fp), (1, 0, c.fn, c.fn + c.tp), (1, 1, c.tp, c.fn + c.tp)]
    half, body = _SIZE / 2, []
    for row, column, n, of in cells:
        x, at = _EDGE + half * column, _EDGE + half * row
        body.append(f'<rect x="{x}" y="{at}" width="{half}" height="{half}" fill="#1f5fa8" fill-opacity="{n / of if of else 0:.3f}" stroke="#888"/>')
        body.append(f'<text x="{x + half / 2}" y="{at + half / 2}" text-anchor="middle" font-size="20">{n}</text>')
    whole = _SIZE + 2 * _EDGE
    names = "".join(f'<text x="{_EDGE + half * (k + 0.5)}" y="{_EDGE + _SIZE + 18}" text-anchor="middle">predicted {k}</text><text x="{_EDGE - 8}" y="{_EDGE + half * (k + 0.5)}" text-anchor="end">true {k}</text>' for k in (0, 1))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{whole}" height="{whole}" font-family="sans-serif" font-size="12"><text x="{whole / 2}" y="24" text-anchor="middle" font-size="16">Confusion matrix</text>{"".join(body)}{names}</svg>'


def evaluation_report(levels: DataFrame) -> str:
    """The rows of pipeline.evaluate() as text."""
    out = ["Evaluation"]
    for r in sorted(levels.collect(), key=lambda r: r.level):
        out += ["", r.level, f"  rows {r.tp + r.fp + r.fn + r.tn}: true positive {r.tp}, false positive {r.fp}, false negative {r.fn}, true negative {r.tn}"]
        for name in ("accuracy", "sensitivity", "specificity", "precision_1", "recall_1", "f1_1", "precision_0", "recall_0", "f1_0", "roc_auc", "average_precision"):
            value = r[name]
            out.append(f"  {name:<18} {'undefined' if value is None else f'{value:.4f}'}")
    return "\n".join(out) + "\n"


def split_report(windows: DataFrame, listed: int = LISTED) -> str:
    """Sizes, classes and rates of the splits of windows(subject, y, split), the subjects of the highest rates, and any subject that stands in both."""
    rates = splits.subject_rates(windows, "subject", "y").join(windows.groupBy("subject").agg(F.min("split").alias("split"), F.count_distinct("split").alias("sides")), "subject").persist()
    sizes = windows.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("positive"), F.count_distinct("subject").alias("subjects")).orderBy("split").collect()
    means = {r.split: r.mean for r in rates.groupBy("split").agg(F.avg("rate").alias("mean")).collect()}
    out = ["Splits"]
    for r in sizes:
        negative = r.n - r.positive
        out.append(f"  {r.split}: {r.n} windows of {r.subjects} subjects, {r.positive} positive ({100 * r.positive / r.n:.2f} %), {negative} negative, {'no' if not r.positive else f'{negative / r.positive:.2f}'} negative ones for each positive, mean rate of a subject {means.get(r.split, 0.0):.4f}")
    both = rates.where("sides > 1").count()
    out += [f"  subjects on both sides: {both}", "", f"Subjects of the highest rates (at most {listed})"]
    out += [f"  {r.subject} ({r.split}): {r.n_positive} of {r.n_windows}, {r.rate:.4f}" for r in rates.orderBy(F.desc("rate"), "subject").limit(listed).collect()]
    rates.unpersist()
    return "\n".join(out) + "\n"
