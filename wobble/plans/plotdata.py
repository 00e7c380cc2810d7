"""Tables that plots are drawn from, and plain SVG."""

from __future__ import annotations

import colorsys
import html

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wobble.errors import WobbleError
from wobble.functions import linalg
from wobble.operators.compare import Compared


def distinct_colours(n: int) -> list[str]:
    """n colours of evenly spread hue."""
    return ["#%02x%02x%02x" % tuple(round(255 * v) for v in colorsys.hsv_to_rgb(i / max(n, 1), 0.75, 0.85)) for i in range(n)]


def red_green(value: float) -> str:
    """Red at 0 over yellow to green at 1."""
    return "#%02x%02x%02x" % tuple(round(255 * v) for v in colorsys.hsv_to_rgb(min(max(value, 0), 1) / 3, 0.8, 0.85))


def check_dimensions(k: int, x: int, y: int) -> None:
    if x == y:
        raise WobbleError("The plot's dimensions must differ.")
    if max(x, y) >= k:
        raise WobbleError(f"The embedding has {k} dimensions; {max(x, y)} can't be plotted.")


def _xy(e: DataFrame, x: int, y: int) -> list:
    return [F.get("coords", F.lit(x)).alias("x"), F.get("coords", F.lit(y)).alias("y")]


def _colour_index(group: str) -> F.Column:
    return F.dense_rank().over(Window.orderBy(group)) - 1


def populations(e: DataFrame, x: int = 0, y: int = 1) -> DataFrame:
    """x, y, label, group (population), colour (its number), anchor: the end of the label's text that stands beside the point, in turn, so that labels of neighbours part."""
    names = e.select("population").distinct().withColumn("colour", _colour_index("population"))
    turn = F.row_number().over(Window.partitionBy("population").orderBy("sample_id")) % 2
    return e.join(names, "population").select(*_xy(e, x, y), F.col("sample_id").alias("label"), F.col("population").alias("group"), "colour", F.when(turn == 0, "end").otherwise("start").alias("anchor"))


def projections(e: DataFrame, embedding_populations: DataFrame, x: int = 0, y: int = 1) -> DataFrame:
    """The same by whether a sample's population made the embedding or was projected onto it."""
    flag = embedding_populations.select("population", F.lit(True).alias("_in")).distinct()
    return e.join(flag, "population", "left").select(*_xy(e, x, y), F.col("sample_id").alias("label"), F.when(F.col("_in"), "embedded").otherwise("projected").alias("group"), F.when(F.col("_in"), 0).otherwise(1).alias("colour"))


def clusters(e: DataFrame, k: int, x: int = 0, y: int = 1) -> DataFrame:
    """The same by cluster of the raw embedding."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample_id")
        return pdf.assign(cluster=linalg.kmeans(np.stack(pdf["coords"].to_numpy()), k).astype(np.int32))

    c = e.groupBy("replicate_id").applyInPandas(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in e.schema)}, cluster int")
    return c.select(*_xy(c, x, y), F.col("sample_id").alias("label"), F.concat(F.lit("cluster "), F.col("cluster").cast("string")).alias("group"), F.col("cluster").alias("colour"))


def rogue(support: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """Samples whose support value is under the cutoff."""
    return support.where(F.col("PSV") < cutoff)


def support_values(e: DataFrame, support: DataFrame, cutoff: float = 0.5, x: int = 0, y: int = 1, only: DataFrame | None = None) -> DataFrame:
    """x, y, label, group (rogue or stable), value. Samples of only, if given; others are the group other. Samples of one side alone are left out; unmatched() lists them."""
    low = rogue(support, cutoff).select("sample_id", F.lit(True).alias("_low"))
    s = e.join(support, "sample_id").join(low, "sample_id", "left")
    group = F.when(F.col("_low"), "rogue").otherwise("stable")
    if only is not None:
        s = s.join(only.select("sample_id", F.lit(True).alias("_in")), "sample_id", "left")
        group = F.when(F.col("_in"), group).otherwise("other")
    return s.select(*_xy(s, x, y), F.col("sample_id").alias("label"), group.alias("group"), F.col("PSV").alias("value"))


def unmatched(e: DataFrame, support: DataFrame) -> DataFrame:
    """sample_id, side: samples with coordinates or a support value only."""
    a, b = e.select("sample_id", F.lit(1).alias("a")), support.select("sample_id", F.lit(1).alias("b"))
    return a.join(b, "sample_id", "full").where("a is null or b is null").select("sample_id", F.when(F.col("a").isNull(), "support").otherwise("embedding").alias("side"))


def embedding_comparison(embedded: DataFrame, i: int, j: int, support: DataFrame | None = None, cutoff: float = 0.5, x: int = 0, y: int = 1) -> DataFrame:
    """Both embeddings of an aligned pair: x, y, label, group (reference or comparable), rogue."""
    spark = embedded.sparkSession
    rows = {r.replicate_id: r for r in embedded.where(F.col("replicate_id").isin(i, j)).collect()}
    c = Compared(*[v for r in (i, j) for v in (list(rows[r].sample_ids), np.array(rows[r].coords))])
    data = [(float(m[k, x]), float(m[k, y]), s, name) for name, m in (("reference", c.reference), ("comparable", c.comparable)) for k, s in enumerate(c.ids)]
    df = spark.createDataFrame(data, "x double, y double, label string, group string")
    if support is None:
        return df.withColumn("rogue", F.lit(False))
    marked = rogue(support, cutoff).select(F.col("sample_id").alias("label"), F.lit(True).alias("rogue"))
    return df.join(marked, "label", "left").withColumn("rogue", F.coalesce("rogue", F.lit(False)))


def svg(points: pd.DataFrame, title: str, explained: list[float] | None, dims: tuple[int, int], size: int = 640) -> str:
    """An HTML page with a scatter plot. Points with a column value are coloured from red to green, those marked rogue have a ring, and those with an anchor a label."""
    pad = 60
    span = lambda v: (v.min(), max(v.max() - v.min(), 1e-12))
    (x0, xs), (y0, ys) = span(points["x"]), span(points["y"])
    groups = sorted(points["group"].unique())
    colours = dict(zip(groups, distinct_colours(len(groups)), strict=True))
    dots = []
    for r in points.itertuples():
        colour = red_green(r.value) if hasattr(r, "value") else colours[r.group]
        cx, cy = pad + (r.x - x0) / xs * (size - 2 * pad), size - pad - (r.y - y0) / ys * (size - 2 * pad)
        ring = ' stroke="#000000" stroke-width="2"' if getattr(r, "rogue", False) else ""
        dots.append(f'<circle cx="{cx:.1f}" cy="{cy:.1f}" r="5" fill="{colour}"{ring}><title>{html.escape(f"{r.label}: {r.group}")}</title></circle>')
        if hasattr(r, "anchor"):
            dots.append(f'<text x="{cx + (8 if r.anchor == "start" else -8):.1f}" y="{cy + 4:.1f}" font-size="9" text-anchor="{r.anchor}">{html.escape(str(r.label))}</text>')
    legend = [f'<text x="{size}" y="{40 + 18 * k}" fill="{colours[g]}">{html.escape(str(g))}</text>' for k, g in enumerate(groups)]
    share = lambda d: f"dimension {d + 1}" + (f" ({100 * explained[d]:.1f} %)" if explained else "")
    axes = f'<text x="{size / 2}" y="{size - 15}">{share(dims[0])}</text><text transform="translate(20 {size / 2}) rotate(-90)">{share(dims[1])}</text>'
    return f'<!DOCTYPE html><meta charset="utf-8"><title>{html.escape(title)}</title><svg xmlns="http://www.w3.org/2000/svg" width="{size + 200}" height="{size}" font-family="sans-serif" font-size="13">{"".join(dots + legend)}{axes}</svg>\n'
