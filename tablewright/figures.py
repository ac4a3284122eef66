"""Figures as tables of marks, and small SVG drawings of them without any plotting library."""

from __future__ import annotations

from dataclasses import dataclass, field
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.config import PlotConfig
from tablewright.sources.io import write_frame

#: Marks an SVG draws at most; the marks table always holds all.
SVG_MARKS = 5000
_RAMP = {"viridis": [(68, 1, 84), (59, 82, 139), (33, 145, 140), (94, 201, 98), (253, 231, 37)], "coolwarm": [(59, 76, 192), (221, 221, 221), (180, 4, 38)]}


def apply_style(config: PlotConfig = PlotConfig()) -> dict:
    """The drawing settings that a config stands for."""
    return {"width": round(config.width * 96), "height": round(config.height * 96), "dpi": config.dpi, "grid": "grid" in config.style, "font": {"paper": 10, "notebook": 12, "talk": 16, "poster": 22}.get(config.context, 12), "sequential": config.sequential, "diverging": config.diverging}


def colour(value: float, ramp: str) -> str:
    """value in 0..1."""
    stops = _RAMP.get(ramp, _RAMP["viridis"])
    at = min(max(value, 0.0), 1.0) * (len(stops) - 1)
    i = min(int(at), len(stops) - 2)
    return "#%02x%02x%02x" % tuple(round(a + (b - a) * (at - i)) for a, b in zip(stops[i], stops[i + 1]))


def _svg(body: list[str], style: dict, title: str) -> str:
    w, h = style["width"], style["height"]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}" viewBox="0 0 {w} {h}" font-family="sans-serif" font-size="{style["font"]}"><rect width="100%" height="100%" fill="white"/><text x="{w / 2}" y="20" text-anchor="middle">{escape(title)}</text>' + "".join(body) + "</svg>"


def _axis(values: list[float], low: float, high: float) -> list[float]:
    a, b = min(values, default=0.0), max(values, default=1.0)
    return [low + (v - a) / (b - a) * (high - low) if b > a else (low + high) / 2 for v in values]


def scatter_svg(rows: list, x: str, y: str, style: dict, title: str) -> str:
    px, py = _axis([r[x] for r in rows], 50, style["width"] - 20), _axis([r[y] for r in rows], style["height"] - 40, 40)
    return _svg([f'<circle cx="{a:.1f}" cy="{b:.1f}" r="2" fill="{colour(0.3, style["sequential"])}" fill-opacity="0.6"/>' for a, b in zip(px, py)], style, title)


def bars_svg(rows: list, label: str, value: str, style: dict, title: str) -> str:
    top, step = max((abs(r[value] or 0) for r in rows), default=1) or 1, (style["height"] - 60) / max(len(rows), 1)
    body = []
    for i, r in enumerate(rows):
        w = abs(r[value] or 0) / top * (style["width"] - 260)
        body.append(f'<text x="190" y="{45 + i * step + step / 2:.1f}" text-anchor="end">{escape(str(r[label]))}</text><rect x="200" y="{40 + i * step:.1f}" width="{w:.1f}" height="{step * 0.8:.1f}" fill="{colour(0.4, style["sequential"])}"/>')
    return _svg(body, style, title)


def heat_svg(rows: list, x: str, y: str, value: str, style: dict, title: str, span: tuple[float, float], ramp: str) -> str:
    xs, ys = list(dict.fromkeys(r[x] for r in rows)), list(dict.fromkeys(r[y] for r in rows))
    w, h = (style["width"] - 160) / max(len(xs), 1), (style["height"] - 80) / max(len(ys), 1)
    body = [f'<rect x="{150 + xs.index(r[x]) * w:.1f}" y="{40 + ys.index(r[y]) * h:.1f}" width="{w:.1f}" height="{h:.1f}" fill="{colour((r[value] - span[0]) / (span[1] - span[0]), ramp)}"/>' for r in rows if r[value] is not None]
    if len(ys) <= 40:
        body += [f'<text x="145" y="{40 + i * h + h / 2:.1f}" text-anchor="end">{escape(str(v))}</text>' for i, v in enumerate(ys)]
    return _svg(body, style, title)


def heatmap_marks(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """(row_feature, column_feature, correlation, text): the lower triangle; text up to 25 columns, names up to 40."""
    place = F.create_map(*(x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))))
    text = F.when(F.lit(len(columns) <= 25), F.format_string("%.2f", "correlation"))
    first = place[F.col("feature_1")] < place[F.col("feature_2")]
    return pairs.select(F.when(first, F.col("feature_2")).otherwise(F.col("feature_1")).alias("row_feature"), F.when(first, F.col("feature_1")).otherwise(F.col("feature_2")).alias("column_feature"), "correlation", text.alias("text"), F.lit(len(columns) <= 40).alias("named"))


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text wherever Hadoop's file systems reach."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


@dataclass
class FigureSink:
    """Writes a figure's marks as Parquet, and a drawing where one is asked for, into a folder."""

    folder: str
    config: PlotConfig = PlotConfig()
    written: list[str] = field(default_factory=list)

    def write(self, stem: str, marks: DataFrame, draw=None) -> str:
        path = write_frame(marks, f"{self.folder}/{stem}.parquet")
        self.written.append(stem)
        if draw is not None:
            svg = draw(marks.limit(SVG_MARKS).collect(), apply_style(self.config), stem.replace("_", " "))
            _put(marks.sparkSession, f"{self.folder}/{stem}.svg", svg)
        return path
