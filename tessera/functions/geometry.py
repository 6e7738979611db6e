"""Rectangles as struct<x, y, width, height> of doubles, in columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(r) -> Column:
    return F.col(r) if isinstance(r, str) else r


def area(r) -> Column:
    r = _c(r)
    return F.greatest(r["width"], F.lit(0.0)) * F.greatest(r["height"], F.lit(0.0))


def intersection(a, b) -> Column:
    a, b = _c(a), _c(b)
    w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a, b) -> Column:
    i = intersection(a, b)
    u = area(a) + area(b) - i
    return F.when(u > 0, i / u).otherwise(0.0)


def coverage(inner, outer) -> Column:
    """Share of the inner rectangle inside the outer one."""
    return F.when(area(inner) > 0, intersection(inner, outer) / area(inner)).otherwise(0.0)


def centre_inside(inner, outer) -> Column:
    i, o = _c(inner), _c(outer)
    x, y = i["x"] + i["width"] / 2, i["y"] + i["height"] / 2
    return (x >= o["x"]) & (x <= o["x"] + o["width"]) & (y >= o["y"]) & (y <= o["y"] + o["height"])


def centre_distance(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.hypot(a["x"] + a["width"] / 2 - b["x"] - b["width"] / 2, a["y"] + a["height"] / 2 - b["y"] - b["height"] / 2)


def clamp(c, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(c)))


def band(c, low: float, inner_low: float, inner_high: float, high: float) -> Column:
    """Trapezoid: 0 outside (low, high), 1 inside, linear between."""
    c = _c(c)
    return F.when((c <= low) | (c >= high), 0.0).when(c < inner_low, (c - low) / (inner_low - low)).when(c > inner_high, (high - c) / (high - inner_high)).otherwise(1.0)


# ---- quadrilaterals: array<struct<x, y>> of four points

def canonical_quad(points) -> Column:
    """The four points around their centre by rising angle, from the one of least x + y (the first of equals).
    Angles and sums are compared to nine places, so the order does not hang on the last bit."""
    at = lambda s, k: F.aggregate(s, F.lit(0.0), lambda a, q: a + q[k] / 4)
    angle = lambda s: lambda q: F.struct(F.round(F.atan2(q["y"] - s["cy"], q["x"] - s["cx"]), 9).alias("a"), q["x"].alias("x"), q["y"].alias("y"))
    # every step is bound to a name by a list of one, so that none is worked out again for each point
    centred = once(_c(points), lambda p: F.struct(p.alias("p"), at(p, "x").alias("cx"), at(p, "y").alias("cy")))
    ordered = once(centred, lambda s: F.transform(F.array_sort(F.transform(s["p"], angle(s))), lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))))
    least = lambda o: F.array_min(F.transform(o, lambda q, i: F.struct(F.round(q["x"] + q["y"], 9).alias("s"), i.alias("i"))))["i"]
    start = once(ordered, lambda o: F.struct(o.alias("o"), least(o).alias("i")))
    return once(start, lambda s: F.concat(F.slice(s["o"], s["i"] + 1, F.lit(4)), F.slice(s["o"], F.lit(1), s["i"])))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def quad_is_convex(points) -> Column:
    """All turns go the same way."""
    p = _c(points)

    def turn(i: int) -> Column:
        a, b, c = (F.get(p, F.lit((i + k) % 4)) for k in range(3))
        return (b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"])

    turns = F.array(*map(turn, range(4)))
    return F.forall(turns, lambda t: t > 1e-8) | F.forall(turns, lambda t: t < -1e-8)


def quad_bounds(points) -> Column:
    p = _c(points)
    x, y = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
    return F.struct(F.array_min(x).alias("x"), F.array_min(y).alias("y"), (F.array_max(x) - F.array_min(x)).alias("width"), (F.array_max(y) - F.array_min(y)).alias("height"))


# ---- scores of objects in an image.  Fixed values: the weights and bands below.

def object_intent(r, model_score, image_width: float, image_height: float) -> Column:
    """How much an object is what the picture is of: centrality, prominence, model score and shape."""
    r, m = _c(r), _c(model_score)
    cx, cy = (r["x"] + r["width"] / 2) / image_width, (r["y"] + r["height"] / 2) / image_height
    off = F.sqrt(F.pow((cx - 0.5) / 0.5, F.lit(2)) + F.pow((cy - 0.52) / 0.52, F.lit(2)))
    prominence = clamp(F.sqrt(r["width"] * r["height"] / max(1.0, image_width * image_height)))
    shape = band(r["width"] / F.greatest(F.lit(1.0), r["height"]), 0.07, 0.14, 0.72, 1.25)
    return clamp(clamp(1 - off / F.sqrt(F.lit(2.0))) * 0.45 + prominence * 0.28 + m * 0.17 + shape * 0.1)


def label_intent(label, outer, model_score, largest_area) -> Column:
    """How well a label lies on the front of the object around it; largest_area is that of its largest label."""
    one = F.lit(1.0)
    i, o, m = _c(label), _c(outer), _c(model_score)
    mid_x, mid_y = i["x"] + i["width"] / 2, i["y"] + i["height"] / 2
    central = clamp(1 - F.abs(mid_x - (o["x"] + o["width"] / 2)) / F.greatest(one, o["width"] / 2))
    fits = (central * 0.25
            + band(i["width"] / F.greatest(one, o["width"]), 0.12, 0.25, 0.92, 1.06) * 0.16
            + band((mid_y - o["y"]) / F.greatest(one, o["height"]), 0.18, 0.34, 0.88, 0.98) * 0.17
            + clamp(1 - F.abs(F.log(F.greatest(F.lit(0.05), i["width"] / F.greatest(one, i["height"])) / 1.15)) / 2.4) * 0.1
            + clamp(1 - F.greatest(F.lit(0.0), i["height"] / F.greatest(one, o["height"]) - 0.38) / 0.3) * 0.13
            + F.sqrt(clamp(i["width"] * i["height"] / F.greatest(one, _c(largest_area)))) * 0.1
            + coverage(label, outer) * 0.09)
    return clamp(clamp(fits) * 0.85 + m * 0.15)


def matched_geometry(inliers, ratio, grid, hull, span) -> Column:
    """One matching mode as the mean of five terms of at most one."""
    cap = lambda c: F.least(c, F.lit(1.0))
    return (cap(_c(inliers) / 30) + _c(ratio) + _c(grid) + cap(_c(hull) / 0.25) + cap(_c(span) / 0.5)) / 5


def overlap_similarity(a, b) -> Column:
    """The larger of the share of the joint area and 0.92 of the share of the smaller rectangle."""
    i = intersection(a, b)
    x, y = F.greatest(F.lit(1.0), area(a)), F.greatest(F.lit(1.0), area(b))
    return F.greatest(i / F.greatest(F.lit(1.0), x + y - i), i / F.greatest(F.lit(1.0), F.least(x, y)) * 0.92)


def duplicate_class(geometry_score, text_score, probable: float = 0.8, possible: float = 0.5, overlap: float = 0.45, least: float = 0.3,
                    geometry_weight: float = 0.55, text_weight: float = 0.45) -> tuple[Column, Column]:
    """(total score, class) of two regions; a null text score leaves the geometry alone to decide."""
    g, t = _c(geometry_score), _c(text_score)
    total = F.when(t.isNull(), g).otherwise(g * geometry_weight + t * text_weight)
    alone = F.when(g >= probable, "possible_duplicate").when(g >= overlap, "overlapping").otherwise("unlikely")
    both = (F.when((g >= least) & (total >= probable), "probable_duplicate").when((g >= least) & (total >= possible), "possible_duplicate")
            .when(g >= overlap, "overlapping").otherwise("unlikely"))
    return total, F.when(t.isNull(), alone).otherwise(both)


def least_overlap(probable: float = 0.8, possible: float = 0.5, overlap: float = 0.45, least: float = 0.3, **_) -> float:
    """The geometry score below which ``duplicate_class`` says unlikely whatever the texts."""
    return min(probable, overlap, least)
