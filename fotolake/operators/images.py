"""Picture measures in numpy over the image source: exposure, sharpness, difference hash, dominant colour, screenshots."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolake.functions.scalars import colour_bucket, quality_score

# Names and sizes of screenshots.
SHOT_NAME = r"(?i)screen[\s_-]?shot|screen[\s_-]?capture|screenrecord|צילום[\s_-]?מסך|capture d.[eé]cran|bildschirmfoto"
SCREENS = [
    (1080, 1920), (1080, 2160), (1080, 2220), (1080, 2280), (1080, 2340), (1080, 2400), (1170, 2532), (1179, 2556),
    (1284, 2778), (1290, 2796), (750, 1334), (828, 1792), (1125, 2436), (1242, 2688), (1440, 2560), (1440, 3040),
    (1440, 3120), (1440, 3200), (720, 1280), (720, 1520), (720, 1600), (1920, 1080), (2560, 1440), (3840, 2160),
    (1366, 768), (1536, 864), (1440, 900), (1680, 1050), (2880, 1800), (2560, 1600), (3024, 1964), (3456, 2234),
]
#: Long side of the copy that is measured, and of the one whose palette is taken.
LONG, SMALL = 512, 48
MEASURES = "luma double, saturation double, p5 double, p95 double, clip_dark double, clip_white double, ink double, white double, flips int, rows int, sharp double, phash long, r int, g int, b int"


def image_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """origin, width, height, nChannels, data (BGR) of pictures; files that are none are left out."""
    return spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(folder).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")


# A resampling's reach in source pixels at scale 1.
LANCZOS, BICUBIC = 3.0, 2.0
#: Luma weights in 65536ths.
LUMA = (19595, 38470, 7471)


def _filter(x: np.ndarray, reach: float) -> np.ndarray:
    """Lanczos with three lobes, or the cubic with a = -0.5, by its reach."""
    x = np.abs(x)
    if reach == LANCZOS:
        return np.where(x < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    near, far = 1.5 * x**3 - 2.5 * x**2 + 1, -0.5 * (x**3 - 5 * x**2 + 8 * x - 4)
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


@lru_cache(256)
def coefficients(n: int, out: int, reach: float, span: float | None = None) -> np.ndarray:
    """out x n weights that resample span (all n if None) source pixels of an axis to out; rows sum to 1."""
    scale = (span or n) / out
    wide = max(scale, 1.0)
    center = (np.arange(out) + 0.5) * scale
    first = np.maximum((center - reach * wide + 0.5).astype(int), 0)
    last = np.minimum((center + reach * wide + 0.5).astype(int), n)
    at = np.arange(n)
    weight = _filter((at[None, :] - center[:, None] + 0.5) / wide, reach) * ((at >= first[:, None]) & (at < last[:, None]))
    weight /= weight.sum(1, keepdims=True)
    weight.setflags(write=False)
    return weight


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x + 0.5), 0, 255)


def resampled(pixels: np.ndarray, height: int, width: int, reach: float = LANCZOS, spans: tuple[float, float] | None = None) -> np.ndarray:
    """A picture (rows, columns, channels, or grey) at another size: two matrix products, whole levels after each."""
    h, w = pixels.shape[:2]
    tall, wide = spans or (h, w)
    if (w, wide) != (width, width):
        pixels = _bytes(np.einsum("ox,hx...->ho...", coefficients(w, width, reach, wide), pixels))
    if (h, tall) != (height, height):
        pixels = _bytes(np.einsum("oy,yw...->ow...", coefficients(h, height, reach, tall), pixels))
    return pixels


def _reduced(pixels: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Mean over cells of rows x cols pixels, smaller ones at the far edges."""
    h, w = pixels.shape[:2]
    sums = np.add.reduceat(np.add.reduceat(pixels, np.arange(0, h, rows), 0), np.arange(0, w, cols), 1)
    tall, wide = (np.minimum(np.arange(0, n, k) + k, n) - np.arange(0, n, k) for n, k in ((h, rows), (w, cols)))
    area = np.outer(tall, wide)
    return _bytes(sums / (area[:, :, None] if pixels.ndim == 3 else area))


def thumbnail_size(height: int, width: int, side: int) -> tuple[int, int]:
    """The size that fits into a square of side and keeps the aspect best."""
    aspect = width / height

    def best(x: float, off) -> int:
        return max(min(int(np.floor(x)), int(np.ceil(x)), key=off), 1)

    if aspect <= 1:
        return side, best(side * aspect, lambda n: abs(aspect - n / side))
    return best(side / aspect, lambda n: 0 if n == 0 else abs(aspect - side / n)), side


def thumbnail(pixels: np.ndarray, side: int, reach: float = LANCZOS) -> np.ndarray:
    """The picture, or a copy that fits into a square of side. Large ones are first averaged to twice the size or more."""
    h, w = pixels.shape[:2]
    if h <= side and w <= side:
        return pixels
    height, width = thumbnail_size(h, w, side)
    rows, cols = max(int(h / height / 2), 1), max(int(w / width / 2), 1)
    if rows > 1 or cols > 1:
        return resampled(_reduced(pixels, rows, cols), height, width, reach, (h / rows, w / cols))
    return resampled(pixels, height, width, reach)


def luma(rgb: np.ndarray) -> np.ndarray:
    """Grey levels of whole-numbered pixels."""
    return np.floor((rgb @ np.array(LUMA, float) + 0x8000) / 0x10000)


def dhash(rgb: np.ndarray) -> int | None:
    """64 bits of a copy of 9 x 8 pixels: is each darker than its right neighbour; null for pictures without structure."""
    small = resampled(luma(rgb), 8, 9)
    # A deviation below 3, in whole numbers: about seven of a million random pictures lie at 3 exactly, where sums of fractions round to either side.
    if small.size * (small * small).sum() - small.sum() ** 2 < (3 * small.size) ** 2:
        return None
    return int(np.packbits(np.diff(small, axis=1) > 0).view(">i8")[0])


def sharpness(grey: np.ndarray) -> float:
    """80th percentile of the Laplacian's variance within 4 x 4 tiles."""
    if min(grey.shape) < 16:
        return 0.0
    rows, cols = ([n * i // 4 for i in range(5)] for n in grey.shape)
    found = []
    bends = grey[:-2, 1:-1] + grey[2:, 1:-1] + grey[1:-1, :-2] + grey[1:-1, 2:] - 4 * grey[1:-1, 1:-1]
    for top, end in zip(rows, rows[1:], strict=False):
        for left, right in zip(cols, cols[1:], strict=False):
            if min(end - top, right - left) > 4:
                found.append(bends[top : end - 2, left : right - 2].var())
    return float(np.percentile(found, 80)) if found else 0.0


def palette(pixels: np.ndarray, colours: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean colours and their pixels, by cutting the histogram: the box of most pixels is halved where half of them lie, across
    its widest side, until there are so many boxes."""
    values, n = np.unique(pixels.reshape(-1, 3), axis=0, return_counts=True)
    boxes = [(values, n)]
    while len(boxes) < colours:
        i = max(range(len(boxes)), key=lambda k: (len(boxes[k][1]) > 1, boxes[k][1].sum()))
        v, c = boxes[i]
        if len(c) < 2:
            break
        by = v[:, np.ptp(v, axis=0).argmax()].argsort(kind="stable")
        v, c = v[by], c[by]
        cut = min(max(int(np.searchsorted(np.cumsum(c), c.sum() / 2)) + 1, 1), len(c) - 1)
        boxes[i : i + 1] = [(v[:cut], c[:cut]), (v[cut:], c[cut:])]
    return np.array([np.average(v, axis=0, weights=c) for v, c in boxes]), np.array([c.sum() for _, c in boxes])


def dominant(rgb: np.ndarray) -> tuple[int, int, int]:
    """The heaviest of six palette colours of a small copy, saturated ones that are not near black weighing more; of equally heavy
    ones that of more pixels."""
    means, n = palette(thumbnail(rgb, SMALL, BICUBIC), 6)
    means = np.floor(means + 0.5)
    top, low = means.max(1), means.min(1)
    weight = n * (1 + 1.5 * (top - low) / np.maximum(top, 1) * (top / 255 > 0.18))
    return tuple(int(x) for x in means[int(np.lexsort((-n, -weight))[0])])


def exposure(rgb: np.ndarray, grey: np.ndarray) -> tuple:
    """luma to rows of MEASURES."""
    top, low = rgb.max(2), rgb.min(2)
    sat = ((top - low) / np.maximum(top, 1)).mean()
    p5, p95 = np.percentile(grey, (5, 95))
    # Lines of text: rows with ink and blank ones take turns.
    ink = grey < min(150.0, grey.mean() - 45)
    lines = ink.mean(1) > 0.012
    flips = int((lines[1:] != lines[:-1]).sum())
    return grey.mean(), sat, p5, p95, (grey < 8).mean(), (grey > 247).mean(), ink.mean(), (grey > 165).mean(), flips, len(grey)


#: Measures that are taken together.
TOGETHER = (("luma", "saturation", "p5", "p95", "clip_dark", "clip_white", "ink", "white", "flips", "rows"), ("sharp",), ("phash",), ("r", "g", "b"))


def measure_one(data: bytes, height: int, width: int, channels: int, only: tuple[str, ...] = ()) -> tuple:
    """MEASURES of a picture; with only, those of other groups than its names' are not taken and null."""
    light, edges, hashed, colour = (not only or any(n in only for n in names) for names in TOGETHER)
    bgr = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    rgb = np.repeat(bgr, 3, 2) if channels == 1 else bgr[:, :, 2::-1]
    whole = rgb.astype(np.float64)
    rgb = thumbnail(whole, LONG) if light or edges or hashed else None
    grey = rgb @ (0.299, 0.587, 0.114) if light or edges else None
    return (*(exposure(rgb, grey) if light else [None] * len(TOGETHER[0])), sharpness(grey) if edges else None, dhash(rgb) if hashed else None, *(dominant(whole) if colour else (None, None, None)))


def measure(images: DataFrame, *only: str) -> DataFrame:
    """origin, width, height and MEASURES of pictures, or only those named; one picture at a time is unpacked."""
    kinds = dict(m.split() for m in MEASURES.split(", "))
    chosen = only or tuple(kinds)

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [measure_one(d, h, w, c, only) for d, h, w, c in zip(f.data, f.height, f.width, f.nChannels, strict=True)]
            out = pd.DataFrame(found, columns=list(kinds), index=f.index)
            # From the numbers themselves: beside a null, the frame's own column would hold them as doubles.
            out["phash"] = pd.array([x[list(kinds).index("phash")] for x in found], dtype="Int64")
            yield pd.concat([f[["origin", "width", "height"]], out[list(chosen)]], axis=1)

    return images.mapInPandas(task, f"origin string, width int, height int, {', '.join(f'{n} {kinds[n]}' for n in chosen)}")


def screenshot_flag(name: Column, width: Column, height: Column, has_camera: Column) -> Column:
    """By its name, or as a large PNG of a screen's size that names no camera."""
    sizes = [w * 100_000 + h for a, b in SCREENS for w, h in ((a, b), (b, a))]
    file = F.regexp_replace(name, r"^.*[/\\]", "")
    as_screen = F.lower(file).endswith(".png") & ~has_camera & (F.greatest(width, height) >= 900) & (width * 100_000 + height).isin(sizes)
    return (file.rlike(SHOT_NAME) | as_screen).cast("int")


def receipt_flag(white: Column, saturation: Column, ink: Column, flips: Column, rows: Column, width: Column, height: Column) -> Column:
    """Upright, mostly white, hardly any colour, some ink, and that in lines."""
    return ((height >= width * 1.25) & (white >= 0.5) & (saturation < 0.14) & (ink > 0.015) & (ink < 0.3) & (flips >= 0.06 * rows)).cast("int")


def scored(measures: DataFrame) -> DataFrame:
    """measures with screenshot, receipt, colour and score; has_camera is taken from measures where it has it."""
    c = F.col
    camera = c("has_camera") if "has_camera" in measures.columns else F.lit(False)
    return measures.select(
        "*", screenshot_flag(c("origin"), c("width"), c("height"), camera).alias("screenshot"),
        receipt_flag(c("white"), c("saturation"), c("ink"), c("flips"), c("rows"), c("width"), c("height")).alias("receipt"),
        colour_bucket(c("r"), c("g"), c("b")).alias("colour"),
        quality_score(c("sharp"), c("luma"), c("p5"), c("p95"), c("clip_dark"), c("clip_white"), F.lit(0), c("width"), c("height")).alias("score"),
    )


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once a row; a column that is merely used twice is worked out at each use, and once
    for each element inside a function over an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def eye_ratio(points: Column) -> Column:
    """Extent of eye landmarks across their main axis over that along it, 1 where they are one spot; null with fewer than three
    points. The main axis of points in the plane has half the angle of (2 sxy, sxx - syy)."""
    x, y = (lambda p: p[0].cast("double")), (lambda p: p[1].cast("double"))

    def ratio(points: Column) -> Column:
        total = lambda f: F.aggregate(points, F.lit(0.0), lambda s, p: s + f(p))
        n = F.size(points)

        def spread(m: Column) -> Column:
            dx, dy = (lambda p: x(p) - m["x"]), (lambda p: y(p) - m["y"])
            return F.struct(total(lambda p: dx(p) ** 2).alias("xx"), total(lambda p: dy(p) ** 2).alias("yy"), total(lambda p: dx(p) * dy(p)).alias("xy"))

        def extents(a: Column) -> Column:
            on = lambda along, across: F.transform(points, lambda p: x(p) * along + y(p) * across)
            extent = lambda along, across: _let(on(along, across), lambda d: F.array_max(d) - F.array_min(d))
            return F.struct(extent(a["cos"], a["sin"]).alias("main"), extent(-a["sin"], a["cos"]).alias("cross"))

        axis = lambda angle: F.struct(F.cos(angle).alias("cos"), F.sin(angle).alias("sin"))
        means = F.struct((total(x) / n).alias("x"), (total(y) / n).alias("y"))
        angle = _let(_let(means, spread), lambda s: F.atan2(2 * s["xy"], s["xx"] - s["yy"]) / 2)
        return _let(_let(_let(angle, axis), extents), lambda e: F.when(e["main"] > 1e-6, e["cross"] / e["main"]).otherwise(1.0))

    return F.when(F.size(points) >= 3, _let(points, ratio))


def closed_eyes(faces: DataFrame, photos: DataFrame, limit: float = 0.2) -> DataFrame:
    """photo_id, eyes_closed: 1 when a clear, large enough face has closed eyes, 0 when none has; faces has photo_id, det_score,
    x1, x2, left_eye, right_eye."""
    rows = faces.join(photos.select(F.col("id").alias("photo_id"), "width"), "photo_id").where((F.col("det_score") >= 0.6) & (F.col("x2") - F.col("x1") >= 0.03 * F.col("width")))
    ratio = (eye_ratio(F.col("left_eye")) + eye_ratio(F.col("right_eye"))) / 2
    return rows.withColumn("ratio", ratio).where("ratio is not null").groupBy("photo_id").agg(F.max((F.col("ratio") < limit).cast("int")).alias("eyes_closed"))
