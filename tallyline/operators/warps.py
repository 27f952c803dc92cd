"""Geometry and blur of frames, as linear maps over Arrow batches: every step is a small matrix for rows and one for columns, or one sampling grid.

A batch's frames of one size are one array; matrices and grids depend on sizes and parameters alone. Frames are flat arrays of whole numbers from 0 to 255,
row by row; colour frames hold blue, green and red of each pixel in turn. A null frame, or one whose length doesn't fit its height and width, gives null."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pixels import Stabilisation, stabilised


@dataclass(frozen=True)
class Stress:
    downsample: float = 1.0
    blur_sigma: float = 0.0
    exposure_gain: float = 1.0
    exposure_offset: float = 0.0
    contrast_gain: float = 1.0
    exposure_amplitude: float = 0.0


@dataclass(frozen=True)
class Crop:
    scale: float = 1.0
    dx: float = 0.0
    dy: float = 0.0
    mirror: bool = False
    fine: bool = False


# Presets of stress and stabilisation, the bounds of their parameters, the grid of crops.
STRESS = {"clean": Stress(), "synthetic_mild": Stress(0.75, 0.55, 0.92, -4, 0.95, 0.10), "synthetic_moderate": Stress(0.5, 1.0, 0.80, -10, 0.90, 0.20)}
STRESS_BOUNDS = {"downsample": (0.25, 1), "blur_sigma": (0, 2), "exposure_gain": (0.5, 1.25), "exposure_offset": (-24, 24), "contrast_gain": (0.5, 1.25), "exposure_amplitude": (0, 0.25)}
_BOUNDS = {"min_brightness": 24.0, "max_brightness": 231.0, "min_contrast": 12.0, "max_saturated": 0.20}
STABILISATION = {"identity": Stabilisation(0.0, 1.0, 0.0, **_BOUNDS), "stabilize_mild": Stabilisation(0.5, 1.15, 8, **_BOUNDS), "stabilize_moderate": Stabilisation(0.75, 1.25, 16, **_BOUNDS)}
CROPS = {
    "baseline": Crop(), "scale_0.8": Crop(scale=0.8), "scale_1.2": Crop(scale=1.2), "scale_1.4": Crop(scale=1.4), "translate_x_minus6": Crop(dx=-6), "translate_x_plus6": Crop(dx=6),
    "translate_y_minus6": Crop(dy=-6), "translate_y_plus6": Crop(dy=6), "translate_y_minus12": Crop(dy=-12), "translate_y_plus12": Crop(dy=12), "mirror": Crop(mirror=True), "official_float_grayscale": Crop(fine=True),
}
GREY, FINE_GREY = (0.114, 0.587, 0.299), (0.1140, 0.5870, 0.2989)


def checked(stress: Stress) -> Stress:
    """The same, if every parameter is a finite number within its bounds."""
    for name, (low, high) in STRESS_BOUNDS.items():
        value = getattr(stress, name)
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not low <= value <= high:
            raise ValueError(f"{name} must be within {low} and {high}")
    return stress


def shrink(n: int, m: int) -> np.ndarray:
    """m rows over n values: each the mean of the stretch of n / m values that it covers."""
    edges = np.arange(m + 1) * n / m
    low, high = np.maximum(edges[:-1, None], np.arange(n)), np.minimum(edges[1:, None], np.arange(n) + 1)
    return np.maximum(high - low, 0) * m / n


def stretch(n: int, m: int) -> np.ndarray:
    """m rows over n values: linear between the middles of values, the outermost beyond them."""
    at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    low = np.minimum(np.floor(at).astype(int), n - 1)
    out = np.zeros((m, n))
    np.add.at(out, (np.arange(m), low), 1 - (at - low))
    np.add.at(out, (np.arange(m), np.minimum(low + 1, n - 1)), at - low)
    return out


def reflected(at: np.ndarray, n: int) -> np.ndarray:
    """Places beyond the ends as in a mirror at the outermost values."""
    if n == 1:
        return np.zeros_like(at)
    at = np.abs(at) % (2 * n - 2)
    return np.minimum(at, 2 * n - 2 - at)


def blurring(n: int, sigma: float) -> np.ndarray:
    """n rows over n values: a normal curve about each, over 3 sigma to either side, mirrored at the ends."""
    reach = int(round(sigma * 6 + 1) | 1) // 2
    away = np.arange(-reach, reach + 1)
    weight = np.exp(-(away**2) / (2 * sigma**2))
    out = np.zeros((n, n))
    np.add.at(out, (np.arange(n)[:, None], reflected(np.arange(n)[:, None] + away, n)), weight / weight.sum())
    return out


def _whole(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255)


def stressed_frames(x: np.ndarray, gain: np.ndarray, s: Stress) -> np.ndarray:
    """Frames (number, height, width) through lower resolution, blur, contrast and exposure; whole numbers after each step."""
    h, w = x.shape[1:]
    both = lambda y, a, b: _whole(np.einsum("rh,nhw,cw->nrc", a, y, b, optimize=True))
    if s.downsample != 1:
        small = [max(2, round(n * s.downsample)) for n in (h, w)]
        x = both(x, shrink(h, small[0]), shrink(w, small[1]))
        x = both(x, stretch(small[0], h), stretch(small[1], w))
    if s.blur_sigma:
        x = both(x, blurring(h, s.blur_sigma), blurring(w, s.blur_sigma))
    return _whole(((x - 127.5) * s.contrast_gain + 127.5) * gain[:, None, None] + s.exposure_offset)


def _framed(column: pd.Series, height: int, width: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a whole frame, and these frames."""
    good = np.array([x is not None and len(x) == height * width * depth for x in column], bool)
    x = np.stack([np.asarray(v, np.float64) for v in column[good]]) if good.any() else np.zeros((0, height * width * depth))
    return good, x.reshape(-1, height, width, depth) if depth > 1 else x.reshape(-1, height, width)


def _spread(good: np.ndarray, x: np.ndarray, kind: type) -> pd.Series:
    out = pd.Series([None] * len(good), dtype=object)
    for at, frame in zip(np.flatnonzero(good), x, strict=True):
        out[at] = frame.ravel().astype(kind)
    return out


def stressed(frames: DataFrame, stress: Stress, height: int, width: int, seed: int = 0) -> DataFrame:
    """(clip_id, frame_no, pixels): synthetic camera stress. Exposure swings once over a clip's frames in their order, from a phase that ``seed`` draws."""
    s, shape = checked(stress), frames.schema
    phase = np.random.default_rng(seed).uniform(0, 2 * np.pi)
    if s == Stress():
        return frames.select("clip_id", "frame_no", "pixels")
    # a frame's place among its clip's: by counts of stretches of frame numbers, so no window holds a clip
    wide = F.floor(F.col("frame_no") / 4096)
    counts = frames.groupBy("clip_id", wide.alias("_part")).agg(F.count("*").alias("_n"))
    counts = counts.select("clip_id", "_part", (F.sum("_n").over(Window.partitionBy("clip_id").orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy("clip_id")).alias("_all"))
    placed = frames.withColumn("_part", wide).join(counts, ["clip_id", "_part"]).withColumn("_at", F.col("_before") + F.row_number().over(Window.partitionBy("clip_id", "_part").orderBy("frame_no")) - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good, x = _framed(b["pixels"], height, width, 1)
            gain = s.exposure_gain * (1 + s.exposure_amplitude * np.sin(2 * np.pi * b["_at"].to_numpy(float) / b["_all"].to_numpy(float) + phase))
            yield b[["clip_id", "frame_no"]].assign(pixels=_spread(good, stressed_frames(x, gain[good], s), np.int32).to_numpy())

    types = ", ".join(f"{c} {shape[c].dataType.simpleString()}" for c in ("clip_id", "frame_no"))
    return placed.select("clip_id", "frame_no", "pixels", "_at", "_all").mapInPandas(run, f"{types}, pixels array<int>")


def stressed_then_stabilised(frames: DataFrame, stress: str, preset: str, height: int, width: int, seed: int = 0) -> DataFrame:
    """Synthetic stress first, then stabilisation; presets by name, never chosen here."""
    return stabilised(stressed(frames, STRESS[stress], height, width, seed), STABILISATION[preset])


def cropped_frames(bgr: np.ndarray, c: Crop) -> np.ndarray:
    """Frames (number, height, width, 3) in grey, mirrored, scaled about the middle and moved; linear between pixels, mirrored at the ends."""
    n, h, w, _ = bgr.shape
    grey = bgr @ np.array(FINE_GREY if c.fine else GREY)
    grey = grey if c.fine else _whole(grey)
    if c.mirror:
        grey = grey[:, :, ::-1]
    if (c.scale, c.dx, c.dy) == (1.0, 0.0, 0.0):
        return grey

    def sampled(size: int, move: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        middle = (size - 1) / 2
        at = (np.arange(size) - middle - move) / c.scale + middle
        low = np.floor(at)
        return reflected(low.astype(int), size), reflected(low.astype(int) + 1, size), at - low

    (top, below, v), (left, right, u) = sampled(h, c.dy), sampled(w, c.dx)
    rows = grey[:, top] * (1 - v)[None, :, None] + grey[:, below] * v[None, :, None]
    out = rows[:, :, left] * (1 - u) + rows[:, :, right] * u
    return out if c.fine else _whole(out)


def crop_grid(frames: DataFrame, height: int, width: int, crops: dict[str, Crop] | None = None) -> DataFrame:
    """(clip_id, frame_no, crop, pixels): each colour frame by every transform of the grid, a table of a row for each."""
    crops = crops or CROPS
    table = F.explode(F.array(*(F.struct(F.lit(n).alias("crop"), F.array(*(F.lit(float(v)) for v in astuple(c))).alias("how")) for n, c in crops.items())))
    both = frames.select("clip_id", "frame_no", "pixels", table.alias("x")).select("clip_id", "frame_no", "pixels", "x.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, b in batch.groupby("crop", sort=False):
                scale, dx, dy, mirror, fine = b["how"].iloc[0]
                good, x = _framed(b["pixels"], height, width, 3)
                yield b[["clip_id", "frame_no", "crop"]].assign(pixels=_spread(good, cropped_frames(x, Crop(scale, dx, dy, bool(mirror), bool(fine))), np.float64).to_numpy())

    types = ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in ("clip_id", "frame_no"))
    return both.mapInPandas(run, f"{types}, crop string, pixels array<double>")
