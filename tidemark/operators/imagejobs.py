"""Per-image kernels as jobs over image tables: decoding, hashing, geometry, augmentation."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.jpeg import compressed
from tidemark.functions.labels import IGNORE, OBSTACLE, UNKNOWN
from tidemark.session import ship

# Channel means and deviations (red, green, blue).
#: Images of a batch that leaves a kernel, and pixels of a batch of rows.
SLICE, PIXELS = 64, 100_000
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def _each(rows: DataFrame, schema: str, work: Callable[[pd.Series], dict | None]) -> DataFrame:
    """One output row for each input row; images pass in Arrow batches, one at a time in the kernel."""
    ship(rows.sparkSession)
    names = [f.name for f in rows.sparkSession.createDataFrame([], schema).schema]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, max(1, len(frame)), SLICE):
                yield pd.DataFrame([work(row) for row in frame.iloc[at : at + SLICE].itertuples(index=False)], columns=names)

    return rows.mapInPandas(run, schema)


def unrolled(images: DataFrame, keep: list[str], data: str, values: dict[str, str], depth: int = 1) -> DataFrame:
    """``keep, y, x, values`` (names and types): one row for each pixel of the bytes in ``data``, ``depth`` bytes each, for images with a ``width``.

    Some images at a time, PIXELS pixels or one image: a task never holds a whole batch as pixels.
    """
    fields = [images.schema[n] for n in keep]
    schema = T.StructType([*fields, T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType())])
    for n, kind in values.items():
        schema = schema.add(T.StructType.fromDDL(f"`{n}` {kind}")[n])
    arrow, m = to_arrow_schema(schema), len(keep)
    ship(images.sparkSession)

    def rows(part: pa.RecordBatch, sizes: np.ndarray) -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        width = part.column(m).to_numpy(zero_copy_only=False)[owner].astype(np.int64)
        found = np.frombuffer(b"".join(b or b"" for b in part.column(m + 1).to_pylist()), np.uint8).reshape(-1, depth)
        columns = [part.column(k).take(pa.array(owner)) for k in range(m)] + [pa.array(v) for v in (at // width, at % width)] + [pa.array(found[:, k]) for k in range(depth)]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(m + 1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) // depth
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, low + int(np.searchsorted(np.cumsum(sizes[low:]), PIXELS, "right")))
                if sizes[low:high].any():
                    yield rows(batch.slice(low, high - low), sizes[low:high])
                low = high

    return images.select(*keep, "width", data).mapInArrow(run, schema)


def pixels_of(row) -> np.ndarray:
    """Height x width x channels, red first, from Spark's image columns (blue first)."""
    data = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)
    return data[:, :, ::-1] if row.channels == 3 else data[:, :, [2, 1, 0, 3]] if row.channels == 4 else data


def decode_labels(pixels: np.ndarray) -> np.ndarray:
    """Label ids of a mask: gray values as they are; colour by its strongest channel (the first on ties), black ignored."""
    if pixels.shape[2] == 1:
        return pixels[:, :, 0].astype(np.uint8)
    rgb = pixels[:, :, :3]
    if (rgb[:, :, 0] == rgb[:, :, 1]).all() and (rgb[:, :, 1] == rgb[:, :, 2]).all():
        return rgb[:, :, 0].astype(np.uint8)
    return np.where(rgb.max(2) == 0, IGNORE, rgb.argmax(2)).astype(np.uint8)


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG file of (height, width, 1 or 3) bytes, red first."""
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 0 if pixels.shape[2] == 1 else 2, 0, 0, 0)
    lines = np.pad(np.ascontiguousarray(pixels, np.uint8).reshape(pixels.shape[0], -1), ((0, 0), (1, 0)))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def channel_sums(images: DataFrame) -> DataFrame:
    """``stem, height, width, channels, red, green, blue``: sizes and sums of the channels of decoded colour images."""

    def kernel(r):
        sums = pixels_of(r)[:, :, :3].reshape(-1, min(3, r.channels)).sum(0, dtype=np.int64)
        return {"stem": r.stem, "height": r.height, "width": r.width, "channels": r.channels, **dict(zip(("red", "green", "blue"), np.resize(sums, 3).tolist(), strict=True))}

    return _each(images.select("stem", "height", "width", "channels", "data"), "stem string, height int, width int, channels int, red bigint, green bigint, blue bigint", kernel)


def named_like_images(masks: DataFrame) -> DataFrame:
    """Masks under their images' stems: a last m of the name goes."""
    return masks.withColumn("stem", F.regexp_replace("stem", "m$", ""))


def samples(images: DataFrame, masks: DataFrame, imus: DataFrame | None = None) -> DataFrame:
    """Whole samples ``stem, height, width, channels, data, labels[, imu]``: decoded images with their labels, and the IMU mask where there is one."""
    out = images.select("stem", "height", "width", "channels", "data").join(masks.select("stem", "labels"), "stem")
    return out if imus is None else out.join(imus.select("stem", F.col("labels").alias("imu")), "stem", "left")


def sample_counts(samples_: DataFrame) -> DataFrame:
    """``stem, obstacle, red, imu_pixels``: a digest of whole samples (obstacle pixels, sum of red, pixels set in the IMU mask)."""

    def kernel(r):
        imu = None if r.imu is None else int(np.count_nonzero(np.frombuffer(r.imu, np.uint8)))
        return {"stem": r.stem, "obstacle": int((np.frombuffer(r.labels, np.uint8) == OBSTACLE).sum()), "red": int(pixels_of(r)[:, :, 0].sum(dtype=np.int64)), "imu_pixels": imu}

    return _each(samples_, "stem string, obstacle bigint, red bigint, imu_pixels bigint", kernel)


def decode_masks(images: DataFrame) -> DataFrame:
    """``stem, height, width, labels`` (one byte a pixel) of decoded mask images."""
    kernel = lambda r: {"stem": r.stem, "height": r.height, "width": r.width, "labels": decode_labels(pixels_of(r)).tobytes()}
    return _each(images.select("stem", "height", "width", "channels", "data"), "stem string, height int, width int, labels binary", kernel)


def label_rows(masks: DataFrame) -> DataFrame:
    """``stem, label`` for each label that a mask holds."""

    @F.pandas_udf("array<int>")
    def found(data):
        return data.map(lambda b: np.unique(np.frombuffer(b, np.uint8)).astype(np.int32))

    return masks.select("stem", F.explode(found("labels")).alias("label"))


#: Bits of fraction of a resampling weight.
FRACTION = 22


@cache
def dct(size: int) -> np.ndarray:
    """The orthonormal cosine transform's matrix."""
    k, n = np.arange(size)[:, None], np.arange(size)[None, :]
    scale = np.where(k == 0, np.sqrt(1 / size), np.sqrt(2 / size))
    return scale * np.cos(np.pi * (n + 0.5) * k / size)


def _weights(source: int, target: int) -> np.ndarray:
    """Bilinear resampling matrix: a tent stretched by the scale where the image shrinks, normalised at each output."""
    scale = source / target
    centre = (np.arange(target) + 0.5) * scale
    at = np.arange(source) + 0.5
    w = np.maximum(1 - np.abs(at[None, :] - centre[:, None]) / max(scale, 1.0), 0)
    return w / np.maximum(w.sum(1, keepdims=True), 1e-12)


def resize(image: np.ndarray, size: tuple[int, int], way: str = "bilinear") -> np.ndarray:
    """Resized float image of shape (h, w, ...): ``nearest``, or ``bilinear`` with smoothing on shrinking."""
    h, w = image.shape[:2]
    if way == "nearest":
        y = np.minimum((np.arange(size[0]) + 0.5) * h / size[0], h - 1).astype(int)
        x = np.minimum((np.arange(size[1]) + 0.5) * w / size[1], w - 1).astype(int)
        return image[np.ix_(y, x)]
    rows, cols = _weights(h, size[0]), _weights(w, size[1])
    return np.moveaxis(np.tensordot(rows, np.tensordot(image.astype(np.float64), cols, ([1], [1])), ([1], [0])), -1, 1) if image.ndim > 2 else rows @ image @ cols.T


def interpolate(values: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Plain bilinear interpolation of (channels, h, w) between pixel centres, edges repeated."""
    out = values
    for axis, target in ((1, size[0]), (2, size[1])):
        n = out.shape[axis]
        at = np.clip((np.arange(target) + 0.5) * n / target - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        high = np.minimum(low + 1, n - 1)
        part = (at - low).reshape([-1 if k == axis else 1 for k in range(3)])
        out = np.take(out, low, axis) * (1 - part) + np.take(out, high, axis) * part
    return out


@cache
def fixed_weights(source: int, target: int) -> np.ndarray:
    """Lanczos resampling matrix (target, source) in whole numbers of 22 bits' fraction, as imaging libraries resample bytes.

    An output pixel takes the source pixels whose centres lie within three (stretched where the image shrinks) of its own.
    """
    scale = source / target
    stretch = max(scale, 1.0)
    out = np.zeros((target, source), np.int64)
    for k in range(target):
        centre = (k + 0.5) * scale
        low, high = max(int(centre - 3 * stretch + 0.5), 0), min(int(centre + 3 * stretch + 0.5), source)
        t = (np.arange(low, high) - centre + 0.5) / stretch
        w = np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0.0)
        w = w / w.sum() * (1 << FRACTION)
        out[k, low:high] = np.where(w < 0, np.ceil(w - 0.5), np.floor(w + 0.5))
    return out


def resize_bytes(image: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Gray bytes (h, w) resampled by ``fixed_weights``: columns first, then rows, rounded to bytes after each; exact in double precision."""
    for axis in (1, 0):
        if image.shape[axis] != size[axis]:
            weights = fixed_weights(image.shape[axis], size[axis]).astype(float)
            sums = image @ weights.T if axis else weights @ image
            image = np.clip(np.floor((sums + (1 << FRACTION - 1)) / (1 << FRACTION)), 0, 255)
    return image


def phash(pixels: np.ndarray) -> int:
    """Signed 64-bit perceptual hash: gray, 32 x 32, cosine transform, low 8 x 8 block against its median without the first.

    Coefficients are rounded to six places, so that those that vanish are equal on every machine.
    """
    rgb = pixels[:, :, :3].astype(np.int64)
    gray = rgb[:, :, 0] if rgb.shape[2] == 1 else (rgb @ np.array([19595, 38470, 7471]) + 32768) >> 16
    small = resize_bytes(gray.astype(float), (32, 32))
    low = np.round((dct(32) @ small @ dct(32).T)[:8, :8].reshape(-1), 6)
    bits = np.packbits(low > np.median(low[1:]))
    return int(np.frombuffer(bits.tobytes(), ">i8")[0])


def image_hashes(images: DataFrame) -> DataFrame:
    """``stem, h`` of decoded images."""
    return _each(images.select("stem", "height", "width", "channels", "data"), "stem string, h bigint", lambda r: {"stem": r.stem, "h": phash(pixels_of(r))})


def plan(height: int, width: int, target: tuple[int, int], mode: str) -> dict:
    """The geometry struct for one image, as ``functions.geometry`` gives it for a column."""
    h, w = target
    out = {"mode": mode, "original": (height, width), "target": target, "resized": target, "padding": None, "crop": None}
    if mode == "stretch":
        return out
    pick = min if mode == "letterbox" else max
    scale = pick(h / height, w / width)
    rh, rw = max(1, round(height * scale)), max(1, round(width * scale))
    out["resized"] = (rh, rw)
    if mode == "letterbox":
        left, top = (w - rw) // 2, (h - rh) // 2
        out["padding"] = (left, top, w - rw - left, h - rh - top)
    elif mode == "center_crop":
        left, top = (rw - w) // 2, (rh - h) // 2
        out["crop"] = (left, top, left + w, top + h)
    else:
        raise ValueError(f"unknown geometry mode: {mode}")
    return out


def to_model(pixels: np.ndarray, target: tuple[int, int], mode: str) -> np.ndarray:
    """Normalised (3, h, w) input; letterbox pads with zeros after normalisation."""
    g = plan(pixels.shape[0], pixels.shape[1], target, mode)
    rgb = np.repeat(pixels, 3, 2) if pixels.shape[2] == 1 else pixels[:, :, :3]
    x = np.clip(np.rint(resize(rgb.astype(np.float64), g["resized"])), 0, 255)
    if g["crop"]:
        left, top, right, bottom = g["crop"]
        x = x[top:bottom, left:right]
    x = (x / 255.0 - np.array(MEAN)) / np.array(STD)
    if g["padding"]:
        left, top, right, bottom = g["padding"]
        x = np.pad(x, ((top, bottom), (left, right), (0, 0)))
    return np.moveaxis(x, 2, 0).astype(np.float32)


def from_model(logits: np.ndarray, original: tuple[int, int], target: tuple[int, int], mode: str) -> np.ndarray:
    """Labels in the source image: logits are brought back bilinearly, then the largest class wins; what the model did not see is unknown."""
    g = plan(*original, target, mode)
    if logits.shape[1:] != tuple(target):
        logits = interpolate(logits, target)
    seen = np.ones(original, bool)
    if mode == "letterbox":
        left, top, right, bottom = g["padding"]
        logits = logits[:, top : target[0] - bottom, left : target[1] - right]
    elif mode == "center_crop":
        left, top, right, bottom = g["crop"]
        full, inside = np.zeros((logits.shape[0], *g["resized"])), np.zeros(g["resized"], bool)
        full[:, top:bottom, left:right] = logits
        inside[top:bottom, left:right] = True
        y = np.minimum(np.arange(original[0]) * inside.shape[0] // original[0], inside.shape[0] - 1)
        x = np.minimum(np.arange(original[1]) * inside.shape[1] // original[1], inside.shape[1] - 1)
        logits, seen = full, inside[np.ix_(y, x)]
    return np.where(seen, interpolate(logits, original).argmax(0), UNKNOWN).astype(np.uint8)


def resize_masks(masks: DataFrame, height: int, width: int) -> DataFrame:
    """Label masks brought to a size by their nearest pixels."""

    def kernel(r):
        data = np.frombuffer(r.labels, np.uint8).reshape(r.height, r.width)
        return {"stem": r.stem, "height": height, "width": width, "labels": resize(data, (height, width), "nearest").tobytes()}

    return _each(masks.select("stem", "height", "width", "labels"), "stem string, height int, width int, labels binary", kernel)


def resize_pixels(pixels: DataFrame, sizes: DataFrame, height: int, width: int) -> DataFrame:
    """The same as a gather over pixel rows: each output pixel takes the source pixel under its centre. ``sizes(stem, height, width)``."""
    grid = sizes.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    src = lambda at, have, want: F.least(F.floor((F.col(at) + 0.5) * F.col(have) / want), F.col(have) - 1)
    grid = grid.select("stem", "y", "x", src("y", "height", height).alias("sy"), src("x", "width", width).alias("sx"))
    return grid.join(pixels.withColumnsRenamed({"y": "sy", "x": "sx"}).hint("merge"), ["stem", "sy", "sx"]).drop("sy", "sx")


def _shift_hue(x: np.ndarray, turn: float) -> np.ndarray:
    """Rotate the hue of (h, w, 3) values in [0, 1] by a share of the circle."""
    top, low = x.max(2), x.min(2)
    span = np.maximum(top - low, 1e-12)
    r, g, b = x[:, :, 0], x[:, :, 1], x[:, :, 2]
    hue = np.where(top == r, (g - b) / span % 6, np.where(top == g, (b - r) / span + 2, (r - g) / span + 4)) / 6
    hue = (np.where(top > low, hue, 0) + turn) % 1.0
    k = (np.array([5.0, 3.0, 1.0])[None, None, :] + hue[:, :, None] * 6) % 6
    return top[:, :, None] - (top - low)[:, :, None] * np.clip(np.minimum(k, 4 - k), 0, 1)


def augment(pixels: np.ndarray, labels: np.ndarray, ops: dict[str, tuple[bool, float]], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Image in [0, 1] and labels after the planned ops, in their fixed order; the flip moves both."""
    x = np.repeat(pixels, 3, 2) if pixels.shape[2] == 1 else pixels[:, :, :3]
    x = x.astype(np.float64) / 255.0
    on = lambda name: name in ops and ops[name][0]
    if on("horizontal_flip"):
        x, labels = x[:, ::-1], labels[:, ::-1]
    if on("brightness"):
        x = np.clip(x * ops["brightness"][1], 0, 1)
    gray = lambda v: (v * [0.2989, 0.587, 0.114]).sum(2, keepdims=True)
    if on("contrast"):
        x = np.clip(gray(x).mean() + (x - gray(x).mean()) * ops["contrast"][1], 0, 1)
    if on("saturation"):
        x = np.clip(gray(x) + (x - gray(x)) * ops["saturation"][1], 0, 1)
    if on("hue"):
        x = _shift_hue(x, ops["hue"][1])
    if on("gamma"):
        x = x ** ops["gamma"][1]
    if on("gaussian_blur"):
        s = max(ops["gaussian_blur"][1], 1e-3)
        t = np.arange(-int(3 * s + 1), int(3 * s + 1) + 1)
        w = np.exp(-t * t / (2 * s * s))
        w /= w.sum()
        for axis in (0, 1):
            pad = [(len(t) // 2, len(t) // 2) if k == axis else (0, 0) for k in range(3)]
            x = np.apply_along_axis(lambda v: np.convolve(v, w, "valid"), axis, np.pad(x, pad, mode="edge"))
    if on("jpeg"):
        x = compressed(np.rint(np.clip(x, 0, 1) * 255).astype(np.uint8), round(ops["jpeg"][1])) / 255.0
    if on("fog"):
        x = x * (1 - ops["fog"][1]) + ops["fog"][1]
    if on("gaussian_noise"):
        x = np.clip(x + np.random.default_rng(seed).normal(0, ops["gaussian_noise"][1], x.shape), 0, 1)
    return x, labels


def apply_augmentation(samples: DataFrame, planned: DataFrame) -> DataFrame:
    """``stem, variant, height, width, image (bytes), labels``: ``samples(stem, height, width, channels, data, labels)`` after ``augmentation_plan``."""
    ops = F.map_from_entries(F.collect_list(F.struct("op", F.struct("applied", "value"))))
    by_variant = planned.groupBy("stem", "variant", "variant_seed").agg(ops.alias("ops"))
    rows = samples.join(by_variant, "stem").select("stem", "variant", "variant_seed", "height", "width", "channels", "data", "labels", "ops")

    def kernel(r):
        plan_ = {k: (v["applied"], v["value"]) if isinstance(v, dict) else (v[0], v[1]) for k, v in dict(r.ops).items()}
        x, labels = augment(pixels_of(r), np.frombuffer(r.labels, np.uint8).reshape(r.height, r.width), plan_, int(r.variant_seed))
        return {"stem": r.stem, "variant": r.variant, "height": r.height, "width": r.width, "image": np.rint(x * 255).astype(np.uint8).tobytes(), "labels": np.ascontiguousarray(labels).tobytes()}

    return _each(rows, "stem string, variant int, height int, width int, image binary, labels binary", kernel)


def rgb_rows(images: DataFrame) -> DataFrame:
    """``stem, variant, y, x, red, green, blue`` of augmented images."""
    return unrolled(images, ["stem", "variant"], "image", {"red": "int", "green": "int", "blue": "int"}, 3)
