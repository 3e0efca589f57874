"""Frames to candidates: letterbox, model run and decoding of its output, fused in one pass over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import INPUT_SIZE
from tessera.operators.detect import LEAST_CONFIDENCE

PAD = 114
OUTPUT_SHAPE = (1, 84, 8400)
CANDIDATES = "source string, frame_index long, media_ms double, inference_ms double, class_id int, confidence float, x_min float, y_min float, x_max float, y_max float"
_sessions: dict = {}


def check_contract(inputs, outputs) -> None:
    """A model has one float input of 1x3x640x640 and one float output of 1x84x8400."""
    for name, ports, shape in (("input", inputs, (1, 3, INPUT_SIZE, INPUT_SIZE)), ("output", outputs, OUTPUT_SHAPE)):
        if len(ports) != 1:
            raise ValueError(f"model has {len(ports)} {name}s, not 1")
        if ports[0].type != "tensor(float)" or tuple(ports[0].shape) != shape:
            raise ValueError(f"model {name} is {ports[0].type} {ports[0].shape}, not float {list(shape)}")


def onnx_model(path: str) -> Callable[[np.ndarray], np.ndarray]:
    """A model that a worker loads once, with all graph optimisations."""

    def run(tensor: np.ndarray) -> np.ndarray:
        if path not in _sessions:
            import onnxruntime as ort

            options = ort.SessionOptions()
            options.graph_optimization_level = ort.GraphOptimizationLevel.ORT_ENABLE_ALL
            session = ort.InferenceSession(path, options, providers=["CPUExecutionProvider"])
            check_contract(session.get_inputs(), session.get_outputs())
            _sessions[path] = session
        session = _sessions[path]
        return session.run(None, {session.get_inputs()[0].name: tensor})[0]

    return run


def fit(width: int, height: int) -> tuple[np.float32, int, int, int, int]:
    """scale, resized width and height, left and top pad."""
    if width <= 0 or height <= 0:
        raise ValueError(f"frame of {width}x{height}")
    scale = np.float32(min(np.float32(INPUT_SIZE) / np.float32(width), np.float32(INPUT_SIZE) / np.float32(height)))
    w, h = int(np.float32(width) * scale + np.float32(0.5)), int(np.float32(height) * scale + np.float32(0.5))
    return scale, w, h, (INPUT_SIZE - w) // 2, (INPUT_SIZE - h) // 2


def resized(image: np.ndarray, w: int, h: int) -> np.ndarray:
    """Bilinear, with pixel centres at halves and edges held."""
    def axis(n: int, m: int):
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), (at - low).astype(np.float32)

    y0, y1, fy = axis(image.shape[0], h)
    x0, x1, fx = axis(image.shape[1], w)
    image = image.astype(np.float32)
    rows = image[y0] * (1 - fy)[:, None, None] + image[y1] * fy[:, None, None]
    return np.rint(rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None]).astype(np.uint8)


def prepared(bgr: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The padded RGB planes from 0 to 1 that the model takes, and the transform back."""
    if bgr.ndim != 3 or bgr.shape[2] != 3 or bgr.dtype != np.uint8 or not bgr.size:
        raise ValueError(f"not an 8-bit BGR frame: {bgr.dtype} {bgr.shape}")
    height, width = bgr.shape[:2]
    scale, w, h, left, top = fit(width, height)
    canvas = np.full((INPUT_SIZE, INPUT_SIZE, 3), PAD, np.uint8)
    canvas[top : top + h, left : left + w] = resized(bgr, w, h)
    planes = np.ascontiguousarray(canvas[:, :, ::-1].transpose(2, 0, 1)).astype(np.float32) / np.float32(255)
    return planes[None], (scale, left, top, width, height)


def decoded(output: np.ndarray, transform: tuple, least: float = LEAST_CONFIDENCE) -> pd.DataFrame:
    """Candidates above the threshold in source pixels; empty boxes are dropped."""
    if output.shape != OUTPUT_SHAPE or output.dtype != np.float32:
        raise ValueError(f"model output is {output.dtype} {output.shape}")
    cx, cy, w, h = output[0, :4]
    scores = output[0, 4:]
    # a NaN in the first class sticks, others are passed over
    best = np.argmax(np.where(np.isnan(scores), -np.inf, scores), axis=0)
    confidence = np.where(np.isnan(scores[0]), np.nan, scores[best, np.arange(scores.shape[1])])
    with np.errstate(invalid="ignore"):
        ok = np.isfinite([cx, cy, w, h, confidence]).all(axis=0) & (w > 0) & (h > 0) & (confidence >= np.float32(least))
    scale, left, top, width, height = transform
    half = np.float32(2)
    side = lambda c, d, pad, most: np.clip((c + d - np.float32(pad)) / scale, 0, np.float32(most)).astype(np.float32)
    found = pd.DataFrame({
        "class_id": best[ok].astype(np.int32), "confidence": confidence[ok].astype(np.float32),
        "x_min": side(cx[ok], -w[ok] / half, left, width), "y_min": side(cy[ok], -h[ok] / half, top, height),
        "x_max": side(cx[ok], w[ok] / half, left, width), "y_max": side(cy[ok], h[ok] / half, top, height),
    })
    return found[(found.x_max > found.x_min) & (found.y_max > found.y_min)]


def candidates_of(frames: DataFrame, model: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """frames: source, frame_index, media_ms, height, width, data (8-bit BGR rows). The tensor never becomes a column.

    Batches are small, for a frame is large; suppression follows as a DataFrame operator.
    """
    import time

    frames.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")

    def run(batches):
        for pdf in batches:
            for source, index, ms, height, width, data in zip(*(pdf[c] for c in ("source", "frame_index", "media_ms", "height", "width", "data"))):
                try:
                    tensor, transform = prepared(np.frombuffer(data, np.uint8).reshape(int(height), int(width), 3))
                    began = time.perf_counter()
                    output = model(tensor)
                    took = 1000 * (time.perf_counter() - began)
                    out = decoded(output, transform)
                except Exception as e:
                    raise RuntimeError(f"source {source}, frame {index}: {e}") from e
                out.insert(0, "source", str(source))
                out.insert(1, "frame_index", int(index))
                out.insert(2, "media_ms", float(ms))
                out.insert(3, "inference_ms", took)
                yield out

    return frames.select("source", "frame_index", "media_ms", "height", "width", F.col("data")).mapInPandas(run, CANDIDATES)
