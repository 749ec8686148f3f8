"""Detector output to entities: decoding and non-maximum suppression, vectorised per picture cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Least confidence by night, by day and of what is neither person nor vehicle; overlap that suppresses.
NIGHT, DAY, OTHER, OVERLAP = 0.22, 0.28, 0.45, 0.45
#: The classes of the detector that are kept, by number, and those that are vehicles.
KEPT = {
    0: "person",
    1: "bicycle",
    2: "car",
    3: "motorcycle",
    5: "bus",
    7: "truck",
    9: "traffic light",
    11: "stop sign",
    24: "backpack",
    26: "handbag",
    28: "suitcase",
    39: "bottle",
    43: "knife",
    67: "cell phone",
}
VEHICLES = (1, 2, 3, 5, 7)


def kept_classes(classes: int = 80) -> tuple[list[str], dict[str, str]]:
    """Labels by class number, empty for what is not kept, and the kind of each label."""
    kind = lambda n: "person" if n == 0 else "vehicle" if n in VEHICLES else "object"
    return [KEPT.get(n, "") for n in range(classes)], {label: kind(n) for n, label in KEPT.items()}


def suppress(boxes: np.ndarray, scores: np.ndarray, overlap: float = OVERLAP) -> np.ndarray:
    """Indices of the boxes that stay, the surest first; of boxes that overlap by ``overlap`` or more the surest stays."""
    if not len(boxes):
        return np.empty(0, np.int64)
    boxes = boxes.astype(np.float64)
    area = np.clip(boxes[:, 2] - boxes[:, 0], 0, None) * np.clip(boxes[:, 3] - boxes[:, 1], 0, None)
    left = np.argsort(-scores, kind="stable")
    kept = []
    while len(left):
        i, rest = left[0], left[1:]
        kept.append(i)
        w = np.clip(np.minimum(boxes[i, 2], boxes[rest, 2]) - np.maximum(boxes[i, 0], boxes[rest, 0]), 0, None)
        h = np.clip(np.minimum(boxes[i, 3], boxes[rest, 3]) - np.maximum(boxes[i, 1], boxes[rest, 1]), 0, None)
        union = area[i] + area[rest] - w * h
        left = rest[np.divide(w * h, union, out=np.zeros_like(union), where=union > 0) < overlap]
    return np.asarray(kept, np.int64)


def decode(output: np.ndarray, labels: list[str], kinds: dict[str, str], night: bool, scale: float, pad: tuple[float, float]) -> list[tuple[str, str, float, list[int]]]:
    """Detections of a ``(4 + classes) x n`` tensor: ``type, label, confidence, box`` after suppression."""
    best = output[4:].argmax(axis=0)
    score = output[4:].max(axis=0)
    rows = []
    for i in np.flatnonzero(score >= (NIGHT if night else DAY)):
        label = labels[best[i]]
        kind = kinds.get(label)
        if kind is None or (kind == "object" and score[i] < OTHER):
            continue
        x, y, w, h = output[:4, i]
        corners = np.array([x - w / 2 - pad[0], y - h / 2 - pad[1], x + w / 2 - pad[0], y + h / 2 - pad[1]]) / scale
        rows.append((kind, label, float(score[i]), [int(v) for v in corners]))
    keep = suppress(np.array([r[3] for r in rows]).reshape(-1, 4), np.array([r[2] for r in rows]))
    return [rows[i] for i in keep]


def suppress_boxes(detections: DataFrame, key: str = "cell_id") -> DataFrame:
    """The detections that stay in each cell: ``key, box, confidence`` and the other columns.

    A cell is one picture, so its detections are bounded by the detector; rows without a box are left out.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["box"].map(lambda b: b is not None and len(b) == 4)].reset_index(drop=True)
        boxes = np.array(pdf["box"].tolist()).reshape(-1, 4)
        return pdf.iloc[suppress(boxes, pdf["confidence"].to_numpy(float))]

    return detections.groupBy(key).applyInPandas(run, detections.schema)


def detect(pictures: DataFrame, model, schema: str, columns: list[str]) -> DataFrame:
    """Runs an injected detector, ``model() -> callable(pandas.DataFrame) -> pandas.DataFrame``, made once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = model()
        for pdf in batches:
            yield call(pdf)

    return pictures.select(*columns).mapInPandas(run, schema)
