"""Tracker configurations and a ByteTrack-style tracker (two-stage association of boxes) as a grouped map per video."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, fields, make_dataclass
from enum import StrEnum
from pathlib import Path
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linking import assign


class MOTModels(StrEnum):
    BOTSORT = "botsort"
    BOOSTTRACK = "boosttrack"
    BYTE_TRACK = "bytetrack"
    OCSORT = "ocsort"
    STRONGSORT = "strongsort"
    DEEPOCSORT = "deepocsort"
    HYBRIDSORT = "hybridsort"
    SFSORT = "sfsort"


@dataclass
class MOTBaseConfig:
    """What all trackers share. Keys a tracker doesn't know land in extra_kwargs when read from a mapping."""

    model: MOTModels = MOTModels.BOTSORT
    per_class: bool = False
    extra_kwargs: dict[str, Any] = field(default_factory=dict)

    def to_kwargs(self) -> dict[str, Any]:
        out = {k: v for k, v in asdict(self).items() if k not in ("model", "extra_kwargs")}
        return out | self.extra_kwargs

    def to_dict(self) -> dict[str, Any]:
        return {k: str(v) if isinstance(v, StrEnum) else v for k, v in asdict(self).items()}

    @classmethod
    def from_dict(cls, data: dict[str, Any]):
        known = {f.name for f in fields(cls)}
        own = {k: v for k, v in data.items() if k in known}
        extra = dict(own.pop("extra_kwargs", None) or {}) | {k: v for k, v in data.items() if k not in known}
        if "model" in own:
            own["model"] = MOTModels(own["model"])
        return cls(**own, extra_kwargs=extra)

    def export_yaml(self, path: str) -> None:
        """One `key: value` line per field; values are JSON, which YAML reads too."""
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text("".join(f"{k}: {json.dumps(v)}\n" for k, v in self.to_dict().items()))

    @classmethod
    def import_yaml(cls, path: str):
        return cls.from_dict(read_yaml(path))


def read_yaml(path: str) -> dict[str, Any]:
    """A flat mapping of scalars and flow values, indented lines being a nested mapping; anything else raises ValueError."""
    out: dict[str, Any] = {}
    inner: dict[str, Any] | None = None
    for line in Path(path).read_text().splitlines():
        text = line.split(" #")[0].rstrip()
        if not text.strip() or text.lstrip().startswith("#"):
            continue
        key, mark, value = text.partition(":")
        if not mark or key.strip().startswith("-"):
            raise ValueError("the file holds no mapping")
        value = value.strip()
        try:
            parsed = json.loads(value) if value else {}
        except ValueError:
            words = {"~": None, "True": True, "False": False, "None": None}
            parsed = words.get(value, value.strip("'\""))
        if line[:1] in " \t" and inner is not None:
            inner[key.strip()] = parsed
        else:
            out[key.strip()] = parsed
            inner = parsed if not value else None
    return out


# The trackers' parameters and their defaults.
_REID = {"reid_weights": "osnet_x1_0_msmt17.pt"}
_AGE = {"det_thresh": 0.3, "max_age": 30, "min_hits": 3, "iou_threshold": 0.3, "asso_func": "iou"}
_MOVE = {"delta_t": 3, "inertia": 0.2}
DEFAULTS: dict[MOTModels, dict[str, Any]] = {
    MOTModels.BOTSORT: {**_REID, "track_high_thresh": 0.5, "track_low_thresh": 0.1, "new_track_thresh": 0.6, "match_thresh": 0.8, "track_buffer": 30, "with_reid": True, "proximity_thresh": 0.5, "appearance_thresh": 0.25},
    MOTModels.BOOSTTRACK: {**_REID, **_AGE},
    MOTModels.BYTE_TRACK: {"track_thresh": 0.5, "match_thresh": 0.8, "track_buffer": 30, "frame_rate": 30},
    MOTModels.OCSORT: {**_AGE, **_MOVE},
    MOTModels.STRONGSORT: {**_REID, "max_dist": 0.2, "max_iou_dist": 0.7, "max_age": 70, "n_init": 3, "nn_budget": 100, "ema_alpha": 0.9, "mc_lambda": 0.995},
    MOTModels.DEEPOCSORT: {**_REID, **_AGE, **_MOVE},
    MOTModels.HYBRIDSORT: {**_REID, **_AGE},
    MOTModels.SFSORT: {**_AGE},
}


def _config(name: str, model: MOTModels):
    own = [("model", MOTModels, field(default=model))] + [(k, type(v), field(default=v)) for k, v in DEFAULTS[model].items()]
    return make_dataclass(name, own, bases=(MOTBaseConfig,), module=__name__)


BoTSORTConfig = BOTSORTConfig = _config("BoTSORTConfig", MOTModels.BOTSORT)
BoostTrackConfig = _config("BoostTrackConfig", MOTModels.BOOSTTRACK)
ByteTrackConfig = _config("ByteTrackConfig", MOTModels.BYTE_TRACK)
OCSORTConfig = _config("OCSORTConfig", MOTModels.OCSORT)
StrongSORTConfig = _config("StrongSORTConfig", MOTModels.STRONGSORT)
DeepOCSORTConfig = _config("DeepOCSORTConfig", MOTModels.DEEPOCSORT)
HybridSORTConfig = _config("HybridSORTConfig", MOTModels.HYBRIDSORT)
SFSORTConfig = SFSortConfig = _config("SFSORTConfig", MOTModels.SFSORT)
CONFIGS = {
    MOTModels.BOTSORT: BoTSORTConfig, MOTModels.BOOSTTRACK: BoostTrackConfig, MOTModels.BYTE_TRACK: ByteTrackConfig, MOTModels.OCSORT: OCSORTConfig,
    MOTModels.STRONGSORT: StrongSORTConfig, MOTModels.DEEPOCSORT: DeepOCSORTConfig, MOTModels.HYBRIDSORT: HybridSORTConfig, MOTModels.SFSORT: SFSORTConfig,
}


def import_config(path: str) -> MOTBaseConfig:
    """The configuration class that the file's model names (BoT-SORT without one)."""
    data = read_yaml(path)
    return CONFIGS[MOTModels(data.get("model", "botsort"))].from_dict(data)


def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    across = np.minimum(a[:, None, 0] + a[:, None, 2], b[None, :, 0] + b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    down = np.minimum(a[:, None, 1] + a[:, None, 3], b[None, :, 1] + b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    both = np.maximum(across, 0) * np.maximum(down, 0)
    union = (a[:, 2] * a[:, 3])[:, None] + (b[:, 2] * b[:, 3])[None] - both
    return both / np.maximum(union, 1e-6)


class ByteTracker:
    """State of one video: tracks with a constant-velocity filter per box figure, lost ones kept for a while.

    step() takes the boxes of one frame (x, y, w, h, score, class); frames without boxes must be stepped too.
    """

    def __init__(self, track_thresh: float = 0.5, match_thresh: float = 0.8, track_buffer: int = 30, frame_rate: int = 30, low_thresh: float = 0.1):
        self.high, self.low, self.match, self.new = track_thresh, low_thresh, match_thresh, track_thresh + 0.1
        self.keep = int(frame_rate / 30 * track_buffer)
        self.tracks: list[dict[str, Any]] = []
        self.next, self.first = 1, True

    @staticmethod
    def _predict(t: dict[str, Any]) -> None:
        if t["lost"]:
            t["v"][2:] = 0
        t["x"] = t["x"] + t["v"]
        size = max(t["x"][3], 1.0)
        q, qv = (size / 20) ** 2, (size / 160) ** 2
        a, b, c = t["p"]
        t["p"] = [a + 2 * b + c + q, b + c, c + qv]

    @staticmethod
    def _update(t: dict[str, Any], z: np.ndarray) -> None:
        a, b, c = t["p"]
        r = (max(z[3], 1.0) / 20) ** 2
        g, h = a / (a + r), b / (a + r)
        gap = z - t["x"]
        t["x"], t["v"] = t["x"] + g * gap, t["v"] + h * gap
        t["p"] = [(1 - g) * a, (1 - g) * b, c - h * b]

    @staticmethod
    def _box(t: dict[str, Any]) -> np.ndarray:
        cx, cy, w, h = t["x"]
        return np.array([cx - w / 2, cy - h / 2, max(w, 1e-3), max(h, 1e-3)])

    def _pair(self, tracks: list, dets: np.ndarray, most: float, weigh: bool) -> tuple[list, list, list]:
        if not tracks or not len(dets):
            return [], list(range(len(tracks))), list(range(len(dets)))
        iou = _iou(np.array([self._box(t) for t in tracks]), dets[:, :4])
        cost = 1 - (iou * dets[None, :, 4] if weigh else iou)
        pairs = assign(np.where(cost <= most, cost, np.inf))
        used_t, used_d = {i for i, _ in pairs}, {j for _, j in pairs}
        return pairs, [i for i in range(len(tracks)) if i not in used_t], [j for j in range(len(dets)) if j not in used_d]

    def _hit(self, t: dict[str, Any], d: np.ndarray) -> None:
        self._update(t, np.array([d[0] + d[2] / 2, d[1] + d[3] / 2, d[2], d[3]]))
        t.update(lost=0, seen=True, active=True, score=float(d[4]), cls=int(d[5]))

    def step(self, dets: np.ndarray) -> list[tuple]:
        """Boxes of this frame that belong to a confirmed track: (id, x, y, w, h, score, class)."""
        dets = np.asarray(dets, float).reshape(-1, 6)
        high = dets[dets[:, 4] >= self.high]
        low = dets[(dets[:, 4] > self.low) & (dets[:, 4] < self.high)]
        for t in self.tracks:
            t["seen"] = False
            self._predict(t)
        sure = [t for t in self.tracks if t["active"]]
        fresh = [t for t in self.tracks if not t["active"]]
        pairs, rest_t, rest_d = self._pair(sure, high, self.match, True)
        for i, j in pairs:
            self._hit(sure[i], high[j])
        left = [sure[i] for i in rest_t]
        second = [t for t in left if not t["lost"]]
        pairs, _, _ = self._pair(second, low, 0.5, False)
        for i, j in pairs:
            self._hit(second[i], low[j])
        high = high[rest_d]
        pairs, gone, rest_d = self._pair(fresh, high, 0.7, True)
        for i, j in pairs:
            self._hit(fresh[i], high[j])
        dropped = {id(fresh[i]) for i in gone}
        for t in left:
            t["lost"] += not t["seen"]
        self.tracks = [t for t in self.tracks if id(t) not in dropped and t["lost"] <= self.keep]
        for d in high[rest_d]:
            if d[4] >= self.new:
                size = max(d[3], 1.0)
                t = {"id": self.next, "x": np.array([d[0] + d[2] / 2, d[1] + d[3] / 2, d[2], d[3]]), "v": np.zeros(4), "p": [(size / 10) ** 2, 0.0, (size / 16) ** 2], "lost": 0, "seen": True, "active": self.first, "score": float(d[4]), "cls": int(d[5])}
                self.next += 1
                self.tracks.append(t)
        self.first = False
        return [(t["id"], *self._box(t), t["score"], t["cls"]) for t in self.tracks if t["active"] and t["seen"]]


class ByClass:
    """A tracker for each class, all with ids of one sequence."""

    def __init__(self, make):
        self.make, self.each, self.ids = make, {}, {}

    def step(self, dets: np.ndarray) -> list[tuple]:
        """As of one tracker; every class that was ever seen is stepped, in the order of its number."""
        dets = np.asarray(dets, float).reshape(-1, 6)
        for c in np.unique(dets[:, 5]).tolist():
            self.each.setdefault(c, self.make())
        out = []
        for c in sorted(self.each):
            for hit in self.each[c].step(dets[dets[:, 5] == c]):
                out.append((self.ids.setdefault((c, hit[0]), len(self.ids) + 1), *hit[1:]))
        return out


OUT = "frame int, track int, x int, y int, w int, h int, score double, cls int, r3 int, r4 int"


def rows_of(frame: int, hits: list[tuple], output_score_cls: bool) -> list[tuple]:
    return [(frame, i, *(int(round(v)) for v in (x, y, w, h)), round(s, 2) if output_score_cls else -1.0, c if output_score_cls else -1, -1, -1) for i, x, y, w, h, s, c in hits]


def track(dets: DataFrame, config: MOTBaseConfig | None = None, by: Sequence[str] = ("video_id",), start_frame: int | None = None, end_frame: int | None = None, output_score_cls: bool = True) -> DataFrame:
    """Tracks of every video: *by and the ten track columns.

    dets: *by, frame, x, y, w, h, conf, class. Frames are stepped in order from the first to the last, empty
    ones too. Only the geometric ByteTrack parameters are known here; others raise ValueError. A video is one
    sequential state and so one task; videos run in parallel. With per_class boxes of different classes never
    meet in a track.
    """
    config = config or ByteTrackConfig()
    known = set(DEFAULTS[MOTModels.BYTE_TRACK]) | {"low_thresh"}
    options = {k: v for k, v in config.to_kwargs().items() if k != "per_class"}
    if config.model != MOTModels.BYTE_TRACK or set(options) - known:
        raise ValueError(f"only bytetrack with {', '.join(sorted(known))} runs in this engine")
    keys = list(by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tracker = ByClass(lambda: ByteTracker(**options)) if config.per_class else ByteTracker(**options)
        pdf = pdf.sort_values(["frame", "conf", "x", "y", "w", "h"], ascending=[True, False, True, True, True, True])
        frames, dets = pdf["frame"].to_numpy(), pdf[["x", "y", "w", "h", "conf", "class"]].to_numpy(float)
        at = np.flatnonzero(np.append(True, frames[1:] != frames[:-1]))
        groups = {f: dets[a:b] for f, a, b in zip(frames[at].tolist(), at.tolist(), [*at[1:].tolist(), len(dets)])}
        first = min(groups) if start_frame is None else start_frame
        last = max(groups) if end_frame is None else end_frame
        none = np.zeros((0, 6))
        out: list[tuple] = []
        for frame in range(int(first), int(last) + 1):
            out += rows_of(frame, tracker.step(groups.get(frame, none)), output_score_cls)
        got = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
        return got.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, *got.columns]]

    kinds = "".join(f"`{c}` {dets.schema[c].dataType.simpleString()}, " for c in keys)
    return dets.groupBy(*(keys or [F.lit(0)])).applyInPandas(run, kinds + OUT)


def track_batch(spark, det_paths: Sequence[str], out_path: str, config: MOTBaseConfig | None = None, overwrite: bool = False, suffix: str = "_iou", output_score_cls: bool = True) -> DataFrame:
    """Track many detection files at once, the video id being the file's stem without suffix, and write headerless track
    tables under out_path/video_id=.... Videos already there are skipped unless overwritten. Returns the manifest of the
    videos tracked (video_id, rows)."""
    from ..sources.files import read_detections

    dets = read_detections(spark, list(det_paths), video_from_name=suffix)
    path = spark._jvm.org.apache.hadoop.fs.Path(out_path)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    if there and not overwrite:
        done = spark.read.option("basePath", out_path).option("inferSchema", False).csv(out_path).select(F.col("video_id").cast("string").alias("video_id")).distinct()
        dets = dets.join(done, "video_id", "left_anti")
    out = track(dets, config, output_score_cls=output_score_cls)
    out.write.mode("overwrite" if overwrite else "append").partitionBy("video_id").csv(out_path)
    return dets.groupBy("video_id").agg(F.count(F.lit(1)).alias("rows"))


class Tracker:
    """A configuration (a file's over an object's, BoT-SORT's without either) and what runs with it."""

    def __init__(self, config: MOTBaseConfig | None = None, config_yaml: str | None = None, output_score_cls: bool = True):
        self.config = import_config(config_yaml) if config_yaml else config or BoTSORTConfig()
        self.output_score_cls = output_score_cls

    def track(self, dets: DataFrame, by: Sequence[str] = ("video_id",), **frames) -> DataFrame:
        return track(dets, self.config, by, output_score_cls=self.output_score_cls, **frames)

    def track_batch(self, spark, det_paths: Sequence[str], out_path: str, **more) -> DataFrame:
        return track_batch(spark, det_paths, out_path, self.config, output_score_cls=self.output_score_cls, **more)

    def export_current_config_to_yaml(self, path: str) -> None:
        self.config.export_yaml(path)

    export_current_params_to_yaml = export_current_config_to_yaml
    export_config_to_yaml = export_params_to_yaml = staticmethod(lambda path, config: config.export_yaml(path))
    import_config_from_yaml = import_params_from_yaml = staticmethod(import_config)
