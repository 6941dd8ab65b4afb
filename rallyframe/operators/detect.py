"""Contract for detection models, which are the user's: batches of frame rows in, detection rows out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.sources.schemas import SCHEMAS

Model = Callable[[pd.DataFrame], pd.DataFrame]


def detect(frames: DataFrame, load: Callable[[], Model], table: str) -> DataFrame:
    """Runs a model over ``frames``: ``load`` makes it once for each task; its rows take the schema of fact ``table``.

    A frame batch that the model fails on fails the job; ``detect_apart`` keeps videos apart.
    """
    schema = SCHEMAS[table]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            yield model(b)[names]

    return frames.mapInPandas(run, schema)


def detect_apart(frames: DataFrame, load: Callable[[], Model], table: str, path: str) -> tuple[DataFrame, DataFrame]:
    """The same so that a video the model fails on doesn't stop the others: (rows, rejects).

    The model runs once, into a table at ``path`` of detections and errors. A batch that fails is tried again video by video;
    a video with an error is rejected whole, with its first error: ``rejects`` is (video_id, reject_reason), one row a video.
    A model that can't be loaded still fails the job.
    """
    schema = SCHEMAS[table]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            try:
                yield model(b)[names].assign(error_frame=None, error=None)
                continue
            except Exception:  # noqa: BLE001, S110
                pass
            for video, own in b.groupby("video_id", sort=True):
                try:
                    yield model(own)[names].assign(error_frame=None, error=None)
                except Exception as e:  # noqa: BLE001
                    yield pd.DataFrame({**dict.fromkeys(names), "video_id": [video], "error_frame": [own["frame_num"].min()], "error": [f"{type(e).__name__}: {e}"]})

    frames.mapInPandas(run, f"{schema}, error_frame int, error string").write.parquet(path)
    made = frames.sparkSession.read.schema(f"{schema}, error_frame int, error string").parquet(path)
    rejects = made.filter("error is not null").groupBy("video_id").agg(F.min_by("error", F.struct("error_frame", "error")).alias("reject_reason"))
    return made.filter("error is null").select(*names).join(rejects.select("video_id"), "video_id", "left_anti"), rejects
