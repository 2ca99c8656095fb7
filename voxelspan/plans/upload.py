"""An upload from its parts to what a viewer gets: points, levels of detail, a reduced file, and the messages of all."""

from __future__ import annotations

from dataclasses import dataclass, field
from glob import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspan.functions import scalar
from voxelspan.operators import events, octree, reduce
from voxelspan.schema import OCTREE_DEPTH, WINDOW_POINTS, Header, Options
from voxelspan.sources import las, parts
from voxelspan.sources.storage import shared_dir, stored


@dataclass
class Upload:
    """header of the file; points as sent, in file order or by cells; levels by name; uri of the reduced file; messages."""

    header: Header
    points: DataFrame
    levels: dict[str, DataFrame] = field(default_factory=dict)
    file: str | None = None
    messages: DataFrame | None = None


def process_landed(spark: SparkSession, folder: str, uploader_id: str, session: str = "", **settings) -> Upload:
    """process() of the upload whose parts lie in a landing folder, as the options say that came with it; without any, by default."""
    found = parts.read_options(spark, folder).where(F.col("uploader_id") == uploader_id).limit(1).collect()
    options = Options(*[found[0][c] for c in ("clustering", "subsample", "lod", "density")]) if found else Options()
    return process(spark, f"{folder}/{escape(uploader_id)}.*.part", options, session, **settings)


def process(spark: SparkSession, uri: str, options: Options, session: str = "", folder: str | None = None, depth: int = OCTREE_DEPTH, window: int = WINDOW_POINTS) -> Upload:
    """Runs an upload's parts, the files that uri names (las.Parts), as its options say.

    Without clustering: sampled if asked for, centred, sent in windows. With it: sampled, dealt to cells, reduced,
    centred; sent, written as a reduced file, and with lod sent as two coarser levels. Sampling is done by the scan.
    Parts are read where they lie, by ranges of records, and only the header comes to the driver. Levels are stored once:
    messages, the file and the coarser levels are made from what was stored.
    """
    h = las.read_header(uri)
    rate = options.keep_rate if options.subsample else None
    points = las.read_points(spark, uri, records_per_partition=window, sample=rate)
    told = [events.session(spark, 0, session), events.progress(spark, 1, events.PARSING), events.header(spark, 2, h)]
    if not options.clustering:
        sent = points.withColumns(scalar.centred(h))
        told.append(events.window_points(reduce.window_chunks(sent, window, sampled=options.subsample), 5))
        out = Upload(h, sent)
    else:
        cells = octree.assign_cells(points, h.box(), depth)
        told += [events.progress(spark, 3, events.OPTIMIZING), events.progress(spark, 4, events.CLUSTERING)]
        levels = reduce.levels_of_detail(cells, len(options.levels) - 1, watch=lambda k, level: stored(level), depth=depth)
        moved = {name: df.withColumns(scalar.centred(h)) for name, df in zip(options.levels, levels)}
        told.append(events.clustered_points(moved["base"], 5, depth))
        for k, name in enumerate(options.levels[1:], 1):
            told.append(events.level_points(moved[name], 5 + k, name, depth - k))
        target = folder or f"{shared_dir(spark)}/reduced"
        las.write_reduced(las.file_records(moved["base"], h), uri, target)
        told.append(events.file_ready(spark, 8, target))
        out = Upload(h, moved["base"], moved, target)
    told.append(events.done(spark, 9))
    out.messages = told[0]
    for t in told[1:]:
        out.messages = out.messages.unionByName(t)
    return out
