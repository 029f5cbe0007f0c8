"""Image files derived from the embedding images, written by the executors to the shared folder."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.scratch import qualified, scratch_path
from workload import tables as D

PNG_BYTES = 332  # an uncompressed 8x8 RGBA file


def png(width: int, height: int, rgba: bytes) -> bytes:
    """An uncompressed RGBA PNG."""

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = b"".join(b"\0" + rgba[k * width * 4 : (k + 1) * width * 4] for k in range(height))
    header = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", header) + part(b"IDAT", zlib.compress(lines, 0)) + part(b"IEND", b"")


def image_files(spark: SparkSession, sf_dir: str) -> str:
    """One PNG per embedding image, and a broken .jpg for every 50th; returns the folder."""
    folder = scratch_path(spark, "files")
    images: DataFrame = D.images(spark, sf_dir)
    target = qualified(spark, folder)

    def write(batches):
        store, root = fs.FileSystem.from_uri(target)
        store.create_dir(root, recursive=True)
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                rgba = bytes(v for px in zip(row["r"], row["g"], row["b"], row["a"], strict=True) for v in px)
                with store.open_output_stream(f"{root}/{row['image_id']}.png") as out:
                    out.write(png(row["width"], row["height"], rgba))
                if row["image_id"] % 50 == 0:
                    with store.open_output_stream(f"{root}/broken_{row['image_id']}.jpg") as out:
                        out.write(b"not an image")
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(rows)], pa.int64())})

    images.repartition(8, "image_id").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return folder
