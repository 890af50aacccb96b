"""Images: decode, encode, and replacement or overlay from a catalog of files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.codecs import dsc, images
from lexloom.operators.catalogs import first_match
from lexloom.schemas import IMAGE

#: Suffixes of catalog files in order of priority: a file replaces an image or is drawn over it.
SUFFIXES = [".psd", ".patch.psd", ".png", ".patch.png"]
REPLACE, OVERLAY = ".png", ".patch.png"


def decode(blobs: DataFrame) -> DataFrame:
    """(path, content) -> images, pixels as BGR(A) rows; content is unwrapped as needed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(p, images.kind(bytes(c)), *images.load(bytes(c))) for p, c in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame([(p, w, h, bpp, k, px.tobytes()) for p, k, w, h, bpp, px in got], columns=["path", "width", "height", "bpp", "codec", "pixels"])

    return blobs.select("path", "content").mapInPandas(run, IMAGE)


def encode(table: DataFrame, form: str = "raw", level: int = -1) -> DataFrame:
    """Images -> (path, content) as raw, png, tga or cbg; with a level packed besides."""
    from lexloom.codecs import cbg

    save = {"raw": images.save_raw, "png": images.to_png, "tga": images.to_tga, "cbg": cbg.save}[form]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            px = [np.frombuffer(bytes(p), np.uint8).reshape(h, w, bpp // 8) for p, w, h, bpp in zip(b["pixels"], b["width"], b["height"], b["bpp"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "content": [dsc.compress_checked(save(x), level) for x in px]})

    return table.mapInPandas(run, "path string, content binary")


def choose(entries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Entries (name) that the catalog (name) replaces or overlays, with the file that does. Names
    are joined before any payload is read or decoded."""
    return first_match(entries, catalog, "name", SUFFIXES).withColumn("overlays", F.col("priority") % 2 == 1)


def overlay(pairs: DataFrame) -> DataFrame:
    """(path, content, patch: raw image blobs) -> (path, content): the patch drawn at (0, 0), raw."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [images.save_raw(images.overlay(images.load(bytes(c))[3], images.load(bytes(p))[3])) for c, p in zip(b["content"], b["patch"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "content": out})

    return pairs.select("path", "content", "patch").mapInPandas(run, "path string, content binary")


def changed(entries: DataFrame, catalog: DataFrame, level: int = 9) -> DataFrame:
    """The entries (arc, k, name, payload) that a catalog of image files (name, content) replaces
    or is drawn over, with their new payload: a raw image, packed. Names meet first, so only
    payloads that change are read and decoded."""
    chosen = choose(entries.select("name").distinct(), catalog)
    files = catalog.select(F.col("name").alias("matched"), F.col("content").alias("file"))
    rows = entries.join(chosen.join(files, "matched").select("name", "overlays", "file"), "name")

    @F.pandas_udf("binary")
    def made(payload: pd.Series, file: pd.Series, overlays: pd.Series) -> pd.Series:
        out = []
        for p, f, over in zip(payload, file, overlays, strict=True):
            new = images.load(bytes(f))[3]
            out.append(dsc.compress_checked(images.save_raw(images.overlay(images.load(bytes(p))[3], new) if over else new), level))
        return pd.Series(out)

    return rows.select("arc", "k", "name", made("payload", "file", "overlays").alias("payload"))
