"""The batch programs: extract catalogs, translate an archive's scripts and images, report
coverage, apply a memory, and the older script tools.

A script is known by its archive and its name: archives may hold scripts of one name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import binary as B
from lexloom.operators import catalogs as K
from lexloom.operators import images as I
from lexloom.operators import scripts as S
from lexloom.sinks import archives as AW
from lexloom.sinks import scripts as SW
from lexloom.sources import archives as AR
from lexloom.sources import catalogs as C
from lexloom.sources.scripts import read_ops

#: Between archive and name in `file`.
_SLASH = "/"


def _scripts(blobs: DataFrame) -> DataFrame:
    """Archives (arc, content) -> (arc, name, file, payload), file being archive and name."""
    rows = AR.lookup(AR.entries(blobs))
    return rows.select("arc", "name", F.concat_ws(_SLASH, "arc", "name").alias("file"), "payload")


def _ops(scripts: DataFrame) -> DataFrame:
    return read_ops(scripts.select("file", B.dsc_decompress("payload").alias("content")))


def script_ops(blobs: DataFrame) -> DataFrame:
    """Archives (arc, content) -> ops of all their scripts; file is archive/name."""
    return _ops(_scripts(blobs))


def generate_catalogs(blobs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(arc, file, text): a PO catalog per script; files (names) that exist already (file) are left
    out before any of theirs is unpacked."""
    rows = _scripts(blobs)
    if existing is not None:
        rows = K.missing(rows, existing.select(F.col("file").alias("name")), "name")
    name = F.element_at(F.split("file", _SLASH), -1)
    made = C.joined(C.po_lines(C.keyed_to_po(S.extract_keyed(_ops(rows)), name)), "entry_idx")
    return made.join(rows.select("file", "arc", "name"), "file").select("arc", F.col("name").alias("file"), "text")


def translations(lines: DataFrame) -> DataFrame:
    """(file, ln, line) of PO catalogs -> (file, id, text), untranslated ids left out."""
    return C.po_to_keyed(C.parse_po(lines)).where("text <> ''").select("file", "id", "text")


def translate(blobs: DataFrame, lines: DataFrame) -> DataFrame:
    """(arc, name, content): every script of the archives with its texts translated by the catalog
    of its name."""
    rows = _scripts(blobs)
    said = translations(lines).withColumnRenamed("file", "name").join(rows.select("name", "file"), "name").select("file", "id", "text")
    return SW.write_ops(S.translate(_ops(rows), said)).join(rows.select("file", "arc", "name"), "file").select("arc", "name", "content")


def _put_back(table: DataFrame, done: DataFrame, keys: list[str], level: int) -> DataFrame:
    """Archives of the table's entries, with the payloads of `done` (keys, content) where it has any."""
    rows = table.join(done.withColumnRenamed("content", "new"), keys, "left")
    return AW.build(rows.withColumn("payload", F.coalesce("new", "payload")), level)


def translate_archive(blobs: DataFrame, lines: DataFrame, level: int = -1) -> DataFrame:
    """(arc, content): the archives with translated scripts, entries in their order."""
    return _put_back(AR.entries(blobs), translate(blobs, lines), ["arc", "name"], level)


def translate_images(blobs: DataFrame, catalog: DataFrame, level: int = 9) -> DataFrame:
    """(arc, name, content): the images of the archives that files of the catalog (name, content)
    replace or are drawn over."""
    return I.changed(AR.lookup(AR.entries(blobs)), catalog, level).select("arc", "name", F.col("payload").alias("content"))


def translate_image_archive(blobs: DataFrame, catalog: DataFrame, level: int = 9) -> DataFrame:
    """(arc, content): the archives with those images in their place; other entries stay as they are."""
    table = AR.entries(blobs)
    return _put_back(table, I.changed(table, catalog, level).select("arc", "k", F.col("payload").alias("content")), ["arc", "k"], -1)


def report(lines: DataFrame) -> DataFrame:
    """Coverage of PO catalogs, one row: entries, translated, characters, tokens, ratios."""
    entries = C.parse_po(lines)
    source = K.token_total(entries, "msgid").withColumnRenamed("n_tokens", "source_tokens")
    target = K.token_total(entries, "msgstr").withColumnRenamed("n_tokens", "target_tokens")
    return K.coverage(entries).join(F.broadcast(source)).join(F.broadcast(target))  # one row each


def apply_memory(lines: DataFrame, old_lines: DataFrame, lang: str = "es") -> DataFrame:
    """(file, text): PO catalogs filled from older tagged catalogs of the same name."""
    return C.joined(C.po_lines(K.apply_memory(C.parse_po(lines), C.parse_tagged(old_lines, lang))), "entry_idx")


def extract_tagged(scripts: DataFrame) -> DataFrame:
    """Scripts (file, content) -> (file, text): their texts in the tagged format, to fill in."""
    return C.joined(C.tagged(S.extract_keyed(read_ops(scripts))), "id", "")


def patch_tagged(scripts: DataFrame, lines: DataFrame, lang: str = "es") -> DataFrame:
    """Scripts (file, content) -> (file, content): patched with the texts of tagged catalogs
    (file, ln, line) of their names, where these have any."""
    said = C.parse_tagged(lines, lang).where("id is not null and text <> ''").select("file", "id", "text")
    return SW.write_ops(S.patch(read_ops(scripts), said))
