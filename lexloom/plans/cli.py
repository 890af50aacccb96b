"""Command line: python -m lexloom.plans.cli list|extract|pack|... PATH [...].

extract and pack use PATH.d unless names or --out say otherwise; script-extract and script-patch take
a folder of scripts and a folder of texts (NAME.txt)."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexloom.functions import binary as B
from lexloom.plans import programs
from lexloom.sinks import archives as AW
from lexloom.sources import archives as AR
from lexloom.sources import catalogs as C


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("what", choices=["list", "extract", "pack", "decompress", "compress", "test", "report", "catalogs", "translate", "images", "script-extract", "script-patch"])
    p.add_argument("path")
    p.add_argument("names", nargs="*", help="entries to extract (to the folder one is in); for translate and images the folder of catalogs; for scripts the folder of texts")
    p.add_argument("--out", default=None)
    p.add_argument("--level", type=int, default=9)
    a = p.parse_args(argv)
    out = a.out or (f"{a.path.rstrip('/')}.d" if a.what == "extract" and not a.names else ".")
    spark = SparkSession.builder.getOrCreate()
    blobs = AR.read_files(spark, a.path)
    if a.what == "list":
        AR.entries(blobs, payload=False).orderBy("arc", "k").show(1000, False)
    elif a.what == "extract":
        table = AR.entries(blobs)
        table = table.where(F.col("name").isin(a.names)) if a.names else table
        AW.write_files(table.withColumn("payload", B.dsc_decompress("payload") if a.level else F.col("payload")), out, "name", "payload")
    elif a.what == "pack":
        print(AW.pack_folder(spark, a.path, a.level))
    elif a.what in ("decompress", "compress"):
        made = B.dsc_decompress("content") if a.what == "decompress" else B.dsc_compress(F.col("content"), a.level)
        AW.write_files(blobs.select("arc", made.alias("content")), out, "arc", "content")
    elif a.what == "test":
        again = B.dsc_decompress(B.dsc_compress(F.col("content"), a.level))
        blobs.select("arc", (again == F.col("content")).alias("same")).show(1000, False)
    elif a.what == "report":
        programs.report(C.read_lines(spark, a.path, "*.po")).show(vertical=True)
    elif a.what == "catalogs":
        AW.write_files(programs.generate_catalogs(blobs).withColumn("file", F.concat("file", F.lit(".po"))), out, "file", "text", overwrite=False)
    elif a.what == "translate":
        AW.write_files(programs.translate(blobs, C.read_lines(spark, a.names[0], "*.po")), out, "name", "content")
    elif a.what == "images":
        AW.write_files(programs.translate_images(blobs, AR.read_files(spark, a.names[0]).withColumnRenamed("arc", "name"), a.level), out, "name", "content")
    elif a.what in ("script-extract", "script-patch"):
        scripts = blobs.where(~F.col("arc").startswith(".")).withColumnRenamed("arc", "file")
        if a.what == "script-extract":
            AW.write_files(programs.extract_tagged(scripts).withColumn("file", F.concat("file", F.lit(".txt"))), a.out or a.names[0], "file", "text")
        else:
            AW.write_files(programs.patch_tagged(scripts, C.read_lines(spark, a.names[0], "*.txt")), out, "file", "content")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
