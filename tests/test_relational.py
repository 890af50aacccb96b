from __future__ import annotations

import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.codecs import dsc
from lexloom.codecs import images as codec
from lexloom.functions import binary as B
from lexloom.functions import text as T
from lexloom.operators import catalogs as K
from lexloom.operators import images as I
from lexloom.operators import scripts as S
from lexloom.plans import cli, programs
from lexloom.sinks import archives as AW
from lexloom.sinks import scripts as SW
from lexloom.sources import archives as AR
from lexloom.sources import catalogs as C
from lexloom.sources.scripts import LINE, PUSH_INT, PUSH_PTR, PUSH_STR, SIZE, TEXT, read_ops

OP = "file string, op_idx int, ori_pos int, type int, args array<struct<kind:string,i:int,s:string>>"
ARGS = lambda *xs: [("STR", None, x) if isinstance(x, str) else ("PTR", x[0], None) if isinstance(x, tuple) else ("INT", x, None) for x in xs]


def ops(spark, rows, file="f"):
    return spark.createDataFrame([(file, i, None, t, ARGS(*a)) for i, (t, a) in enumerate(rows)], OP)


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


PO = r'''
# Comments for 'f'
msgid ""
msgstr ""
"Language: es\n"
"Other: 8bit\n"

#: f:8

msgid "If I was there."
msgstr ""

#: f:9 f:36
msgid "{Name}\n\"Where?\" \\ x"
msgstr "¿Dónde?"
msgstr "twice"
# at the end
'''


def po(spark, text=PO, file="f"):
    return C.parse_po(C.as_lines(spark.createDataFrame([(file, text)], "file string, text string")))


def test_po_parse(spark):
    rows = po(spark).orderBy("entry_idx").collect()
    assert [r["msgid"] for r in rows] == ["", "If I was there.", '{Name}\n"Where?" \\ x']
    assert [r["msgstr"] for r in rows] == ["Language: es\nOther: 8bit\n", "", "twice"]
    assert [r["comments"] for r in rows] == [[" Comments for 'f'"], [": f:8"], [": f:9 f:36"]]
    refs = C.po_references(po(spark)).orderBy("id").collect()
    assert [(r["entry_idx"], r["ref"], r["id"]) for r in refs] == [(1, "f:8", 8), (2, "f:9", 9), (2, "f:36", 36)]


@pytest.mark.parametrize("bad", ['msgid_plural "x"', 'msgid "a"\nmsgstr[0] "x"', 'msgctxt "x"', "plain", '"stray"', '# c\n"stray"', 'msgstr "x"'])
def test_po_rejects(spark, bad):
    with pytest.raises(Exception, match="not a catalog line|a string without a key"):
        po(spark, bad).collect()


def test_po_rejects_a_lone_backslash(spark):
    with pytest.raises(Exception, match="an escape without its character"):
        po(spark, 'msgid "a\\"\nmsgstr ""').collect()
    assert po(spark, 'msgid "a\\\\"\nmsgstr ""').first()["msgid"] == "a\\"


def test_po_round_trip(spark):
    rnd = random.Random(2)
    text = lambda: "".join(rnd.choice(["a", " ", "\n", '"', "\\", "\t", "é", "\\n", "x y"]) for _ in range(rnd.randint(0, 9)))
    rows = [("f", i, text(), text(), [f": f:{i}"]) for i in range(150)]
    entries = spark.createDataFrame(rows, "file string, entry_idx int, msgid string, msgstr string, comments array<string>")
    back = C.parse_po(C.as_lines(C.joined(C.po_lines(entries), "entry_idx"))).orderBy("entry_idx").collect()
    assert [tuple(r) for r in back] == rows


def test_keyed_last_wins_keeps_the_first_place(spark):
    text = 'msgid "a"\nmsgstr "1"\n#: f:5 g:6\nmsgid "b"\nmsgstr "2"\n#: f:5\nmsgid "c"\nmsgstr "3"\n'
    got = [tuple(r)[:5] for r in C.po_to_keyed(po(spark, text)).orderBy("put_idx").collect()]
    assert got == [("f", 5, 0, "c", "3"), ("f", 6, 1, "b", "2")]
    with pytest.raises(Exception, match="not a reference"):
        C.po_to_keyed(po(spark, '#: f:x\nmsgid "a"\nmsgstr ""')).collect()


def test_sections(spark):
    files = spark.createDataFrame([("f", "dropped\n## POINTER 3 x\nfirst  \n\n## POINTER 4\nbody\nmore\n## POINTER 3\nlast\n")], "file string, text string")
    assert [tuple(r) for r in C.parse_sections(files).orderBy("put_idx").collect()] == [("f", 3, 0, "last"), ("f", 4, 1, "body\nmore")]


def test_tagged(spark):
    text = "# doc\n@4\n# note\n<en>Hello\\nthere \n<es>\n<es>Hola\n<fr>Non\nignored\n@5\n<en>x\\\\y\\q\n@4\n<es>Otra"
    got = [tuple(r) for r in C.parse_tagged(C.as_lines(spark.createDataFrame([("f", text)], "file string, text string"))).orderBy("put_idx").collect()]
    assert got == [("f", None, 0, "", "", [" doc"]), ("f", 4, 1, "Hello\nthere", "Otra", [" note"]), ("f", 5, 2, "x\\yq", "", [])]
    with pytest.raises(Exception, match="not an id"):
        C.parse_tagged(C.as_lines(spark.createDataFrame([("f", "@x")], "file string, text string"))).collect()


def test_memory(spark):
    entries = po(spark, '# c\nmsgid ""\nmsgstr "head"\n#: f:1\nmsgid "a"\nmsgstr "old"\n#: f:2\nmsgid "b"\nmsgstr "kept"\n')
    memory = spark.createDataFrame([("f", None, 0, "zz", "doc", ["n"]), ("f", 1, 1, "a", "first", []), ("f", 2, 2, "a", "last", [" c", "d "]), ("f", 3, 3, "b", "", ["e"]), ("g", 1, 0, "b", "other", [])], "file string, id int, put_idx int, original string, text string, comments array<string>")
    got = [(r["msgid"], r["msgstr"], r["comments"]) for r in K.apply_memory(entries, memory).orderBy("entry_idx").collect()]
    assert got == [("", "doc", [" c", " n"]), ("a", "last", [": f:1", " c", " d"]), ("b", "kept", [": f:2", " e"])]


def test_text_functions(spark):
    c = F.col("c")
    assert one(spark, [("a\\\nb\t",)], "c string", T.escape_controls(c), T.escape_controls(c, True), T.unescape_controls(T.escape_controls(c, True))) == [("a\\\\nb\\t", "a\\\\\\nb\\t", "a\\\nb\t")]
    assert one(spark, [("hello",)], "c string", T.slice_text(c, 1, 3), T.slice_text(c, -2), T.slice_text(c, 9), T.slice_text(c, 0)) == [("ell", "lo", "", "hello")]
    assert one(spark, [("a.b.c",)], "c string", T.split_limited(c, ".", 2), T.split_limited(c, ".", 5, True)) == [(["a", "b.c"], ["a", "b", "c", "", ""])]
    assert one(spark, [("a\r\n b \nc\nd",)], "c string", T.fold_lines(c)) == [("a b c d",)]
    assert one(spark, [("“x”",)], "c string", T.straight_quotes(c), T.encodable(c), T.encodable(T.straight_quotes(c))) == [('"x"', False, True)]
    assert one(spark, [("  Bob \n",)], "c string", T.reshape(c, F.lit("Ana"))) == [("  Ana \n",)]
    assert one(spark, [("", "b"), ("t", "b"), (None, "b")], "c string, b string", T.message(c, F.col("b"))) == [("b",), ("{t}\nb",), ("b",)]
    assert one(spark, [('"Hey!"',), ("¿Qué es?",)], "c string", T.tokens(c)) == [(['"', "Hey", '!"'],), (["¿", "Qué", "es", "?"],)]
    assert one(spark, [("x/A.b.PO",)], "c string", T.extension(c)) == [("po",)]
    assert one(spark, [("a\\",), ("a\\\\",)], "c string", T.ends_in_backslash(c)) == [(True,), (False,)]


def test_binary_functions(spark):
    c = F.col("c")
    assert one(spark, [(bytearray(b"\xff\xff\xff\xff\x02\x01"),)], "c binary", B.uint(c, 0), B.sint(c, 0), B.uint(c, 4, 2)) == [(4294967295, -1, 258)]
    assert one(spark, [(-2,), (70000,)], "c int", B.sint(B.pack_int(c), 0)) == [(-2,), (70000,)]
    got = one(spark, [(bytearray(b"\xf0\x20\x01"),), (bytearray(),)], "c binary", B.checksum(c)["sum"], B.checksum(c)["xor"])
    assert got == [((0xF0 + 0x21) % 256, 0xF0 ^ 0x20 ^ 0x01), (0, 0)]


def test_token_total(spark):
    texts = ["Hey!", "{x", "", "  ", "a b", "...", "?! c", "d"]
    rows = spark.createDataFrame([(f"f{i // 3}", i, t) for i, t in enumerate(texts)], "file string, entry_idx int, t string")
    joined = "".join(" " + t for t in texts)
    assert K.token_total(rows, "t").first()[0] == len([x for x in re.split(r"\b", joined) if x.strip()])
    assert K.token_total(rows.limit(0), "t").first()[0] == 0


def test_coverage(spark):
    rows = spark.createDataFrame([("ab", ""), ("", " "), ("c", "dd")], "msgid string, msgstr string")
    assert tuple(K.coverage(rows).first()) == (3, 2, 6, 6, 1.0, 2 / 3 * 100)
    assert tuple(K.coverage(rows.limit(0)).first())[:2] == (0, 0)


def test_intervals(spark):
    s = "k int, a int, b int"
    rows = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 10, 12), (2, 1, 2), (1, 2, 3)], s)
    assert sorted(map(tuple, K.merge_intervals(rows, "k", "a", "b").collect())) == [(1, 0, 8), (1, 10, 12), (2, 1, 2)]
    minus = spark.createDataFrame([(1, 3, 4), (1, 7, 11), (3, 0, 9)], s)
    assert sorted(map(tuple, K.subtract_intervals(rows, minus, "k", "a", "b").collect())) == [(1, 0, 3), (1, 4, 7), (1, 11, 12), (2, 1, 2)]


SCRIPT = [
    (LINE, ("file", 7)), (PUSH_STR, (" Bob ",)), (PUSH_STR, ("hi",)), (TEXT, ()), (TEXT, ()),
    (LINE, ("file", 8)), (PUSH_INT, (0,)), (PUSH_STR, ("alone",)), (TEXT, ()), (PUSH_PTR, ((0,),)), (0x21, (1, 2)), (0x19, (-5,)),
]


def test_scripts_round_trip(spark):
    blob = SW.write_ops(ops(spark, SCRIPT))
    back = read_ops(blob).orderBy("op_idx").collect()
    assert [(r["type"], [tuple(a) for a in r["args"]]) for r in back] == [(t, ARGS(*a)) for t, a in SCRIPT]
    assert [r["ori_pos"] for r in back][:4] == [0, 12, 20, 28]
    content = bytes(blob.first()["content"])
    assert content.count(b"file\0bss.h\0") == 1 and SW.write_ops(read_ops(blob)).first()["content"] == content


def test_null_argument(spark):
    bad = spark.createDataFrame([("f", 0, None, PUSH_INT, [("INT", None, None)])], OP)
    with pytest.raises(Exception, match="null argument"):
        SW.write_ops(bad).collect()


def test_extract(spark):
    got = [tuple(r)[2:] for r in S.extract(ops(spark, SCRIPT)).orderBy("op_idx").collect()]
    assert got == [(7, "Bob", "hi", "{Bob}\nhi"), (7, "Bob", "hi", "{Bob}\nhi"), (8, "", "alone", "alone")]
    keyed = [tuple(r) for r in S.extract_keyed(ops(spark, SCRIPT)).orderBy("put_idx").collect()]
    assert keyed == [("f", 7, 0, "{Bob}\nhi"), ("f", 8, 1, "alone")]
    with pytest.raises(Exception, match="without title and body"):
        S.extract(ops(spark, [(PUSH_STR, ("x",)), (TEXT, ())])).collect()


def test_translate(spark):
    script = [x for i, x in enumerate(SCRIPT) if i != 4]
    said = spark.createDataFrame([("f", 7, "{Ana}\n“hola”\nb"), ("g", 8, "no"), ("f", 8, "")], "file string, id int, text string")
    got = S.extract(S.translate(ops(spark, script), said)).orderBy("op_idx").collect()
    assert [(r["title"], r["body"]) for r in got] == [("Ana", '"hola"\nb'), ("", "alone")]
    args = S.translate(ops(spark, script), said).where("op_idx = 1").first()["args"]
    assert args[0]["s"] == " Ana "
    with pytest.raises(Exception, match="without a body"):
        S.translate(ops(spark, script), spark.createDataFrame([("f", 7, "{Ana}")], "file string, id int, text string")).collect()
    with pytest.raises(Exception, match="without title and body"):  # the first text emptied the stack
        S.translate(ops(spark, SCRIPT), said).collect()


@pytest.mark.parametrize(("length", "height"), [(132, 22), (133, 20), (176, 20), (177, 19), (219, 19), (220, 22)])
def test_font_height(spark, length, height):
    assert spark.range(1).select(S.font_height(F.lit(length))).first()[0] == height


def test_patch(spark):
    # the older operands: body pushed first, title second
    script = [(LINE, ("f", 1)), (PUSH_STR, ("body",)), (PUSH_STR, ("Bob",)), (TEXT, ()), (LINE, ("f", 2)), (PUSH_STR, ("b2",)), (TEXT, ()), (PUSH_PTR, ((32,),))]
    read = read_ops(SW.write_ops(ops(spark, script)))
    said = spark.createDataFrame([("f", 1, "{Ana}\nx\ny " + "z" * 140), ("f", 2, "short ")], "file string, id int, text string")
    got = S.patch(read, said).orderBy("op_idx").collect()
    kinds = [r["type"] for r in got]
    assert kinds == [LINE, 0, 0, 0, 0, 0x3F, SIZE, PUSH_STR, PUSH_STR, TEXT, LINE, 0, 0, 0, 0, 0x3F, SIZE, PUSH_STR, TEXT, PUSH_PTR]
    assert [r["args"][0]["i"] for r in got[1:5]] == [2, 20, 20, 0] and [r["args"][0]["i"] for r in got[11:15]] == [2, 22, 22, 0]
    assert got[7]["args"][0]["s"] == "x y " + "z" * 140 and got[8]["args"][0]["s"] == "Bob" and got[17]["args"][0]["s"] == "short"
    assert got[19]["args"][0]["i"] == 32 + 6 * 8 - 4  # five ops of 8 bytes and one of 4 came before it


def test_relocate_and_listing(spark):
    base = read_ops(SW.write_ops(ops(spark, SCRIPT)))
    new = spark.createDataFrame([("f", 0, 0, 0x22, [])], "file string, before_idx int, sub_idx int, type int, args array<struct<kind:string,i:int,s:string>>")
    moved = S.relocate(S.insert(base, new))
    assert moved.where(F.col("type") == PUSH_PTR).first()["args"][0]["i"] == 4
    shown = [(r["pos"], r["shown"]) for r in S.listing(base).orderBy("op_idx").collect()]
    assert shown[:2] == [(0, "\nfile_7:"), (12, "PUSH_STR(' Bob ')")] and shown[10][1] == "OP_021(1, 2)"
    assert S.replace_constant(base, "f", "hi", "ho").where("op_idx = 2").first()["args"][0]["s"] == "ho"


def _arc(spark, names=("a", "b", "a")):
    return AW.build(spark.createDataFrame([("x", k, n, bytearray(f"data{k}".encode() * k)) for k, n in enumerate(names)], "arc string, k int, name string, payload binary"))


def test_archives(spark, tmp_path):
    rows = AR.entries(_arc(spark)).orderBy("k").collect()
    assert [(r["name"], r["start"], r["len"], bytes(r["payload"])) for r in rows] == [("a", 0, 0, b""), ("b", 0, 5, b"data1"), ("a", 5, 10, b"data2data2")]
    assert bytes(AR.get(AR.entries(_arc(spark)), "a").first()["payload"]) == b"data2data2"
    with pytest.raises(Exception, match="no entry z"):
        AR.get(AR.entries(_arc(spark)), "z").collect()
    with pytest.raises(Exception, match="more than 16 bytes"):
        _arc(spark, ["n" * 17]).collect()
    with pytest.raises(Exception, match="not an archive"):
        AR.entries(spark.createDataFrame([("x", bytearray(b"junk" * 9))], "arc string, content binary")).collect()
    AW.write_files(_arc(spark), str(tmp_path), "arc", "content")
    spark.dataSource.register(AR.ArchiveSource)
    from_file = spark.read.format("arc").load(str(tmp_path / "x")).orderBy("k").collect()
    assert [tuple(r) for r in from_file] == [tuple(r) for r in rows]
    assert [r["name"] for r in AR.entries(AR.read_files(spark, str(tmp_path)), payload=False).orderBy("k").collect()] == ["a", "b", "a"]


def test_pack_folder_and_backup(spark, tmp_path):
    folder = tmp_path / "z.arc.d"
    folder.mkdir()
    (folder / "b").write_bytes(b"two" * 50)
    (folder / "a").write_bytes(b"one")
    for _ in range(2):
        AW.pack_folder(spark, str(folder), 9)
    got = AR.entries(AR.read_files(spark, str(tmp_path), "z.arc")).withColumn("p", B.dsc_decompress("payload")).orderBy("k").collect()
    assert [(r["name"], bytes(r["p"])) for r in got] == [("a", b"one"), ("b", b"two" * 50)] and (tmp_path / "z.arc.bak").exists()
    with pytest.raises(ValueError):
        AW.pack_folder(spark, str(tmp_path))


def test_no_entry_carries_its_archive_to_python(spark, tmp_path):
    def into_python(plan):  # noqa: ANN001, ANN202
        children = [plan.children().apply(i) for i in range(plan.children().size())]
        return [c.output().mkString(",") for c in children if plan.nodeName() == "ArrowEvalPython"] + [x for c in children for x in into_python(c)]

    text = F.decode(B.dsc_decompress("payload"), "UTF-8").alias("text")
    table = AR.entries(AR.read_files(spark, str(tmp_path))).select("arc", "k", "name", text)
    rows = into_python(table._jdf.queryExecution().optimizedPlan())
    assert len(rows) == 1 and "payload#" in rows[0] and "content#" not in rows[0]


@pytest.mark.parametrize("level", [-1, 0])
def test_pack_folder_in_runs(spark, tmp_path, monkeypatch, level):
    """Files are packed in several runs, none of which gathers the archive; the result is that of build."""
    monkeypatch.setattr(AW, "RUN", 200, raising=False)
    monkeypatch.setattr(AW, "build", lambda *_: pytest.fail("the archive is gathered"))
    folder = tmp_path / "z.arc.d"
    (folder / "folder").mkdir(parents=True)
    files = {f"f{k:02d}": bytes([65 + k]) * 37 * k for k in range(12)} | {"_x": b"counts", "\u00e9": dsc.compress(b"packed")}
    for name, data in (files | {".hidden": b"no entry"}).items():
        (folder / name).write_bytes(data)
    assert AW.pack_folder(spark, str(folder), level) == str(tmp_path / "z.arc")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["z.arc", "z.arc.d"]
    got = AR.entries(AR.read_files(spark, str(tmp_path), "z.arc")).orderBy("k").collect()
    want = {n: x if level < 0 or dsc.is_compressed(x) else dsc.compress(x, level) for n, x in sorted(files.items())}
    assert [(r["name"], bytes(r["payload"])) for r in got] == list(want.items())
    assert [r["start"] for r in got] == [sum(map(len, list(want.values())[:k])) for k in range(len(want))]


def test_pack_folder_without_files_or_with_a_long_name(spark, tmp_path):
    folder = tmp_path / "z.arc.d"
    folder.mkdir()
    assert Path(AW.pack_folder(spark, str(folder))).read_bytes() == AR.MAGIC + bytes(4)
    (folder / ("n" * 17)).write_bytes(b"")
    with pytest.raises(ValueError, match="more than 16 bytes"):
        AW.pack_folder(spark, str(folder))


def test_programs(spark):
    script = [x for i, x in enumerate(SCRIPT) if i != 4]
    blob = SW.write_ops(ops(spark, script, "s1"))
    arc = AW.build(blob.select(F.lit("x").alias("arc"), F.lit(0).alias("k"), F.col("file").alias("name"), F.col("content").alias("payload")), level=9)
    made = programs.generate_catalogs(arc).collect()
    assert [(r["arc"], r["file"]) for r in made] == [("x", "s1")] and '#: s1:7\nmsgid ""\n"{Bob}\\n"\n"hi"\nmsgstr ""' in made[0]["text"]
    assert programs.generate_catalogs(arc, spark.createDataFrame([("s1",)], "file string")).count() == 0
    text = made[0]["text"].replace('"hi"\nmsgstr ""', '"hi"\nmsgstr "{Eva}\\nhola"')
    lines = C.as_lines(spark.createDataFrame([("s1", text)], "file string, text string"))
    again = S.extract(programs.script_ops(programs.translate_archive(arc, lines, level=0))).orderBy("op_idx").collect()
    assert [(r["title"], r["body"]) for r in again] == [("Eva", "hola"), ("", "alone")]
    got = programs.report(lines).first()
    assert (got["entries"], got["translated"], got["source_tokens"] > 0) == (3, 2, True)
    old = C.as_lines(spark.createDataFrame([("s1", "@8\n<en>alone\n<es>solo\n")], "file string, text string"))
    assert 'msgid "alone"\nmsgstr "solo"' in programs.apply_memory(lines, old).first()["text"]


def test_images_by_catalog(spark):
    entries = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    names = spark.createDataFrame([("a.png",), ("a.patch.png",), ("b.patch.png",)], "name string")
    got = sorted((r["name"], r["matched"], r["overlays"]) for r in I.choose(entries, names).collect())
    assert got == [("a", "a.png", False), ("b", "b.patch.png", True)]
    px = spark.createDataFrame([("p", 2, 1, 32, "RAWIMG", bytearray([1, 2, 3, 255, 4, 5, 6, 0]))], "path string, width int, height int, bpp int, codec string, pixels binary")
    blobs = I.encode(px, "raw", level=9)
    assert bytes(I.decode(blobs).first()["pixels"]) == bytes([1, 2, 3, 255, 4, 5, 6, 0])
    drawn = I.overlay(blobs.withColumn("patch", F.col("content")))
    assert I.decode(drawn).first()["width"] == 2
    assert bytes(I.encode(px, "png").first()["content"]).startswith(b"\x89PNG")


def test_programs_keep_archives_apart(spark):
    """Two archives with a script of one name."""
    first = [x for i, x in enumerate(SCRIPT) if i != 4]
    second = [(LINE, ("file", 7)), (PUSH_STR, ("",)), (PUSH_STR, ("other",)), (TEXT, ())]
    packed = [SW.write_ops(ops(spark, o, "s1")).select(F.lit(arc).alias("arc"), F.lit(0).alias("k"), F.lit("s1").alias("name"), F.col("content").alias("payload")) for arc, o in (("x", first), ("y", second))]
    arcs = AW.build(packed[0].union(packed[1]))
    assert sorted((r["arc"], r["file"], r["text"].count("msgid")) for r in programs.generate_catalogs(arcs).collect()) == [("x", "s1", 3), ("y", "s1", 2)]
    lines = C.as_lines(spark.createDataFrame([("s1", '#: s1:7\nmsgid "a"\nmsgstr "{Eva}\\nhola"\n')], "file string, text string"))
    again = S.extract(programs.script_ops(programs.translate_archive(arcs, lines))).orderBy("file", "op_idx").collect()
    assert [(r["file"], r["title"], r["body"]) for r in again] == [("x/s1", "Eva", "hola"), ("x/s1", "", "alone"), ("y/s1", "", "{Eva}\nhola")]


def test_translate_with_a_function(spark):
    script = [x for i, x in enumerate(SCRIPT) if i != 4]
    said = lambda line, full, title, body: f"{{{title.strip()}!}}\n{body}{line}" if title else None
    got = S.extract(S.translate(ops(spark, script), said)).orderBy("op_idx").collect()
    assert [(r["title"], r["body"]) for r in got] == [("Bob!", "hi7"), ("", "alone")]


def test_script_tools(spark):
    blob = SW.write_ops(ops(spark, [(LINE, ("f", 1)), (PUSH_STR, ("body",)), (PUSH_STR, ("Bob",)), (TEXT, ())], "s1"))
    text = programs.extract_tagged(blob).first()["text"]
    assert text == "@1\n<en>{body}\\nBob\n<es>\n"
    lines = C.as_lines(spark.createDataFrame([("s1", text.replace("<es>", "<es>{Bob}\\nhola"))], "file string, text string"))
    args = read_ops(programs.patch_tagged(blob, lines)).where("op_idx = 1").first()["args"]
    assert args[0]["s"] == "hola"


def test_images_are_replaced_and_drawn_over(spark):
    px = lambda *rows: np.array(rows, np.uint8).reshape(1, -1, 4)
    base = codec.save_raw(px([1, 2, 3, 255], [4, 5, 6, 255]))
    entries = spark.createDataFrame([("x", 0, "a", bytearray(base)), ("x", 1, "b", bytearray(dsc.compress(base))), ("x", 2, "c", bytearray(b"no image"))], "arc string, k int, name string, payload binary")
    files = spark.createDataFrame([("a.png", bytearray(codec.to_png(px([9, 9, 9, 255])))), ("b.patch.png", bytearray(codec.to_png(px([9, 8, 7, 255], [0, 0, 0, 0])))), ("z.png", bytearray(b""))], "name string, content binary")
    blobs = AW.build(entries)
    made = {r["name"]: bytes(r["payload"]) for r in AR.entries(programs.translate_image_archive(blobs, files)).collect()}
    assert codec.load(made["a"])[3].tolist() == [[[9, 9, 9, 255]]] and codec.load(made["b"])[3].tolist() == [[[9, 8, 7, 255], [4, 5, 6, 255]]]
    assert made["c"] == b"no image" and dsc.is_compressed(made["a"])
    assert sorted(r["name"] for r in programs.translate_images(blobs, files).collect()) == ["a", "b"]


def test_token_total_over_ranges(spark):
    rnd = random.Random(3)
    texts = [rnd.choice(["Hey!", "{x", "", "  ", "a b", "...", "?! c", "d", "«"]) for _ in range(400)]
    rows = spark.createDataFrame([(f"f{i // 2:04}", i, t) for i, t in enumerate(texts)], "file string, entry_idx int, t string").repartition(7)
    joined = "".join(" " + t for t in texts)
    assert K.token_total(rows, "t").first()[0] == len([x for x in re.split(r"\b", joined) if x.strip()])


def test_command_line(spark, tmp_path):
    folder, texts = tmp_path / "in", tmp_path / "texts"
    folder.mkdir()
    blob = SW.write_ops(ops(spark, [(LINE, ("f", 1)), (PUSH_STR, ("body",)), (PUSH_STR, ("Bob",)), (TEXT, ())], "s1")).first()["content"]
    (folder / "s1").write_bytes(bytes(blob))
    assert cli.main(["script-extract", str(folder), str(texts)]) == 0
    text = (texts / "s1.txt").read_text()
    (texts / "s1.txt").write_text(text.replace("<es>", "<es>{Bob}\\nhola"))
    assert cli.main(["script-patch", str(folder), str(texts), "--out", str(tmp_path / "out")]) == 0
    assert b"hola\0" in (tmp_path / "out" / "s1").read_bytes()
    AW.write_files(_arc(spark), str(tmp_path), "arc", "content")
    assert cli.main(["extract", str(tmp_path / "x")]) == 0
    assert (tmp_path / "x.d" / "b").read_bytes() == b"data1"
