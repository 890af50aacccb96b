from lexloom.streaming.coverage import latest, watch


def test_files_are_taken_up_as_they_arrive(spark, tmp_path):
    folder, out, state = tmp_path / "po", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    (folder / "a.po").write_text('msgid "x"\nmsgstr ""\n')
    watch(spark, str(folder), out, state).awaitTermination(60)
    (folder / "b.po").write_text('msgid "x"\nmsgstr "y"\n\nmsgid "z"\nmsgstr ""\n')
    watch(spark, str(folder), out, state).awaitTermination(60)
    assert sorted((r["file"], r["entries"], r["translated"]) for r in latest(spark, out).collect()) == [("a", 1, 0), ("b", 2, 1)]
