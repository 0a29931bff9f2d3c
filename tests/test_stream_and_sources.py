"""Files on disk, and a stream of changes in micro-batches."""

from pyspark.sql import functions as F

from codeloom.functions.extract import sites_of, symbols_of
from codeloom.sources import files
from codeloom.streaming import incremental


def test_project_on_disk(spark, tmp_path):
    root = tmp_path / "p"
    for path, text in {"Project/Sources/Methods/Run.4dm": "Other(1)", "Project/Sources/Classes/Box.4dm": "Function go\n  This.x()", "Project/Sources/skip/Methods/a.4dm": "x", "Resources/Constants_A.xlf": '<xliff><file><group d4:groupName="Tints" xmlns:d4="u"><trans-unit id="k_1" resname="Red" d4:value="1:L"/><trans-unit id="k_2" resname="Blue" d4:value="b:S"/></group></file></xliff>'}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    rows = files.read_files(spark, str(root), ["skip"], "*.4dm").withColumn("c", files.classify(F.col("rel_path")))
    sources = rows.select("rel_path", "c.category", "c.container", F.regexp_extract("rel_path", r"([^/]+)\.4dm$", 1).alias("base"), "content")
    assert {r.symbol_id for r in symbols_of(sources).collect()} == {"ProjectMethod:Run", "Class:Box", "ClassFunction:Box.go"}
    assert {(r.from_id, r.hint_kind, r.name) for r in sites_of(sources).collect()} == {("ProjectMethod:Run", "BareName", "Other"), ("ClassFunction:Box.go", "ThisCall", "x")}
    found = files.constants(spark, str(root / "Resources/Constants_A.xlf"))
    assert {tuple(r) for r in found.select("name", "value", "type_letter", "theme").collect()} == {("Red", "1", "L", "Tints"), ("Blue", "b", "S", "Tints")}


def test_stream_keeps_last_change(spark, tmp_path):
    src, seen = str(tmp_path / "in"), {}
    spark.createDataFrame([("a", "create", 1), ("a", "delete", 2), ("b", "change", 3)], "path string, kind string, event_seq long").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("path string, kind string, event_seq long").parquet(src)
    incremental.run_stream(stream, lambda df, n: seen.update({r.path: r.kind for r in df.collect()}), str(tmp_path / "ck")).awaitTermination(60)
    assert seen == {"a": "delete", "b": "change"}


def test_patch_equals_rebuild(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, x int")
    changed = spark.createDataFrame([("a", "delete"), ("b", "change"), ("d", "create")], "path string, kind string")
    new = spark.createDataFrame([("b", 20), ("d", 40), ("a", 10)], "path string, x int")
    assert {tuple(r) for r in incremental.apply_batch(old, changed, new).collect()} == {("b", 20), ("c", 3), ("d", 40)}


def test_freshness(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "path string, mtime double")
    assert files.fresh(a, a)
    assert not files.fresh(a, a.filter("path = 'x'"))
    assert not files.fresh(a, spark.createDataFrame([("x", 1.0), ("y", 9.0)], "path string, mtime double"))
