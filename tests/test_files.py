"""PLY files, pictures, log folders and manifests."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.sources import logs, ply, ply_binary


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(ply_binary.PlySource)
    return spark


def points(spark, n):
    return spark.range(n).select((F.col("id") * 0.5).cast("float").alias("x"), (-F.col("id")).cast("double").alias("y"), (F.col("id") % 128).cast("tinyint").alias("red"), F.when(F.col("id") % 3 > 0, F.col("id").cast("int")).alias("n"))


def test_binary_round_trip_in_many_splits(source, tmp_path):
    path = str(tmp_path / "out")
    points(source, 5000).repartition(3).write.format("ply").mode("append").save(path)
    back = source.read.format("ply").option("split", 1000).load(path)
    assert back.columns == ["file", "x", "y", "red", "n"] and back.rdd.getNumPartitions() > 50
    want = {(float(i) * 0.5, -float(i), i % 128, i if i % 3 else 0) for i in range(5000)}
    rows = [tuple(r)[1:] for r in back.collect()]
    assert len(rows) == 5000 and set(rows) == want
    assert len(os.listdir(path)) == 3
    points(source, 7).write.format("ply").mode("overwrite").save(path)
    assert source.read.format("ply").load(path).count() == 7


def test_a_failed_write_leaves_no_file(source, tmp_path):
    path = str(tmp_path / "failed")
    bad = points(source, 100).repartition(2).withColumn("y", F.when(F.col("n") == 77, F.raise_error(F.lit("stop")).cast("double")).otherwise(F.col("y")))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("ply").mode("append").save(path)
    assert ply_binary.files(path) == []


def test_files_with_differing_headers_orders_and_elements(source, tmp_path):
    big = np.array([(7, 1.5, -2)], [("k", ">i4"), ("y", ">f8"), ("x", ">i2")])
    (tmp_path / "a.ply").write_bytes(b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty uchar red\nend_header\n1 200\noops 3\n")
    (tmp_path / "b.ply").write_bytes(b"ply\nformat binary_big_endian 1.0\ncomment x\nelement pose 1\nproperty int k\nelement vertex 1\nproperty double y\nproperty short x\nelement face 9\nproperty list uchar int vertex_indices\nend_header\n" + big.tobytes() + b"tail")
    got = {tuple(r)[1:] for r in source.read.format("ply").load(str(tmp_path)).where("not isnan(x)").collect()}
    assert got == {(1.0, 200), (-2.0, None)}
    named = source.read.format("ply").schema("y double, x double, file string").load(str(tmp_path))
    assert {(r["x"], r["y"]) for r in named.where("not isnan(x)").collect()} == {(1.0, None), (-2.0, 1.5)}
    (tmp_path / "c.ply").write_bytes(b"ply\nformat binary_little_endian 1.0\nelement vertex 3\nproperty float x\nend_header\nabcd")
    with pytest.raises(Exception, match="shorter than its 3"):
        source.read.format("ply").load(str(tmp_path / "c.ply")).collect()
    (tmp_path / "d.ply").write_bytes(b"ply\nformat binary_little_endian 1.0\nelement vertex 1\nproperty list uchar int i\nend_header\n")
    with pytest.raises(Exception, match="list"):
        source.read.format("ply").load(str(tmp_path / "d.ply")).collect()


def test_text_files_with_properties_in_another_order(spark, tmp_path):
    top = "ply\nformat ascii 1.0\nelement vertex 1\n{}end_header\n"
    (tmp_path / "a.ply").write_text(top.format("property float x\nproperty float y\nproperty float z\nproperty uchar red\n") + "1 2 3 9\n")
    (tmp_path / "b.ply").write_text(top.format("property uchar red\nproperty double z\nproperty float y\nproperty float x\n") + "9 3 2 1\n")
    (tmp_path / "c.ply").write_text(top.format("property float y\nproperty float x\nelement face 0\nproperty list uchar int z\n") + "2 1\n")
    got = ply.read(spark, str(tmp_path)).orderBy("file").select("x", "y", "z", "red").collect()
    assert [tuple(r) for r in got] == [(1.0, 2.0, 3.0, 9), (1.0, 2.0, 3.0, 9), (1.0, 2.0, None, None)]


def test_pictures_there_and_back(spark):
    import zlib

    from pointweave.sources import images

    rng = np.random.default_rng(1)
    shapes = {"a": (7, 5), "b": (1, 1), None: (40, 3)}
    nodes = [(k, i, j, *map(float, rng.integers(0, 256, 3))) for k, (h, w) in shapes.items() for i in range(h) for j in range(w)]
    black = [("c", 9, 2, 300.0, -4.0, None), ("c", 9, 2, 300.0, -4.0, 5.0), ("c", -1, 0, 1.0, 1.0, 1.0), ("c", None, 0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(nodes + black, "image string, gi int, gj int, red double, green double, blue double").repartition(5)
    files = images.pictures(df, strip=11)
    got = {tuple(r) for r in images.pixels(files).collect()}
    assert {r for r in got if r[0] != "c"} == {tuple(map(lambda v: int(v) if isinstance(v, float) else v, n)) for n in nodes}
    assert {r for r in got if r[0] == "c"} == {("c", i, j, 0, 0, 0) for i in range(10) for j in range(3)} - {("c", 9, 2, 0, 0, 0)} | {("c", 9, 2, 255, 0, 0)}
    sizes = {r["image"]: (r["height"], r["width"], bytes(r["png"])) for r in files.collect()}
    assert sizes["a"][:2] == (7, 5) and sizes["c"][:2] == (10, 3)
    # the strips are one zlib stream with the checksum of the whole
    stream, at, png = b"", 8, sizes[None][2]
    while at < len(png):
        n = int.from_bytes(png[at : at + 4], "big")
        stream += png[at + 8 : at + 8 + n] if png[at + 4 : at + 8] == b"IDAT" else b""
        at += 12 + n
    assert len(zlib.decompress(stream)) == 40 * (1 + 9)
    assert images.pictures(df.where("gi > 99")).count() == 0


def test_pictures_of_other_writers(spark):
    import struct
    import zlib

    from pointweave.sources import images

    rng = np.random.default_rng(2)
    want = rng.integers(0, 256, (6, 4, 4))
    raw, above = b"", np.zeros((4, 4), int)
    for i, row in enumerate(want):
        kind, out = i % 5, np.zeros((4, 4), int)
        for x in range(4):
            a, b, c = (row[x - 1] if x else 0 * row[0]), above[x], (above[x - 1] if x else 0 * row[0])
            p = a + b - c
            paeth = [min((abs(q - v), n, v) for n, v in enumerate((e, f, g)))[2] for q, e, f, g in zip(p, a, b, c)]
            out[x] = (row[x] - [0 * a, a, b, (a + b) // 2, paeth][kind]) & 255
        raw, above = raw + bytes([kind]) + out.astype(np.uint8).tobytes(), row
    body = zlib.compress(raw)
    png = images.SIGNATURE + images.chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 6, 8, 6, 0, 0, 0)) + images.chunk(b"tEXt", b"x") + images.chunk(b"IDAT", body[:9]) + images.chunk(b"IDAT", body[9:]) + images.chunk(b"IEND", b"")
    got = images.pixels(spark.createDataFrame([(1, bytearray(png)), (2, None)], "image int, png binary")).collect()
    assert {(r["gi"], r["gj"], r["red"], r["green"], r["blue"]) for r in got} == {(i, j, *map(int, want[i, j, :3])) for i in range(6) for j in range(4)}
    for bad in (b"no", png[:60], png.replace(b"IHDR", b"IHDX")):
        with pytest.raises(Exception, match="PNG|cut off|checksum"):
            list(images.unpacked(bad))


def test_log_folders_hold_one_log_of_each_kind(spark, tmp_path):
    from pointweave.sources import logs

    for k, text in (("a/r01", "one\ntwo\n"), ("b c/r02", "three")):
        os.makedirs(tmp_path / k)
        (tmp_path / k / "x.ply.bin.log").write_text(text)
        (tmp_path / k / "x.pc_error").write_text(text.upper())
        (tmp_path / k / "notes.txt").write_text("other")
    got = {r["folder"].rpartition("/")[2]: (r["encoder"], r["metric"]) for r in logs.from_folders(spark, str(tmp_path)).collect()}
    assert got == {"r01": ("one\ntwo\n", "ONE\nTWO\n"), "r02": ("three", "THREE")}
    (tmp_path / "a/r01/y.bin.log").write_text("again")
    with pytest.raises(Exception, match="encoder logs in .*r01: 2"):
        logs.from_folders(spark, str(tmp_path)).collect()
    os.remove(tmp_path / "a/r01/y.bin.log")
    os.remove(tmp_path / "a/r01/x.pc_error")
    with pytest.raises(Exception, match="metric logs in .*r01: 0"):
        logs.from_folders(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError):
        logs.from_folders(spark, str(tmp_path), kinds={"none": "nothing"})


def test_log_trees_are_written_and_listed_by_a_few_tasks(spark, tmp_path, monkeypatch):
    from pointweave.sources import logs

    texts = [(i, f"one {i}\n", None if i == 5 else f"two é {i}") for i in range(-2, 300)]
    df = spark.createDataFrame([*texts, texts[7]], "id long, one string, two string").coalesce(1)
    started = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    path = logs.to_folders(spark, df, "id", ["one", "two"])
    tracker = spark.sparkContext.statusTracker()
    new = lambda old: [tracker.getStageInfo(s).numTasks for j in set(tracker.getJobIdsForGroup(None)) - set(old) if tracker.getJobInfo(j) for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)]
    assert max(new(started)) == logs.tasks(spark)  # one task wrote all of a small table
    found = [os.path.join(d, f) for d, _, names in os.walk(path.removeprefix("file://")) for f in names]
    assert len(found) == 2 * 302 - 1 and not [f for f in found if os.path.basename(f).startswith(".")]
    started, before = tracker.getJobIdsForGroup(None), spark.conf.get(logs.LISTING)
    files = logs.below(spark, path)
    assert 0 < max(new(started)) <= logs.tasks(spark) and spark.conf.get(logs.LISTING) == before
    assert files.count() == len(found)
    kinds = {k: f"/kind={k}/" for k in ("one", "two")}
    read = lambda: {int(r["folder"]): (r["one"], r["two"]) for r in logs.from_folders(spark, path, r"/id=(-?\d+)/", kinds).collect()}
    with pytest.raises(Exception, match="two logs in 5: 0"):
        read()
    logs.put(os.path.join(path.removeprefix("file://"), "id=5", "kind=two"), b"x")
    assert read() == {i: (a, "x" if i == 5 else b) for i, a, b in texts}
    # a second row of a key with another text
    path = logs.to_folders(spark, spark.createDataFrame([(1, "a", "b"), (1, "a", "c")], "id int, one string, two string"), "id", ["one", "two"])
    with pytest.raises(Exception, match="two logs in 1: 2"):
        read()
    # where Spark writes
    monkeypatch.setattr(logs, "MOUNTED", ())
    path = logs.to_folders(spark, df.limit(3), "id", ["one", "two"])
    assert read() == {i: (a + "\n", b + "\n") for i, a, b in texts[:3]}


def test_a_second_run_makes_nothing_and_a_lost_output_alone_is_made_again(spark, tmp_path):
    import shutil

    from pointweave.sources import manifest

    folder, made = str(tmp_path / "job"), []
    items = spark.createDataFrame([("a b", 1), ("c/d=1", 2), ("é+%", 3)], "item string, k int")

    def work(todo):
        made.append({r["item"] for r in todo.collect()})
        return todo.select("item", (F.col("k") * 10).alias("v"))

    assert manifest.resumed(items, folder, work) == 3
    assert manifest.resumed(items, folder, work) == 0 and len(made) == 1
    want = {("a b", 10), ("c/d=1", 20), ("é+%", 30)}
    assert {tuple(r) for r in manifest.outputs(spark, folder, "v int").collect()} == want
    lost = next(d for d in os.listdir(folder) if "c%2Fd" in d)
    shutil.rmtree(f"{folder}/{lost}")
    assert [r["item"] for r in manifest.absent(items, folder).collect()] == ["c/d=1"]
    assert manifest.resumed(items, folder, work) == 1 and made[1:] == [{"c/d=1"}]
    with pytest.raises(Exception, match="stop"):
        manifest.resumed(spark.createDataFrame([("new", 1)], "item string, k int"), folder, lambda t: t.select("item", F.raise_error(F.lit("stop")).cast("int").alias("v")))
    assert {tuple(r) for r in manifest.outputs(spark, folder, "v int").collect()} == want
    assert manifest.resumed(items.where("k > 9"), folder, work) == 0


def test_logs_keep_to_one_line_each(spark):
    texts = ["a\nb", "", "c\\n\\b\td\r\n\\", "e \n\n"]
    df = spark.createDataFrame([(i, t, None if i == 1 else t + "x") for i, t in enumerate(texts)], "id long, one string, two string")
    path = logs.to_files(spark, df, "id", ["one", "two"])
    assert spark.read.text(path).count() == 7
    got = {r["id"]: (r["one"], r["two"]) for r in logs.from_files(spark, path, "id", ["one", "two"]).collect()}
    assert got == {i: (t, None if i == 1 else t + "x") for i, t in enumerate(texts)}
