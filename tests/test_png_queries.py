from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom import kernels
from scanloom.operators import chunks, codec, pixels
from scanloom.plans import fixtures, queries, rasters
from scanloom.sources import png as source


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(name, same):
    assert len(same(queries.QUERIES[name], queries.SQL[name])) > 0


def test_sizes_by_strategy_and_level(spark, sf):
    by = {(r.strategy, r.strict): r.bytes for r in queries.QUERIES["strategy_bruteforce"](spark, sf).collect()}
    assert by["bruteforce", True] == by["zero", False]
    sizes = {r.level: r.bytes for r in queries.QUERIES["compression_level_monotone"](spark, sf).collect()}
    assert sizes[0] >= sizes[1] >= sizes[6] >= sizes[9] == sizes[10]


def test_mean_by_label_is_as_published(spark):
    import __spark_entry__

    got = {r.label: (r.images, r.sum_b) for r in __spark_entry__.entry(spark).collect()}
    assert got[0] == (56, 453896) and got[9] == (63, 510977) and len(got) == 10


def test_every_query_has_sql_for_its_own_name():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_spark_reads_what_we_write(spark, tmp_path):
    """Spark's own image source decodes our files alike; its rows are B, G, R."""
    rng = np.random.default_rng(2)
    for color, channels in ((0, 1), (2, 3)):
        x = rng.integers(0, 256, (1, 7, 5, channels), dtype=np.uint8)
        folder = tmp_path / str(color)
        folder.mkdir()
        (folder / "a.png").write_bytes(kernels.encode_images(x, color, 8)[0])
        r = spark.read.format("image").load(str(folder)).select("image.*").first()
        got = np.frombuffer(bytes(r.data), np.uint8).reshape(7, 5, r.nChannels)
        assert (got[:, :, ::-1] == x[0]).all()


def test_options_of_the_source(spark, sf, tmp_path):
    source.register(spark)
    path = str(tmp_path / "out")
    own = rasters.rasters(spark, sf, "palette").filter("image_id < 5").withColumn("name", F.col("image_id").cast("string"))
    write = own.write.format("png").option("interlace", "true").option("filter_strategy", "entropy").option("compression_level", "9")
    write.mode("append").save(path)
    back = spark.read.format("png").load(path).orderBy("path").collect()
    want = {r["name"]: r for r in own.collect()}
    assert len(back) == 5
    for r in back:
        w = want[r.path.rsplit("/", 1)[1][:-4]]
        assert bytes(r.samples) == bytes(w.samples) and r.interlace and r.palette == w.palette and r.alphas == w.alphas
    own.limit(2).write.format("png").mode("overwrite").save(path)
    assert spark.read.format("png").load(path).count() == 2
    assert spark.read.format("png").option("strict_reference", "true").load(path).filter("error IS NOT NULL").count() == 0


def test_pushed_names(spark, tmp_path):
    source.register(spark)
    (tmp_path / "a.png").write_bytes(fixtures.png(kernels.chunk(b"tEXt", b"k\0v"), fixtures.IDAT, fixtures.IEND))
    c = spark.read.format("png_chunks").load(str(tmp_path))
    assert [r.name for r in c.collect()] == ["IHDR", "tEXt", "IDAT", "IEND"]
    assert [r.name for r in c.filter("name IN ('tEXt', 'IEND')").collect()] == ["tEXt", "IEND"]
    assert c.filter("name = 'tEXt' AND chunk_idx = 9").count() == 0


def frame(spark, rows):
    return spark.createDataFrame([(k, bytearray(d) if d is not None else None) for k, d in enumerate(rows)], "image_id int, content binary")


def test_empty_null_and_repeated_files(spark):
    good = fixtures.png(fixtures.IDAT, fixtures.IEND)
    f = frame(spark, [None, b"", good, good])
    got = [(r.image_id, r.error.code if r.error else None) for r in codec.decode_png(f).orderBy("image_id").collect()]
    assert got == [(1, "Io"), (2, None), (3, None)]
    assert [r.n for r in chunks.split_chunks(f).groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).orderBy("image_id").collect()] == [1, 3, 3]
    none = frame(spark, [])
    assert codec.decode_png(none).count() == chunks.split_chunks(none).count() == chunks.assemble(chunks.split_chunks(none)).count() == 0


def test_typed_errors_are_those_of_the_decoder(spark):
    """Chunk by chunk, a parse error goes before one of the checksum."""
    kinds = {"BitDepth", "ColorType", "ColorMode", "ImageDimensions", "FilterMethod", "InterlaceMethod", "PhysUnits", "KeySize", "TextLength"}
    rows = [x for x in fixtures.errors() if x[2] in kinds]
    f = spark.createDataFrame([(n, bytearray(d)) for n, d, _ in rows], "image_id string, content binary")
    bad = chunks.typed_chunks(chunks.split_chunks(f)).filter("parse_error IS NOT NULL").select("image_id", "parse_error").collect()
    assert {(r.image_id, r.parse_error) for r in bad} == {(n, c) for n, _, c in rows}


def test_no_python_for_headers_and_checksums(spark, sf):
    files = frame(spark, [fixtures.png(fixtures.IDAT, fixtures.IEND)])
    plan = codec.headers(files)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_metadata_on_the_image_row(spark):
    c = kernels.chunk
    data = fixtures.png(
        c(b"pHYs", struct.pack(">IIB", 3, 4, 1)), c(b"tIME", struct.pack(">HBBBBB", 2020, 13, 2, 3, 4, 5)), c(b"tRNS", b"\0\7"), c(b"bKGD", b"\0\5"), c(b"tEXt", b"a\0b"),
        fixtures.IDAT, c(b"zzZz", b"x"), fixtures.IEND,
    )
    r = codec.decode_png(frame(spark, [data])).first()
    assert (r.physical.ppu_x, r.physical.is_meter, r.time.month, r.key, r.background, r.text) == (3, True, 13, [7], [5], {"a": "b"})
    t = chunks.typed_chunks(chunks.split_chunks(frame(spark, [data]))).filter("name = 'tIME'").first()
    assert t.time.ts is None and t.time.month == 13


def test_collect_pixels_is_the_inverse_of_explode(spark, sf):
    r = rasters.rasters(spark, sf, "rgb16").filter("image_id < 9")
    done = codec.decode_png(codec.encode_png(r))
    back = pixels.collect_pixels(pixels.explode_pixels(done), channels=3, depth=16)
    assert {(x.image_id, bytes(x.samples)) for x in back.collect()} == {(x.image_id, bytes(x.samples)) for x in r.collect()}


def test_texts_with_two_faults_have_the_same_first_one_in_both_ways(spark):
    from scanloom import frames
    from scanloom.errors import PngError
    from scanloom.functions import parsers

    good, long_key = kernels.deflate(b"text"), b"k" * 80
    cases = [
        ("zTXt", long_key + b"\0\1" + good), ("zTXt", long_key + b"\0\0" + good), ("zTXt", b"\0\1" + good), ("zTXt", b"key\0"), ("zTXt", b"key"), ("zTXt", b"key\0\0" + good),
        ("iTXt", long_key + b"\0\0\1"), ("iTXt", b"key\0\0\1"), ("iTXt", b"key\0\0"), ("iTXt", b"key\0\0\0"), ("iTXt", b"key\0\0\0en\0"), ("iTXt", b"key\0\0\0en\0k\0v"),
        ("tEXt", long_key + b"\0v"), ("tEXt", b"\0v"), ("tEXt", b"key"), ("tEXt", b"key\0v"),
    ]
    f = spark.createDataFrame([(k, n, bytearray(d)) for k, (n, d) in enumerate(cases)], "k int, name string, data binary")
    got = {r.k: r.e for r in f.select("k", parsers.error(F.col("name"), F.col("data"), F.lit(False)).alias("e")).collect()}
    for k, (name, data) in enumerate(cases):
        try:
            frames.parse(name, data)
            want = None
        except PngError as e:
            want = e.code
        assert got[k] == want, cases[k]


def test_messages_of_tasks_do_not_grow_with_their_files(tmp_path):
    """A task tells the driver its folder, not the paths of its files; rows of one name are refused, also across tasks."""
    import pickle

    import pyarrow as pa

    def rows(names):
        n = len(names)
        return [pa.RecordBatch.from_pydict({"name": names, "width": [1] * n, "height": [1] * n, "color_type": [0] * n, "bit_depth": [8] * n, "samples": [b"x"] * n})]

    def writer(path):
        return source.ImageWriter({"path": str(path)}, rows(["a"])[0].schema, False)

    w = writer(tmp_path / "a")
    many, one = w.write(rows([str(k) for k in range(150)])), w.write(rows(["own"]))
    assert len(pickle.dumps(many)) == len(pickle.dumps(one))
    w.commit([many, one, None])
    assert len(source._listed(str(tmp_path / "a"))) == 151
    batches = list(source.ImageReader({"path": str(tmp_path / "a")}).read(source.Files(tuple(p for p, _ in source._listed(str(tmp_path / "a"))))))
    assert [b.num_rows for b in batches] == [64, 64, 23] and all(isinstance(b, pa.RecordBatch) for b in batches)
    w = writer(tmp_path / "b")
    with pytest.raises(ValueError):
        w.write(rows(["x", "x"]))
    with pytest.raises(ValueError):
        w.commit([w.write(rows(["x"])), w.write(rows(["x"]))])


def test_chunks_of_many_files_are_made_in_parts(spark, monkeypatch):
    import pyarrow as pa

    seen = []
    files = spark.createDataFrame([(1, bytearray(b"x"))], "image_id int, content binary")
    monkeypatch.setattr(type(files), "mapInArrow", lambda self, f, schema: seen.append(f) or (_ for _ in ()).throw(KeyError))
    with pytest.raises(KeyError):
        chunks.split_chunks(files)
    big = fixtures.png(kernels.chunk(b"tEXt", b"k\0" + b"v" * (1 << 20)), fixtures.IDAT, fixtures.IEND)
    batch = pa.RecordBatch.from_pydict({"image_id": pa.array(range(12), pa.int32()), "content": pa.array([*[big] * 10, None, big], pa.binary())})
    out = list(seen[0](iter([batch])))
    assert len(out) >= 3 and sum(b.num_rows for b in out) == 44 and max(b.nbytes for b in out) < 5 << 20
