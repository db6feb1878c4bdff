import hashlib
import os
import zlib

import numpy as np
import pytest

from attestor.llm import media

DOC = "doc_id long, text string"
TEXTS = [None, "", "a", "x" * 64, "x" * 65, "é😀" * 1000, "long " * 60_000, "a\0", "a"]


def stored(spark, tmp_path, rows, range_bytes, extra=""):
    folder = f"file://{tmp_path}/archives"
    df = spark.createDataFrame(rows, DOC + extra).repartition(3)
    assert media.write_archives(df, folder, range_bytes) == len(rows)
    return media.features(media.read_media(spark, folder), df.schema["doc_id"].dataType.simpleString()).collect()


@pytest.mark.parametrize("range_bytes", [100, 5_000, 1 << 30])
def test_round_trip_by_ranges(spark, tmp_path, range_bytes):
    rows = list(enumerate(TEXTS)) + [(None, "a"), (2, "a")]
    got = stored(spark, tmp_path, rows, range_bytes)
    want = []
    for i, t in rows:
        payload, n = media.payload_of(t)
        png = media.to_png(payload, n)
        want.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest(), media.feature_of(np.frombuffer(payload, np.uint8))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_images_are_what_others_read(tmp_path):
    payload, n = media.payload_of("hello")
    png = media.to_png(payload, n)
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and media.from_png(png) == (payload, 5)
    for broken in (png[:-20], png[:40] + b"x" + png[41:], b"GIF89a"):
        with pytest.raises((ValueError, zlib.error, Exception)):
            media.from_png(broken)


def test_images_are_what_java_reads(spark, tmp_path):
    """Another decoder, Spark's image source, sees the payload as gray samples."""
    payloads = [media.payload_of(t)[0] for t in TEXTS]
    for i, (p, t) in enumerate(zip(payloads, TEXTS)):
        (tmp_path / f"{i}.png").write_bytes(media.to_png(*media.payload_of(t)))
    rows = spark.read.format("image").load(str(tmp_path)).select("image.*").collect()
    assert len(rows) == len(TEXTS) and {(r.width, r.nChannels) for r in rows} == {(64, 1)}
    assert sorted(bytes(r.data) for r in rows) == sorted(payloads)


def plain_feature(samples):
    import math

    n = len(samples)
    mean = sum(samples) / n
    deviation = math.sqrt(sum((x - mean) ** 2 for x in samples) / n)
    bits = -sum(samples.count(v) / n * math.log2(samples.count(v) / n) for v in set(samples))
    step = sum(abs(a - b) for a, b in zip(samples, samples[1:])) / (n - 1)
    sizes = [n // 16 + (i < n % 16) for i in range(16)]
    grid, at = 0, 0
    for i, k in enumerate(sizes):
        grid |= (sum(samples[at : at + k]) / k > mean) << i
        at += k
    return mean, deviation, abs(bits), step, grid


def test_the_query_against_a_plain_version(spark):
    from attestor.llm.queries import QUERIES
    from tests import oracle

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{oracle.DATA}/documents.parquet").collect()}
    rows = QUERIES["op9_media"](spark, oracle.DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    seen = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert seen.setdefault(texts[r.doc_id], r.media_sha256) == r.media_sha256
        if len(payload) < 20_000:
            mean, deviation, bits, step, grid = plain_feature(list(payload))
            told = dict(x.split("=") for x in r.feature.split(" ")[2:])
            assert r.feature.startswith(f"gray8 64x{len(payload) // 64} ") and told["grid"] == f"{grid:04x}"
            for name, v in (("mean", mean), ("dev", deviation), ("bits", bits), ("step", step)):
                assert abs(float(told[name]) - v) < 2e-4


@pytest.mark.parametrize("ids", [["", "a/b.png", "nul\0inside", "ä 😀", None, "x" * 3000, "", ".."]])
def test_ids_of_any_kind(spark, tmp_path, ids):
    folder = f"file://{tmp_path}/archives"
    df = spark.createDataFrame([(i, "t", "clash") for i in ids], "doc_id string, text string, media string").repartition(2)
    assert media.write_archives(df, folder, 300) == len(ids)
    got = media.features(media.read_media(spark, folder), "string").collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted(ids, key=repr)


def test_archives_without_a_manifest(spark, tmp_path):
    """Any archives of stored members: ranges by size, members from each archive's directory."""
    folder = f"file://{tmp_path}/archives"
    media.write_archives(spark.createDataFrame(list(enumerate(TEXTS)), DOC).repartition(2), folder)
    with_it = sorted(map(tuple, media.read_media(spark, folder).collect()))
    import shutil

    shutil.rmtree(tmp_path / "archives" / media.MANIFEST)
    for size in (100, 5_000, 1 << 30):
        assert sorted(map(tuple, media.read_media(spark, folder, size).collect())) == with_it


def test_what_died_attempts_leave_is_not_read(spark, tmp_path):
    folder = f"file://{tmp_path}/archives"
    df = spark.createDataFrame(list(enumerate(TEXTS)), DOC).repartition(2)
    media.write_archives(df, folder)
    for name in ("part-dead.zip", "part-dead.zip.index"):
        (tmp_path / "archives" / name).write_bytes(b"PK half of an arch")
    assert media.read_media(spark, folder).count() == len(TEXTS)
    media.write_archives(df, folder)  # the second run's archives count, not both
    assert media.read_media(spark, folder).count() == len(TEXTS)


def test_members_are_tried_again(spark, tmp_path, monkeypatch):
    stored(spark, tmp_path, list(enumerate(TEXTS)), 1000)
    reader = media.MediaReader({"path": f"file://{tmp_path}/archives"})
    monkeypatch.setattr(media.time, "sleep", lambda s: None)

    class Flaky:
        def __init__(self, file):
            self.file, self.calls = file, 0

        def seek(self, at):
            self.file.seek(at)

        def read(self, n=-1):
            self.calls += 1
            if self.calls % 4 == 1:
                raise OSError("lost")
            return self.file.read(n)

    name = sorted(x for x in os.listdir(tmp_path / "archives") if x.endswith(".zip"))[0]
    with open(tmp_path / "archives" / name, "rb") as f:
        for info in media.zipfile.ZipFile(f).infolist():
            said, blob = reader.member(Flaky(f), info.header_offset, info.file_size, info.CRC)
            assert said == info.filename and media.from_png(blob)
            with pytest.raises(ValueError):
                reader.member(f, info.header_offset, info.file_size, info.CRC ^ 1)
    assert sum(len(b) for p in reader.partitions() for b in reader.read(p)) == len(TEXTS)


def test_empty_table_and_clashes(spark, tmp_path):
    assert stored(spark, tmp_path, [], 100) == []
    got = stored(spark, tmp_path / "b", [(1, "a", "m", 3)], 100, ", member string, offset int")
    assert [r.doc_id for r in got] == [1]
