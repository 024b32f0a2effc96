import base64
import json
import time
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quartzite import api, cli, registry
from quartzite.functions import codecs, security, words
from quartzite.operators import storage
from quartzite.operators.relational import mismatches
from quartzite.sources import archive, files
from quartzite.sources.zips import zip_entries, zip_of
from quartzite.streaming import blocks

FILES = [("a/b.txt", b"hello " * 2000), ("copy.txt", b"hello " * 2000), ("empty", b""), ("w.bin", bytes(range(255)) * 9 + b"xyz"), ("magic.txt", b"QZA1QZS1"), ("ü/é.txt", "straße".encode())]


@pytest.mark.parametrize("solid", [True, False])
def test_container_round_trip_and_checks(solid):
    x = archive.pack(FILES, solid)
    assert list(archive.unpack(x)) == sorted(FILES)
    assert len(x) < sum(len(c) for _, c in FILES)
    for i in (3, len(x) // 2, len(x) - 1):
        bad = bytearray(x)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            list(archive.unpack(bytes(bad)))
    assert list(archive.unpack(archive.pack([], solid))) == []


@pytest.mark.parametrize("path", ["../x", "/abs", "a/../../x", "C:/x", "\\\\host\\x"])
def test_unsafe_paths(path):
    with pytest.raises(ValueError):
        archive.pack([(path, b"")])


def test_stream_round_trip():
    for x in (b"", b"x", b"abcd" * 1000, bytes(range(256)) * 40):
        y = archive.pack_stream(x, 512)
        assert archive.unpack_stream(y) == x
        if x:
            with pytest.raises(ValueError):
                archive.unpack_stream(y[:-1] + bytes([y[-1] ^ 1]) if len(x) < 3 else y[:20] + bytes([y[20] ^ 255]) + y[21:])


def test_archive_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "PART_BYTES", 5000)
    df = spark.createDataFrame([*FILES, ("null", None)], "path string, content binary").repartition(2)
    for solid in (True, False):
        out = str(tmp_path / str(solid))
        archive.write_archive(df, out, solid)
        back = archive.read_archive(spark, out)
        assert mismatches(df.where("content is not null"), back, "path", "content").count() == 0 and back.count() == 7
    with open(tmp_path / "one.qza", "wb") as f:
        f.write(archive.pack(FILES))
    assert archive.read_archive_files(spark, str(tmp_path / "one.qza")).count() == len(FILES)


def tree(root, files):
    for name, content in files:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)


def found(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}


def test_cli_and_scan(spark, tmp_path, capsys):
    tree(tmp_path / "tree", [*FILES, ("skip/x.txt", b"not this")])
    (tmp_path / "key").write_text("open sesame\n")
    assert cli.main(["compress", str(tmp_path / "tree"), str(tmp_path / "out"), "--ignore", "skip", "--fast"]) == 0
    assert cli.main(["info", str(tmp_path / "out")]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert {x["path"]: x["bytes"] for x in lines if "path" in x} == {n: len(c) for n, c in FILES}
    assert cli.main(["decompress", str(tmp_path / "out"), str(tmp_path / "back")]) == 0
    assert found(tmp_path / "back") == dict(FILES)
    assert cli.main(["decompress", str(tmp_path / "out"), str(tmp_path / "rows"), "--table"]) == 0
    assert spark.read.parquet(str(tmp_path / "rows")).count() == len(FILES)
    assert cli.main(["decompress", str(tmp_path / "none"), str(tmp_path / "x")]) == 1
    sealed = ["--passphrase-file", str(tmp_path / "key")]
    assert cli.main(["compress", str(tmp_path / "tree"), str(tmp_path / "sealed"), "--files", "--best", "--ignore", "skip", *sealed]) == 0
    assert cli.main(["decompress", str(tmp_path / "sealed"), str(tmp_path / "no")]) == 1
    assert cli.main(["decompress", str(tmp_path / "sealed"), str(tmp_path / "yes"), *sealed]) == 0
    assert found(tmp_path / "yes") == dict(FILES)


def test_scan_leaves_out_links(spark, tmp_path):
    tree(tmp_path / "t", [("a.txt", b"a"), ("d/b.txt", b"b"), ("e", b"")])
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside" / "x.txt").write_bytes(b"x")
    (tmp_path / "t" / "link.txt").symlink_to(tmp_path / "t" / "a.txt")
    (tmp_path / "t" / "dir").symlink_to(tmp_path / "outside")
    assert {r.relative: r.length for r in files.scan(spark, str(tmp_path / "t")).collect()} == {"a.txt": 1, "d/b.txt": 1, "e": 0}
    assert [r.relative for r in files.scan(spark, str(tmp_path / "t" / "a.txt")).collect()] == ["a.txt"]


def floats(n, seed=0):
    return np.random.default_rng(seed).normal(size=n).astype("<f4")


KINDS = [("m/w.pt", floats(3000).tobytes()), ("m/odd.safetensors", floats(99).tobytes() + b"xy"), ("a.wav", b"RIFF" + bytes(40) + np.random.default_rng(1).integers(0, 99, 3000).astype("<i2").tobytes()), ("i.bmp", bytes(54) + bytes(range(250)) * 20), ("p.zip", zip_of([("a", b"x" * 50)])), ("t.md", b"The cat and the Dog AND the cat. " * 300 + "ß".encode()), ("n.unknown", bytes(range(256)) * 30), ("says.unknown", b"plain words " * 30), ("w.bin", b"text in a bin " * 40), ("e.pt", b"")]


@pytest.mark.parametrize("solid", [True, False])
@pytest.mark.parametrize("speed", ["fast", "normal", "best"])
def test_every_kind_of_file_comes_back(solid, speed):
    x = archive.pack(KINDS, archive.Settings(solid, 0, speed))
    got = {p: (mode, elem, pad, c) for p, mode, elem, pad, c in archive.entries(x)}
    assert {p: g[3] for p, g in got.items()} == dict(KINDS)
    assert {p: g[:2] for p, g in got.items()} == {"m/w.pt": (4, 4), "m/odd.safetensors": (4, 4), "a.wav": (4, 1), "i.bmp": (0, 1), "p.zip": (5, 1), "t.md": (2, 1), "n.unknown": (0, 1), "says.unknown": (2, 1), "w.bin": (2, 1), "e.pt": (4, 4)}
    assert len(x) < sum(len(c) for _, c in KINDS)


@pytest.mark.parametrize("level", [1, 2, 3, 4, 7])
def test_lossy_levels_clear_low_bits_only(level):
    bits = {1: 8, 2: 16, 3: 23, 4: 24, 7: 7}[level]
    for solid in (True, False):
        back = dict(archive.unpack(archive.pack(KINDS, archive.Settings(solid, level))))
        for path, content in KINDS:
            want = bytearray(content)
            if path in ("m/w.pt", "m/odd.safetensors", "e.pt"):
                for i in range(0, len(want) // 4 * 4, 4):
                    want[i : i + 4] = (int.from_bytes(want[i : i + 4], "little") >> bits << bits & 0xFFFFFFFF).to_bytes(4, "little")
            elif path == "w.bin":  # tensors by name, where bits may be lost
                for i in range(0, len(want) // 4 * 4, 4):
                    want[i : i + 4] = (int.from_bytes(want[i : i + 4], "little") >> bits << bits & 0xFFFFFFFF).to_bytes(4, "little")
            elif path == "a.wav":
                want[44::2] = bytes(b & (0xF0 if level == 1 else 0) for b in want[44::2])
            elif path == "i.bmp":
                want[54:] = bytes(b & (0xF8 if level == 1 else 0xF0) for b in want[54:])
            assert back[path] == bytes(want), path


def test_tokens_dictionary_dedup_and_raw_are_used():
    import random

    words = ["".join(random.Random(i).choices("abcdefghij", k=9)) for i in range(400)]
    text = lambda s: " ".join(random.Random(s).choices(words, k=300)).encode()
    files_ = [(f"{i:03d}.txt", text(i)) for i in range(60)]
    one = archive.pack(files_, archive.Settings(False))
    assert dict(archive.unpack(one)) == dict(files_)
    assert len(one) < sum(len(zlib.compress(c, 9)) for _, c in files_)  # what files have in common is stored once
    noise = random.Random(5).randbytes(40_000)
    same = archive.pack([(f"{i}.dat", noise) for i in range(8)])
    assert len(same) < 1.1 * len(noise) and len(archive.pack([("n.dat", noise)])) < 1.01 * len(noise)


@given(st.lists(st.text(alphabet="abcXYZ ,é", max_size=40), max_size=8))
def test_word_codec(texts):
    data = [t.encode() for t in texts]
    vocabulary = words.learn(data) + [b"a", b"ab", b"abc"]
    table = words.forms(vocabulary)
    for x in data:
        y = words.encode(x, table)
        assert words.decode(y, vocabulary) == x
    assert words.encode(b"abc Abc ABC aBc \xff", table) == b"".join([table[b"abc"], b" ", table[b"Abc"], b" ", table[b"ABC"], b" aBc \xff\xff"])
    assert words.decode(b"\x9f\xff\x80", []) == b"\x9f\xff\x80"  # no token of this vocabulary, and half of one


def test_data_source(spark, tmp_path):
    from quartzite.sources.datasource import register

    register(spark)
    df = spark.createDataFrame([*FILES, ("null", None)], "path string, content binary").repartition(2)
    out = str(tmp_path / "archive")
    for speed in ("normal", "fast"):  # the second replaces the first
        df.write.format("quartzite_archive").option("speed", speed).option("path", out).mode("overwrite").save()
    back = spark.read.format("quartzite_archive").load(out)
    assert {r.path: bytes(r.content) for r in back.collect()} == dict(FILES) | {"null": b""}
    assert back.columns == ["path", "mode", "elem", "pad", "content"]
    df.limit(1).withColumn("path", F.lit("more.txt")).write.format("quartzite_archive").option("path", out).mode("append").save()
    assert spark.read.format("quartzite_archive").load(out).count() == len(FILES) + 2
    assert not [p for p in (tmp_path / "archive").iterdir() if p.name.startswith("_draft")]
    (next((tmp_path / "archive").glob("*.qza"))).write_bytes(b"broken")
    with pytest.raises(Exception):
        spark.read.format("quartzite_archive").load(out).collect()


def test_places_by_path(spark, tmp_path):
    paths = [f"d{i * 7919 % 1000}/f" for i in range(500)]
    got = files.ordered(spark.createDataFrame([(p,) for p in paths], "path string").repartition(5), "path", str(tmp_path / "sorted")).collect()
    assert [r.path for r in sorted(got, key=lambda r: r.place)] == sorted(paths) and sorted(r.place for r in got) == list(range(500))


def test_measured_tournaments(spark, tmp_path):
    """Against the libraries themselves, text by text."""
    texts = ["", "a" * 500, "the cat sat on the mat " * 20, "é" * 40, "x", None, "".join(chr(33 + i * i % 90) for i in range(700))]
    spark.createDataFrame([(i, t, f"s{i % 2}") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda q: registry.QUERIES[q](spark, str(tmp_path)).collect()
    sizes = {i: {n: len(codecs.CODECS[n][0]((t or "").encode())) for n in storage.FAST} for i, t in enumerate(texts)}
    best = {i: min(storage.FAST, key=lambda n: (s[n], storage.FAST.index(n))) for i, s in sizes.items()}
    assert {r.doc_id: (r.winner, r["size"]) for r in run("q_tournament")} == {i: (b, sizes[i][b]) for i, b in best.items()}
    total = sum(len((t or "").encode()) for t in texts)
    assert {r.codec: (r.n, r["size"], r.wins) for r in run("q_codec_totals")} == {n: (total, sum(s[n] for s in sizes.values()), list(best.values()).count(n)) for n in storage.FAST}
    of = lambda k: [i for i in sizes if i % 2 == k]
    n = {i: len((t or "").encode()) for i, t in enumerate(texts)}
    ratio = {k: {c: sum(n[i] for i in of(k)) / sum(sizes[i][c] for i in of(k)) for c in storage.FAST} for k in (0, 1)}
    assert {r.source: (r.best_ratio_codec, r.best_ratio) for r in run("q_codec_winner")} == {f"s{k}": (max(storage.FAST, key=lambda c: (ratio[k][c], -storage.FAST.index(c))), round(max(ratio[k].values()), 4)) for k in (0, 1)}
    assert {r.source: (r.improved, r.n_docs) for r in run("q_scorecard")} == {f"s{k}": (sum(0 < n[i] and sizes[i][best[i]] < n[i] for i in of(k)), len(of(k))) for k in (0, 1)}


def test_online_state_goes_on_between_micro_batches(spark, tmp_path):
    import math

    rows = [(i, "ab"[i % 2], "".join(chr(97 + (i * j) % 7) for j in range(900))) for i in range(9)]
    for part in range(3):
        spark.createDataFrame(rows[part * 3 : part * 3 + 3], "id long, k string, x string").coalesce(1).write.parquet(str(tmp_path / "in" / f"{part}"))
    src = spark.readStream.schema("id long, k string, x string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    listener = blocks.Progress()
    spark.streams.addListener(listener)
    blocks.stream_online(src, "k", "id", "x", str(tmp_path / "o"), str(tmp_path / "c"), step=40).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "o")).collect()
    assert len(got) == 6  # both keys in each of three micro-batches
    for key in "ab":
        f, bits, n = [1] * 256, 0.0, 0
        order = sorted((r for r in rows if r[1] == key), key=lambda r: r[0])
        seen = {}
        for _, _, x in order:
            for b in x.encode():
                bits -= math.log2(f[b] / sum(f))
                f[b] += 40
                n += 1
                if sum(f) > 32_000:
                    f = [max(1, v // 2) for v in f]
            seen[n] = (round(bits, 4), sum(f))
        mine = {r.n: (round(r.bits, 4), r.total) for r in got if r.key == key}
        assert max(mine) == n and all(mine[k] == seen[k] for k in mine if k in seen)
    spark.streams.removeListener(listener)


def test_api():
    assert api.text_entropy("")["entropy_bits_per_byte"] == 0
    assert api.text_entropy(b"ab")["entropy_bits_per_byte"] == 1
    status, body = api.handle("compress", json.dumps({"text": "hello " * 99}))
    status2, back = api.handle("decompress", json.dumps({"data": json.loads(body)["data"]}))
    assert (status, status2) == (200, 200) and base64.b64decode(json.loads(back)["data"]).decode() == "hello " * 99
    assert json.loads(back)["sha256"] == json.loads(body)["sha256"]
    assert api.handle("decompress", json.dumps({"data": "!"}))[0] == 400 and api.handle("entropy", "{")[0] == 400 and api.handle("none", '{"text": ""}')[0] == 404
    assert api.handle("decompress", json.dumps({"data": base64.b64encode(security.MAGIC).decode()}))[0] == 403
    assert api.handle("status", "")[0] == 200
    assert api.metrics(0, 0, 0)["ratio"] == 0


def test_encrypted_requests(spark):
    status, body = api.handle("compress", json.dumps({"text": "secret " * 50, "passphrase": "p"}))
    data = json.loads(body)["data"]
    assert status == 200 and security.MAGIC == base64.b64decode(data)[: len(security.MAGIC)]
    status, back = api.handle("decompress", json.dumps({"data": data, "passphrase": "p"}))
    assert status == 200 and base64.b64decode(json.loads(back)["data"]) == b"secret " * 50
    bad = bytearray(base64.b64decode(data))
    bad[-1] ^= 1
    for request in ({"data": data}, {"data": data, "passphrase": "q"}, {"data": base64.b64encode(bad).decode(), "passphrase": "p"}):
        assert api.handle("decompress", json.dumps(request))[0] == 403


def test_report(spark, tmp_path):
    api.report(spark.createDataFrame([("a", 1)], "codec string, n long"), str(tmp_path / "r"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "r")).select("codec", "n").collect()] == [("a", 1)]


def test_encryption(spark):
    df = spark.createDataFrame([(1, b"one"), (2, b""), (3, None)], "id int, x binary")
    sealed = security.encrypt(df, "x", "p").unionByName(security.encrypt(df.where("id = 1").withColumn("id", F.lit(4)), "x", "p"))
    assert {r.id: r.x and bytes(r.x) for r in security.decrypt(sealed, "x", "p").collect()} == {1: b"one", 2: b"", 3: None, 4: b"one"}
    wrong = sealed.where("id = 1").unionByName(spark.createDataFrame([(9, b"plain")], "id int, x binary"))
    assert [r.x for r in security.decrypt(wrong, "x", "q", strict=False).collect()] == [None, None]
    tampered = sealed.where("id = 1").select("id", F.concat(F.expr("substring(x, 1, octet_length(x) - 1)"), F.lit(bytearray(b"\0"))).alias("x"))
    one = bytes(sealed.where("id = 1").first().x)
    flipped = spark.createDataFrame([(1, bytearray(one[:-1] + bytes([one[-1] ^ 1])))], "id int, x binary")
    assert security.decrypt(flipped, "x", "p", strict=False).first().x is None
    with pytest.raises(Exception):
        security.decrypt(flipped, "x", "p").collect()
    with pytest.raises(Exception):
        security.decrypt(wrong, "x", "q").collect()


def test_many_salts_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(security, "ROUNDS", 10)
    df = spark.createDataFrame([(i, f"v{i}".encode(), "s", "k") for i in range(6)], "row int, x binary, salt string, key string")
    parts = [security.encrypt(df.where(F.col("row") == i), "x", "p") for i in range(6)]
    sealed = parts[0]
    for p in parts[1:]:
        sealed = sealed.unionByName(p)
    for most in (4096, 2):
        monkeypatch.setattr(security, "SENT_SALTS", most)
        out = security.decrypt(sealed, "x", "p")
        assert out.columns == df.columns and {(r.row, bytes(r.x), r.salt, r.key) for r in out.collect()} == {(r.row, bytes(r.x), r.salt, r.key) for r in df.collect()}


def test_zip_entries(spark):
    df = spark.createDataFrame([(1, zip_of([("m/data/0", b"abc"), ("x.json", b"{}")])), (2, b"no zip"), (3, None)], "id int, z binary")
    rows = zip_entries(df, "z", ["id"]).collect()
    assert [(r.id, r.name, r.size, r.is_tensor, r.is_metadata) for r in rows] == [(1, "m/data/0", 3, True, False), (1, "x.json", 2, False, True)]


def test_streams_add_each_batch_once(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab" * i, "s" + str(i % 2)) for i in range(6)], "id long, text string, source string")
    df.repartition(3).write.parquet(str(tmp_path / "t"))
    out, check = str(tmp_path / "o"), str(tmp_path / "c")
    listener = blocks.Progress()
    spark.streams.addListener(listener)
    for _ in range(2):
        blocks.stream_histogram(blocks.read_stream(spark, str(tmp_path / "t")), "text", "source", out, check).awaitTermination()
    for _ in range(100):  # the listener's bus is behind
        if sum(e["status"] == "done" for e in listener.events) == 2:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert sum(e.get("rows", 0) for e in listener.events) >= 6 and {"started", "progress", "done"} <= {e["status"] for e in listener.events}
    assert {r.key: (r.total, round(r.entropy, 6)) for r in blocks.stream_entropy(spark, out).collect()} == {"s0": (12, 1.0), "s1": (18, 1.0)}
    blocks.stream_blocks(blocks.read_stream(spark, str(tmp_path / "t")), "id", "text", str(tmp_path / "b"), str(tmp_path / "bc")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "b")).where("length(restored) = 32").count() == 5


def test_sql_functions(spark):
    from quartzite.functions.sql import register

    register(spark)
    r = spark.sql("SELECT entropy(CAST('abab' AS BINARY)) AS e, crc32c(CAST('123456789' AS BINARY)) AS c, entropy(CAST(NULL AS BINARY)) AS n").first()
    assert (r.e, r.c, r.n) == (1.0, 0xE3069283, None)
    assert spark.sql("SELECT group_entropy(x) FROM VALUES (CAST('a' AS BINARY)), (CAST('b' AS BINARY)) t(x)").first()[0] == 1.0
    spark.createDataFrame([(bytearray(zip_of([("m/data/0", b"abc")])), bytearray(archive.pack(FILES)))], "z binary, a binary").createOrReplaceTempView("boxes")
    assert [tuple(r) for r in spark.sql("SELECT e.name, e.size FROM boxes, LATERAL zip_entries(z) e").collect()] == [("m/data/0", 3)]
    assert {r.path: r.n for r in spark.sql("SELECT e.path, octet_length(e.content) AS n FROM boxes, LATERAL archive_entries(a) e").collect()} == {p: len(c) for p, c in FILES}
    assert [tuple(r) for r in spark.sql("SELECT * FROM text_parts('ab, c') ORDER BY pos").collect()] == [(0, "ab"), (1, ", "), (2, "c")]


def test_decode_any():
    import bz2
    import lzma
    import zlib

    from quartzite.operators.extras import decode_any

    for x in (b"", b"BZh not really", b"\x78\x9c\x00", b"text"):
        assert decode_any(x) == ("raw", x)
    assert decode_any(bz2.compress(b"a")) == ("bzip2", b"a") and decode_any(lzma.compress(b"a")) == ("lzma", b"a") and decode_any(zlib.compress(b"a")) == ("zlib", b"a")
