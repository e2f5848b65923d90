import base64
import gzip
import hashlib

from quillspark.llm import fixity

KIND = "at long, body string, other int"


def test_audit_finds_exactly_the_differences(spark):
    rows = [(i * 37, f"record {i}", 0) for i in range(300)] + [(5, None, 1), (5, None, 2), (None, "x", 0)]
    bad = [r for r in rows if r[0] != 37 * 20]
    bad[40] = (bad[40][0], "flipped", 0)
    bad[-2] = (5, "", 2)
    bad.append((37 * 299 + 70_000, "extra", 0))
    one, two = spark.createDataFrame(rows, KIND), spark.createDataFrame(bad, KIND)
    got = {r.record_id: r.fault for r in fixity.audit(one, two, "at", ["body"]).collect()}
    assert got == {37 * 20: "missing", bad[40][0]: "changed", 5: "changed", 37 * 299 + 70_000: "added"}
    assert fixity.audit(one, one, "at", ["body"]).count() == 0
    assert fixity.audit(one.limit(0), one.limit(0), "at", ["body"]).count() == 0
    assert {r.fault for r in fixity.audit(one, one.limit(0), "at", ["body"]).collect()} == {"missing"}


def test_rows_without_an_offset_are_audited(spark):
    rows = [(0, "a", 0), (700, "b", 0), (-5, "c", 0), (-6, "d", 0), (-7, "same", 0), (None, "e", 0), (None, "f", 0)]
    bad = [*rows[:2], (-5, "flipped", 0), (-7, "same", 0), (-8, "new", 0), (None, "f", 0), (None, "g", 0)]
    one, two = spark.createDataFrame(rows, KIND), spark.createDataFrame(bad, KIND)
    assert {r.record_id: r.fault for r in fixity.audit(one, two, "at", ["body"]).collect()} == {-5: "changed", -6: "missing", -8: "added", None: "changed"}
    assert fixity.audit(one, one, "at", ["body"]).count() == 0


def test_equal_roots_end_the_audit(spark, monkeypatch):
    read = []
    monkeypatch.setattr(fixity, "_differing", lambda a, b, own=fixity._differing: read.append(1) or own(a, b))
    one = spark.createDataFrame([(i * 300, "x", 0) for i in range(300)], KIND)  # three levels
    assert fixity.audit(one, one, "at", ["body"]).count() == 0
    assert len(read) == 2  # the roots, and the records outside the ranges


def test_columns_with_the_operators_own_names(spark):
    rows = [(1, "a", "p", "q"), (2, "b", "p", "q")]
    kind = "node long, hash string, up string, d string"
    one, two = spark.createDataFrame(rows, kind), spark.createDataFrame([rows[0], (2, "c", "p", "q")], kind)
    assert [(r.record_id, r.fault) for r in fixity.audit(one, two, "node", ["hash"]).collect()] == [(2, "changed")]


def warc(blocks, flip=None):
    out, offsets = b"", []
    for i, block in enumerate(blocks):
        digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
        body = block if i != flip else bytes([block[0] ^ 1]) + block[1:]
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{i}>\r\nWARC-Target-URI: http://example.com/{i}\r\nWARC-Block-Digest: sha1:{digest}\r\nContent-Length: {len(block)}\r\n\r\n"
        offsets.append(len(out))
        out += head.encode() + body + b"\r\n\r\n"
    return out, offsets


def test_warc_files_are_read_with_offsets_and_audited(spark, tmp_path):
    blocks = [b"plain", b"\xff\xfe\x00 bytes \r\n\r\nWARC/1.0\r\nnot a record\r\n\r\n", b"x" * 5000, b"last"]
    good, offsets = warc(blocks)
    bad, _ = warc(blocks, flip=2)
    for name, data in (("one", good), ("two", bad)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(data)
        members = offsets[1:] + [len(data)]
        (tmp_path / name / "b.warc.gz").write_bytes(b"".join(gzip.compress(data[a:b]) for a, b in zip(offsets, members, strict=True)))
    one, two = (fixity.warc_records(spark, str(tmp_path / x)) for x in ("one", "two"))
    got = one.orderBy("archive", "offset").collect()
    assert [(r.offset, r.warc_id, r.length, r.digest_fits) for r in got] == 2 * [(o, f"<urn:uuid:{i}>", len(b), True) for i, (o, b) in enumerate(zip(offsets, blocks, strict=True))]
    assert [r.offset for r in two.where("not digest_fits").collect()] == 2 * [offsets[2]]
    short = [x.selectExpr("regexp_extract(archive, '[^/]+$', 0) AS file", "offset", "sha256") for x in (one, two)]
    faults = fixity.audit(*short, "offset", ["sha256"], archive="file").collect()
    assert sorted((r.file, r.record_id, r.fault) for r in faults) == [("a.warc", offsets[2], "changed"), ("b.warc.gz", offsets[2], "changed")]


def test_split_warc_files_keep_their_offsets(spark, tmp_path):
    data, offsets = warc([f"block {i} ".encode() * 40 for i in range(400)])
    (tmp_path / "c.warc").write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = fixity.warc_records(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.offset for r in got) == offsets and all(r.digest_fits for r in got)
