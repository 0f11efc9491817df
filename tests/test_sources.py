import bz2
import io
import tarfile
import zipfile

from corpusloom.sources import archives, files
from corpusloom.streaming import events
from tests.conftest import rows


def test_ragged_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("m.csv", "a,1,t,in,n,1,ham, hello,world ,,\nshort,row\nb,2,t,in,n,1,spam,caf\xe9\n".encode("latin-1"))
        z.writestr("sub/n.csv", "a,1,t,in,n,1,ham, ,")
    got = rows(archives.ragged_zip(spark, str(tmp_path / "a.zip")).select("source_record", "raw_text", "label"))
    assert got == [("m:1", "hello,world", 0), ("m:3", "café", 1), ("n:1", "", 0)]


def test_headed_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("in/v.csv", 'COMMENT_ID,AUTHOR,DATE,CONTENT,CLASS\nx1,a,d,"hi, y\xf6u",1\n'.encode("latin-1"))
        z.writestr("__MACOSX/v.csv", "COMMENT_ID,AUTHOR,DATE,CONTENT,CLASS\nx2,a,d,no,1\n")
    assert rows(archives.headed_zip(spark, str(tmp_path / "b.zip")).select("source_record", "raw_text", "label")) == [("v.csv:x1", "hi, yöu", 1)]


def test_mail_tar(spark, tmp_path):
    mail = b"Subject: Hello\nContent-Type: text/plain; charset=latin-1\nContent-Transfer-Encoding: 8bit\n\ncaf\xe9\n"
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as t:
        for name, body in (("spam_1/0001", mail), ("ham_1/cmds", b"x"), ("ham_1/0002", b"Subject: Only\n\n")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    (tmp_path / "hard_spam_2.tar.bz2").write_bytes(bz2.compress(raw.getvalue()))
    got = rows(archives.mail_tar(spark, str(tmp_path / "hard_spam_2.tar.bz2")).select("source_record", "raw_text", "label"))
    assert [(a, b.strip(), c) for a, b, c in got] == [("hard_spam_2.tar.bz2:ham_1/0002", "Only", 1), ("hard_spam_2.tar.bz2:spam_1/0001", "Hello\ncafé", 1)]


def test_coerced_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('Group;Message\n1; bir \n2;"iki;iki"\nx;no\n3;no\n1;\n')
    got = rows(archives.coerced_csv(spark, str(tmp_path / "t.csv")).select("source_record", "raw_text", "label"))
    assert got == [("row:2", "bir", 1), ("row:3", "iki;iki", 0)]


def test_cache_is_renewed_when_the_source_changes(spark, tmp_path):
    src, cache, calls = str(tmp_path / "src"), str(tmp_path / "cache"), []

    def make(p):
        calls.append(p)
        return spark.read.parquet(p)

    spark.range(3).write.parquet(src)
    for _ in range(2):
        assert files.cached(spark, src, cache, make).count() == 3
    assert len(calls) == 1
    spark.range(5).write.mode("overwrite").parquet(src)
    assert files.cached(spark, src, cache, make).count() == 5 and len(calls) == 2


def test_resumption(spark, tmp_path):
    out, seen = str(tmp_path / "done"), []

    def run(work):
        seen.append(sorted(r[0] for r in work.collect()))
        return work

    files.append_missing(spark.range(3).toDF("k"), out, ["k"], run)
    assert rows(files.append_missing(spark.range(5).toDF("k"), out, ["k"], run)) == [(k,) for k in range(5)]
    assert seen == [[0, 1, 2], [3, 4]]


def test_stream_equals_batch(spark, tmp_path):
    e = spark.sql("select id event_id, timestamp_ntz '2024-01-01 10:00:00' + make_dt_interval(cast(id % 3 as int)) ts, 'a' event_type, double(id) value from range(30)")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    streamed = events.run_once(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert rows(streamed) == rows(events.windowed(spark.read.parquet(str(tmp_path / "in"))))
