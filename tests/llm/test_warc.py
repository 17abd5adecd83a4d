import base64
import hashlib
import time

import pytest

from tallyspark.llm import warc

PAGES = [(1, "http://a/", "same"), (5, "http://b/", "same"), (3, "http://c/", "same"), (4, "http://d/", "other é"), (6, None, None), (7, "http://e/", ""), (None, "http://f/", "same"), (8, "http://g/\r\nX: y", "x" * 500_000), (5, "http://b/", "same")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, 1, "h") for p in PAGES], "page_id long, url string, html string, id long, header string")


def expected(least=0):
    out = []
    for key, _, html in PAGES:
        raw = (html or "").encode()
        same = [k for k, _, h in PAGES if (h or "").encode() == raw and k is not None]
        last = max(same, default=None)
        revisit = len(raw) >= least and key != last
        out.append((key, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 1, 5])
def test_archive_reads_back(pages, least):
    assert sorted(map(tuple, warc.archive_pages(pages, least).collect()), key=repr) == expected(least)


def test_records_are_exact(pages, spark, tmp_path):
    rows = warc.addressed(pages, "page_id", "url", "html")
    headers, payloads = warc.write_archive(rows, f"file://{tmp_path}/archive")
    assert payloads.count() == len({(h or "") for _, _, h in PAGES})
    for r in warc.reconstruct(headers, payloads).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n")
        block = rest[:-4]
        assert len(block) == int(fields["Content-Length"]) and fields["WARC-Type"] == r.record_type
        digest = base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()
        assert fields["WARC-Payload-Digest"] == f"sha1:{digest}"
        assert block == (b"" if r.record_type == "revisit" else bytes(r.payload))
        assert ("WARC-Refers-To" in fields) == (r.record_type == "revisit")
    again = warc.read_archive(spark, f"file://{tmp_path}/archive")
    assert again[0].count() == len(PAGES)


def test_damage_is_noticed(pages):
    from pyspark.sql import functions as F

    headers, payloads = warc.write_archive(warc.addressed(pages, "page_id", "url", "html"))
    damaged = payloads.withColumn("payload", F.concat("payload", F.lit("!").cast("binary")))
    with pytest.raises(Exception, match="does not match its address"):
        warc.record_facts(warc.reconstruct(headers, damaged)).collect()


@pytest.mark.parametrize("old, new", [("Content-Length: ", "Content-Length: 1"), ("WARC-Payload-Digest: sha1:", "WARC-Payload-Digest: sha1:A"), ("WARC-Type: response", "WARC-Type: revisit"), ("\r\n\r\n", "\r\n")])
def test_false_headers_are_noticed(pages, old, new):
    from pyspark.sql import functions as F

    headers, payloads = warc.write_archive(warc.addressed(pages, "page_id", "url", "html"))
    false = headers.withColumn("header", F.replace("header", F.lit(old), F.lit(new)))
    with pytest.raises(Exception, match="does not agree with itself"):
        warc.record_facts(warc.reconstruct(false, payloads)).collect()


def test_no_pages(pages):
    assert warc.archive_pages(pages.where("false")).collect() == []


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (blocks.apply(i).getName() for i in range(blocks.size())) if name.startswith("shuffle_")}


@pytest.mark.parametrize("to_path", [False, True])
def test_writing_leaves_no_shuffle_files(pages, spark, tmp_path, to_path):
    before = shuffle_files(spark)
    rows = warc.addressed(pages, "page_id", "url", "html")
    archive = warc.write_archive(rows, f"file://{tmp_path}/archive" if to_path else None)
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    # shuffles of the reader's own plans stay, and the setting is as it was
    found = warc.reconstruct(*archive)
    assert found.count() == found.count() == len(PAGES)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
