import gzip

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, Not, StringStartsWith

from feedloom.llm import warc

PAGES = [(1, "http://a.org/x", "<p>één</p>"), (2, "http://b.org/é y\nz", "WARC/1.0\r\n\r\nWARC-Type: response\r\n\r\n"), (3, None, ""), (None, "http://c.org", "x"), (4, "http://d.org", None), (1, "http://a.org/x", "<p>één</p>"), (5, "http://e.org", "long " * 200_000)]


def frame(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' path", "1 payload")


def test_round_trip(spark):
    got = sorted(((r.page_id, r.html) for r in warc.archived(frame(spark)).collect()), key=str)
    assert got == sorted(((i, h) for i, _, h in PAGES if h is not None), key=str)
    assert warc.archived(frame(spark).limit(0)).count() == 0


@pytest.mark.parametrize("compressed", [True, False])
def test_filters_and_skipping(spark, tmp_path, compressed):
    uri = f"file://{tmp_path}/w"
    assert sum(r.records for r in warc.write_warc(frame(spark).repartition(3), uri, compressed=compressed).collect()) == len(PAGES)

    def df(**k):
        return warc.read_warc(spark, uri, **k)

    n = {r.warc_type: r["count"] for r in df().groupBy("warc_type").count().collect()}
    assert n["request"] == 7 and n["response"] == 6 and n["metadata"] == 1 and n["warcinfo"] >= 1
    assert [r.http_status for r in df().filter((F.col("warc_type") == "response") & F.col("target_uri").startswith("http://a.org")).collect()] == [200, 200]
    assert df().filter("content_length > 100000").count() == 1
    assert df().filter("target_uri is null and warc_type = 'response'").count() == 1
    assert df().filter("warc_type not in ('request', 'warcinfo')").count() == 7
    assert df().filter("http_status = 200").count() == 6
    assert df(payload=False).filter("payload is not null").count() == 0
    assert df().select("headers").first().headers["warc-type"]
    both = df().filter("warc_type = 'request'").alias("q").join(df().filter("warc_type = 'response'").alias("r"), "record_id")
    assert both.count() == 4 + 3  # the page that is there twice, and four others but for the one without an id and the one without text


def test_reader_takes_the_filters(spark, tmp_path):
    warc.write_warc(frame(spark).coalesce(1), f"file://{tmp_path}/w").collect()
    reader = warc.WarcReader({"path": f"file://{tmp_path}/w"})
    assert len(list(reader.pushFilters([EqualTo(("warc_type",), "request"), EqualTo(("http_status",), 200)]))) == 2
    assert len(reader.filters) == 1
    got = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in got) == 7 and {x for b in got for x in b.column(0).to_pylist()} == {"request"}


def test_payload_that_is_not_wanted_is_not_parsed(tmp_path, monkeypatch):
    a = warc._record("response", b"Content-Type: application/http\r\n", b"HTTP/1.1 200 OK\r\n\r\nbody" + b"z" * 500_000)
    b = warc._record("request", b"Content-Type: application/http\r\nX-Long: one\r\n two\r\n", b"GET / HTTP/1.1\r\n\r\n")
    seen = []
    real = warc._http
    monkeypatch.setattr(warc, "_http", lambda raw, kind: seen.append(len(raw)) or real(raw, kind))
    for name, raw in (("p.warc", (a + b) * 3), ("g.warc.gz", (gzip.compress(a) + gzip.compress(b)) * 3)):
        (tmp_path / name).write_bytes(raw)
        seen.clear()
        got = list(warc.records(f"file://{tmp_path}/{name}", [EqualTo(("warc_type",), "request")]))
        assert len(got) == 3 and len(seen) == 3 and max(seen) < 100
        assert got[0][6]["x-long"] == "one two"
        assert len(list(warc.records(f"file://{tmp_path}/{name}"))) == 6
        (tmp_path / name).write_bytes(raw[: len(raw) - 40])
        assert len(list(warc.records(f"file://{tmp_path}/{name}"))) >= 5
    (tmp_path / "bad.warc").write_bytes(b"not an archive\r\n\r\nat all")
    assert list(warc.records(f"file://{tmp_path}/bad.warc")) == []


@pytest.mark.parametrize("compressed", [True, False])
def test_damage_does_not_end_a_file(spark, tmp_path, compressed):
    each = [warc._record("response", f"WARC-Record-ID: <r{i}>\r\nContent-Type: text/plain\r\n".encode(), f"body {i} ".encode() * 400) for i in range(9)]
    if compressed:
        each = [gzip.compress(x, 1) for x in each]
        each[2] = each[2][:40] + b"\xff" * 20 + each[2][60:]
        each[6] = each[6][: len(each[6]) // 2]
    else:
        each[2] = b"WRAC" + each[2][4:]
        each[6] = each[6][: len(each[6]) // 2]
    (tmp_path / "x.warc").write_bytes(b"".join(each) + (b"" if compressed else b"rubbish at the end"))
    uri = f"file://{tmp_path}/x.warc"
    lost = {2, 6} if compressed else {2, 6, 7}  # the short record's length runs on into the next one
    want = {f"<r{i}>" for i in range(9)} - {f"<r{i}>" for i in lost}
    for payload in (True, False):
        got = list(warc.records(uri, payload=payload, mode="PERMISSIVE"))
        whole = [r for r in got if r[0] == "response"]
        assert want <= {r[1] for r in whole} and len({r[1] for r in whole}) == len(whole)
        assert all(r[8] is None or r[8] == f"body {r[1][2]} ".encode() * 400 for r in whole if r[1] in want)
        assert sum(r[0] == warc.DAMAGED and r[5] > 0 for r in got) >= 2
        assert len(list(warc.records(uri, payload=payload))) == len(whole)
    df = warc.read_warc(spark, uri)
    assert df.filter("warc_type = 'damaged'").agg(F.sum("content_length")).first()[0] > (100 if compressed else 1000)
    assert warc.read_warc(spark, uri).filter("warc_type = 'response'").count() >= len(want)
    with pytest.raises(ValueError):
        list(warc.records(uri, mode="FAILFAST"))
    with pytest.raises(ValueError):
        warc.WarcReader({"path": uri, "mode": "x"})


def test_pushable():
    assert warc.pushable(In(("warc_type",), ("a", "b"))) and warc.pushable(Not(EqualTo(("target_uri",), "x")))
    assert not warc.pushable(EqualTo(("http_status",), 200)) and not warc.pushable(EqualTo(("headers", "x"), "y"))
    assert not warc.holds(Not(EqualTo(("target_uri",), "x")), {"target_uri": None})
    assert warc.holds(StringStartsWith(("target_uri",), "x"), {"target_uri": "xy"})


def test_partitions_are_even(tmp_path):
    for i in range(10):
        (tmp_path / f"f{i}.warc").write_bytes(b"x" * (i + 1) * 100)
    parts = warc.WarcReader({"path": f"file://{tmp_path}", "partitionBytes": 1200}).partitions()
    assert sum(len(p.paths) for p in parts) == 10 and len(parts) == 5
    sizes = [sum(int(x.split("/f")[-1][0]) + 1 for x in p.paths) for p in parts]
    assert max(sizes) - min(sizes) <= 2
