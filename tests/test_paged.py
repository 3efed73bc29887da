"""The paged source over files and over a server that is slow to answer."""

import http.server
import json
import threading

import pytest

from loomtext.plans import catalogue
from loomtext.sources import paged

RECORDS = [{"id": k, "name": f"ż {k}", "price": k / 2, "more": {"a": [k]}} for k in range(23)]
FIELDS = "id long, name string, price double, more string, absent int"


@pytest.fixture
def source(spark):
    spark.dataSource.register(paged.PagedSource)
    return lambda **options: spark.read.format("paged").options(**{"fields": FIELDS} | options).load()


def rows(df):
    return sorted((r.id, r.name, r.price, json.loads(r.more), r.absent) for r in df.collect())


EXPECTED = [(r["id"], r["name"], r["price"], r["more"], None) for r in RECORDS]


def test_folders_files_and_fallbacks(source, spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    for k in range(5):
        (folder / f"p{k}.json").write_text(json.dumps({"n": 5, "items": RECORDS[5 * k : 5 * k + 5]}), encoding="utf-8")
    (folder / "_SUCCESS").write_text("")
    df = source(path=f"{tmp_path}/none\nhttp://127.0.0.1:9/x\nfile://{folder}", rows="items", tries="1")
    assert rows(df) == EXPECTED and df.rdd.getNumPartitions() == 5
    assert rows(source(path=f"{folder}/p0.json", rows="items")) == EXPECTED[:5]
    whole = tmp_path / "all.json"
    whole.write_text(json.dumps(RECORDS), encoding="utf-8")
    assert rows(source(path=str(whole))) == EXPECTED
    plain = spark.read.schema("id long, name string, price double, more string").json(str(whole), multiLine=True)
    assert sorted(r.id for r in plain.collect()) == [r[0] for r in EXPECTED]
    with pytest.raises(Exception, match="no path answers"):
        source(path=f"{tmp_path}/none").collect()


def test_a_server_that_asks_to_wait(source):
    asked: list[str] = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            page = int(self.path.rsplit("=", 1)[1])
            if asked.count(self.path) == 1:
                self.send_response(429 if page % 2 else 503)
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            body = json.dumps({"total": 3, "items": RECORDS[10 * page - 10 : 10 * page]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/products?page={{page}}"
        assert rows(source(path=url, rows="items", pages="total")) == EXPECTED
        assert {p[-1] for p in asked} == {"1", "2", "3"}
    finally:
        server.shutdown()


def test_waits_double_up_to_a_limit(monkeypatch):
    assert list(paged.waits(6, 10.0)) == [1.0, 2.0, 4.0, 8.0, 10.0]
    slept: list[float] = []

    def refuse(*_, **__):
        raise paged.urllib.error.URLError("no")

    monkeypatch.setattr(paged.urllib.request, "urlopen", refuse)
    with pytest.raises(paged.urllib.error.URLError):
        paged.fetch("http://x", 4, 3.0, slept.append)
    assert slept == [1.0, 2.0, 3.0]


def test_pages_through_the_source(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, catalogue.paged_source(spark, sf).collect()))
    assert got == sorted((r.page_id, r.url, len(r.html)) for r in spark.read.parquet(f"{sf}/pages.parquet").collect())
