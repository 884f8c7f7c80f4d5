import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from lexweave.sinks import exports as X
from lexweave.sources import pages as P
from lexweave.sources import programs as G
from lexweave.sources.files import extract


class Recogniser(BaseHTTPRequestHandler):
    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"]))
        assert b'name="language"\r\n\r\nde\r\n' in body and b'filename="page.png"\r\nContent-Type: image/png\r\n\r\n' in body
        if b"broken" in body:
            self.send_response(500)
            self.end_headers()
            self.wfile.write(b"cannot read")
            return
        answer = {"error": "no page"} if b"refused" in body else {"results": [{"text": " one "}, {"text": ""}, {"text": "a longer second line"}]}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(answer).encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def server():
    s = HTTPServer(("127.0.0.1", 0), Recogniser)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/ocr"
    s.shutdown()


def opener(content, dpi):
    if content == b"damaged":
        raise ValueError("no document")
    for part in content.decode().split("|"):
        yield part, lambda part=part: f"image {part} {dpi}".encode()


def test_pages(spark, tmp_path, server):
    (tmp_path / "a.pdf").write_bytes(b"-- 1 of 9 --\na first page of more than twenty-five characters|short|broken|refused")
    (tmp_path / "b.PDF").write_bytes(b"damaged")
    pages = P.pdf_pages(spark, str(tmp_path), opener)
    bad = pages.where("error IS NOT NULL").first()
    assert bad["path"].endswith("b.PDF") and bad["error"] == "no document"
    read = P.recognised(pages.where("error IS NULL"), P.recognise_over_http(server, "de"), "http")
    rows = {r["page_num"]: r for r in P.page_rows(read).collect()}
    assert [rows[n]["method"] for n in (1, 2, 3, 4)] == ["native", "http", "native", "native"] and rows[2]["text"] == "one\na longer second line"
    assert rows[3]["warning"] == "OCR failed for page 3: HTTP 500: cannot read" and rows[4]["warning"].endswith("no page")
    one = P.documents_of_pages(P.page_rows(read)).first()
    assert one["text"].startswith("--- Slide 1 ---\na first") and one["text"].endswith("one\na longer second line\nbroken\nrefused\n")
    assert (one["pages"], one["ocr_pages"], len(one["warnings"])) == (4, 1, 2)
    assert P.documents_of_pages(P.page_rows(read.limit(0))).count() == 0
    with pytest.raises(RuntimeError, match="no answer"):
        P.recognise_over_http("http://127.0.0.1:1/x")(b"x")


def test_layout(spark):
    raw = json.dumps({"pages": [
        {"page_num": 1, "width": 10, "text": " x ", "text_items": [{"text": "x", "x": 1, "confidence": 0.5}]},
        {"page_number": 2, "page_height": 7, "textItems": [{"text": "y", "font_name": "F"}, {"text": "z"}]},
        {"page_num": 3, "text": "end"},
    ]})
    df = spark.createDataFrame([(raw,), ('{"pages": []}',), ("no json",), (None,)], "raw string").coalesce(1)
    p = P.layout_pages(F.col("raw"))
    rows = df.select(P.text_of_layout(p).alias("t"), P.layout_stats(p).alias("s"), P.layout_ocr_pages(p).alias("o"), P.layout_json(p).alias("j")).collect()
    assert [r["t"] for r in rows] == ["x\n\nend", None, None, None] and rows[0]["o"] == 1
    assert [(s["page_num"], s["char_count"], s["ocr"], s["text_item_count"]) for s in rows[0]["s"]] == [(1, 3, True, 1), (2, 0, False, 2), (3, 3, False, 0)]
    back = json.loads(rows[0]["j"])["pages"]
    assert back[1]["height"] == 7 and back[1]["text_items"][0]["font_name"] == "F" and back[0]["text_items"][0]["y"] is None
    assert P.reader_options({"pdf_ocr": False, "pdf_password": "", "extract_dpi": 72}) == {"ocr_enabled": False, "dpi": 72}
    set_ = {"target_pages": F.lit("1-2"), "extract_dpi": F.lit(None).cast("int"), "preserve_layout": F.lit(False), "extract_screenshots": F.lit(True)}
    assert spark.range(1).select(P.ignored_options(F.lit("native"), set_)).first()[0] == ["target_pages", "extract_screenshots"]
    assert spark.range(1).select(P.ignored_options(F.lit("layout"), set_)).first()[0] == []


def test_programs(spark, tmp_path):
    assert G.run(["echo", "x"], "echo").strip() == "x"
    with pytest.raises(RuntimeError, match="odd failed: .*<path>"):
        G.run(["ls", "/no/such/folder"], "odd")
    with pytest.raises(RuntimeError, match="slow took more than"):
        G.run(["sleep", "5"], "slow", 0.1)

    def fails(content):
        raise RuntimeError("first")

    (tmp_path / "a.doc").write_bytes(b"old text")
    (tmp_path / "b.pdf").write_bytes(b"x")
    own = G.readers(spark, str(tmp_path), {"doc": G.first_of(fails, lambda c: (c.decode().upper(), "upper")), "pdf": fails})
    got = {r["path"].rsplit("/", 1)[1]: r for r in extract(spark, str(tmp_path), own).collect()}
    assert got["a.doc"]["text"] == "OLD TEXT\n" and got["a.doc"]["error"] is None and got["b.pdf"]["error"] == "first"
    if G.program("pandoc") is None:
        with pytest.raises(RuntimeError, match="not installed"):
            G.legacy_word()(b"x")


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("a", "# A", "md", "en"), ("b", None, "md", None), ("c", "x", "odd", "en"), ("../d", "x", "md", "en"), ("e", "# E", "html", "ar")], "name string, markdown string, format string, lang string")
    got = {r["name"]: r for r in X.write_files(X.exported(rows), str(tmp_path / "out")).collect()}
    assert (tmp_path / "out/a.md").read_text() == "# A" and got["b"]["bytes"] == 0
    assert got["c"]["error"] == "unknown format: odd" and got["../d"]["error"] == "name leaves the folder" and not (tmp_path / "d.md").exists()
    assert G.program("pandoc") or got["e"]["error"] == "pandoc is not installed"
    X.write_files(X.exported(rows), str(tmp_path / "out")).collect()
    assert sorted(f.name for f in (tmp_path / "out").iterdir()) == (["a.md", "b.md"] if not G.program("pandoc") else ["a.md", "b.md", "e.html"])
