"""Parsing over HTTP with a local parser behind it."""

import http.server
import threading
import time

import pytest

from spindle.sources.files import read_files
from spindle.sources.parsers import Chain, HttpParser, local


class Answers(http.server.BaseHTTPRequestHandler):
    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"]))
        if b"slow.pdf" in body:
            time.sleep(3)
        bad = b"bad.pdf" in body or b".docx" in body or b".odt" in body
        self.send_response(500 if bad else 200)
        self.end_headers()
        if not bad:
            self.wfile.write(f"{self.headers['Authorization']}: {len(body.split(b'\r\n\r\n', 1)[1].rsplit(b'\r\n--', 1)[0])} bytes".encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def endpoint():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/parse"
    server.shutdown()


def test_fallback_chain(spark, tmp_path, endpoint):
    import io
    import zipfile

    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("word/document.xml", "<w:document xmlns:w='w'><w:p>local text</w:p></w:document>")
    for name, content in {"good.pdf": b"12345", "bad.pdf": b"x", "slow.pdf": b"x", "a.docx": made.getvalue()}.items():
        (tmp_path / name).write_bytes(content)
    parser = Chain(HttpParser(endpoint, "key", timeout=0.8), local)
    got = {r.original_name: (r.text, r.error) for r in read_files(spark, str(tmp_path), parser=parser).collect()}
    assert got["good.pdf"] == ("Bearer key: 5 bytes", None) and got["a.docx"] == ("local text", None)
    assert "500" in got["bad.pdf"][1] and "no local parser" in got["bad.pdf"][1]
    assert got["slow.pdf"][0] is None and "timed out" in got["slow.pdf"][1]
