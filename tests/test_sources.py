import io
import zipfile

import pytest

from passages.schema import EngineError
from passages.sources import embedders, generators, loaders, parsers


def loaded(spark, data, uti, **plug):
    rows = [{"source_id": "s", "bytes": data, "uti": uti}]
    return [(r.page, r.text) for r in loaders.load(loaders.inputs(spark, rows), **plug).orderBy("page").collect()]


def test_csv(spark):
    csv = b'name,note,n\r\nann,"a, b",1\r\n\r\nbob,"line\nbreak ""q""",2,extra\r\n'
    assert loaded(spark, csv, "public.comma-separated-values-text") == [(1, "name: ann, note: a, b, n: 1"), (2, 'name: bob, note: line\nbreak "q", n: 2, col4: extra')]
    assert loaded(spark, b"part\tstock\nvalve\t17\nhose\t0\n", "public.tab-separated-values-text") == [(1, "part: valve, stock: 17"), (2, "part: hose, stock: 0")]
    assert loaded(spark, b"", "public.comma-separated-values-text") == []


def test_structured(spark):
    assert loaded(spark, b'{"k":"v","a":["x",{"n":2}],"e":{},"z":null,"b":true}', "public.json") == [(0, "a[0]: x\na[1].n: 2\nb: true\nk: v\nz: null")]
    assert loaded(spark, b"<e a='v' b='w'>lead<c1>t</c1><c2> u </c2></e>", "public.xml") == [(0, "e.@a: v\ne.@b: w\ne.c1: t\ne.c2: u")]
    assert loaded(spark, b"---\n# c\na: 1 # d\n\nl:\n  - x\n...\n", "public.yaml") == [(0, "a: 1\nl:\n- x")]


def test_html_and_rtf(spark):
    page = b"<style>p{}</style><script>x<y</script><p>A&amp;B &#39;q&#39; &#x2014; &amp;lt;</p>"
    assert loaded(spark, page, "public.html") == [(0, "A&B 'q' — <")]
    rich = rb"{\rtf1{\fonttbl{\f0 X;}}{\b Bold} plain\par " + b"\\" + b"u8212? " + rb"\'e9}"
    assert loaded(spark, rich, "public.rtf") == [(0, "Bold plain\n\N{EM DASH} \N{LATIN SMALL LETTER E WITH ACUTE}")]


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_docx(spark, method):
    out = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(out, "w", method) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t><w:br/><w:t>three</w:t></w:r></w:p><w:p/></w:body></w:document>')
    assert loaded(spark, out.getvalue(), "org.openxmlformats.wordprocessingml.document") == [(0, "One two\nthree")]


def test_zip_errors():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("other", "x")
    for data, code in ((b"no zip", 405), (out.getvalue(), 406)):
        with pytest.raises(EngineError) as e:
            parsers.zip_entry(data, "word/document.xml")
        assert e.value.code == code


def test_plugged_readers(spark):
    assert loaded(spark, b"x", "com.adobe.pdf", pdf=lambda b: ["so\xadft", "  "], ocr=lambda b: "seen") == [(0, "soft"), (1, "seen")]
    assert loaded(spark, b"x", "public.png", ocr=lambda b: "shown") == [(0, "shown")]
    with pytest.raises(EngineError) as e:
        loaded(spark, b"x", "com.adobe.pdf")
    assert e.value.code == 401
    with pytest.raises(EngineError) as e:
        loaded(spark, b"x", "org.unknown")
    assert e.value.code == 400


def test_bad_text(spark):
    assert loaded(spark, b"\xff\xfe", "public.plain-text") == [(0, "")]
    with pytest.raises(Exception, match="404"):
        loaded(spark, b"\xff", "net.daringfireball.markdown")


def test_http_embedder_and_chat(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from passages.schema import EmbeddingModel

    class Answers(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.path == "/v1/embeddings":
                assert "Authorization" not in self.headers
                out = json.dumps({"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(body["input"])))]})
            elif body.get("stream"):
                out = "".join(f'data: {{"choices":[{{"index":0,"delta":{{"content":"{x}"}}}}]}}\n\n' for x in ("Hel", "lo")) + "data: [DONE]\n\n"
            elif body["messages"][0]["content"] == "fail":
                self.send_response(429)
                self.end_headers()
                return
            else:
                out = json.dumps({"choices": [{"message": {"role": "assistant", "content": "Hi [1]"}}]})
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out.encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        e = embedders.HttpEmbedder(base, EmbeddingModel("m", 2), batch=2)
        assert e.embed_batch(["a", "bb", "ccc"]) == [[1.0, 1.0], [2.0, 1.0], [3.0, 1.0]] and e.embed_batch([]) == []
        chat = generators.ChatGenerator(base + "/v1", "m")
        assert chat.generate([("user", "q")]) == "Hi [1]" and list(chat.stream([("user", "q")])) == ["Hel", "lo"]
        with pytest.raises(EngineError) as err:
            chat.generate([("user", "fail")])
        assert err.value.code == 429
    finally:
        server.shutdown()
