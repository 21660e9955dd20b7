"""Routes and status codes of the service, and the fetch command's exit code."""

import json
import threading
import urllib.error
import urllib.request

import pytest

from veracite import __main__ as command
from veracite import web
from veracite.service import validated
from veracite.sources import manifests


class Fake:
    def __init__(self, built=True):
        self.built = built

    def health(self):
        return {"status": "ok"}

    def ask(self, question, k=5):
        validated(question, k)
        if not self.built:
            raise FileNotFoundError("no index")
        return {"question": question, "k": k}

    def search(self, question, k=5, jurisdiction=None, include_withdrawn=True):
        validated(question, k)
        return {"jurisdiction": jurisdiction, "include_withdrawn": include_withdrawn}


@pytest.mark.parametrize(("path", "body", "status"), [
    ("/ask", {"question": "What applies?"}, 200), ("/ask", {"question": "hi"}, 422), ("/ask", {"question": "What applies?", "k": 99}, 422), ("/ask", {}, 422), ("/ask", [], 400), ("/nothing", {}, 404),
    ("/search", {"question": "What applies?", "jurisdiction": "NYC", "include_withdrawn": False}, 200), ("/search", {"question": "What applies?", "jurisdiction": 3}, 422),
])
def test_routes(path, body, status):
    assert web.answer(Fake(), "POST", path, json.dumps(body).encode())[0] == status


def test_server():
    assert web.answer(Fake(False), "POST", "/ask", b'{"question": "What applies?"}')[0] == 503
    assert web.answer(Fake(), "POST", "/ask", b"{")[0] == 400
    s = web.server(Fake(), port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{s.server_address[1]}"
        assert json.load(urllib.request.urlopen(f"{at}/health")) == {"status": "ok"}
        found = json.load(urllib.request.urlopen(f"{at}/ask", json.dumps({"question": "Où ça?"}).encode()))
        assert found == {"question": "Où ça?", "k": 5}
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(f"{at}/ask", b"{}")
        assert e.value.code == 422
    finally:
        s.shutdown()
        s.server_close()


def test_fetch_command_tells_failures_by_its_exit_code(spark, tmp_path, monkeypatch, capsys):
    sources = [{"id": "a", "kind": "html", "name": "A", "url": "http://a"}, {"id": "b", "kind": "html", "name": "B", "url": "http://b"}]
    (tmp_path / "m.json").write_text(json.dumps({"ecfr_date": "2026-01-01", "sources": sources}))
    good = {"http://a"}
    fetch = manifests.fetch
    get = lambda url: manifests.Response(200 if url in good else 404, b"<p>text</p>")
    monkeypatch.setattr(manifests, "fetch", lambda *a: fetch(*a, get, lambda s: None))
    assert command.main(["fetch", "--manifest", str(tmp_path / "m.json"), "--out", str(tmp_path / "raw")]) == 1
    assert "1 of 2 sources fetched; unresolved: b" in capsys.readouterr().out
    good.add("http://b")
    assert command.main(["fetch", "--manifest", str(tmp_path / "m.json"), "--out", str(tmp_path / "raw")]) == 0
