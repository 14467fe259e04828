import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from corpusmill import cli, config, models, service
from corpusmill.cli import parser
from corpusmill.models import embed_text
from corpusmill.sources.files import Snapshots
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("kb"))
    docs = spark.createDataFrame([(1, "a.md", "x/a.md", "power", "s1", 1), (2, "b.md", "x/b.md", "water", "s2", 2)], "doc_id long, source string, rel_path string, domain string, sha256 string, n_chunks int")
    chunks = spark.createDataFrame([(10, 1, 0, "the quick brown fox"), (20, 2, 0, "all about pumps"), (21, 2, 1, "and valves")], "chunk_id long, document_id long, seq int, text string")
    Snapshots(spark, root).commit(documents=docs, chunks=chunks, vchunks=chunks.select("chunk_id", embed_text(F.col("text")).alias("embedding")))
    return service.Service(spark, root, ["power", "fire"])


def test_search_ask_and_status(kb):
    hits = kb.search("pumps", k=2)
    assert hits[0]["chunk_id"] == 20 and hits[0]["score"] == 0.033333 and hits[0]["rank"] == 1
    assert kb.search("pumps", domains=["power"])[0]["document_id"] == 1
    assert kb.ask("pumps")["state"] == "degraded" and "[1] b.md — all about pumps" in kb.ask("pumps")["answer"]
    kb.answer = lambda q, c: "They are pumps [1] [99]"
    assert kb.ask("pumps")["state"] == "partial" and "[invalid citation removed]" in kb.ask("pumps")["answer"]
    kb.answer = None
    assert kb.status() == {"documents": 2, "chunks": 3} and kb.domains() == {"power": 1, "fire": 0, "water": 1}
    assert kb.source(2) == "all about pumps\n\nand valves" and kb.source(9) is None


def test_rerank_dispatch_fails_open(capsys):
    hits = [{"chunk_id": n, "source": "s", "text": "t" * 400} for n in range(5)]
    ids = lambda settings, **b: [h["chunk_id"] for h in service.reranked("q", hits, settings, b)]
    assert ids({"backend": "none"}) == ids({}) == ids({"backend": "llm", "enabled": False}, llm=lambda q, h: [1]) == [0, 1, 2, 3, 4]
    assert ids({"backend": "unknown"}) == [0, 1, 2, 3, 4] == ids({"backend": "llm"}, llm=lambda q, h: 1 / 0) and "failed" in capsys.readouterr().err
    chat = lambda reply: service.listwise(lambda m: reply)
    assert ids({"backend": "LLM", "pool": 3}, llm=chat("Best first: [3, 1, 2] as asked")) == [2, 0, 1, 3, 4]
    assert ids({"backend": "llm"}, llm=chat("[3,3,99,1]")) == [2, 0, 1, 3, 4] and ids({"backend": "llm"}, llm=chat("none")) == [0, 1, 2, 3, 4]
    score = lambda s: service.scoring("u", lambda url, body, timeout: {"scores": s})
    assert ids({"backend": "service"}, service=score([0, 2, 1, 2, 0])) == [1, 3, 2, 0, 4] and ids({"backend": "service"}, service=score([1, 2])) == [0, 1, 2, 3, 4]


def test_chat_formats():
    seen = []

    def post(url, body, timeout):
        seen.append(body)
        return {"message": {"content": "<think>x</think> yes "}} if "/api/chat" in url else {"choices": [{"message": {"content": "no"}}]}

    say = [{"role": "user", "content": "?"}]
    assert models.chat_model("http://h/api/chat", "m", post=post)(say) == "yes" and models.chat_model("http://h/v1/chat/completions", "m", post=post)(say) == "no"
    assert seen[0]["options"]["num_predict"] == 800 and seen[1]["max_tokens"] == 800 and seen[0]["stream"] is False
    assert models.chat_model("http://h/v1", "m", post=lambda *a: {})(say) == ""


def test_answers_tell_their_sources_and_failures(kb):
    told = kb.ask("pumps")["sources"][0]
    assert told["n"] == 1 and told["parent_path"] == "x" and told["revision_state"] == "current" and told["revision_label"] is None and set(service.SOURCE_KEYS) < set(told)
    kb.answer = lambda q, c: "no number"
    assert kb.ask("pumps")["failure"] == "missing_citations"
    kb.answer = lambda q, c: 1 / 0
    assert kb.ask("pumps")["failure"] == "generation_error"
    kb.answer, tables = None, kb._tables
    kb._tables = lambda: 1 / 0
    assert kb.ask("pumps")["state"] == "retrieval_error"
    kb._tables = tables
    kb.settings, kb.backends = {"rerank": {"backend": "mine", "pool": 3}}, {"mine": lambda q, h: [1]}
    assert [h["chunk_id"] for h in kb.search("all about pumps", k=2)][1] == 20
    kb.settings = {}


def test_bounds():
    assert service.bounded("q", 999)[1] == 50 and service.bounded("q", -3)[1] == 1
    for bad in (("",), (None,), ("x" * 2001,), ("q", "8"), ("q", 8, "magic"), ("q", 8, "fts", "power")):
        with pytest.raises(service.BadRequest):
            service.bounded(*bad)


def test_http_and_rpc(kb):
    server = service.serve(kb, "127.0.0.1", 0, token="t")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        assert json.load(urllib.request.urlopen(f"{base}/stats"))["chunks"] == 3
        post = lambda path, body, token="t": urllib.request.Request(base + path, json.dumps(body).encode(), {"Authorization": f"Bearer {token}"})
        assert json.load(urllib.request.urlopen(post("/search", {"query": "fox"})))["hits"][0]["chunk_id"] == 10
        for request, code in ((post("/search", {"query": "fox"}, "no"), 401), (post("/search", {"query": ""}), 400), (f"{base}/source?id=1", 401), (f"{base}/nope", 404)):
            with pytest.raises(urllib.error.HTTPError) as e:
                urllib.request.urlopen(request)
            assert e.value.code == code
    finally:
        server.shutdown()
    out = io.StringIO()
    service.rpc_loop(kb, ['{"id": 1, "method": "tools/list"}\n', '{"method": "x"}\n', "broken\n", '{"id": 2, "method": "tools/call", "params": {"name": "kb_status"}}\n'], out)
    lines = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(lines) == 3 and len(lines[0]["result"]["tools"]) == 3 and lines[1]["error"]["code"] == -32700


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("search:\n  k: 5\n")
    c = config.load(str(tmp_path / "c.yaml"), {"CORPUSMILL_SEARCH_MODE": "fts", "CORPUSMILL_VISION_DESCRIBE_ENABLED": "yes", "CORPUSMILL_TAXONOMY": "a, b", "OTHER": "1"})
    assert c["search"] == {"k": 5, "mode": "fts", "rrf_k": 60, "boost": 0.01} and c["vision_describe"]["enabled"] is True and c["taxonomy"] == ["a", "b"]
    assert config.load(None, {"CORPUSMILL_VISION_DESCRIBE_ENABLED": ""})["vision_describe"]["enabled"] is False


def test_commands_over_a_store(tmp_path, spark, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    for name in ("store", "inbox", "checkpoint", "curated", "quarantine"):
        monkeypatch.setenv(f"CORPUSMILL_PATHS_{name.upper()}", str(tmp_path / name))
    monkeypatch.setenv("CORPUSMILL_PATHS_EXCLUSIONS", str(tmp_path / "ex.txt"))

    def run(*args):
        code = cli.main(list(args))
        return code, capsys.readouterr().out

    run("init")
    (tmp_path / "inbox" / "pump.txt").write_text("The pump of the north hall must be drained before work begins.")
    assert json.loads(run("ingest", "--dry-run")[1]) == [{"rel_path": "pump.txt", "action": "would_ingest"}]
    assert json.loads(run("ingest")[1]) == {"documents": 1, "chunks": 1}
    assert json.loads(run("search", "pump")[1])[0]["rel_path"] == "99_MISC/pump.txt"
    (tmp_path / "gold.jsonl").write_text('{"id": "1", "q": "pump of the north hall", "expect_source": "pump", "expected_facts": ["drained"], "category": "facts", "expected_behaviour": "answer", "expect_citations": true}')
    told = json.loads(run("evaluate", "--gold", str(tmp_path / "gold.jsonl"))[1])
    assert told[0] == {"questions": 1, "recall": 1.0, "mrr": 1.0} and {m["metric"]: m["rate"] for m in told[1:]}["known_answer_correctness"] == 1.0
    (tmp_path / "curated" / "99_MISC" / "pump.txt").write_text("changed")
    assert '"changed"' in run("check")[1]
    assert json.loads(run("reextract", "99_MISC/pump.txt", "--apply")[1].split("]")[-1]) == {"asked": 1, "done": 0}
    assert run("backup", str(tmp_path / "b"))[0] == 0 and run("restore-check", str(tmp_path / "b"))[0] == 0 and run("restore", str(tmp_path / "b"))[0] == 0 and run("verify")[0] == 0
    assert run("retry", "pump.txt")[1].strip() == "[]" and run("restore-check", str(tmp_path / "none"))[0] == 1


def test_commands():
    assert parser().parse_args(["search", "pump", "-k", "3"]).k == 3
