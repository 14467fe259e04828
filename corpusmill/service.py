"""The store as a service: search, ask, status and source, with their bounds; a small HTTP server and a JSON-RPC loop over them."""

from __future__ import annotations

import hmac
import json
import re
import sys
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .models import embed_text, post_json
from .operators import answers, audit, retrieval, segmentation
from .sources.files import Snapshots

MAX_QUERY, MAX_K, MODES = 2000, 50, ("hybrid", "vector", "fts")


class BadRequest(ValueError):
    pass


def bounded(query, k=8, mode="hybrid", domains=None) -> tuple[str, int, str, list[str] | None]:
    """Checked arguments: a query of 1 to 2,000 characters, k within 1 to 50, a known mode, a list of names."""
    if not isinstance(query, str) or not query.strip():
        raise BadRequest("query must be a non-empty string")
    if len(query) > MAX_QUERY:
        raise BadRequest(f"query is longer than {MAX_QUERY} characters")
    if isinstance(k, bool) or not isinstance(k, int):
        raise BadRequest("k must be an integer")
    if mode not in MODES:
        raise BadRequest(f"mode must be one of {', '.join(MODES)}")
    if domains is not None and not (isinstance(domains, list) and all(isinstance(d, str) for d in domains)):
        raise BadRequest("domains must be a list of strings")
    return query, min(MAX_K, max(1, k)), mode, domains


#: What a hit's source tells beside its number.
SOURCE_KEYS = ("source", "rel_path", "domain", "chunk_id", "document_id", "sha256", "parent_path", "revision_label", "revision_family", "revision_state")
#: Characters of a passage that a list-wise reranker and a scoring one are shown.
LISTED, SCORED = 300, 2000


def listwise(chat: Callable[[list[dict]], str]) -> Callable[[str, list[dict]], list[int] | None]:
    """A backend that has a model order numbered passages; it gives places from 0, those the model named first."""

    def order(query: str, hits: list[dict]) -> list[int] | None:
        lines = "\n".join(f"[{n}] ({h.get('source') or ''}) {(h.get('text') or '')[:LISTED]}".replace("\n", " ") for n, h in enumerate(hits, 1))
        said = chat([{"role": "user", "content": f"Order all {len(hits)} passages by how well they answer the query, best first. Reply with a JSON array of their numbers and nothing else.\n\nQuery: {query}\n\n{lines}"}])
        found = re.search(r"\[([^\[\]]*)\]", said or "")
        return [int(n) - 1 for n in re.findall(r"\d+", found[1])] if found else None

    return order


def scoring(url: str, post: Callable[[str, dict, float], dict] = post_json, timeout: float = 20) -> Callable[[str, list[dict]], list[int] | None]:
    """A backend that asks a service for one score a passage; it gives places from 0, best first, equal scores as they stand."""

    def order(query: str, hits: list[dict]) -> list[int] | None:
        scores = post(url, {"query": query, "texts": [(h.get("text") or "")[:SCORED] for h in hits]}, timeout).get("scores")
        return sorted(range(len(hits)), key=lambda i: -scores[i]) if scores and len(scores) == len(hits) else None

    return order


def reranked(query: str, hits: list[dict], settings: dict, backends: dict[str, Callable]) -> list[dict]:
    """The first ``pool`` hits in the order of the backend told in the settings, the others behind them.

    Whatever goes wrong, an unknown backend, an exception, a reply that orders nothing, leaves the order. Places out of range and
    repeated ones are dropped, those not named follow in their order.
    """
    name = str(settings.get("backend") or "none").lower()
    pool = hits[: int(settings.get("pool", 15))]
    if name == "none" or not settings.get("enabled", True) or len(pool) < 2:
        return hits
    try:
        order = backends[name](query, pool)
    except Exception as e:  # a broken reranker must not take the search with it
        print(f"rerank backend {name!r} failed ({type(e).__name__}), order kept", file=sys.stderr)
        return hits
    told = list(dict.fromkeys(n for n in order or [] if 0 <= n < len(pool)))
    return [pool[n] for n in [*told, *(n for n in range(len(pool)) if n not in told)]] + hits[len(pool) :]


class Service:
    """``answer`` is a model that gets the question and the numbered context; without one, excerpts are given.

    settings: rerank (backend, pool, enabled) and search (boost, the weight of a named item's documents; 0 for none); backends:
    rerankers by name.
    """

    def __init__(self, spark: SparkSession, store: str, taxonomy: list[str] | None = None, answer: Callable[[str, str], str] | None = None, excluded=None, settings: dict | None = None, backends: dict[str, Callable] | None = None):
        self.spark, self.store, self.taxonomy, self.answer, self.excluded = spark, Snapshots(spark, store), taxonomy or [], answer, excluded
        self.settings, self.backends = settings or {}, backends or {}

    def _tables(self):
        return tuple(self.store.read(n) for n in ("documents", "chunks", "vchunks"))

    def _boosted(self, q):
        """Documents of items the query names; None without a registry, and if it can't be read."""
        try:
            equipment, links = self.store.read("equipment"), self.store.read("doc_equipment")
            return None if equipment is None or links is None else retrieval.boosted_documents(q.select("query_id", "text"), retrieval.aliases(equipment, links))
        except Exception as e:  # the boost is an extra
            print(f"boost failed ({type(e).__name__}), left out", file=sys.stderr)
            return None

    def search(self, query: str, k: int = 8, mode: str = "hybrid", domains: list[str] | None = None) -> list[dict]:
        query, k, mode, domains = bounded(query, k, mode, domains)
        docs, chunks, vectors = self._tables()
        if docs is None:
            return []
        q = self.spark.createDataFrame([(0, query)], "query_id long, text string").withColumn("vector", embed_text(F.col("text")))
        ok = None if domains is None and self.excluded is None else retrieval.eligible_chunks(chunks, docs, domains, self.excluded)
        rerank = self.settings.get("rerank", {})
        active = mode == "hybrid" and rerank.get("enabled", True) and str(rerank.get("backend") or "none").lower() != "none"
        weight = float(self.settings.get("search", {}).get("boost", 0.0))
        boosted = self._boosted(q) if weight and mode == "hybrid" else None
        hits = retrieval.hybrid(q, chunks, vectors.withColumnRenamed("embedding", "vector"), max(k, int(rerank.get("pool", 15))) if active else k, mode, ok, boosted, weight)
        rows = [r.asDict() for r in retrieval.hydrated(hits, chunks, docs).orderBy("rank").collect()]  # at most MAX_K rows, or the pool
        rows = (reranked(query, rows, rerank, self.backends) if active else rows)[:k]
        return [{**r, "rank": n} for n, r in enumerate(rows, 1)]

    def ask(self, query: str, k: int = 8, domains: list[str] | None = None) -> dict:
        """state is retrieval_error, no_relevant, degraded, partial or grounded, failure why it isn't grounded; a model that fails gives excerpts."""
        try:
            hits = self.search(query, k, "hybrid", domains)
        except BadRequest:
            raise
        except Exception as e:
            return {"state": "retrieval_error", "failure": "retrieval_error", "answer": f"[Retrieval is unavailable ({type(e).__name__}); no grounded answer was generated.]", "sources": [], "hits": []}
        row = self.spark.createDataFrame([([{c: h[c] for c in ("source", "domain", "text")} for h in hits],)], "hits array<struct<source:string,domain:string,text:string>>")
        excerpts, context = row.select(answers.excerpts(F.col("hits")), answers.context(F.col("hits"))).first()
        failure = None
        try:
            text = self.answer(query, context) if self.answer and hits else ""
        except Exception:  # the model's failure is part of the contract
            text, failure = "", "generation_error"
        judged = self.spark.createDataFrame([(text, len(hits))], "a string, n int").select(
            answers.state(F.lit(None).cast("string"), F.col("n"), F.col("a")).alias("state"), answers.scrubbed(F.col("a"), F.col("n")).alias("answer"), answers.citations(F.col("a"), F.col("n")).alias("c")
        )
        state, clean, c = judged.first()
        if state in ("degraded", "partial") and not failure:
            failure = "empty_generation" if not text.strip() else "invalid_citations" if c["present"] else "missing_citations"
        said = excerpts if state == "degraded" else clean if hits else "No relevant information found in the knowledge base."
        return {"state": state, "failure": failure, "answer": said, "sources": [{"n": h["rank"], **{key: h.get(key) for key in SOURCE_KEYS}} for h in hits], "hits": hits, "citations": c.asDict(True)}

    def status(self) -> dict:
        docs, chunks, _ = self._tables()
        return {"documents": docs.count() if docs else 0, "chunks": chunks.count() if chunks else 0}

    def domains(self) -> dict:
        docs = self.store.read("documents")
        return {} if docs is None else {r.domain: r.documents for r in audit.zero_filled(docs, self.taxonomy).collect()}

    def source(self, document_id: int) -> str | None:
        chunks = self.store.read("chunks")
        row = None if chunks is None else segmentation.reassembled(chunks.where(F.col("document_id") == document_id)).first()
        return row.text if row else None


def handler(service: Service, token: str = "", max_body: int = 2**20):
    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _allowed(self) -> bool:
            return not token or hmac.compare_digest(self.headers.get("Authorization", ""), f"Bearer {token}")

        def do_GET(self) -> None:
            at = urlparse(self.path)
            if at.path in ("/", "/health"):
                return self._send(200, {"ok": True})
            if at.path == "/stats":
                return self._send(200, service.status())
            if at.path == "/domains":
                return self._send(200, service.domains())
            if at.path == "/source":
                if not self._allowed():
                    return self._send(401, {"error": "unauthorised"})
                raw = parse_qs(at.query).get("id", [""])[0]
                if not raw.lstrip("-").isdigit():
                    return self._send(400, {"error": "id must be an integer"})
                text = service.source(int(raw))
                return self._send(404, {"error": "no such document"}) if text is None else self._send(200, {"text": text})
            return self._send(404, {"error": "not found"})

        def do_POST(self) -> None:
            if not self._allowed():
                return self._send(401, {"error": "unauthorised"})
            size = int(self.headers.get("Content-Length") or 0)
            if size > max_body:
                return self._send(413, {"error": "body too large"})
            try:
                body = json.loads(self.rfile.read(size) or b"{}")
                args = {k: body[k] for k in ("k", "domains") if k in body}
                if self.path == "/search":
                    return self._send(200, {"hits": service.search(body.get("query"), mode=body.get("mode", "hybrid"), **args)})
                if self.path == "/ask":
                    return self._send(200, service.ask(body.get("query"), **args))
                return self._send(404, {"error": "not found"})
            except (BadRequest, json.JSONDecodeError, AttributeError) as e:
                return self._send(400, {"error": str(e)})

        def log_message(self, *args) -> None:
            pass

    return Handler


def serve(service: Service, host: str, port: int, token: str = "", max_body: int = 2**20) -> ThreadingHTTPServer:
    return ThreadingHTTPServer((host, port), handler(service, token, max_body))


TOOLS = {"kb_search": "Ranked passages for a query.", "kb_ask": "An answer with citations.", "kb_status": "Counts of the store."}


def respond(service: Service, request: dict) -> dict | None:
    """The answer to one JSON-RPC request; None for a notification."""
    if "id" not in request:
        return None
    out = {"jsonrpc": "2.0", "id": request["id"]}
    method, params = request.get("method"), request.get("params") or {}
    try:
        if method == "initialize":
            return out | {"result": {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "corpusmill", "version": "0.1.0"}}}
        if method == "tools/list":
            schema = {"type": "object", "properties": {"query": {"type": "string"}, "k": {"type": "integer"}}}
            return out | {"result": {"tools": [{"name": n, "description": d, "inputSchema": schema} for n, d in TOOLS.items()]}}
        if method == "tools/call" and params.get("name") in TOOLS:
            args = params.get("arguments") or {}
            call = {"kb_search": lambda: service.search(args.get("query"), args.get("k", 8)), "kb_ask": lambda: service.ask(args.get("query"), args.get("k", 8)), "kb_status": service.status}
            return out | {"result": {"content": [{"type": "text", "text": json.dumps(call[params["name"]](), default=str)}]}}
        return out | {"error": {"code": -32601, "message": "method not found"}}
    except BadRequest as e:
        return out | {"error": {"code": -32602, "message": str(e)}}


def rpc_loop(service: Service, lines=sys.stdin, out=sys.stdout) -> None:
    for line in lines:
        try:
            answer = respond(service, json.loads(line))
        except json.JSONDecodeError:
            answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
        if answer is not None:
            print(json.dumps(answer), file=out, flush=True)
