"""An HTTP service over a collection: GET /health, POST /query, /query_batch, /locate and /histogram, in JSON.

Requests are answered one at a time. An answer that takes longer than ``seconds`` is given up with status 504 and
its Spark jobs are cancelled by their tag.
"""

from __future__ import annotations

import json
import threading
import urllib.request
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import functions as F

from spanquarry.operators import match
from spanquarry.operators.anchors import chunk_id
from spanquarry.plans.engine import Collection

SECONDS, MOST_BODY = 5.0, 1 << 20


def query(c: Collection, given: dict) -> dict:
    """One pattern in ``hex``; with ``text`` instead, its UTF-8 bytes."""
    return query_batch(c, {"queries": [given]})["results"][0]


def _hexes(given: dict) -> list[str]:
    return [q["hex"] if "hex" in q else q["text"].encode().hex() for q in given["queries"]]


def query_batch(c: Collection, given: dict) -> dict:
    rows = c.query(_hexes(given), int(given.get("most", 100))).orderBy("query_id").collect()
    return {"results": [r.asDict() for r in rows]}


def locate(c: Collection, given: dict) -> dict:
    rows = c.locate(_hexes(given), int(given.get("most", 100))).orderBy("query_id", "doc_id", "doc_offset").collect()
    return {"occurrences": [[r["query_id"], r["doc_id"], r["doc_offset"]] for r in rows]}


def histogram(c: Collection, given: dict) -> dict:
    """The chunks with most occurrences of the patterns together, the first ``most`` of them."""
    wanted = c.patterns(_hexes(given)).filter("status = 'OK'")
    hits = match.locate(c.corpus, wanted).groupBy(chunk_id(F.col("doc_id"), F.col("doc_offset")).alias("chunk"))
    rows = hits.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "chunk").limit(int(given.get("most", 16))).collect()
    return {"chunks": [[r["chunk"], r["n"]] for r in rows]}


ROUTES: dict[str, Callable[[Collection, dict], dict]] = {"/query": query, "/query_batch": query_batch, "/locate": locate, "/histogram": histogram}


def serve(collection: Collection, port: int = 0, seconds: float = SECONDS) -> ThreadingHTTPServer:
    """A server that is ready to ``serve_forever``; port 0 takes a free one."""
    one_at_a_time, workers, context = threading.Lock(), ThreadPoolExecutor(1), collection.spark.sparkContext

    def answer(of: Callable, given: dict, tag: str) -> dict:
        context.addJobTag(tag)
        try:
            return of(collection, given)
        finally:
            context.removeJobTag(tag)

    class Handler(BaseHTTPRequestHandler):
        def _say(self, status: int, body: dict) -> None:
            raw = json.dumps(body, sort_keys=True).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            self._say(200, {"status": "ok"}) if self.path == "/health" else self._say(404, {"error": "NOT_FOUND"})

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if self.path not in ROUTES:
                return self._say(404, {"error": "NOT_FOUND"})
            if size > MOST_BODY:
                return self._say(413, {"error": "TOO_LARGE"})
            try:
                given = json.loads(self.rfile.read(size))
                tag = f"service-{uuid.uuid4().hex}"
                with one_at_a_time:
                    return self._say(200, workers.submit(answer, ROUTES[self.path], given, tag).result(seconds))
            except Late:
                context.cancelJobsWithTag(tag)
                return self._say(504, {"error": "TIMEOUT"})
            except (KeyError, TypeError, ValueError, AttributeError) as e:
                return self._say(400, {"error": "BAD_REQUEST", "reason": str(e)[:200]})

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def asked(collection: Collection, path: str, given: dict, seconds: float = 3600.0) -> dict:
    """The answer of a service that runs for this one request."""
    server = serve(collection, seconds=seconds)
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()
    try:
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_address[1]}{path}", json.dumps(given).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request) as answer:
            return json.loads(answer.read())
    finally:
        server.shutdown()
        server.server_close()
