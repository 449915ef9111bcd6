import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from crawlframe.cli import Commands
from crawlframe.operators import closure, outcomes, stats
from crawlframe.sources import live
from crawlframe.sources.store import Store
from crawlframe.streaming import intake

H = "http://h.example/"


def test_submissions_keep_their_ids_over_batches_and_restarts(spark, tmp_path):
    source, store = tmp_path / "in", Store(spark, f"file://{tmp_path}/store")
    source.mkdir()
    schema = "namespace string, pos int, base string"
    for k, bases in enumerate([["a", "b"], ["b", "c"]]):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"namespace": "n", "pos": i, "base": H + b}) for i, b in enumerate(bases)))
        stream = spark.readStream.schema(schema).json(str(source))
        intake.submit_stream(stream, store, f"file://{tmp_path}/state").awaitTermination()
    assert sorted((r.base, r.job_id) for r in store.read("submissions").collect()) == [(H + "a", 1), (H + "b", 2), (H + "c", 3)]


def test_machine_state_lives_on_between_batches(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    schema = "job_id long, seq long, kind string, base string, url string, worker string, outcome string, words string, ext string, children array<string>"
    event = lambda seq, kind, **kw: json.dumps({"job_id": 1, "seq": seq, "kind": kind, "base": H, "worker": "w", **kw})
    batches = [
        [event(0, "submit"), event(1, "claim"), event(2, "complete", url=H, outcome="file", words="2", ext="html", children=[H + "a"])],
        [event(3, "claim"), event(4, "abort"), event(5, "complete", url=H + "a", outcome="file", words="7", ext="html")],
    ]
    for k, lines in enumerate(batches):
        (source / f"{k}.json").write_text("\n".join(lines))
        replies = intake.machine_stream(spark.readStream.schema(schema).json(str(source)))
        run = replies.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    got = [(r.seq, r.reply, r.state, r.files) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("seq").collect()]
    assert got == [(0, "created", "running", 0), (1, f"claimed {H}", "running", 0), (2, "published", "running", 1), (3, f"claimed {H}a", "running", 1), (4, "aborted", "aborted", 1), (5, "aborted", "aborted", 1)]


def served(seen):
    """A server of a small site, counting what it is asked for."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen[self.path] += 1
            status, kind, body, to = {"/s/": (200, "text/html", b"<a href=a>one</a><a href=go>two</a>", None), "/s/a": (200, "image/png", b"x", None), "/s/go": (302, "text/html", b"", "a")}.get(self.path, (404, "text/plain", b"", None))
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            if to:
                self.send_header("Location", to)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


def test_a_node_crawls_what_is_submitted_and_fetches_once(spark, tmp_path):
    seen, lines = Counter(), []
    server = served(seen)
    base = f"http://127.0.0.1:{server.server_port}/s/"
    commands = Commands(spark, Store(spark, f"file://{tmp_path}/store"), out=lines.append)
    assert commands.submit([base]) == 0 and commands.node(polls=2) == 0
    server.shutdown()
    assert seen == {"/s/": 1, "/s/a": 1, "/s/go": 1}
    lines.clear()
    assert commands.stats(1) == 0 and lines == ["files: 2   extensions: 1   words: 2\n  html 2"]


def test_live_source_gets_each_url_once(spark):
    seen = Counter()
    server = served(seen)
    base = f"http://127.0.0.1:{server.server_port}/s/"
    got = live.responses(spark.createDataFrame([(base + p,) for p in ("", "a", "go", "none", "a")], "url string")).persist()
    rows = {r.url.removeprefix(base): (r.status, r.location) for r in got.collect()}
    server.shutdown()
    assert rows == {"": (200, None), "a": (200, None), "go": (302, "a"), "none": (404, None)} and set(seen.values()) == {1}
    visits, states = closure.crawl(spark.createDataFrame([(1, base)], "job_id long, base string"), outcomes.classify(got))
    assert stats.stats_text(stats.job_stats(visits, states)).first().line == "files: 2   extensions: 1   words: 2\n  html 2"
    got.unpersist()
    assert live.fetch("http://127.0.0.1:9/")["error"] == "transport"
