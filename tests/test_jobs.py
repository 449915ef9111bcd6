import pytest

from crawlframe.cli import JOBS, Commands, main
from crawlframe.operators import jobs, metrics, protocol, stats
from crawlframe.operators.protocol import Machine
from crawlframe.sources.snapshot import response, snapshot
from crawlframe.sources.store import Store

H = "http://h.example/"
NONE = "namespace string, base string, job_id long"


def inputs(spark, rows):
    return spark.createDataFrame(rows, "namespace string, pos int, url string")


def test_submission_is_idempotent_and_local_to_its_namespace(spark):
    first = jobs.submit(spark.createDataFrame([], NONE), jobs.validate(inputs(spark, [("n", 1, H), ("n", 2, H + "#f"), ("n", 3, "HTTP://H.EXAMPLE/x"), ("m", 1, H + "x")])))
    got = {(r.namespace, r.pos): (r.job_id, r.created) for r in first.collect()}
    assert got == {("n", 1): (1, True), ("n", 2): (1, False), ("n", 3): (2, True), ("m", 1): (1, True)}
    again = jobs.submit(first.where("created").select("namespace", "base", "job_id"), jobs.validate(inputs(spark, [("n", 1, H + "y"), ("n", 2, H)])))
    assert {r.pos: (r.job_id, r.created) for r in again.collect()} == {1: (3, True), 2: (1, False)}


def test_ids_end_at_the_largest_long(spark):
    old = spark.createDataFrame([("n", H, 2**63 - 2)], NONE)
    got = jobs.submit(old, jobs.validate(inputs(spark, [("n", 1, H + "a"), ("n", 2, H + "b")])))
    assert {r.pos: r.job_id for r in got.collect()} == {1: 2**63 - 1, 2: None}


def test_one_bad_input_refuses_all_and_names_its_place_only(spark):
    with pytest.raises(jobs.InvalidInput) as caught:
        jobs.validate(inputs(spark, [("n", 1, H), ("n", 2, "https://me:hidden@h.example/")]))
    assert str(caught.value) == "input 2: CredentialsNotAllowed"


def test_machine_publishes_once_and_ends():
    m = Machine()
    assert m.submit(H) == "created" and m.submit(H) == "existing"
    assert m.claim("w") == ("claimed", H) and m.claim("w") == ("idle", None)
    assert m.complete(H, H, "v", "file", 1, "html", []) == "ownership"
    assert m.complete("http://x/", H, "w", "file", 1, "html", []) == "invalid"
    assert m.complete(H, H, "w", "file", 3, "html", [H + "a", H + "a", H]) == "published"
    assert m.complete(H, H, "w", "file", 3, "html", []) == "already"
    assert m.complete(H, H + "no", "w", "file", 3, "html", []) == "ownership"
    assert m.claim("v") == ("claimed", H + "a") and m.complete(H, H + "a", "v", "no-file", 0, "", []) == "published"
    assert (m.state, m.processed, m.files, m.words, m.exts) == ("done", 2, 1, 3, {"html": 1})


def test_overflow_fails_without_writing():
    m = Machine()
    m.submit(H)
    m.claim("w")
    m.complete(H, H, "w", "file", 2**64 - 1, "html", [H + "a"])
    m.claim("w")
    assert m.complete(H, H + "a", "w", "file", 1, "html", [H + "b"]) == "failed"
    assert (m.state, m.failure, m.processed, m.files, m.words, len(m.seen)) == ("failed", "statistics", 1, 1, 2**64 - 1, 2)


def test_late_publications_change_nothing():
    for end, want in ((lambda m: m.abort(), "aborted"), (lambda m: m.fail(H, "w", "fetch"), "failed")):
        m = Machine()
        m.submit(H)
        m.claim("w")
        m.complete(H, H, "w", "file", 1, "html", [H + "a", H + "b"])
        m.claim("w")
        m.claim("v")
        if want == "failed":
            assert m.fail(H + "a", "w", "fetch") == "failed"
        else:
            assert end(m) == "aborted" and m.abort() == "unchanged"
        assert m.complete(H, H + "b", "v", "file", 9, "html", []) == want and m.processed == 1 and m.claim("w") == ("idle", None)


def test_fold_keeps_jobs_apart(spark):
    schema = "job_id long, seq long, kind string, base string, url string, worker string, outcome string, words string, ext string, children array<string>"
    rows = []
    for job in (1, 2):
        rows += [(job, 0, "submit", H, None, None, None, None, None, None), (job, 1, "claim", H, None, "w", None, None, None, None), (job, 2, "complete", H, H, "w", "file", str(job), "html", [])]
    got = protocol.fold(spark.createDataFrame(rows[::-1], schema)).where("seq = 2").collect()
    assert sorted((r.job_id, r.reply, r.state, r.files, r.words) for r in got) == [(1, "published", "done", 1, "1"), (2, "published", "done", 1, "2")]


def test_follow_prints_changes_only(spark):
    log = spark.createDataFrame([(1, 1, 5, "running"), (1, 2, 5, "running"), (1, 3, 6, "running"), (1, 4, 6, "done"), (2, 1, 5, None), (2, 2, 5, None)], "job_id long, seq long, n long, state string")
    assert sorted((r.job_id, r.seq) for r in jobs.changes(log).collect()) == [(1, 1), (1, 3), (1, 4), (2, 1)]


def test_gauge_and_utilization(spark):
    steps = spark.createDataFrame([("a", 0, 1), ("a", 10, 1), ("a", 15, -1), ("a", 20, -1), ("b", 5, 1)], "g string, ts_ns long, delta int")
    got = {r.g: (r.peak, r.integral, r.current) for r in metrics.gauges(steps, "g").collect()}
    assert got == {"a": (2, 25, 0), "b": (1, 0, 1)}
    rows = spark.createDataFrame([(50, 10), (150, 10)], "integral long, elapsed long")
    assert metrics.utilization(rows, "elapsed").first()[0] == 1.0
    one = metrics.bench_summary(spark.createDataFrame([("x", 2.0)], "c string, elapsed double"), "c").first()
    assert (one.median, one.stdev) == (2.0, 0.0)


def test_store_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.version() == 0 and store.read("t") is None and store.health()
    store.commit(t=spark.range(2))
    old = store.read("t")
    store.commit(t=spark.range(5), u=spark.range(1))
    assert (store.version(), old.count(), store.read("t").count(), store.read("t", 1).count()) == (2, 2, 5, 2)
    store.commit(u=spark.range(3))
    assert store.read("t").count() == 5 and store.read("u").count() == 3


def test_commands(spark, tmp_path, capsys):
    said = []
    c = Commands(spark, Store(spark, f"file://{tmp_path}/store"), out=said.append)
    assert main(["jobs"], c) == 0 and said.pop() == "No jobs in this database/namespace."
    assert main(["submit", H + "s/", "http://H.example/s/#x", H + "bad/"], c) == 0
    assert said == ["job 1  input 1  created", "job 1  input 2  existing", "job 2  input 3  created"]
    said.clear()
    assert main(["stats", "1"], c) == 1 and main(["stats", "9"], c) == 1 and main(["stats", "01"], c) == 1 and main(["what"], c) == 2 and not said
    web = snapshot(spark, [response(H + "s/", 200, "text/html", "<a href=a.PNG>two words</a>"), response(H + "s/a.PNG", 200, "image/png"), response(H + "bad/", 500)])
    c.run(web)
    assert main(["status", "1"], c) == 0 and main(["status", "2"], c) == 1
    assert said == ["job 1  crawled 2  frontier 0  in flight 0  files 2  discovered 2  done", "job 2  crawled 0  frontier 1  in flight 0  files 0  discovered 1  failed (fetch)"]
    said.clear()
    assert main(["status", "-f", "1"], c) == 0 and main(["status", "2", "-f"], c) == 1 and len(said) == 2 and main(["status", "-f", "9"], c) == 1
    said.clear()
    assert main(["stats", "1"], c) == 0 and said == ["files: 2   extensions: 2   words: 2\n  html 1\n  png 1"]
    said.clear()
    main(["submit", H + "later/"], c)
    assert main(["abort", "--all"], c) == 0 and main(["abort", "1"], c) == 0 and main(["check"], c) == 0
    assert said == ["job 3  input 1  created", "job 3  aborted", "job 1  unchanged (already terminal)", "Spark connectivity: OK"]
    assert main(["submit", "https://a:secret@h.example/"], c) == 1 and "secret" not in capsys.readouterr().err


def test_a_publication_from_another_namespace_isn_t_the_owner_s():
    m = Machine()
    m.apply({"kind": "submit", "base": H, "namespace": "a"})
    m.claim("w")
    done = {"kind": "complete", "base": H, "url": H, "worker": "w", "outcome": "no-file", "children": None}
    assert m.apply({**done, "namespace": "b"}) == "ownership" and m.state == "running"
    assert m.apply({**done, "namespace": "a"}) == "published" and m.state == "done"


def test_damaged_jobs_are_named_and_not_printed(spark, tmp_path, capsys):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = [("default", 1, H, "running", ""), ("default", 2, H + "b", "done", "fetch"), ("default", 3, H + "c", "running", "")]
    visits = [(1, H, 0, None, 0, None, None, None, None, False)]
    store.commit(jobs=spark.createDataFrame(rows, JOBS), visits=spark.createDataFrame(visits, "job_id long, url string, level int, parent string, pos int, outcome string, words long, ext string, error string, done boolean"))
    lines = []
    commands = Commands(spark, store, out=lines.append)
    assert main(["jobs"], commands) == 1 and [line.split("  ")[0] for line in lines] == ["job 1"]
    assert main(["status", "2"], commands) == 1 and "InvalidStorage: job 2" in capsys.readouterr().err
    assert main(["status", "3"], commands) == 0


def test_statistics_beyond_the_bound_fail_the_job(spark):
    visits = spark.createDataFrame([(1, "a", "file", 2**63 - 1, "html", True), (1, "b", "file", 2**63 - 1, "html", True), (1, "c", "file", 2, "html", True), (2, "a", "file", 5, "html", True)], "job_id long, url string, outcome string, words long, ext string, done boolean")
    states = spark.createDataFrame([(1, "a", "done", ""), (2, "a", "done", "")], "job_id long, base string, state string, failure string")
    assert sorted((r.job_id, r.state, r.failure) for r in stats.settled(visits, states).collect()) == [(1, "failed", "statistics"), (2, "done", "")]
