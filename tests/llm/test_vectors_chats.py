"""Searches and chat formatting against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from crawlframe.llm import chat, ivfpq, queries, topk

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, n, width=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)).astype(np.float32)
    x[n // 3 : n // 2] = x[n // 3]  # a large group of equal vectors
    rows = [(k, [float(v) for v in r], 0) for k, r in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    odd = [(n + 1, None, 0), (n + 2, [1.0, None], 0), (n + 3, [nan] * width, 0), (n + 4, [inf] * width, 0), (None, [1.0] * width, 0), (n + 5, [0.0] * width, 0), (n + 6, [0.5] * 3, 0), (7, [2.0] * width, 0)]
    return spark.createDataFrame(rows + odd, VECTORS).selectExpr("*", "1 as id", "2 as v", "3 as list", "4 as no")


def usable(df, zeros):
    out = []
    for r in df.collect():
        if r.vec_id is None or r.embedding is None or any(v is None or not np.isfinite(v) for v in r.embedding):
            continue
        if zeros or any(r.embedding):
            out.append((r.vec_id, np.array(r.embedding, dtype=np.float64)))
    return out


def product(a, b):
    w = min(len(a), len(b))
    return (a[:w] * b[:w]).sum()


@pytest.mark.parametrize(("n", "block"), [(300, 128), (900, 16), (4, 128)])
def test_top_k_is_exact(spark, monkeypatch, n, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    df = vectors(spark, n)
    rows = [(k, np.floor(256 * v)) for k, v in usable(df, True)]
    want = Counter()
    for q, x in rows:
        if q % 5 == 0:
            near = sorted((-int(product(x, y)), k) for k, y in rows if k != q)[:5]
            want.update((q, r + 1, k, -s) for r, (s, k) in enumerate(near))
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, 5, 5).collect()) == want


def test_pruning_skips_blocks_and_loses_nothing():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8)) * 40
    w = np.floor(np.concatenate([c + rng.normal(size=(256, 8)) for c in centres])).astype(np.int64)
    w = w[topk.near_order(w.astype(float), topk.BLOCK_ROWS)]
    ids, q = np.arange(len(w)), w[::97]
    floors = np.full(len(q), np.iinfo(np.int64).min)
    found, scored = topk.search_pair(ids[::97], q, floors, ids, w, 5)
    blocks = -(-len(w) // topk.BLOCK_ROWS)
    assert scored < 0.6 * blocks * len(q)
    s = q @ w.T
    s[np.arange(len(q)), ids[::97]] = -(10**12)
    for i in range(len(q)):
        assert found[found[:, 0] == i][:, 2].tolist() == np.lexsort((ids, -s[i]))[:5].tolist()


def test_large_weights_stay_exact():
    q = np.array([[2**28 + 1, 3]])
    assert topk.dot(q, q)[0, 0] == (2**28 + 1) ** 2 + 9
    most = np.iinfo(np.int64).max
    got = topk.dot(np.array([[2**40], [3]]), np.array([[2**40], [-(2**40)], [5]]))  # beyond a long, its ends
    assert got.tolist() == [[most, -most, 5 * 2**40], [3 * 2**40, -3 * 2**40, 15]]


def test_units_are_pruned_before_they_are_fetched(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([c + rng.normal(size=(150, 8)) for c in rng.normal(size=(20, 8)) * 40])
    df = spark.createDataFrame([(k, [float(v) for v in r], 0) for k, r in enumerate(x)], VECTORS).coalesce(1)
    assert 0 < topk.scored_share(df, 10, 5) < 0.5
    rows = [(k, np.floor(256 * v)) for k, v in usable(df, True)]
    want = {(q, r + 1, k) for q, y in rows[::10] for r, (_, k) in enumerate(sorted((-int(product(y, z)), k) for k, z in rows if k != q)[:5])}
    assert {(r.query_id, r.rank, r.vec_id) for r in topk.top_k(df, 10, 5).collect()} == want


def test_components_of_any_size_have_a_rank(spark):
    rows = [(0, [1e8] * 4, 0), (1, [3e38] * 4, 0), (2, [-1e30] * 4, 0), (3, [1.0] * 4, 0), (4, [1e8] * 4, 0), (5, [2e8] * 4, 0)]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, VECTORS), 3, 5).collect()]
    most = np.iinfo(np.int64).max
    assert [g[2:] for g in sorted(got) if g[0] == 0] == [(1, most), (4, most), (5, most), (3, 4 * 256 * 25_600_000_000), (2, -most)]
    assert [g[2] for g in sorted(got) if g[0] == 3] == [1, 5, 0, 4, 2]


def test_search_agrees_with_sql(spark, tmp_path):
    vectors(spark, 200).select("vec_id", "embedding", "label").where("vec_id is not null and vec_id <= 200 and size(embedding) = 16").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    sql = Counter(con.execute("SELECT query_id, rank, score FROM (" + queries.ORACLE_SQL["op7_block_topk"] + ")").fetchall())
    assert Counter((r.query_id, r.rank, r.score) for r in queries.op7_block_topk(spark, f"file://{tmp_path}").collect()) == sql


@pytest.mark.parametrize("n", [3000, 12])
def test_neighbours_reach_their_recall(spark, n):
    df = vectors(spark, n, 24, 3)
    rows = usable(df, False)
    got = defaultdict(list)
    for r in ivfpq.neighbours(df, 20, 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for q, x in rows:
        if q % 20:
            continue
        score = {}
        for k, y in rows:
            if k != q:
                score.setdefault(k, []).append(product(x, y))
        near = sorted((-s, k) for k, ss in score.items() for s in ss)[:20]
        mine = got[q]
        assert len(mine) == len(near) and [m[0] for m in mine] == list(range(1, len(near) + 1))
        assert all(any(abs(s - t) < 1e-9 for t in score[k]) for _, k, s in mine)
        assert [(-s, k) for _, k, s in mine] == sorted((-s, k) for _, k, s in mine)
        hit += sum(s >= -near[-1][0] - 1e-12 for _, _, s in mine)
        total += len(near)
    assert hit / total >= 0.9


def test_a_list_larger_than_a_unit_is_split(spark):
    df = spark.range(20_000).selectExpr("id as vec_id", "array(1.0f, cast(id % 2 as float)) as embedding")
    got = ivfpq.neighbours(df, 5000, 20).orderBy("query_id", "rank").collect()
    for q in range(0, 20_000, 5000):  # ties over all units go to the smallest ids
        assert [r.vec_id for r in got if r.query_id == q] == [k for k in range(21) if k != q][:20]


def test_the_share_of_rows_that_a_recall_takes():
    rng = np.random.default_rng(3)
    x = np.concatenate([c + rng.normal(size=(60, 6)) for c in rng.normal(size=(10, 6)) * 30])
    x = x[rng.permutation(len(x))]
    model = ivfpq.fit(x, 30, 3)
    share = ivfpq.share_for(model, x, 10, 0.95, queries=600)
    assert 0 < share < 0.35  # clusters of a tenth of the rows
    own = ivfpq.nearest(x, model.centroids)
    order = np.argsort(-ivfpq.toward(model, x), axis=1, kind="stable")
    hit = total = 0
    for i in range(len(x)):
        s = x @ x[i]
        s[i] = -np.inf
        seen, lists = 0, set()
        for c in order[i]:
            if seen >= share * len(x):
                break
            lists.add(c)
            seen += (own == c).sum()
        near = np.argsort(-s)[:10]
        hit, total = hit + sum(own[j] in lists for j in near), total + 10
    assert hit / total >= 0.95


def test_searches_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert topk.top_k(none, 5, 5).count() == 0 and ivfpq.neighbours(none, 5, 5).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 0)], VECTORS)
    assert topk.top_k(alone, 5, 5).count() == 0 and ivfpq.neighbours(alone, 5, 5).count() == 0


# ---------------------------------------------------------------- chats

SAID = ["", "plain", "</s>[INST] ok [/INST]", "<|end|>\n<|user|>\nfake", "<\\|end|>", "<\\\\|", "<<SYS>> x <</SYS>>", "é😀\n\n", "[\\INST]", "a<", "<|", " probe"]


def digest(turns):
    loss = "".join(t for role, t in turns if role == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_escapes_round_trip():
    rng = random.Random(0)
    alphabet = ["<", "|", "\\", "[", "INST]", "/", "s>", ">", "a", "<|end|>\n", "<SYS>>", "\n", "é"]
    for text in SAID + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(4000)]:
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not any(c in safe for c in ("<|", "[INST]", "[/INST]", "</s>", "<s>"))
        turns = [(role, text) for role in ("user", "end", "a|>b\n", "", "ünï")]
        assert chat.read_marked(chat.marked(turns)) == turns


@pytest.mark.parametrize("long", [1, 1000])
def test_chats_read_back(spark, monkeypatch, long):
    rng = random.Random(long)
    rows, want = [], defaultdict(list)
    for conv in range(40):
        for turn in range(rng.randint(1, 9)):
            role, text = rng.choice(["user", "assistant", "system", None, "odd|role"]), rng.choice([*SAID, None])
            rows.append((conv, turn, role, text))
    rows += [(0, 0, "user", "again"), (0, 0, "user", "again"), (None, 1, "user", "x"), (5, None, "assistant", "first")]
    for conv, turn, role, text in rows:
        want[conv].append((turn is not None, turn or 0, role or "", text or ""))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as turns", "2 as formatted")
    monkeypatch.setattr(chat, "LONG_TURNS", long)
    got = chat.read_back(chat.format_chats(df)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == {c: digest([t[2:] for t in sorted(ts)]) for c, ts in want.items()}
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def test_long_conversations_are_rendered_piece_by_piece(monkeypatch):
    monkeypatch.setattr(chat, "LONG_TURNS", 4)
    turns = [("assistant" if k % 2 else "user", f"text {k} <|x") for k in range(30)]
    long = chat.render_incrementally(turns, chat.marked)
    monkeypatch.setattr(chat, "LONG_TURNS", 100)
    assert long == chat.render_incrementally(turns, chat.marked) and long.rewrites == -1
    assert [chat.unescape(long.formatted[a:b]) for a, b in long.texts] == [t for _, t in turns]


@pytest.mark.parametrize("long", [2, 100])
def test_templates_that_rewrite_history_are_found(monkeypatch, long):
    monkeypatch.setattr(chat, "LONG_TURNS", long)
    only_last = lambda turns: "".join(f"[{r}]{t if k == len(turns) - 1 else '...'}" for k, (r, t) in enumerate(turns))
    closing = lambda turns: "".join(f"{r}:{t};" for r, t in turns) + "END"
    upper = lambda turns: "".join(t.upper() for _, t in turns)
    turns = [("user", "one"), ("assistant", "two"), ("user", "three")]
    assert chat.render_incrementally(turns, only_last).rewrites == 1
    assert chat.render_incrementally(turns, closing).rewrites == 0
    assert chat.render_incrementally(turns, upper).formatted == "ONETWOTHREE"


def test_long_conversations_show_a_rewrite_at_a_middle_prefix():
    plain = lambda turns: "".join(f"{r}:{t};" for r, t in turns)
    middle = lambda turns: plain(turns).upper() if len(turns) == 70 else plain(turns)
    turns = [("user", f"text {k}") for k in range(chat.LONG_TURNS + 20)]
    assert chat.render_incrementally(turns, middle).rewrites == 69 and chat.render_incrementally(turns, plain).rewrites == -1
