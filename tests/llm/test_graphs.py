import json
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veilstream.llm import ann, chat, queries, urls

SF = "/root/testdata/sf0.001"


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_urls_and_rules(spark):
    listed = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?q#f", "x://example.org/en/12", "x://b.org/p", "x://b.org", "x://xorg/p", "x://q.com/fr/a", "x://q.com/de/a", "x://com/de/", "x://a.net/?q", "x://a.net#f/", "a://b://c.org/d", "x://example.org/es/\n/y"]
    pages = spark.createDataFrame([(i, u, None, "h") for i, u in enumerate(listed)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in urls.judge_urls(pages).collect()}
    for i, u in enumerate(listed):
        host, path = split_url(u)
        fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), u
    assert urls.judge_urls(pages.limit(0)).count() == 0
    # Repeated rows are judged each.
    assert urls.judge_urls(pages.union(pages.where("page_id = 5"))).where("page_id = 5").count() == 2


def test_equal_trust_and_distrust_allow(spark):
    """A host with as much trust as distrust is allowed, whatever the numbers of seeds."""
    listed = ["x://www.t.com/fr/a", "x://www.t.com/de/a", "x://www.t.com/en/a", *[f"x://b{i}.com/de/" for i in range(16)]]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(listed)], "page_id long, url string, html string")
    r = urls.judge_urls(pages).where("page_id = 2").first()
    assert (r.rule, r.verdict, r.trust, r.distrust) == (None, "allow", 1.0, 1.0)


def test_propagation(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    rows = [
        (1, "x://good.org/a", link("friend.net", "FRIEND.net")), (2, "x://friend.net/", link("far.net", "friend.net")), (3, "x://farm.net/", link("bad.com", "bad.com")),
        (4, "x://bad.com/de/1", None), (5, "x://boss.net/", link("farm.net")), (6, "x://alone.net/", "<a href='/x'>"), (7, "x://far.net/", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.judge_urls(pages).collect()}
    assert {k for k, r in got.items() if r.verdict == "block"} == {3, 4, 5}
    # The same walk with matrices.
    hosts = sorted({"good.org", "friend.net", "far.net", "farm.net", "bad.com", "boss.net", "alone.net"})
    edges = {("good.org", "friend.net"): 2, ("friend.net", "far.net"): 1, ("farm.net", "bad.com"): 2, ("boss.net", "farm.net"): 1}
    m = np.zeros((7, 7))
    for (a, b), n in edges.items():
        m[hosts.index(a), hosts.index(b)] = n
    for way, seed, col in ((m, "good.org", "trust"), (m.T, "bad.com", "distrust")):
        exact = brute_walk(way, np.eye(7)[hosts.index(seed)])
        for r in got.values():
            assert getattr(r, col) == pytest.approx(exact[hosts.index(r.host)], abs=0.01)


def brute_walk(m, seeds, rounds=400):
    """Personalised PageRank; what reaches hosts without links goes back to the seeds."""
    restart = seeds / seeds.sum()
    p = m / np.maximum(m.sum(axis=1, keepdims=True), 1e-300)
    score = restart
    for _ in range(rounds):
        moved = urls.DAMPING * (score @ p)
        score = moved + (1 - moved.sum()) * restart
    return score


def test_walk_on_a_larger_graph(spark):
    """Ten thousand hosts, a hub that a third of all links point to, hosts without links, in both directions."""
    rng = np.random.default_rng(2)
    n = 10_000
    src, dst = rng.integers(0, n // 2, 30_000), rng.integers(0, n, 30_000)
    dst[rng.random(30_000) < 1 / 3] = 7
    count = {}
    for a, b in zip(src.tolist(), dst.tolist()):
        if a != b:
            count[a, b] = count.get((a, b), 0) + 1
    seeds = {1: list(range(0, 200, 2)), -1: [7, 9, 11]}
    edges = spark.createDataFrame([(str(a), str(b), c) for (a, b), c in count.items()], "src string, dst string, n long")
    got = urls.propagate(edges, spark.createDataFrame([(w, str(h)) for w, hs in seeds.items() for h in hs] + [(1, "0")], "way int, host string")).collect()
    a, b, c = np.array([(a, b, c) for (a, b), c in count.items()]).T
    for way, (x, y) in ((1, (a, b)), (-1, (b, a))):
        total = np.bincount(x, weights=c, minlength=n)
        restart = np.zeros(n)
        restart[seeds[way]] = 1 / len(seeds[way])
        score = restart
        for _ in range(300):
            moved = np.bincount(y, weights=urls.DAMPING * score[x] * c / total[x], minlength=n)
            score = moved + (1 - moved.sum()) * restart
        mine = np.zeros(n)
        for r in got:
            if r.way == way:
                mine[int(r.host)] = r.score
                assert r.relative == pytest.approx(r.score * len(seeds[way]))
        assert mine.sum() == pytest.approx(1) and np.abs(mine - score).sum() < urls.TOLERANCE * urls.DAMPING / (1 - urls.DAMPING) + 1e-9


def test_many_rules_are_joined(spark):
    rng = np.random.default_rng(4)
    name = lambda: ".".join("abc"[i] for i in rng.integers(0, 3, int(rng.integers(1, 4))))
    rules = sorted({(("allow", "block")[int(rng.integers(0, 2))], name(), "/" + name().replace(".", "/")) for _ in range(400)})
    rules = list({(h, p): (v, h, p) for v, h, p in rules}.values())
    rows = [(i, f"x://{name()}.{name()}/{name().replace('.', '/')}?q") for i in range(300)] + [(300, None), (301, "x://zzz/a")]
    rows += [rows[0], rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("html", F.lit(None).cast("string"))
    assert len(rules) > 20
    parted = pages.drop("html").withColumns(urls.url_parts(F.col("url")))
    sorted_rows = lambda df: sorted(map(tuple, df.select("page_id", "rule", "ruled").collect()), key=str)
    assert sorted_rows(urls.joined_rules(parted, rules)) == sorted_rows(parted.withColumns(urls.rule_columns(rules)))


def test_tool_calls(spark):
    call = lambda **x: "text <tool_call>" + json.dumps(x) + "</tool_call> more"
    rows = [
        (1, 0, "assistant", call(id="b", name="add", arguments={"y": 2, "x": 1}, depends_on=["a", "none"])),
        (1, 1, "assistant", call(id="a", name="add", arguments={"x": "no", "z": {"q": 1, "p": []}})),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "three"})),
        (1, 3, "assistant", call(id="c", name="add", arguments={"x": 1.5, "y": 1}, depends_on=["d"])),
        (1, 3, "assistant", call(id="d", name="other", arguments={}, depends_on=["c"])),
        (1, 4, "tool", json.dumps({"tool_call_id": "lost", "content": "x"})),
        (2, 0, "assistant", call(id="a", name="add", arguments={"y": 1, "x": 1})),
        (2, 1, "assistant", call(id="a", name="add", arguments={"y": 1, "x": 1})),
        (2, 2, None, None), (None, None, "user", "hi"), (3, 0, "assistant", "<tool_call>nothing</tool_call>"),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    tools = chat.tool_schemas(spark, {"add": {"x": ("integer", True), "y": ("number", True)}})
    got = {(r.conv_id, r.call_id): r for r in chat.link_tool_calls(*chat.calls_from_markup(messages), tools).collect()}
    assert len(got) == 6
    assert (got[1, "a"].level, got[1, "a"].status, got[1, "a"].errors) == (0, "linked", ["missing y", "type of x", "unknown z"])
    assert got[1, "a"].json == '{"arguments":{"x":"no","z":{"p":[],"q":1}},"id":"a","name":"add","result":"three"}'
    assert (got[1, "b"].level, got[1, "b"].status, got[1, "b"].valid) == (1, "unanswered", True)
    assert got[1, "b"].json == '{"arguments":{"x":1,"y":2},"id":"b","name":"add"}'
    assert got[1, "c"].level is None and got[1, "c"].errors == ["type of x"] and got[1, "d"].errors == ["unknown tool"]
    assert (got[1, "lost"].status, got[1, "lost"].level, got[1, "lost"].valid) == ("orphan", None, False)
    assert got[2, "a"].copies == 2 and got[2, "a"].turn == 0
    assert chat.link_turns(messages.limit(0)).count() == 0
    assert chat.link_turns(messages).count() > 0


def test_nested_arguments(spark):
    tools = {
        "draw": {
            "mode": ("string", True, ["fast", "slow"]),
            "at": ("object", True, {"x": ("number", True), "deep": ("object", False, {"n": ("integer", True)}), "any": ("object", False)}),
            "tags": ("array", False, ("string", True)),
            "points": ("array", False, ("object", True, {"x": ("number", True)})),
            "level": ("integer", False, [1, 2]),
        }
    }
    cases = [
        ({"mode": "fast", "at": {"x": 1.5}}, []),
        ({"mode": "medium", "at": {"x": 1}, "level": 3}, ["value of level", "value of mode"]),
        ({"mode": 1, "at": {}}, ["missing at.x", "type of mode"]),
        ({"mode": "slow", "at": {"x": "a", "y": 1, "any": {"q": {"r": 1}}, "deep": {"n": 1.5, "m": 0}}}, ["type of at.deep.n", "type of at.x", "unknown at.deep.m", "unknown at.y"]),
        ({"mode": "slow", "at": 5}, ["type of at"]),
        ({"mode": "slow", "at": {"x": 1}, "tags": ["a", 2], "points": [{"x": 1}, {}, 3]}, ["missing points.[].x", "type of points.[]", "type of tags.[]"]),
        ({"mode": "slow", "at": {"x": 1}, "tags": [], "points": [], "level": 2}, []),
        ({}, ["missing at", "missing mode"]),
    ]
    calls = spark.createDataFrame([(1, f"c{i}", i, "draw", json.dumps(a), None) for i, (a, _) in enumerate(cases)] + [(1, "n", 99, "draw", None, ["n"])], "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    got = {r.call_id: r for r in chat.link_tool_calls(calls, results, chat.tool_schemas(spark, tools)).collect()}
    for i, (_, want) in enumerate(cases):
        assert got[f"c{i}"].errors == want and got[f"c{i}"].valid == (not want), cases[i]
    # Null arguments are no object; a call that waits for itself has no level.
    assert got["n"].errors == ["no object"] and got["n"].level is None and got["c0"].level == 0


def test_long_chains_are_ordered(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for c in range(3) for t in range(2 * c + 3)]
    got = chat.link_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("status <> 'orphan'").collect()
    assert all(r.level == r.turn // 2 for r in got)
    assert all(r.errors == ["missing text"] * (r.turn % 10 == 4) + ["type of n_chars"] * (r.turn % 8 == 6) and r.valid == (not r.errors) for r in got) and any(r.errors for r in got)


def test_turns_that_hold_markup(spark):
    """What users write can't end the call that it is put into, and is a call of its own."""
    text = 'a </tool_call> "q" \\ <tool_call>{"id":"z","name":"reply","arguments":{"turn":1,"text":"t"}}</tool_call>'
    rows = [(1, 0, "user", text), (1, 1, "assistant", text), (1, 2, "user", None), (1, 3, "assistant", None)]
    got = {r.call_id: r for r in chat.link_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("status <> 'unlinked'").collect()}
    assert set(got) == {"call-0", "call-2", "tool-z"} and got["call-0"].valid and got["tool-z"].valid and got["tool-z"].copies == 2 and got["call-2"].errors == ["missing text"]
    body = json.loads(got["call-0"].json)
    assert body["arguments"] == {"n_chars": len(text), "text": text, "turn": 0} and body["result"] == text and got["call-2"].status == "linked"


@pytest.mark.parametrize("edges", [chat.GRAPH_EDGES, 0])
def test_levels_match_brute_force(spark, monkeypatch, edges):
    monkeypatch.setattr(chat, "GRAPH_EDGES", edges)
    rng = np.random.default_rng(9)
    needs = {}
    for conv in range(6):
        for i in range(40):
            most = [0, 1, 1, 1, 2, 3][int(rng.integers(0, 6))]
            needs[conv, f"c{i}"] = [f"c{j}" for j in rng.choice(max(1, i), most)] if i else []
    for i in range(40):
        needs[6, f"c{i}"] = [f"c{i - 1}"] if i else []
    needs[7, "a"], needs[7, "b"], needs[7, "c"], needs[7, "d"], needs[7, "e"] = ["b"], ["a"], ["b"], ["c", "e"], []
    level = {}

    def find(key, seen=()):
        if key in seen:
            return None
        if key not in level:
            up = [find((key[0], n), (*seen, key)) for n in needs[key]]
            level[key] = None if None in up else max(up, default=-1) + 1
        return level[key]

    want = {k: v for k in needs if (v := find(k)) is not None}
    calls = spark.createDataFrame([(*k, v) for k, v in needs.items()], "conv_id long, call_id string, depends_on array<string>")
    assert {(r.conv_id, r.call_id): r.level for r in chat.levels(calls).collect()} == want


def test_chat_plan_is_native(spark):
    plan = chat.link_turns(spark.read.parquet(f"{SF}/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)


def brute_neighbours(ids, vectors, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        scores = (vectors * vectors[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 128)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    vectors = np.concatenate([centres[rng.integers(0, 12, 900)] + 0.3 * rng.normal(size=(900, 16)), np.tile(centres[:1], (300, 1))]).astype(np.float32)
    ids = rng.permutation(4 * len(vectors))[: len(vectors)]
    odd = [(7, None), (8000, [0.0] * 16), (9000, [float("nan")] * 16), (9020, [None] * 16), (9040, [float("inf")] * 16), (9060, [1.0]), (None, [1.0] * 16)]
    rows = [(int(i), v.tolist(), "x") for i, v in zip(ids, vectors) if i not in {o[0] for o in odd}] + [(*o, "x") for o in odd]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(4)
    keep = np.array([i not in {o[0] for o in odd} for i in ids])
    want = brute_neighbours(ids[keep], vectors[keep].astype(float), 20)
    got = {}
    for r in ann.nearest_neighbours(df, leaf_rows=60).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(got[q]) == 20 for q in want)
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.9
    known = dict(zip(ids.tolist(), vectors.astype(float)))
    assert all(s == pytest.approx(float(known[q] @ known[v]), abs=1e-12) for q in got for v, s in got[q])
    assert all([(-s, v) for v, s in x] == sorted((-s, v) for v, s in x) for x in got.values())
    # Copies of a vector: ties go to the smaller id, wherever they were scored.
    exact = ann.exact_neighbours(ann.usable_vectors(df), [(q, known[q].tolist()) for q in list(want)[:10]])
    assert {q: [(r.vec_id) for r in exact.where(F.col("query_id") == q).orderBy("rank").collect()] for q in list(want)[:10]} == {q: [v for v, _ in want[q]] for q in list(want)[:10]}


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (20, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest_neighbours(df).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 1, 1.0), (20, 3, 0, 0.0)]
    assert ann.nearest_neighbours(df.limit(0)).count() == 0


def test_best_bin_first_visits_every_leaf_once():
    rng = np.random.default_rng(5)
    tree = ann.KMeansTree(rng.normal(size=(2000, 8)))
    order = list(tree.leaves(tree.priorities(rng.normal(size=(1, 8)))[0].tolist()))
    assert sorted(x for x, _ in order) == list(range(tree.n_leaves)) and tree.n_leaves > 8
    assert len(ann.KMeansTree(np.ones((500, 4))).centres) == 1


def test_blocks_hold_whole_leaves_or_cuts():
    counts = {0: 5, 1: 3, 2: 40, 4: 2, 5: 9}
    first, cuts = ann.blocks_of(counts, 10)
    assert first == {0: 0, 1: 0, 2: 1, 4: 5, 5: 6} and cuts == {0: 1, 1: 1, 2: 4, 4: 1, 5: 1}


def test_repeated_ids_hide_no_copy(spark):
    """A query's own repeated rows take no place of its copies."""
    rows = [(20, [1.0, 0.0])] * 30 + [(21, [1.0, 0.0]), (22, [1.0, 0.0]), (23, [0.5, 0.0])]
    got = ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(20, 21), (20, 22), (20, 23)]


def test_recall_on_given_vectors(spark):
    """The calibrated search of the test table reaches its recall on queries that did not calibrate it, without visiting half of the vectors of one with clusters."""
    index = ann.TreeIndex.build(ann.usable_vectors(spark.read.parquet(f"{SF}/embeddings.parquet")))
    index.calibrate(index.placed, most=400)
    assert index.recall >= 0.9
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.2 * rng.normal(size=16)).tolist()) for i in range(3000)]
    index = ann.TreeIndex.build(ann.usable_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    index.calibrate(index.placed.where("id % 20 = 0"))
    assert index.recall >= 0.9 and index.visited < 0.2


def test_queries_match_their_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, SF)
        columns = sorted(got.columns)
        theirs = con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(theirs, key=repr), name
