import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from scoreloom.sources.claims import Claims
from scoreloom.sources.pull import get_json, pull, typed


@pytest.fixture()
def server():
    """Each path fails as often as it says, then answers: /fail/<times>/<name>, /text, /week/<n>."""
    seen = {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            n = seen[self.path] = seen.get(self.path, 0) + 1
            parts = self.path.strip("/").split("/")
            if parts[0] == "fail" and n <= int(parts[1]):
                self.send_response(503)
                self.end_headers()
                return
            body = "not json" if parts[0] == "text" else json.dumps({"name": parts[-1], "agent": self.headers["User-Agent"], "items": [{"id": 1, "n": "2.5"}, {"id": n}]})
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *a):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen
    s.shutdown()


def test_two_failures_then_an_answer(spark, server):
    url, seen = server
    got = pull(spark, url, ["fail/2/a", "week/{week}"], [3, 7], pause=0.01, agent="me").collect()
    assert sorted((r.path, r.week, json.loads(r.payload)["name"]) for r in got) == [("fail/2/a", None, "a"), ("week/{week}", 3, "3"), ("week/{week}", 7, "7")]
    assert seen["/fail/2/a"] == 3 and seen["/week/3"] == 1
    assert {json.loads(r.payload)["agent"] for r in got} == {"me"}


def test_three_failures_raise(spark, server):
    url, seen = server
    with pytest.raises(Exception, match="no JSON after 3 tries"):
        pull(spark, url, ["fail/3/b"], pause=0.01).collect()
    with pytest.raises(RuntimeError, match="no JSON after 2 tries"):
        get_json(f"{url}/text", tries=2, pause=0.0)
    with pytest.raises(RuntimeError, match="no JSON after 1 tries"):
        get_json("http://127.0.0.1:9/closed", tries=1)
    with pytest.raises(ValueError):
        get_json(url, tries=0)


def test_payloads_are_typed_and_pruned(spark, server):
    url, _ = server
    rows = typed(pull(spark, url, ["week/{week}", "fail/0/x"], [5]), "week/{week}", "name string, items array<struct<id: int, n: string>>, agent string")
    assert [(r.week, r.name, [i.id for i in r["items"]]) for r in rows.collect()] == [(5, "5", [1, 1])]
    plan = rows.select("name")._jdf.queryExecution().optimizedPlan().toString()
    assert "agent" not in plan


def test_one_winner(spark, tmp_path):
    sessions = [Claims(s, f"file://{tmp_path}/states") for s in (spark, spark.newSession())]
    assert sessions[0].propose("s:1:transfer", "plan") and not sessions[1].propose("s:1:transfer", "another plan")
    for i in range(10):
        key = f"k{i}"
        sessions[0].propose(key, f"plan {i}")
        won, gate = [], threading.Barrier(4)

        def race(who):
            gate.wait()
            got = sessions[who % 2].move(key, "proposed", ["executing", "rejected"][who % 2])
            if got:
                won.append((who, got))

        racers = [threading.Thread(target=race, args=(w,)) for w in range(4)]
        [t.start() for t in racers]
        [t.join() for t in racers]
        assert len(won) == 1
        assert sessions[1].state(key) == won[0][1] and won[0][1].detail == f"plan {i}"


def test_moves_follow_the_status(spark, tmp_path):
    c = Claims(spark, f"{tmp_path}/states")
    assert c.state("a") is None and c.move("a", "proposed", "executing") is None
    c.propose("a", "é plan")
    c.propose("b")
    assert c.move("a", "executing", "done") is None
    assert c.move("a", "proposed", "executing").version == 1
    assert c.move("a", "proposed", "rejected") is None
    assert c.move("a", "executing", "done", "sent").detail == "sent"
    assert sorted(map(tuple, c.states().collect())) == [("a", 2, "done", "sent"), ("b", 0, "proposed", "")]
