import unicodedata

import pytest
from pyspark.sql import functions as F

from scoreloom.functions import text as tx
from scoreloom.operators import matching
from scoreloom.plans.model_queries import name_match, name_tables

SF = "/root/testdata/sf0.001"


def club(s):
    n = tx.normal(s)
    return matching.CLUB_ALIASES.get(n, n)


def brute(raw, people, least=90.0):
    """The passes in turn, over lists."""
    names = {}
    for name, c, seq in raw:
        if name is not None and (name not in names or seq > names[name][1]):
            names[name] = (c, seq)
    full = [(tx.normal(f), tx.normal(w), club(t), code) for code, f, w, t in people]
    out = {}
    for name, (c, _) in names.items():
        n, c = tx.normal(name), club(c)
        exact = {p[3] for p in full if n and n in (p[0], p[1])}
        token = {p[3] for p in full if p[1] and p[1] in n.split()}
        if len(exact) == 1:
            out[name] = (exact.pop(), "exact")
            continue
        if len(token) == 1:
            out[name] = (token.pop(), "token")
            continue
        scores = {}
        for p in full:
            if c and p[2] and p[3] in token and (r := tx.partial_ratio(c, p[2])) >= least:
                scores[p[3]] = max(scores.get(p[3], 0), r)
        best = {k for k, r in scores.items() if r == max(scores.values())}
        if len(best) == 1:
            out[name] = (best.pop(), "token_club")
            continue
        at_club = [p for p in full if c and p[2] and tx.partial_ratio(c, p[2]) >= least]
        scores = {}
        for p in at_club or full:
            if n and (r := tx.token_sort_ratio(n, p[0])) >= least:
                scores[p[3]] = max(scores.get(p[3], 0), r)
        best = {k for k, r in scores.items() if r == max(scores.values())}
        out[name] = (best.pop(), "fuzzy") if len(best) == 1 else (None, None)
    return out


def test_query_against_brute_force(spark):
    raw, people = name_tables(spark, SF)
    got = {r.raw_name: (r.code, r["pass"]) for r in name_match(spark, SF).collect()}
    want = brute([tuple(r) for r in raw.collect()], [tuple(r) for r in people.select("code", "full_name", "web_name", "team").collect()])
    assert got == want
    assert {p for _, p in got.values()} >= {"exact", "token_club", "fuzzy", None}


def test_shared_short_names_and_clubs(spark):
    people = [(1, "Ann Lee", "Lee", "Man Utd"), (2, "Bo Lee", "Lee", "Spurs"), (3, "Cy Dee", "Dee", "Brighton"), (4, "Di Dee", "Dee", ""), (5, "Éd Ñu", "Ñu", "Nott'm Forest")]
    raw = [("X Lee", "Tottenham Hotspur FC", 1), ("Y Lee", "Manchester United", 1), ("Z Dee", "Brighton & Hove Albion", 1), ("Z Lee", None, 1), ("q NU", "x", 1), ("Cyy Dee", "brighton", 2), ("Nobody", "Nowhere", 1), ("", "x", 1), (None, "x", 1)]
    got = {r.raw_name: (r.code, r["pass"]) for r in matching.match_names(spark.createDataFrame(raw, "raw_name string, club string, seq int"), spark.createDataFrame(people, "code int, full_name string, web_name string, team string")).collect()}
    assert got == brute(raw, people)
    assert got["X Lee"] == (2, "token_club") and got["q NU"] == (5, "token")


def test_normal_forms_without_python(spark):
    chars = [chr(c) for c in range(1, 0x3000) if unicodedata.category(chr(c)) != "Cn"]
    alone = [c for c in chars if len(tx._plain(c)) < 2 or c in "ĲĳǄǅǆ"]
    df = spark.createDataFrame([(f" Zo{c}b {c} ",) for c in [*alone, "ﬁ", "ﬂ"]] + [(None,), ("",)], "s string")
    out = df.select("s", tx.normalise(F.col("s")).alias("n"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert all(r.n == tx.normal(r.s) for r in out.collect())


@pytest.mark.parametrize("a, b", [("brighton", "brighton and hove albion"), ("leeds united", "leeds"), ("abc", "xyz"), ("manchester unitde", "manchester united fc")])
def test_club_scores(spark, a, b):
    clubs, teams = spark.createDataFrame([(a,)], "c string"), spark.createDataFrame([(b,), ("other",)], "team_n string")
    got = [(r.c, r.team_n, r.score) for r in matching._club_scores(clubs, teams, 90.0).collect()]
    r = tx.partial_ratio(a, b)
    assert got == ([(a, b, pytest.approx(r))] if r >= 90 else [])


def test_club_blocks_lose_no_pair(spark):
    import random

    rng = random.Random(5)
    words = ["".join(rng.choices("abc ", k=rng.randrange(2, 14))).strip() or "a" for _ in range(70)]
    left, right = sorted(set(words[:35])), sorted(set(words[35:]))
    got = {(r.c, r.team_n) for r in matching._club_scores(spark.createDataFrame([(w,) for w in left], "c string"), spark.createDataFrame([(w,) for w in right], "team_n string"), 90.0).collect()}
    assert got == {(a, b) for a in left for b in right if tx.partial_ratio(a, b) >= 90}


def test_one_character_off_is_found_by_equality(spark):
    """Pairs a character apart or equal, of one lane, and no others; they need no search by pieces."""
    names = spark.createDataFrame([("A", "red bolt ab", "x"), ("B", "bolt redd ab", "x"), ("C", "ab", "x"), ("D", "red bolt ab", "y")], "raw_name string, n string, lane string")
    people = spark.createDataFrame([("bolt ab red", 1, "x"), ("bolt ab re", 2, "x"), ("bolt ab reddd", 3, "x"), ("bolt ab r", 4, "x"), ("ab", 5, "x")], "full_n string, code int, lane string")
    assert {(r.raw_name, r.code) for r in matching._one_off(names, people).collect()} == {("A", 1), ("A", 2), ("B", 1), ("B", 3)}


def test_names_are_not_sent_through_the_driver(spark, monkeypatch):
    """Rows that look small are merged, and no plan after the first two repeats the letters of normal forms."""
    names = spark.createDataFrame([("A", "red bolt ab", "x")], "raw_name string, n string, lane string")
    people = spark.createDataFrame([("bolt ab red", 1, "x")], "full_n string, code int, lane string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(matching._one_off(names, people))
    # Only the lengths of pieces.
    assert plan(matching._by_blocks(names, people, 90.0)).count("BroadcastHashJoin") == 1
    written = []
    monkeypatch.setattr(matching, "materialise", lambda df, name, f=matching.materialise: written.append((name, plan(df))) or f(df, name))
    last = plan(name_match(spark, SF))
    assert {name for name, p in [*written, ("last", last)] if "translate(" in p} == {"names", "names-people"}
    # Clubs that match, which are counted first, and the lengths of pieces.
    sent = {name: p.count("BroadcastHashJoin") for name, p in [*written, ("last", last)] if "BroadcastHashJoin" in p}
    assert sent == {"names-settled": 1, "names-left": 2, "last": 1}
