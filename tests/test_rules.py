import json
import random
from fnmatch import fnmatch

import pytest
from pyspark.sql import functions as F

from packetloom.functions.strings import glob_literal
from packetloom.operators.allowlist import with_allowed
from packetloom.operators.rules import match_rules
from packetloom.schemas import RULE_TABLE
from packetloom.sources.tables import read_allowlist, read_files, read_rules


def expected(event, rules):
    for r in sorted(rules, key=lambda r: (r[4], r[9])):
        value = r[3].strip().lower()
        src, dst, port, text = (str(x) for x in event[1:])
        hit = {"ip_src": src.lower() == value, "ip_dst": dst.lower() == value, "port": port == value,
               "domain": value in dst.lower(), "keyword": value in text.lower()}[r[2]]
        if r[5] and hit:
            return r[0]
    return None


@pytest.mark.parametrize("chain_limit,table_limit", [(256, None), (0, None), (0, 0)])
def test_first_match_agrees_with_a_scan(spark, chain_limit, table_limit):
    rng = random.Random(3)
    words = ["eval(", "a", "", " Ab ", "xyz", "shop", "Éte", "zz"]
    rules = [(f"r{i}", rng.choice(["allow", "block"]), rng.choice(["ip_src", "ip_dst", "port", "domain", "keyword"]), "", rng.choice([1, 5, 5, 100]),
              rng.random() < 0.8, "", 0, "", i) for i in range(30)]
    values = {"ip_src": ["1.1.1.1", "Host"], "ip_dst": ["shop.x", "b.c"], "port": ["80", " 443 "], "domain": ["shop", ".c", "q"], "keyword": words[:2] + words[3:]}
    rules = [(*r[:3], rng.choice(values[r[2]]), *r[4:]) for r in rules] + [("all", "block", "keyword", " ", 500, True, "", 0, "", 30)]
    events = [(i, rng.choice(["1.1.1.1", "HOST", "2.2.2.2"]), rng.choice(["SHOP.x", "b.c", "none"]), rng.choice(["80", "443", ""]),
               " ".join(rng.choices(words, k=rng.randint(0, 4)))) for i in range(300)]
    frame = spark.createDataFrame(events, "id long, source_ip string, destination_ip string, port string, text_content string")
    for subset in (rules, rules[:12], rules[:1]):
        table = spark.createDataFrame(subset, RULE_TABLE)
        found = {r["id"]: r["rule"] and r["rule"]["id"] for r in match_rules(frame, table, chain_limit=chain_limit, table_limit=table_limit).select("id", "rule").collect()}
        assert found == {e[0]: expected(e, subset) for e in events}


@pytest.mark.parametrize("limit", [2000, 0])
def test_allowlist_agrees_with_fnmatch(spark, limit):
    patterns = ["*.x.net", "exact.com", "a?c.org", "[ab].io", "[!ab].de", "*z*", "we[ird"]
    hosts = ["x.net", "a.x.net", "a.b.x.net", ".x.net", "EXACT.com ", "abc.org", "ac.org", "a.io", "c.io", "c.de", "a.de", "oozoo", "we[ird", "", None, "ax.net"]
    frame = spark.createDataFrame([(h,) for h in hosts], "host string")
    table = spark.createDataFrame([(p,) for p in patterns], "host string")
    found = {r["host"]: r["allowed"] for r in with_allowed(frame, "host", table, limit).collect()}
    for host in hosts:
        low = (host or "").strip().lower()
        assert found[host] == (bool(low) and any(low == p or fnmatch(low, p) for p in patterns)), host


@pytest.mark.parametrize("glob,literal", [("a?bcd*e", "bcd"), ("*", ""), ("[ab]", ""), ("[!a]xy", "xy"), ("[]]x", "x"), ("we[ird", "we[ird"), ("[!]", "[!]"), ("[!]]q", "q")])
def test_literal_of_globs(glob, literal):
    assert glob_literal(glob) == literal


def test_allowlist_of_many_globs(spark):
    draw = random.Random(5)
    globs = [f"h?{i:05d}*.[a-c]om" for i in range(30_000)] + ["??", "[x-z]*q", "*.net"]
    hosts = [f"h{draw.choice('xyz')}{draw.randrange(40_000):05d}{draw.choice(['', 'w'])}.{draw.choice('abd')}om" for _ in range(300)] + ["ab", "yq", "a.net", "net"]
    frame = spark.createDataFrame([(h,) for h in hosts], "host string")
    table = spark.createDataFrame([(g,) for g in globs], "host string")
    number = {g[2:7] for g in globs[:30_000]}
    def allowed(h):
        return any(fnmatch(h, g) for g in globs[30_000:]) or h[2:7] in number and fnmatch(h, f"h?{h[2:7]}*.[a-c]om")
    found = with_allowed(frame, "host", table).collect()
    assert len(found) == len(hosts) and {r["host"]: r["allowed"] for r in found} == {h: allowed(h) for h in hosts}


def test_config_files(spark, tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps({"rules": [
        {"id": "x", "action": "block", "match_type": "port", "value": "22", "odd": 1},
        {"id": "y", "action": "allow", "match_type": "domain", "value": "a", "priority": 3, "enabled": False}]}, indent=1))
    (tmp_path / "hosts.json").write_text(json.dumps({"hosts": [" A.com", 7, "", "*.b.net"]}))
    rules = read_rules(spark, str(tmp_path / "rules.json")).orderBy("seq").collect()
    assert [(r["id"], r["priority"], r["enabled"], r["seq"]) for r in rules] == [("x", 100, True, 0), ("y", 3, False, 1)]
    assert [r["host"] for r in read_allowlist(spark, str(tmp_path / "hosts.json")).collect()] == ["a.com", "*.b.net"]
    files = read_files(spark, str(tmp_path), "*.json").select("name", F.length("content").alias("n"), "length").collect()
    assert {f["name"] for f in files} == {"rules.json", "hosts.json"} and all(f["n"] == f["length"] for f in files)


def test_texts_give_rows_for_their_anchors_only(spark):
    """50,000 keyword rules: few grams of a text leave the task, and all matches are found."""
    import random

    from packetloom.operators import rules as ru
    from packetloom.schemas import RULE_TABLE
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzé🙂", k=rng.randint(5, 9)))
    values = [word() for _ in range(50_000)]
    values[7], values[8] = "", "x"
    table = spark.createDataFrame([(f"r{i}", "block", "keyword", v, 10, i not in (7, 8), "", 0, None, i) for i, v in enumerate(values)], RULE_TABLE)
    texts = [" ".join(rng.choice(values) if rng.random() < 0.1 else str(rng.randrange(10**6)) for _ in range(200)) for _ in range(30)] + ["", None, "12 34"]
    rows = spark.createDataFrame([(i, "1.1.1.1", "a.com", "80", t) for i, t in enumerate(texts)],
                                 "id long, source_ip string, destination_ip string, port string, text_content string")
    found = {r.id: r.rule and r.rule.id for r in ru.match_rules(rows, table).collect()}
    live = [(v, f"r{i}") for i, v in enumerate(values) if i not in (7, 8)]
    assert found == {i: next((r for v, r in live if t is not None and v in t), None) for i, t in enumerate(texts)}
    filed = spark.createDataFrame([(v,) for v in ("abc", "q", "é🙂z", "")], "g string").select(ru._gram_key(ru.F.col("g")).alias("_key"))
    once = rows.filter("text_content IS NOT NULL").selectExpr("text_content AS _text", "id AS _hash")
    true = sum(len({g for g in ("abc", "q", "é🙂z", "") if g in t}) for t in texts if t is not None)
    assert true <= ru.anchored_texts(once, filed).count() <= 1.2 * true + 5
