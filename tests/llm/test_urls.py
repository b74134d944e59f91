import datetime as dt
import random

import duckdb

from panelcast.llm.registry import ORACLES, QUERIES
from panelcast.llm.urls import filter_urls


def brute(captures, entries):
    by = {}
    for pattern, action, day in entries:
        if None not in (pattern, action, day):
            own = by.setdefault(pattern.lower(), {})
            own[day] = max(own.get(day, 0), {"block": 2, "allow": 1, "remove": 0}[action])
    out = []
    for i, url, day in captures:
        verdict, pattern = "none", None
        if url and "://" in url and day:
            host, _, rest = url.split("://", 1)[1].partition("/")
            host, path = host.rsplit("@")[-1].split(":")[0].split("?")[0].lower(), ("/" + rest).split("?")[0].split("#")[0] if rest or url.endswith("/") else ""
            parts = host.split(".")
            keys = [".".join(parts[k:]) for k in range(len(parts) - 1, -1, -1)] + [host + path[: k + 1] for k, x in enumerate(path) if x == "/"]
            for key in keys if host else []:
                past = [d for d in by.get(key, {}) if d <= day]
                if past and by[key][max(past)]:
                    pattern, verdict = key, {2: "block", 1: "allow"}[by[key][max(past)]]
        out.append((i, url, day, pattern, verdict, verdict != "block"))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(4)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(1500))
    hosts = ["a.example.com", "b.a.example.com", "example.com", "other.org"]
    paths = ["", "/", "/x/", "/x/y/z", "/X/", "/x?q=1", "/x/y/#top"]
    captures = [(i, f"https://{rng.choice(hosts)}{rng.choice(paths)}", day()) for i in range(300)]
    captures += [(400, None, day()), (401, "not a url", day()), (402, "https://example.com/", None), (403, "", day()), (None, "https://EXAMPLE.com/x/", day()), captures[0], captures[0]]
    captures += [(404, "https://example.com/" + "d/" * 400, day()), (405, "http://u:p@other.org:80/x/", day())]
    patterns = [*hosts, "com", "example.com/x/", "a.example.com/", "Other.org/x/", "example.com/" + "d/" * 300]
    entries = [(rng.choice(patterns), rng.choice(["block", "allow", "remove"]), day()) for _ in range(80)]
    entries += [(None, "block", day()), ("com", None, day()), ("com", "block", None), entries[0]]
    left = spark.createDataFrame([(*c, "p", True) for c in captures], "page_id long, url string, fetched date, pattern string, kept boolean").repartition(3)
    right = spark.createDataFrame([(*e, 1) for e in entries], "pattern string, action string, dated date, url int")
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in filter_urls(left, right).collect()), key=key) == sorted(brute(captures, entries), key=key)
    assert filter_urls(left.limit(0), right).count() == 0
    assert filter_urls(left, right.limit(0)).where("verdict <> 'none' or not kept").count() == 0


def test_matches_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{folder}/pages.parquet'")
    want = con.execute(ORACLES["op6_url_filters"]).fetchall()
    got = [tuple(r) for r in QUERIES["op6_url_filters"](spark, folder).collect()]
    assert sorted(got, key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])
    assert {r[4] for r in got} == {"none", "allow", "block"}
