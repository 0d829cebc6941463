import datetime as dt
import random

from tessel.llm import urlfilter

EVENTS = "list string, policy string, kind string, value string, action string, day date"
CAPTURES = "page_id long, url string, fetch_day date, verdict string"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def brute(captures, events):
    """Every capture against every entry's state on its day."""
    out = []
    entries = {(e[0], e[2], (e[3] or "").lower()) for e in events if e[0] and e[3] and e[2] in ("host", "domain", "prefix")}
    for page, url, when, _ in captures:
        hits = []
        if url and when and "://" in url:
            rest = url.split("://", 1)[1]
            host = rest.split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0].lower().rstrip(".")
            path = rest.split("?")[0].split("#")[0]
            seg = [s.lower() for s in path.split("/")[1:] if s]
            for lst, kind, value in entries:
                fits = host and (kind == "host" and value == host or kind == "domain" and (host == value or host.endswith("." + value))
                                 or kind == "prefix" and any(value == "/".join([host, *seg[:k]]) for k in range(1, len(seg) + 1)))
                if not fits:
                    continue
                own = [e for e in events if e[0] == lst and e[2] == kind and (e[3] or "").lower() == value and e[5] is not None and e[4] in ("add", "remove")]
                past = [e for e in own if e[5] <= when]
                if past:
                    last = max(e[5] for e in past)
                    now = [e for e in past if e[5] == last]
                    if any(e[4] == "add" for e in now):
                        hits.append((f"{lst}:{kind}:{value}", max(e[1] for e in now), last))
        blocked = any(h[1] == "block" for h in hits) and not any(h[1] == "allow" for h in hits)
        out.append((page, url, when, blocked, len(hits), min((h[0] for h in hits), default=None), min((h[2] for h in hits), default=None)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    r = random.Random(4)
    hosts = ["a.example.com", "b.example.com", "x.a.example.com", "other.org", "EXAMPLE.com"]
    events = [(r.choice(["l1", "l2", "ok"]), None, r.choice(["host", "domain"]), r.choice([*hosts, "example.com", "com"]), r.choice(["add", "remove"]), day(r.randrange(400))) for _ in range(120)]
    events += [("pre", None, "prefix", r.choice(hosts) + r.choice(["/p", "/p/q", "/P"]), r.choice(["add", "remove"]), day(r.randrange(400))) for _ in range(40)]
    events = [(a, "allow" if a == "ok" else "block", *e) for a, _, *e in events]
    events += [(None, "block", "host", "other.org", "add", day(1)), ("l1", "block", "host", None, "add", day(1)), ("l1", "block", "host", "other.org", "add", None),
               ("l1", "block", "host", "other.org", "drop", day(1)), events[0], events[0]]
    captures = [(i, f"https://{r.choice(['', 'u:p@'])}{r.choice(hosts)}{r.choice(['', ':80', '.'])}{r.choice(['', '/', '/p', '/p/q/z?x#y', '//p'])}", day(r.randrange(420)), "v") for i in range(300)]
    captures += [(900, None, day(3), "v"), (901, "nonsense", day(3), "v"), (902, "https://other.org/", None, None), captures[0], captures[0], (903, "https://other.org/" + "s/" * 3000, day(200), None)]
    got = urlfilter.judge(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(events, EVENTS))
    assert got.columns == ["page_id", "url", "fetch_day", "verdict", "verdict_"]
    rows = sorted(((r["page_id"], r["url"], r["fetch_day"], *r["verdict_"]) for r in got.collect()), key=str)
    assert rows == brute(captures, events)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], CAPTURES), spark.createDataFrame([(1, "https://a.b/", day(1), None)], CAPTURES)
    events = spark.createDataFrame([("l", "block", "host", "a.b", "add", day(0))], EVENTS)
    assert urlfilter.judge(none, events).count() == 0
    assert [r["verdict_"]["blocked"] for r in urlfilter.judge(some, events.limit(0)).collect()] == [False]
    assert [r["verdict_"]["blocked"] for r in urlfilter.judge(some, events).collect()] == [True]


def test_list_values_follow_the_rules_of_captures(spark):
    url = "https://u@example.com.:80/ads//x?y"
    forms = [("prefix", v, True) for v in ("example.com/ads/", "Example.com//ads", "example.com", "example.com/", "example.com.:443/ads/x/", "https://example.com/ads")]
    forms += [("host", v, True) for v in ("example.com.", "EXAMPLE.com:80", "example.com/")] + [("domain", v, True) for v in ("com.", "example.com.")]
    forms += [("prefix", v, False) for v in ("example.com/ad", "xample.com", "/ads", "", "example.com/ads/x/y/")] + [("host", "example.com/ads", False), ("domain", ".", False)]
    captures = spark.createDataFrame([(1, url, day(5), None), (2, "https://example.org/ads", day(5), None)], CAPTURES)
    events = spark.createDataFrame([(f"l{i}", "block", kind, v, "add", day(0)) for i, (kind, v, _) in enumerate(forms)], EVENTS)
    got = {r["page_id"]: r["verdict_"] for r in urlfilter.judge(captures, events).collect()}
    assert got[1]["matches"] == sum(fits for *_, fits in forms) and got[1]["blocked"] and got[2]["matches"] == 0
    assert got[1]["rule"] == "l0:prefix:example.com/ads"
