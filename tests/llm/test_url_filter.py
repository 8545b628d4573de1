"""URL filter against a plain search over all rules, collisions included."""

import random

import sitelens.llm.url_filter as U
from sitelens.llm.url_filter import CONTRACT_RULES, DigestArray, digest_file, filter_urls, judge


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host):].split("?", 1)[0].split("#", 1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute(url, rules):
    host, path = parse(url)
    best = None
    for h, p, v in rules:
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            if best is None or len(h + p) > len(best[0]):
                best = (h + p, v)
    return host, path, best[0] if best else None, best[1] if best else "allow"


URLS = [None, "", "example.com/en/", "http://EXAMPLE.com/en/x?y#z", "http://www.example.com/en/", "https://m.example.com/en/a", "http://com", "http://com/",
        "http://xexample.com/en/", "http://a.net/es/1", "http://a.net/fr/1", "http://a.net/de/1", "x://y.net/es/://z", "http://?q", "http://#", "://net/es/",
        "http://example.com/EN/", "http://example.com./en/", "http://ÉXAMPLE.com/é", "http://net/es", "a://b://c.com/"]


def test_equals_a_search_over_all_rules(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, "http://x.com/", "h")], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, CONTRACT_RULES).collect()}
    want = {i: brute(u, CONTRACT_RULES) for i, u in enumerate(URLS)} | {None: ("x.com", "/", "com/", "allow")}
    assert got == want
    assert filter_urls(df.limit(0), CONTRACT_RULES).count() == 0
    assert {r.verdict for r in filter_urls(df, [], default="block").collect()} == {"block"}


def test_collisions_are_decided_by_the_stored_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(U.xxhash, "xxh64_intdigest", lambda s: len(s) % 3)
    rnd = random.Random(0)
    hosts = [f"{a}{b}.org" for a in "abcde" for b in ("", ".x", "yy")]
    rules = [(h, rnd.choice(["/", "/p/", "/pq"]), rnd.choice(["allow", "block"])) for h in hosts]
    path = tmp_path / "d.bin"
    path.write_bytes(digest_file(rules))
    array = DigestArray(str(path))
    urls = [(f"{rnd.choice(['', 'www.'])}{rnd.choice(hosts + ['zz.org'])}", rnd.choice(["/", "/p/", "/pq/r", "/pp"])) for _ in range(300)]
    rule, verdict = judge(array, [u[0] for u in urls], [u[1] for u in urls], "allow")
    assert [(r, v) for r, v in zip(rule, verdict)] == [brute(f"http://{h}{p}", rules)[2:] for h, p in urls]
