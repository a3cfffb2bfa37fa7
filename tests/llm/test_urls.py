from ridgeline.llm import urls
from ridgeline.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, html string, host int, rule int"


def brute(rows, rules, default="allow"):
    out = []
    for page, url, *_ in rows:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            n = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
            host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
            path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
        fits = []
        for rule, verdict in rules:
            h, p = rule.split("/", 1)
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fits.append((len(rule), rule, verdict))
        best = max(fits, default=(0, None, default))
        out.append((page, host, path, best[1], best[2]))
    return sorted(out, key=str)


def ours(spark, rows, rules):
    df = spark.createDataFrame([(*r, None, 1, 2) for r in rows], SCHEMA)
    return sorted(map(tuple, urls.judge(df, spark.createDataFrame(rules, "rule string, verdict string")).collect()), key=str)


ROWS = [
    (1, "http://Blog.Example.ORG/es/1?x=/de/"), (2, "https://a.com/de/"), (3, "https://a.com/DE/"), (4, None), (5, ""), (6, "no scheme.org/"), (7, "http://org"), (8, "http://org/"), (9, "x://example.org/en/12#top"), (9, "x://example.org/en/12#top"), (None, "http://b.com/fr/x://y.org/"),
    (10, "http://norg/"), (11, "http://a.b.c.d.org/x y"), (12, "://com/fr/"), (13, "http://com./fr/"), (14, "http://é.com/de/é"), (15, "http://a.com?/de/"), (16, "a://b://c.org/"), (17, "http://a.com/" + "de/" * 20000), (18, "http:///fr/"), (19, "line\nbreak://m.example.org/es/\nq#x"),
]


def test_rules(spark):
    assert ours(spark, ROWS, URL_RULES) == brute(ROWS, URL_RULES)


def test_many_rules_and_false_positives(spark, monkeypatch):
    monkeypatch.setattr(urls, "MOST_BLOCKS", 1)
    rules = [(f"h{i}.com/p{i}", "block" if i % 2 else "allow") for i in range(300)]
    rows = [(i, f"http://www.h{i % 400}.com/p{i % 350}/z") for i in range(900)]
    assert ours(spark, rows, rules) == brute(rows, rules)


def test_empty(spark):
    assert ours(spark, [], URL_RULES) == []
    assert ours(spark, ROWS, []) == brute(ROWS, [])
