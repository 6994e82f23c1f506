import re

from tests.llm.odd import clashing
from turnstile.llm import common, url_filter

ODD = [None, "", "no scheme", "://", "http://", "HTTP://EXAMPLE.ORG/ES/", "http://example.org/es/1", "http://a.b.example.org/en/12?x=1", "http://example.org",
       "http://example.org?x://y.com/de/", "ftp://notexample.org/es/", "http://x.com/fr/#a/b", "http://x.com/de/1", "http://Ünï.COM/de/", "http://org/a", "a://b://c/d",
       "http://example.org/en/1", "http://example.org/en/2", "http://x.net/" + "a" * 50_000, "http://x.com/fr", "http://x.com\n/de/y"]


def host_and_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host) :]).group()


def ruled(url):
    host, path = host_and_path(url)
    fits = [(a, h + p) for a, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[1]), default=(None, None))


def test_hosts_paths_and_rules(spark):
    pages = common.prepare(spark).createDataFrame([*enumerate(ODD), (6, ODD[6])], "page_id long, url string")
    got = url_filter.judge(clashing(pages, "host", "label", "path", "_u", "depth")).collect()
    assert len(got) == len(ODD) + 1
    for r in got:
        verdict, rule = ruled(ODD[r.page_id])
        assert (r.host, r.path, r.rule) == (*host_and_path(ODD[r.page_id]), rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_trees_learn_from_labelled_urls(spark):
    rows = []
    for i in range(400):
        bad = i % 2
        url = f"http://x{i % 7}-win-casino-{i}{i}{i}.net/?a={i}&b=2&c=3" if bad else f"https://news{i % 7}.net/story/{'abcdefgh'[i % 8]}"
        rows.append((i, url, bad if i % 3 else None))
    pages = common.prepare(spark).createDataFrame(rows, "page_id long, url string, bad int")
    got = url_filter.judge(pages, rules=[], label_col="bad").collect()
    unseen = [r for r in got if r.page_id % 3 == 0]
    assert sum((r.verdict == "block") == bool(r.page_id % 2) for r in unseen) >= 0.95 * len(unseen)


def test_one_class_or_none(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", 1), (2, "http://b.net/y", None)], "page_id long, url string, bad int")
    assert {r.verdict for r in url_filter.judge(pages, label_col="bad").collect()} == {"block"}
    assert {r.verdict for r in url_filter.judge(pages).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), label_col="bad").count() == 0


def test_features(spark):
    pages = spark.createDataFrame([(1, "http://a-b.example.net/x/y1?p=1&q=2#f"), (2, None)], "page_id long, url string")
    one, none = url_filter.features(url_filter.with_rules(pages).selectExpr("*", "cast(null AS int) AS label")).orderBy("page_id").collect()
    assert (one.depth, one.labels, one.n_params, one.fragment, one.hyphens, one.https, one.suffix_share) == (2, 3, 2, 1, 1, 0, 0.5)
    assert (none.url_length, none.entropy, none.digit_ratio, none.depth) == (0, 0, 0, 0)


def test_no_python_runs(spark, sf_dir):
    from turnstile.llm.queries import QUERIES

    plan = QUERIES["op6_url_filter"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
