import pytest

from tracewell.llm import url_filter

from .helpers import counted

URLS = [
    (1, "http://A.Example.NET/en/1?x"), (2, "https://example.net/de/2"), (3, "x://net/"), (4, "http://www.example.com/de/5#t"),
    (5, "http://example.com/en/5"), (6, "http://b.org/fr/9.html"), (7, None), (8, "no scheme/net/"), (9, "http://badexample.net"),
    (10, "http://notnet/"), (11, "http://h.com/a?u=://b.net/"), (12, ""), (12, ""), (None, "http://c.net/en/1"), (13, "http://É.Example.net/en/"),
    (14, "http://org/fr/" + "seg/" * 400), (15, "://"), (16, "http://example.com\n/de/1"),
]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = rest[:min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = []
    for rule, _ in url_filter.RULES:
        domain, _, start = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start):
            fits.append(rule)
    return host, path, max(fits, key=len, default=None)


def test_host_path_and_rule(spark):
    pages = spark.createDataFrame([(i, u, "h", "s") for i, u in URLS], "page_id long, url string, host string, shape string")
    got = url_filter.judge(pages)
    assert counted((r.page_id, r.host, r.path, r.rule) for r in got.collect()) == counted((i, *plain(u)) for i, u in URLS)
    verdicts = dict(url_filter.RULES)
    assert all(r.verdict == verdicts[r.rule] for r in got.collect() if r.rule)
    assert got.filter("verdict IS NULL OR verdict NOT IN ('allow', 'block')").count() == 0


def test_templates_generalise_merge_and_reject(spark):
    slug = lambda i: "slug-" + "".join("abcdefghij"[int(c)] for c in str(i))
    rows = [(f"http://shop.com/list/{slug(i)}/end", None) for i in range(60)]  # many children with one page each
    rows += [(f"http://news.com/{x}/{i}", None) for x in ("aa", "bb") for i in range(30)]  # two branches alike
    rows += [(f"http://odd.com/spam/{i}", "block") for i in range(40)] + [(f"http://odd.com/good/{i}", "allow") for i in range(40)]
    rows += [("http://odd.com/spam/extra", None)]
    rules = [("odd.com/spam/1", "block"), ("odd.com/spam/2", "block"), ("odd.com/spam/3", "block"), ("odd.com/good/", "allow")]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages, rules).collect()}
    by = {rows[i][0]: r for i, r in got.items()}
    assert by[f"http://shop.com/list/{slug(7)}/end"].template == "/list/*/end"
    assert by["http://news.com/aa/3"].template == by["http://news.com/bb/4"].template == "/~/#"
    spam = by["http://odd.com/spam/7"]  # no rule fits, but most labelled pages of the template are blocked
    assert spam.rule is None and spam.template == "/spam/~" and spam.verdict == "block" and spam.purity > 0.8
    assert by["http://odd.com/good/7"].verdict == "allow"


def test_blocked_pages_elsewhere_reject_nothing(spark):
    """With block rules alone, or nearly alone, the prior is above the threshold."""
    urls = ["http://bad.com/x"] * 60 + [f"http://good.com/a/{i}" for i in range(30)] + ["http://other.com/b", "http://mixed.com/ok", "http://mixed.com/no"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for rules in ([("bad.com/", "block")], [("bad.com/", "block"), ("mixed.com/ok", "allow")]):
        got = {urls[r.page_id]: r.verdict for r in url_filter.judge(pages, rules).collect()}
        assert {u for u, v in got.items() if v == "block"} == {"http://bad.com/x"}


def test_empty_and_limits(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    with pytest.raises(ValueError):
        url_filter.judge(spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string"), [(f"h{i}/", "block") for i in range(1001)])


def test_main_path_runs_no_python(spark):
    plan = url_filter.judge(spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string").select("*"))._jdf.queryExecution().toString()
    assert "EvalPython" not in plan and "MapInArrow" not in plan
