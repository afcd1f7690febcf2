import re

from ledgerflow.llm import url_filter
from ledgerflow.llm.url_filter import HostRule, Pattern

URLS = ["http://example.org/es/1", "http://EXAMPLE.org/en/12", "http://a.example.org/en/2", "http://org/", "http://org",
        "http://notexample.org/es/", "http://x.com/fr/a", "https://x.com/de/", "https://x.com/De/", "no scheme",
        None, "", "a://b://c.com/de/", "http://x.net/casino", "http://my-casino.net?x=casino", "http://casinos.net/",
        "http://x.org/casino", "http://x.net#/casino", "http://x.net/free/stuff/download", "http://x.com/fr",
        "http://x.com:80/fr/", "http://exa\nmple.org/es/", "http://click.x.net/a/tracker/"]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in url_filter.RULES
            if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    top = max(fits, key=lambda r: len(r.name), default=None)
    low = f"{host}/{path}".lower()
    words = re.split("[^a-z0-9]", low)
    bad = set(words) & {p.pattern.strip("^") for p in url_filter.PATTERNS}
    pairs = [("click", "tracker"), ("free", "download")]
    bad |= {a for a, b in pairs if a in words and b in words[words.index(a) + 1:]}
    return host, path, top.name if top else None, top.verdict if top else "block" if bad else "allow"


def test_matches_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0]), (None, URLS[1])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, host string, rule string")
    got = url_filter.url_filter(df).collect()
    want = sorted([(i, *brute(u)) for i, u in rows], key=repr)
    assert sorted([(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got], key=repr) == want


def test_rules_without_a_whole_token_are_still_tried(spark):
    df = spark.createDataFrame([(1, "http://x.net/banner12"), (2, "http://x.net/b")], "page_id long, url string")
    got = url_filter.url_filter(df, (), (Pattern("block", "banner"),)).orderBy("page_id").collect()
    assert [r.verdict for r in got] == ["block", "allow"]


def test_rarest_token_is_the_key(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.common.net/rare" if i == 0 else f"http://h{i}.common.net/")
                                for i in range(20)], "page_id long, url string")
    urls = df.select(url_filter.host_of(df.url).alias("host"), url_filter.path_of(df.url).alias("path"))
    assert url_filter.token_counts(urls, ["common", "rare", "none"], "host", "path") == {"common": 20, "rare": 1}
    got = url_filter.url_filter(df, (HostRule("block", "common.net", "/"),), ())
    assert got.filter("verdict = 'block'").count() == 20


def test_fifty_thousand_rules_in_waves(spark):
    rules = [HostRule("block" if i % 2 else "allow", f"host{i}.net", f"/p{i % 7}") for i in range(45_000)]
    rules += [HostRule("block", "net", "/"), HostRule("allow", "net", "/p1")]
    patterns = [Pattern("block", f"^word{i}^*^end^") for i in range(5_000)]
    urls = [f"http://a.host{i * 13}.net/p{i % 9}/x" for i in range(3000)]
    urls += [f"http://b{i}.org/word{i}/x/end" for i in range(0, 6000, 50)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    by_host = {(r.host, r.path): r.verdict for r in rules}

    def want(u):
        host, path = re.match("http://([^/]*)(.*)", u).groups()
        found = [(len(h + p), h + p, v) for h in (host, host.split(".", 1)[1], "net") for p in ("/", *(f"/p{k}" for k in range(7)))
                 if (v := by_host.get((h, p))) and path.startswith(p) and (host == h or host.endswith("." + h))]
        if found:
            return max(found)[1:]
        word = re.match(r"/word(\d+)/", path)
        return None, "block" if word and int(word[1]) < 5000 else "allow"

    one = url_filter.url_filter(df, rules, patterns).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in one] == [want(u) for u in urls]
    few = url_filter.url_filter(df, rules, patterns, wave_rules=20_000).orderBy("page_id").collect()
    assert few == one


def test_empty_table(spark):
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0
