import re

import pytest

from terrashelf.llm import urlfilter
from tests.conftest import rows

URLS = [
    None, "", "no scheme", "http://", "http://org", "http://org/", "http://Example.ORG/en/1", "https://a.example.org/en/12?x",
    "https://a.example.org/en/2", "https://b.example.org/es/", "https://b.example.org/es", "http://notexample.org/es/",
    "http://x.com/fr/a#b", "http://x.com/FR/a", "http://x.com/de/", "http://x.com:80/de/", "http://com/de/q",
    "http://x.net/?u=http://y.org/", "x://y://z.org/a", "http://spam-farm.net/", "http://a.spam.net/", "http://aspam.net/",
    "http://spam.x.org/", "http://x.net/login", "http://x.net/login/2", "http://x.net/loginx", "http://x.net/\n/login",
    "http://x.com/de/" + "y" * 50000, "http://x.net/é?",
]


def expected(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in urlfilter.RULES:
        name, start = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            if best is None or len(rule) > len(best[1]):
                best = (verdict, rule)
    free = next((v for _, v, p, _ in urlfilter.PATTERNS if re.search(p, host + path)), None)
    return host, path, best and best[1], best[0] if best else free or "allow"


def judged(spark, urls, rules=None):
    df = spark.createDataFrame([(i, u, "kept", "clash") for i, u in enumerate(urls)], "page_id long, url string, z string, host string")
    found = urlfilter.judge(df, rules if rules is not None else urlfilter.rule_table(spark))
    return found.select("page_id", "host", "path", "rule", "verdict", "z")


def test_against_brute_force(spark):
    urls = URLS + URLS[:12]
    assert rows(judged(spark, urls)) == sorted(((i, *expected(u), "kept") for i, u in enumerate(urls)), key=repr)


def test_empty_table_and_no_rules(spark):
    assert judged(spark, URLS).where("false").count() == 0
    df = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.judge(df, urlfilter.rule_table(spark)).count() == 0
    none = urlfilter.rule_table(spark, [], [])
    assert {r.verdict for r in judged(spark, URLS, none).collect()} == {"allow"}


def test_rule_without_whole_token_and_quoted_signs(spark):
    rules = urlfilter.rule_table(spark, [("block", "x.net/é"), ("block", "ü.net/"), ("block", "a.net/\\E.*")], [])
    found = judged(spark, ["http://x.net/é?", "http://ü.net/", "http://a.net/\\E.*b", "http://a.net/\\Ezz"], rules)
    assert [r[4] for r in rows(found)] == ["block", "block", "block", "allow"]


@pytest.mark.parametrize("rule,tokens", [("org/", ["org"]), ("example.org/en/1", ["example", "org", "en"]), ("a.b/c/", ["a", "b", "c"])])
def test_tokens_are_closed_on_both_sides(rule, tokens):
    assert urlfilter._whole_tokens(rule) == tokens
