"""Filter lists: rules on paths are indexed, too; lines that can't be read, conditions, empty tables."""

import random
import re

import pytest
from tracewright.llm import urlfilter

LINES = ["/ads/banner/*", "-advert.", "&adserver=", "/Pop-Up/x^", "||host.example/Track/me", "|https://a.example/Start/end|", "*promo*", "foo.gif|", "/a+b/", "@@/ads/banner/good^"]


def test_path_rules_are_filed_under_their_tokens(spark):
    rules = urlfilter.list_rules(LINES)
    index, always = urlfilter.build_index(rules, {})
    filed = {rules[i].name for found in index.values() for i in found}
    assert filed == set(LINES) - {"*promo*", "/a+b/"} and {rules[i].name for i in always} == {"*promo*", "/a+b/"}
    r = random.Random(2)
    parts = ["ads", "banner", "ADS", "Banner", "x-advert.js", "advert", "pop-up", "POP-UP", "x", "xy", "Track", "track", "me", "meet", "promo7", "foo.gif", "foo.gifs", "aab", "good", "start", "end"]
    hosts = ["host.example", "www.host.example", "a.example", "other.org"]
    urls = [f"https://{r.choice(hosts)}/" + "/".join(r.choices(parts, k=r.randint(0, 4))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x.page_id: x.verdict for x in urlfilter.judge(df, rules).collect()}
    every = tuple(urlfilter.Rule(x.name, x.action, x.regex, (), x.site) for x in rules)
    assert got == {x.page_id: x.verdict for x in urlfilter.judge(df, every).collect()}
    assert 50 < sum(v == "block" for v in got.values()) < 550
    assert urlfilter.judge(df.limit(0), rules).count() == 0 and urlfilter.judge(df, ()).where("verdict = 'allow'").count() == 600


def test_lines_that_cannot_be_read():
    with pytest.warns(UserWarning, match="left out"):
        rules = urlfilter.list_rules(["/[/", "||ok.example^", "/(/"])
    assert [r.name for r in rules] == ["||ok.example^"] and all(re.compile(r.regex) for r in rules)


def test_conditions():
    lines = ["||a.example^$third-party", "||b.example^$document", "||c.example^$domain=x.org|y.org,script", "||d.example^", "||e.example^$important,all"]
    assert [r.name[2] for r in urlfilter.list_rules(lines)] == list("abcde")
    assert [r.name[2] for r in urlfilter.list_rules(lines, conditional=False)] == list("bde")
