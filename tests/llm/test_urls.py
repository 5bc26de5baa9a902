"""The wildcard automaton against regular expressions, and the rules against a plain loop."""

import random
import re

from gradewell.llm import urls as U

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"))


def as_regex(glob):
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + "(?s:.*)", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        else:
            out, i = out + ("[^/]" if glob[i] == "?" else re.escape(glob[i])), i + 1
    return re.compile(out)


def test_automaton_matches_regular_expressions():
    rng = random.Random(3)
    globs = ["", "*", "**", "?", "a*b", "**a/b", "*.com/**", "a?c/*", "ab" * 50, "**ab**ba**", "/", "*/*"]
    globs += ["".join(rng.choice(["a", "b", "/", "*", "**", "?", ".com"]) for _ in range(rng.randint(0, 12))).replace("***", "**") for _ in range(60)]
    links = ["".join(rng.choice("ab/.") for _ in range(rng.randint(0, 14))) for _ in range(400)] + ["ab" * 50, "x.com/", "a" * 5000, ""]
    fits = U.WildcardAutomaton(globs).fits(links)
    for j, glob in enumerate(globs):
        rule = as_regex(glob)
        assert fits[:, j].tolist() == [bool(rule.fullmatch(x)) for x in links], glob


def plain(link):
    host, path = U.host_and_path(link)
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, "block" if "pills" in host + path else "allow")


LINKS = [None, "", "no scheme", "http://", "HTTPS://WWW.Example.COM/en/1?x#y", "http://example.com/en/2", "http://m.example.com/en", "http://xexample.com/en/",
         "http://example.com?x=/en/", "http://a.net/es/1", "http://net/es/", "http://a.org/pills/1", "x://b.com#/en/", "http://a.org/b.com/x", "http://com/", "http://é.com/É" * 3, "http://a.net/es/" + "x" * 100_000]


def test_rules(spark):
    table = spark.createDataFrame([(None if i == 3 else str(i % 7), x, "r", "v") for i, x in enumerate(LINKS)], "title string, link_or_doi string, rule string, host string")
    rows = U.judge_links(table, RULES).collect()
    assert [(r["rule"], r["verdict"]) for r in rows] == [plain(x) for x in LINKS]
    assert [(r["host"], r["path"]) for r in rows] == [U.host_and_path(x) for x in LINKS]
    assert U.judge_links(table.limit(0), RULES).count() == 0


def test_host_and_path():
    assert U.host_and_path("ftp://User@HÖST:80/A/b?c#d") == ("user@hÖst:80", "/A/b")
    assert U.host_and_path("http://a.b?q=http://c/d") == ("a.b", "")
    assert U.host_and_path("a/b") == ("", "")
