import random

import pytest

from cairn.llm import url_filter
from cairn.llm.queries import URL_RULES

CASES = [
    ("http://example.com/en/x", "example.com", "/en/x", "example.com/en/", "block"),
    ("https://WWW.Example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://a.www.example.com/en/a?b#c", "a.www.example.com", "/en/a", "www.example.com/en/", "allow"),
    ("http://example.com/EN/x", "example.com", "/EN/x", "com/", "allow"),
    ("http://notexample.com/en/x", "notexample.com", "/en/x", "com/", "allow"),
    ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    ("http://x.net/es", "x.net", "/es", None, "allow"),
    ("http://example.com", "example.com", "", None, "allow"),
    ("http://example.com?a=/en/", "example.com", "", None, "allow"),
    ("http://example.com:80/en/", "example.com:80", "/en/", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("x://", "", "", None, "allow"),
    ("http://a\nb.com/en/", "a\nb.com", "/en/", "com/", "allow"),
]


@pytest.mark.parametrize("most", [url_filter.MAX_TRIE_RULES, 0])
def test_cases_by_trie_and_by_join(spark, most):
    rows = [(i, u, "old") for i, (u, *_) in enumerate(CASES)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    found = url_filter.filter_urls(df, URL_RULES, max_trie_rules=most).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == CASES[r["page_id"]][1:]


def test_both_ways_agree_with_all_rules_tried(spark):
    rng = random.Random(3)
    hosts, paths = ["com", "a.com", "b.a.com", "net", "a.net", "x"], ["", "/", "/a", "/a/", "/ab", "/a/b", "/a/b/c", "a", "//", "/a//b"]
    rules = [(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(paths)) for _ in range(25)]
    urls = [f"http://{rng.choice(['', 'w.', 'q.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/a', '/ab/c', '/a/b/c/d', '//', '/a//b/'])}" for _ in range(200)]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, __found int")
    for most in (100, 0):
        for r in url_filter.filter_urls(df, rules, max_trie_rules=most).collect():
            fits = [x for x in rules if (r["host"] == x[1] or r["host"].endswith("." + x[1])) and r["path"].startswith(x[2])]
            best = max(fits, key=lambda x: (len(x[1]) + len(x[2]), len(x[1]), x[0] == "block"), default=None)
            assert (r["rule"], r["verdict"]) == ((best[1] + best[2], best[0]) if best else (None, "allow"))


def test_longest_wins_and_block_breaks_ties(spark):
    rules = [("allow", "a.com", "/x"), ("block", "a.com", "/x"), ("allow", "com", "/xyz/long"), ("block", "a.com", "/xy")]
    trie = url_filter.HostTrie(rules)
    assert trie.match("a.com", "/x")[4] == "block"
    assert trie.match("b.a.com", "/xyz/longer")[3] == "com/xyz/long"
    assert trie.match("a.com", "/xya")[3] == "a.com/xy"
    assert trie.match("org", "/x") is None


def test_empty_table_and_missing_column(spark):
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0
    with pytest.raises(ValueError):
        url_filter.filter_urls(spark.createDataFrame([], "page_id long"), URL_RULES)
