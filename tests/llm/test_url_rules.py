import random
from itertools import combinations

import pytest
from conftest import rows_of

from strandline.llm import url_rules


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]


def fixed(host, path):
    fits = [r for r in url_rules.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len) if fits else None


def pages_of(spark, urls):
    return spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id bigint, url string, html string, tokens int").repartition(3)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, toxic int")


URLS = [
    None, "", "no scheme", "http://", "http://net", "http://NET/", "https://a.Net/x?y#z", "http://example.net/en/1", "http://m.example.net/en/1", "http://xexample.net/en/1",
    "http://example.com/de/", "http://example.com/de", "http://b.org/fr/2?a=1&b=2&a=3", "x://example.org?q", "http://É.com/É", "http://a.net:80/", "http://u://v/w", "http://h#f/p",
]


def test_parts_and_fixed_rules(spark):
    got = {r.page_id: r for r in url_rules.judged(pages_of(spark, URLS), labels_of(spark, [])).collect()}
    for i, url in enumerate(URLS):
        host, path = split(url)
        rule = fixed(host, path)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, url_rules.RULES.get(rule, "allow"))


@pytest.mark.parametrize("seed", [1, 2])
def test_mined_rules_equal_counting(spark, seed):
    rng = random.Random(seed)
    urls = [f"http://{rng.choice('abc')}.{rng.choice('xy')}.edu/{rng.choice(['p', 'q', 'r'])}/{i}" for i in range(300)]
    labels = [(i, int(("a.x" in u and "/p/" in u) or ("/q/" in u and rng.random() < 0.5))) for i, u in enumerate(urls) if rng.random() < 0.8] + [(5, None), (None, 1)]
    support, confidence = 0.02, 0.7
    got = {r.page_id: r.verdict for r in url_rules.judged(pages_of(spark, urls), labels_of(spark, labels), support=support, confidence=confidence).collect()}
    sets = {}
    for i, u in enumerate(urls):
        host, path = split(u)
        sets[i] = frozenset(["h:" + p for p in host.split(".")] + ["p:#" if p.isdigit() else "p:" + p for p in path.split("/") if p])
    marked = [(sets[i], t) for i, t in labels if i is not None and t is not None]
    rules = []
    for tokens in {frozenset(c) for s, _ in marked for n in range(1, len(s) + 1) for c in combinations(sorted(s), n)}:
        found = [t for s, t in marked if tokens <= s]
        if sum(found) >= support * len(marked) and sum(found) >= confidence * len(found):
            rules.append(tokens)
    assert rules and any(v == "block" for v in got.values())
    assert got == {i: "block" if any(r <= s for r in rules) else "allow" for i, s in sets.items()}


def test_empty_tables(spark):
    assert rows_of(url_rules.judged(pages_of(spark, []), labels_of(spark, []))) == []
    assert len(rows_of(url_rules.judged(pages_of(spark, URLS + URLS), labels_of(spark, [(1, 1)])))) == 2 * len(URLS)
