"""Address filter: exactness of the cascade over its universe, rules, both ways of meeting the filters, odd rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import urls as U


def test_a_cascade_is_exact_over_its_universe():
    rng = np.random.default_rng(2)
    for n, share in ((1, 0.0), (1, 1.0), (2, 0.5), (500, 0.01), (5000, 0.3), (5000, 0.97)):
        one, two = (rng.integers(0, 2**63, n).astype(np.uint64) for _ in range(2))
        listed = rng.random(n) < share
        for hashes in (1, 4, 9):
            levels = U.build(one, two, listed, hashes)
            c = U.Cascade({3: ([m for m, _ in levels], [b.tobytes() for _, b in levels])}, hashes)
            assert (c.listed(np.full(n, 3), one, two) == listed).all()


def test_levels_are_small_beside_the_keys():
    rng = np.random.default_rng(0)
    one, two = (rng.integers(0, 2**63, 100_000).astype(np.uint64) for _ in range(2))
    listed = rng.random(100_000) < 0.01
    levels = U.build(one, two, listed, 6)
    # within a few bits a listed key, far below one bit for each key of the universe
    assert sum(m for m, _ in levels) < 15 * listed.sum() and len(levels) > 2


def test_equal_hashes_are_refused():
    same = np.array([5, 5], np.uint64)
    with pytest.raises(ValueError, match="equal hashes"):
        U.build(same, same, np.array([True, False]), 2)


@pytest.mark.parametrize("bound", [U.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("n", [0, 3000])
def test_members_of_many_shards(spark, bound, n):
    keys = spark.range(n).select(F.concat(F.lit("host"), "id").alias("host"), (F.col("id") % 7 == 0).alias("listed"))
    f = U.cascade(keys, shard_keys=100)
    assert f.shards == max(1, n // 100)
    # one host stands in most of the rows
    hot = keys.where("host = 'host14'").select(F.explode(F.sequence(F.lit(1), F.lit(2 * n + 1))), "host", "listed").select("host", "listed")
    rows = keys.unionByName(hot).withColumnRenamed("listed", "truth")
    found = U.member(rows, f, bound=bound)
    assert found.count() == rows.count()
    assert found.where("truth <> listed").count() == 0


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


URLS = [
    "http://a.example.com/de/1", "http://a.example.com/en/1", "http://b.example.com/fr/1", "http://b.example.com/en/2", "HTTP://WWW.EXAMPLE.ORG/es/7?x=1",
    "https://example.org/en/12#top", "https://example.org/en/2", "https://notexample.org/es/", "https://example.org?x=/es/", "https://Éx.COM/de/", "ftp://com/de/",
    "no scheme", "", None, "http://", "http:///de/", "http://x.net/a://b/c", "http://u:p@host.com:80/de/#://", "http://c.example.com/de/", "http://c.example.com/fr/", "http://c.example.com/",
    "http://long.com/" + "x" * 300_000 + "?q", "http://new\nline.com/de/", "http://a.example.com/en/1",
]


@pytest.mark.parametrize("bound", [U.BROADCAST_BYTES, 0])
def test_verdicts(spark, bound):
    pages = spark.createDataFrame([(i, u, "<p>", 1, "c", 2) for i, u in enumerate(URLS)], "page_id int, url string, html string, `x.y` int, host string, listed int")
    votes = {}
    for u in URLS:
        host, _, _, verdict = plain(u)
        votes[host] = votes.get(host, 0) + {"block": 1, "allow": -1, None: 0}[verdict]
    wanted = []
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain(u)
        wanted.append((i, host, path, rule, verdict or ("block" if votes[host] > 0 else "allow"), votes[host] > 0))
    assert sorted(tuple(r) for r in U.judge(pages, bound=bound, shard_keys=3).collect()) == wanted
    assert wanted[1][4] == "block" and wanted[3][4] == "allow" and wanted[20][4] == "allow"


def test_a_list_and_rules_of_ones_own(spark):
    pages = spark.createDataFrame([(None, "http://a.net/x"), (2, "http://b.net/x"), (2, "http://b.net/x")], "page_id int, url string")
    hosts = spark.createDataFrame([("a.net", True), ("b.net", None)], "host string, listed boolean")
    rows = U.judge(pages, hosts, rules=()).collect()
    assert sorted((r["page_id"] or 0, r["rule"], r["verdict"]) for r in rows) == [(0, None, "block"), (2, None, "allow"), (2, None, "allow")]
    equal = (U.Rule("allow", "net", "/xyz"), U.Rule("block", "a.net", "/x"))
    row = U.judge(spark.createDataFrame([(1, "http://a.net/xyz")], "page_id int, url string"), hosts, equal).first()
    assert (row["rule"], row["verdict"]) == ("a.net/x", "block")
    assert U.judge(pages.limit(0)).count() == 0
