import re

import numpy as np
import pytest

from storyloom.llm import url_filter as U

SF = "/root/testdata/sf0.01"


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group().translate({i: i + 32 for i in range(65, 91)})
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
    best = None
    for verdict, h, p in U.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best


URLS = [
    None, "", "no url", "http://", "HTTP://WWW.A.Example.NET/EN/x", "http://example.net/en/1", "http://example.net/enx", "http://xexample.com/de/1", "http://a.example.com/de/", "http://org/fr/",
    "http://a.b.org/fr/x?y#z", "http://net", "http://net/", "http://x.net?q=/", "http://É.NET/p\nq#r", "a://b://c/d", "http://a.net:80/p", "http://u@b.net/", "http://casino-bonus.example/free-slots",
]


@pytest.fixture(scope="module")
def judged(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[4], None), (3, URLS[3], "x")], "page_id long, url string, rule string")
    return U.judge_urls(pages).collect()


def test_rules_and_parts(spark, judged):
    assert len(judged) == len(URLS) + 2
    for r in judged:
        if r.page_id is not None:
            host, path, best = plain(URLS[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, best and best[0])
            assert r.verdict == (best[1] if best else "block" if r.score >= U.THRESHOLD else "allow")
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    urls = {r.page_id: r.url for r in rows}
    got = U.judge_urls(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, best = plain(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[0]) and (not best or r.verdict == best[1])


def test_model_on_held_out_urls():
    rows = U.labelled_urls()
    right = []
    for fold in range(5):
        weights, bias = U.fit([r for i, r in enumerate(rows) if i % 5 != fold], steps=150)
        test = [r for i, r in enumerate(rows) if i % 5 == fold]
        scores = U._scores(weights, bias, *U.features([r[0] for r in test], [r[1] for r in test]))
        right += [(s >= U.THRESHOLD) == r[2] for s, r in zip(scores, test, strict=True)]
    assert np.mean(right) > 0.8


def test_empty(spark):
    assert U.judge_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []
    weights, bias = U.fit([])
    assert (U._scores(weights, bias, *U.features(["a"], [""])) < U.THRESHOLD).all()
    with pytest.raises(ValueError):
        U.fit([("a", "", True)] * (U.MAX_LABELLED + 1))


def test_very_long_paths(spark):
    """Long paths are slices of their own and score as any other."""
    urls = [f"https://h{i}.example.org/" + "segment%d/" % i * (30_000 if i % 3 == 0 else 2) + "?q" for i in range(12)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").coalesce(1)
    got = {r.page_id: r for r in U.judge_urls(pages).collect()}
    weights, bias = U.fit(U.labelled_urls())
    for i, url in enumerate(urls):
        host, path = url[8:-2].split("/", 1)
        want = U._scores(weights, bias, *U.features([host], ["/" + path]))[0]
        assert (got[i].host, got[i].path) == (host, "/" + path) and abs(got[i].score - want) < 1e-6
