"""URL filter: host and path rules, else logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

#: (verdict, host, path): a rule holds for the host and its subdomains if the path starts with the rule's.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
BUCKETS = 1 << 14
ORDERS = (2, 3, 4)
#: Labelled URLs that a fit may have; it runs on the driver.
MAX_LABELLED = 100_000
THRESHOLD = 0.5

#: The small labelled table: URLs to block and URLs to allow, of invented sites.
BLOCKED = """
http://casino-bonus.example/win-big http://best-casino.example/slots/free-spins http://pokerstars-free.example/bonus http://bet365-odds.example/betting/live
http://cheap-pills.example/viagra-online http://buy-viagra.example/order http://pharmacy-discount.example/cialis/buy http://replica-watches.example/rolex-cheap
http://xxx-videos.example/free-porn http://hot-porn.example/sex/videos http://adult-cams.example/live-sex http://sexy-girls.example/nude/gallery
http://free-crack.example/keygen/download.exe http://warez-full.example/serial-crack http://torrent-movies.example/download/free-full http://cracked-apps.example/patch
http://ads.tracker.example/click?id=1 http://adserver.example/banner/click http://click-track.example/redirect/affiliate http://doubleclick-ads.example/popunder
http://get-rich-quick.example/make-money-fast http://crypto-doubler.example/invest/bonus http://payday-loans.example/apply-now/cash http://work-home-cash.example/earn-money
http://win-iphone.example/prize/claim http://lottery-winner.example/claim-prize http://survey-reward.example/gift-card/free http://you-won.example/spin-wheel
http://phish-login.example/verify-account/password http://secure-paypa1.example/login/verify http://bank-update.example/confirm-password http://account-suspended.example/signin/verify
http://seo-backlinks.example/buy-links http://link-farm.example/buy-backlinks http://spam-blog.example/cheap-seo http://article-spinner.example/auto-content
http://slots-jackpot.example/casino/play http://sportsbook.example/bet/odds http://escort-city.example/adult/girls http://dating-hookup.example/sex-tonight
""".split()
ALLOWED = """
https://news.example/politics/article/2024/election https://www.newspaper.example/world/story https://daily.example/science/climate-report https://local-news.example/city/council
https://en.encyclopedia.example/wiki/History https://wiki.example/wiki/Mathematics https://dictionary.example/word/meaning https://museum.example/collection/paintings
https://university.example/department/physics/research https://school.example/library/catalogue https://college.example/courses/biology https://lab.example/papers/abstract.html
https://docs.software.example/guide/install https://developer.example/reference/api https://code.example/project/readme.html https://manual.example/en/chapter/3
https://blog.example/en/travel-notes https://garden.example/plants/roses https://cooking.example/recipes/bread https://health.example/advice/sleep
https://city.gov.example/services/permits https://ministry.example/de/presse https://parliament.example/fr/lois https://court.example/decisions/2023
https://books.example/review/novel https://music.example/concert/programme https://film.example/festival/schedule https://theatre.example/season/plays
https://weather.example/forecast/week https://maps.example/place/station https://train.example/timetable https://forum.example/thread/12345
https://company.example/about/team https://shop.example/books/history https://bank.example/branches/opening-hours https://store.example/products/chairs
https://m.site.example.com/en/25 https://blog.site.example.com/fr/160.html http://www.site.example.org/es/300 https://site.example.org/de/411
""".split()


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path: after the first ``://`` up to ``/ ? #``, then up to ``? #``; both empty without one."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def match_rule(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null if none fits."""
    rules = RULES if rules is None else rules
    rule = verdict = F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule, verdict = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, one URL after the other, and the n + 1 offsets; host and path have their own."""
    offsets, found = [0], []
    for host, path in zip(hosts, paths, strict=True):
        for kind, text in (("h", f"^{host}$"), ("p", f"^{path.lower()}$")):
            raw = text.encode("utf-8", "surrogatepass")
            for n in ORDERS:
                found += [zlib.crc32(raw[i : i + n], ord(kind)) % BUCKETS for i in range(len(raw) - n + 1)]
        offsets.append(len(found))
    return np.array(found, np.int64), np.array(offsets, np.int64)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _scores(weights: np.ndarray, bias: float, buckets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.maximum(np.diff(offsets), 1))
    return 1 / (1 + np.exp(-np.clip(_sums(weights[buckets], offsets) / size + bias, -30, 30)))


def fit(urls: list[tuple[str, str, bool]], steps: int = 400, rate: float = 1.0, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression by gradient descent on (host, path, block) rows; always the same weights for the same rows.

    A row's features are scaled by the root of their number. Without rows the weights are zero and every URL
    has probability one half of being blocked, less an ulp, so that it is allowed.
    """
    if len(urls) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled URLs")
    weights, bias = np.zeros(BUCKETS), -1e-12
    if not urls:
        return weights, bias
    buckets, offsets = features([u[0] for u in urls], [u[1] for u in urls])
    target = np.array([u[2] for u in urls], float)
    lens = np.diff(offsets)
    for _ in range(steps):
        error = _scores(weights, bias, buckets, offsets) - target
        share = np.repeat(error / np.sqrt(np.maximum(lens, 1)), lens)
        weights -= rate * (np.bincount(buckets, share, BUCKETS) / len(urls) * 10 + penalty * weights)
        bias -= rate * error.mean()
    return weights, bias


def labelled_urls() -> list[tuple[str, str, bool]]:
    rows = []
    for block, urls in ((True, BLOCKED), (False, ALLOWED)):
        for url in urls:
            host, slash, path = url.split("://", 1)[1].partition("/")
            rows.append((host.lower(), (slash + path).split("?")[0].split("#")[0], block))
    return rows


def judge_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", labelled=None, rules=None) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (probability of block by the model) of every row.

    ``labelled``: (host, path, block) rows to learn from, the small table of this module by default. A rule's
    verdict goes before the model's. A null URL or one without ``://`` has an empty host and path, fits no rule
    and is judged by the model like any other. Repeated rows give repeated results; other columns are not read.
    """
    host, path = split_url(F.col(url))
    # Slices are measured by host and path together.
    parts = pages.select(F.col(page_id), host.alias("host"), path.alias("path"), F.concat(host, path).alias("__whole"))
    sent = pages.sparkSession.sparkContext.broadcast(fit(labelled_urls() if labelled is None else labelled))

    def worker():
        weights, bias = sent.value

        def run(_, rows):
            return [pa.array(_scores(weights, bias, *features(rows.column("host").to_pylist(), rows.column("path").to_pylist())))]

        return run

    scored = map_texts(parts, [page_id, "host", "path"], "__whole", [("score", T.DoubleType())], worker, limit=200_000)
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow")
    return scored.select(page_id, "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")
