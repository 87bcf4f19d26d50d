"""URL filters: host and path rules first, then logistic regression on hashed character n-grams of host and path.

The model learns from a small labelled table of URLs (below; any table of (url, blocked) rows will do). Its features are
the 3- to 5-grams of "^host$" and of the path, hashed apart; host n-grams stop at the labels, so that a registered
suffix common to all hosts weighs little.

Defined cases: a null url, or one without "://", has an empty host and an empty path, no rule fits it, and the model's
verdict on no features is its intercept. Repeated rows get equal verdicts. Extra columns are ignored.
Scale: narrow, no shuffle; the model, 2**15 doubles, is broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of op9's contract: (rule, verdict). The part before the first "/" is the host.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
SIZE = 1 << 15

#: The labelled table: words that unwanted and wanted hosts and paths are made of, none of them a host of the test tables. labelled_urls()
#: makes the URLs of it, and tests fold by host.
BLOCKED = "bestcasino onlinecasino casinoroyal betnow sportsbets livebets bettips poker-room pokerstar slotswin megaslots jackpotspin luckyspin freespins bonusspins xxxvideo xxxcams adultcams adultdating hotsingles singlesnear porntube pornlinks pharmadeals cheappharma viagrashop cheapviagra weightlosspills dietpills linkfarm buylinks spamlinks spammail seospam seolinks clickfarm clickbaits freemoney quickmoney winprize prizedraw cryptodoubler doublebitcoin paydayloans quickloans replicawatches fakewatches warezcrack crackkeys keygens torrentfree malwaredrop phishlogin loginverify".split()
WANTED = "news dailynews citynews library citylibrary university stateuniversity museum artmuseum weather weatherdata research researchnotes dailypost morningpost sciencejournal lawjournal citycouncil healthinfo publichealth opendata traveldata travelnotes kitchen kitchenrecipes garden gardennotes history localhistory physics mathforum codereview codenotes bookclub bookreview filmarchive webarchive musicschool artschool radio publicradio sportsreport weatherreport localtimes encyclopedia dictionary maps railway railmaps parliament court hospital school reader writer planet ocean forest river mountain valley".split()
BAD_PATHS = "/win/bonus-{} /buy-cheap-{} /free-spins?ref={} /xxx/video{} /click/earn-money/{} /promo/jackpot{} /order/no-prescription/{}".split()
GOOD_PATHS = "/ /about /articles/{} /news/story-{} /index.php?id={} /archive/{}/view /docs/guide{}.html /research/paper/{}".split()


def labelled_urls() -> list[tuple[str, int]]:
    """A few hundred labelled URLs: each host with prefixes and endings in turn, the same for both labels; every other unwanted URL has a plain path."""
    fronts, ends = ("", "www.", "web.", "my."), ("com", "org", "net", "info", "eu")
    out = []
    for y, hosts in ((1, BLOCKED), (0, WANTED)):
        for i, host in enumerate(hosts):
            for k in range(4):
                paths = BAD_PATHS if y and k % 2 else GOOD_PATHS
                out.append((f"https://{fronts[(i + k) % 4]}{host}.{ends[(i + k) % 5]}{paths[(i + 3 * k) % len(paths)].format((i * 37 + k * 101) % 1000)}", y))
    return out


def parts(url: str | None) -> tuple[str, str]:
    """Host and path as the contract cuts them."""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    cut = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:cut]


def features(host: str, path: str) -> list[int]:
    out = set()
    for label in host.split("."):
        s = f"^{label}$"
        out |= {zlib.crc32(f"h{s[i : i + n]}".encode()) % SIZE for n in (3, 4, 5) for i in range(len(s) - n + 1)}
    out |= {zlib.crc32(f"p{path[i : i + n]}".encode()) % SIZE for n in (3, 4, 5) for i in range(len(path) - n + 1)}
    return sorted(out)


def train(rows: list[tuple[str, int]], rounds: int = 30, rate: float = 0.5, decay: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and intercept by stochastic gradient descent; the two labels weigh the same in all."""
    data = [(np.array(features(*parts(u)), dtype=np.int64), y) for u, y in rows]
    positive = sum(y for _, y in data) or 1
    weigh = {1: len(data) / (2 * positive), 0: len(data) / (2 * max(1, len(data) - positive))}
    w, b, rng = np.zeros(SIZE), 0.0, np.random.default_rng(seed)
    for r in range(rounds):
        for i in rng.permutation(len(data)):
            x, y = data[i]
            scale = 1 / np.sqrt(max(1, len(x)))
            g = (1 / (1 + np.exp(-(w[x].sum() * scale + b))) - y) * weigh[y] * rate / (1 + r / 10)
            w[x] -= g * scale + decay * w[x]
            b -= 0.1 * g
    return w, b


def host_path(url: Column) -> tuple[Column, Column]:
    """The same cut as parts(), in SQL functions."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    empty = F.coalesce(url, F.lit("")).contains("://")
    fold = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # path begins at "/": after a bare host come only "?" or "#", and the pattern then takes nothing
    return F.when(empty, fold).otherwise(""), F.when(empty, path).otherwise("")


def judge(pages: DataFrame, rules=RULES, labelled: list[tuple[str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the model's probability that the url is unwanted)."""
    sent = pages.sparkSession.sparkContext.broadcast(train(labelled_urls() if labelled is None else labelled))
    host, path = host_path(F.col("url"))
    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    fit = None
    verdict = None
    for rule, said in sorted(rules, key=lambda r: (-len(r[0]), r[0])):  # the longest first
        name, front = rule[: rule.index("/")], rule[rule.index("/") :]
        here = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(front)
        fit = F.when(here, F.lit(rule)) if fit is None else fit.when(here, F.lit(rule))
        verdict = F.when(here, F.lit(said)) if verdict is None else verdict.when(here, F.lit(said))

    @F.pandas_udf("double")
    def score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        (w, b), out = sent.value, []
        for h, p in zip(hosts, paths, strict=True):
            x = features(h, p)
            out.append(1 / (1 + np.exp(-(w[x].sum() / np.sqrt(max(1, len(x))) + b))))
        return pd.Series(out, dtype="float64")

    none = F.lit(None).cast("string")
    return (
        rows.withColumn("rule", none if fit is None else fit)
        .withColumn("said", none if verdict is None else verdict)
        .withColumn("score", score("host", "path"))
        .select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
    )
