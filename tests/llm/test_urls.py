from __future__ import annotations

import itertools
import math
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from flatspan.llm import urls
from tests.llm.helpers import frame


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def brute(url: str | None) -> tuple[str, str, str | None, str | None]:
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    k = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:k].translate({c: c + 32 for c in range(65, 91)}), rest[k:]
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = []
    for said, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, said))
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


ODD = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/7x?q#f", "a://b://example.com/en/", "http://example.com?x=/en/", "http://notexample.com/en/1", "http://x.net/de/1", "http://example.net/de/81", "http://a.example.net/de/8", "http://example.com/en/71", "http://example.com/en", "ftp://org/es/", "x\n://é.COM/en/ü\n?"]


def test_rules_match_brute_force(spark, sf):
    given = [r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rows = [(i, u, "<p>some words here</p>") for i, u in enumerate(ODD + given)]
    got = {r.page_id: r for r in urls.judge(pages(spark, rows)).collect()}
    for i, u, _ in rows:
        host, path, rule, said = brute(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == said if said else got[i].verdict in ("allow", "block")


def test_viterbi_is_the_best_split():
    words = {"the": -1.0, "rein": -3.0, "there": -2.0, "in": -1.5, "no": -2.0, "where": -2.5, "nowhere": -4.6, "w": -5.0}
    cost = lambda p: words.get(p, 1 - math.log10(1000) - 1.5 * len(p))
    for name in ("therein", "nowherein", "inthexnow", "thereinnowhere"):
        splits = []
        for cuts in itertools.product((0, 1), repeat=len(name) - 1):
            parts, last = [], 0
            for k, c in enumerate(cuts, 1):
                if c:
                    parts.append(name[last:k])
                    last = k
            splits.append([*parts, name[last:]])
        best = max(sum(map(cost, s)) for s in splits)
        got = urls.segment(name, words, 1000)
        assert "".join(got) == name and math.isclose(sum(map(cost, got)), best)


def test_bayes_matches_formula(spark):
    counts = spark.createDataFrame([("a", 3, 1), ("b", 0, 4)], "token string, block long, allow long")
    weights, bias = urls.bayes(counts, {"block": 2, "allow": 3})
    w = {r.token: r.weight for r in weights.collect()}
    assert math.isclose(bias + w["a"] + w["b"], math.log(3 / 4) + math.log((4 / 6) / (2 / 8)) + math.log((1 / 6) / (5 / 8)))


def test_hosts_are_split_and_learned(spark):
    """Hosts glued from words: those that share words with blocked hosts are blocked."""
    text = "casino poker garden flower bonus tulip " * 20
    rows = [(i, f"http://{'casinopoker' if i % 2 else 'gardenflower'}{i % 7}.{'com/en' if i % 2 else 'net/de'}/{i}", text) for i in range(80)]
    rows += [(100, "http://bonuscasino.info/x", text), (101, "http://tulipgarden.info/x", text)]
    got = {r.page_id: r for r in urls.judge(pages(spark, rows)).collect()}
    assert got[100].verdict == "block" and got[101].verdict == "allow"
    words = urls.lexicon(pages(spark, rows).select("html"))
    assert words.agg(F.sum("n")).first()[0] == 82 * 120
    names = spark.createDataFrame([("bonuscasino",), ("x",), ("gardenqq",)], "name string")
    assert {r.name: r.tokens for r in urls.segmented(names, words).collect()} == {"bonuscasino": ["bonus", "casino"], "x": ["x"], "gardenqq": ["garden", "qq"]}


def brute_judge(rows) -> dict[int, float]:
    """Odds by the same formulas over dictionaries."""
    words = Counter(w for _, _, h in rows for w in re.split(r"[^a-z]+", re.sub(r"<[^>]*>", " ", h).lower()) if w)
    total = sum(words.values())
    logs = {w: math.log10(n / total) for w, n in words.items()}
    number = lambda w: "0" if w.isdigit() else w

    def tokens(u):
        host, path, _, said = brute(u)
        names = [number(x) for x in re.split(r"[^a-z0-9]+", host) if x]
        return [f"h:{w}" for x in names for w in urls.segment(x, logs, total)] + [f"p:{number(w)}" for w in re.split(r"[^a-z0-9]+", path.lower()) if w], said

    by = {"block": Counter(), "allow": Counter()}
    n = Counter()
    for _, u, _ in rows:
        own, said = tokens(u)
        if said:
            by[said].update(own)
            n[said] += 1
    kinds = {*by["block"], *by["allow"]}
    size = {v: sum(c.values()) + len(kinds) + 1 for v, c in by.items()}
    weight = {t: math.log((by["block"][t] + 1) / size["block"]) - math.log((by["allow"][t] + 1) / size["allow"]) for t in kinds}
    bias = math.log((n["block"] + 1) / (n["allow"] + 1))
    return {i: bias + sum(weight.get(t, 0.0) for t in tokens(u)[0]) for i, u, _ in rows}


def test_whole_query_matches_brute_force(spark):
    """Hosts glued from words, repeated hosts and paths, numbers; learned and judged."""
    words = ["sun", "sunny", "day", "night", "casino", "win", "garden", "ny"]
    rows = []
    for i in range(300):
        glued = words[i % 8] + words[(i * 3 + 1) % 8] + ("x7" if i % 11 == 0 else "")
        rows.append((i, f"http://{glued}.{['com', 'net', 'info', 'example.com'][i % 4]}/{['en', 'de', 'q'][i % 3]}/{'Sun-day_' * (i % 2)}{i % 50}?x", f"<p>{' '.join(words[: i % 9])} other text"))
    got = {r.page_id: r for r in urls.judge(pages(spark, rows)).collect()}
    for i, odds in brute_judge(rows).items():
        assert math.isclose(got[i].odds, odds, abs_tol=1e-8)
        assert got[i].rule is not None or got[i].verdict == ("block" if got[i].odds > 0 else "allow")


def test_urls_of_any_length(spark):
    """Labels that span many runs split as the whole name does; a label of 100,000 letters is no matter of minutes."""
    text = "casino poker garden flower bonus tulip " * 5
    words = urls.lexicon(pages(spark, [(0, None, text)]).select("html"))
    logs = {w: math.log10(1 / 6) for w in text.split()}
    names = ["casinogarden" * n + "q" * (n % 3) for n in (1, 5, 6, 11, 40)] + ["x" * 62, "x" * 63 + "tulip", "tulip" + "é" * 130 + "bonus"]
    got = {r.name: r.tokens for r in urls.segmented(spark.createDataFrame([(n,) for n in names], "name string"), words).collect()}
    assert got == {n: urls.segment(n, logs, 30) for n in names}
    long = "bonustulip" * 10_000
    rows = [(i, f"http://{'casinopoker' if i % 2 else 'gardenflower'}{i}.{'com/en' if i % 2 else 'net/de'}/{i}", text) for i in range(20)]
    rows += [(100, f"http://{long}.com/en/{long}/{'a/' * 50_000}", text), (101, f"http://{long}.info/{long}?", text)]
    began = time.time()
    got = {r.page_id: r for r in urls.judge(pages(spark, rows)).collect()}
    assert time.time() - began < 60
    assert len(got) == 22 and got[100].verdict == "block" and got[101].host == long + ".info"
    odds = brute_judge(rows)
    assert all(math.isclose(got[i].odds, o, rel_tol=1e-9, abs_tol=1e-6) for i, o in odds.items())


def test_held_out_accuracy(spark):
    """Urls that a rule decides, judged by a classifier that has not learned from them."""
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    learned = F.crc32(F.col("page_id").cast("string").cast("binary")) % 5 != 0
    got = urls.judge(df, teaches=learned).where("rule is not null").join(df.select("page_id", learned.alias("learned")), "page_id").where("not learned").collect()
    assert len(got) > 20
    right = sum((r.odds > 0) == (r.verdict == "block") for r in got)
    # rules that go by the first digit of a number are beyond tokens: about one url in ten
    assert right >= 0.85 * len(got), (right, len(got))


def test_ids_stay_exact_beside_nulls(spark):
    got = frame(urls.judge(pages(spark, [(None, "http://a.com/en/1", "x"), (2**53 + 1, "http://a.net/de/1", "y")]).coalesce(1)))
    assert 2**53 + 1 in set(got.page_id) and got.page_id.isna().sum() == 1


def test_odd_and_empty(spark):
    rows = [(1, "http://example.com/en/1", None), (1, "http://example.com/en/1", None), (None, "http://x.net/q", ""), (2**53 + 1, None, "<b>")]
    df = pages(spark, rows).select("*", F.lit(1).alias("host"), F.lit(2).alias("said"), F.lit(3).alias("token"))
    got = frame(urls.judge(df))
    assert len(got) == 4 and 2**53 + 1 in set(got.page_id) and set(got[got.page_id == 1].verdict) == {"block"}
    assert urls.judge(pages(spark, [])).count() == 0
    assert frame(urls.judge(pages(spark, [(1, "http://x.y/z", "a")]))).verdict.iloc[0] == "allow"
