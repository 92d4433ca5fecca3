"""URL filters: rules, and naive Bayes over host names split into words."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flatspan.llm.common import cut_lineage, small_or_whole, stored

#: Rules as given: verdict and host/path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: A label of a host name has 63 characters at most (RFC 1035), and so has a word in it.
LONGEST = 63
#: What stands between tokens of hosts and paths.
_BETWEEN = r"[^\p{L}\p{N}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: up to ``/``, ``?`` or ``#`` in lower case (A-Z), and from there up to ``?`` or ``#``; else empty."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: its host or a subdomain of it, and a path that starts with its path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def key_of(text: Column) -> Column:
    """What stands for a text in rows of its parts: itself up to the length of a label, else its SHA-256 (which is longer)."""
    return F.when(F.length(text) <= LONGEST, text).otherwise(F.sha2(text, 256))


def lexicon(pages: DataFrame) -> DataFrame:
    """(word, n) of the pages' visible words, counted over all of them; counts stay in Spark."""
    words = F.split(F.lower(F.regexp_replace("html", r"(?s)<(script|style).*?</\1>|<[^>]*>|&[a-z]+;", " ")), r"[^\p{L}]+")
    return pages.select(F.explode(words).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def segment(name: str, words: dict[str, float], total: int) -> list[str]:
    """Most probable split of a name into words (unigram Viterbi); unknown pieces cost more with each letter."""
    best, cut = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
    for end in range(1, len(name) + 1):
        for start in range(max(0, end - LONGEST), end):
            piece = name[start:end]
            p = words.get(piece)
            score = best[start] + (p if p is not None else 1 - math.log10(max(total, 10)) - 1.5 * len(piece))
            if score > best[end]:
                best[end], cut[end] = score, start
    out, end = [], len(name)
    while end:
        out.append(name[cut[end] : end])
        end = cut[end]
    return out[::-1]


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """(name, tokens): distinct names split into words. names: name; words: word and n.

    Each name lists its pieces, the lexicon joins those, and the Viterbi split sees the words that stand in its name:
    nothing of the lexicon is broadcast or left out.
    """
    total = words.agg(F.sum("n")).first()[0] or 0
    keyed = names.select("name", key_of(F.col("name")).alias("key"))
    # a long name is cut into runs of places where pieces begin, so no row is longer than two words and its name's key
    places = F.sequence(F.lit(0), (F.length("name") - 1).cast("int"), F.lit(LONGEST))
    runs = keyed.where("name <> ''").select("key", F.explode(F.transform(places, lambda a: F.substring("name", a + 1, F.lit(2 * LONGEST - 1)))).alias("run"))
    starts = F.sequence(F.lit(1), F.least(F.length("run"), F.lit(LONGEST)))
    pieces = F.flatten(F.transform(starts, lambda a: F.transform(F.sequence(F.lit(1), F.least(F.length("run") - a + 1, F.lit(LONGEST))), lambda n: F.substring("run", a, n))))
    listed = runs.select("key", F.explode(F.array_distinct(pieces)).alias("word"))
    known = listed.join(words, "word").groupBy("key").agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("ns"))

    @F.pandas_udf("array<string>")
    def split(name: pd.Series, own: pd.Series, ns: pd.Series) -> pd.Series:
        none: list = []
        return pd.Series([segment(x, {w: math.log10(n / total) for w, n in zip(none if o is None else o, none if k is None else k, strict=True)}, total) for x, o, k in zip(name, own, ns, strict=True)])

    return keyed.join(known, "key", "left").select("name", split("name", "words", "ns").alias("tokens"))


def parts_of(text: Column) -> Column:
    """The runs of letters and digits in a text, in lower case; a number counts as the token 0."""
    some = F.filter(F.split(F.lower(text), _BETWEEN), lambda w: w != "")
    return F.transform(some, lambda w: F.when(w.rlike(r"^\p{N}+$"), F.lit("0")).otherwise(w))


def host_tokens(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """(host_key, token): the words of distinct hosts, marked as such."""
    parts = hosts.select("host_key", F.explode(parts_of(F.col("host"))).alias("name"))
    split = segmented(parts.select("name").distinct(), words)
    return parts.join(split, "name").select("host_key", F.explode("tokens").alias("word")).select("host_key", F.concat(F.lit("h:"), "word").alias("token"))


def path_tokens(paths: DataFrame, *carried: str) -> DataFrame:
    """(path_key, token) and carried columns: the tokens of distinct paths, marked as such."""
    return paths.select("path_key", *carried, F.explode(parts_of(F.col("path"))).alias("word")).select("path_key", F.concat(F.lit("p:"), "word").alias("token"), *carried)


def bayes(counts: DataFrame, urls: dict[str, int]) -> tuple[DataFrame, float]:
    """(weights by token, bias) of multinomial naive Bayes with add-one smoothing, for block over allow.

    counts: token, block, allow. urls: taught urls by verdict.
    """
    block, allow, kinds = counts.agg(F.coalesce(F.sum("block"), F.lit(0)), F.coalesce(F.sum("allow"), F.lit(0)), F.count(F.lit(1))).first()
    weight = F.log((F.col("block") + 1) / (block + kinds + 1)) - F.log((F.col("allow") + 1) / (allow + kinds + 1))
    bias = math.log((urls.get("block", 0) + 1) / (urls.get("allow", 0) + 1)) if kinds else -1.0
    return counts.select("token", weight.alias("weight")), bias


def judge(pages: DataFrame, rules=RULES, teaches: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, odds of every url: the fitting rule's verdict, else the classifier's.

    The classifier learns from all urls that a rule decides (and for which ``teaches`` holds, where given), and its
    lexicon from the words of all pages. It blocks where block is likelier (odds above 0); with nothing to learn from it
    allows. A null url, or one without ``://``, has an empty host and path. Repeated rows each get a row; an empty table
    gives an empty result; further columns are ignored; a null page adds no words. Hosts, labels and paths may have any
    length: rows of their parts carry a key of 64 characters at most.

    Distinct hosts and distinct paths are tokenised and weighed once each and joined back, so a host or path of
    any number of urls costs one row of those tables, and no vocabulary goes through the driver.
    """
    host, path = host_and_path(F.col("url"))
    taught = F.lit(True) if teaches is None else teaches
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), taught.alias("taught"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    keys = key_of(F.col("host")).alias("host_key"), key_of(F.col("path")).alias("path_key")
    rows = rows.select("page_id", "host", "path", *keys, rule.alias("rule"), verdict.alias("said"), "taught")
    words = stored(lexicon(pages.select("html")))
    of_hosts = cut_lineage(host_tokens(rows.select("host_key", "host").distinct(), words))
    lessons = rows.where(F.col("said").isNotNull() & F.col("taught"))
    verdicts = F.count_if(F.col("said") == "block").alias("block"), F.count_if(F.col("said") == "allow").alias("allow")
    by_host = lessons.groupBy("host_key").agg(*verdicts).join(of_hosts, "host_key").select("token", "block", "allow")
    by_path = path_tokens(lessons.groupBy("path_key", "path").agg(*verdicts), "block", "allow").drop("path_key")
    counts = cut_lineage(by_host.union(by_path).groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")))
    urls = {r["said"]: r["n"] for r in lessons.groupBy("said").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights, bias = bayes(counts, urls)
    weights = small_or_whole(weights)
    hosts = small_or_whole(cut_lineage(of_hosts.join(weights, "token").groupBy("host_key").agg(F.sum("weight").alias("of_host"))))
    paths = small_or_whole(cut_lineage(path_tokens(rows.select("path_key", "path").distinct()).join(weights, "token").groupBy("path_key").agg(F.sum("weight").alias("of_path"))))
    odds = F.round(F.lit(bias) + F.coalesce("of_host", F.lit(0.0)) + F.coalesce("of_path", F.lit(0.0)), 9)  # the order of sums leaves no trace
    out = rows.join(hosts, "host_key", "left").join(paths, "path_key", "left").withColumn("odds", odds)
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("odds") > 0, "block").otherwise("allow")).alias("verdict"), "odds")
