"""URL verdicts: listed hosts and paths first, then a weighted vocabulary.

The vocabulary's terms are found in one walk over the URL by an Aho-Corasick
automaton. A hit counts only between boundaries (anything but ASCII letters and digits).
One strict term, or several distinct soft ones, reject the URL.
"""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.llm.common import free_name

# The default vocabulary; both lists are parameters.
STRICT = ["porn", "xxx", "hardcore", "camgirls", "escorts", "warez", "keygen"]
SOFT = ["adult", "bet", "bonus", "casino", "crack", "dating", "free", "hot", "loan", "lottery", "nude", "poker", "sex", "torrent", "win"]
#: Distinct soft terms that reject.
SOFT_LIMIT = 2
ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as ``struct(rule, verdict)``; null if none does.

    A rule ``host/path`` fits the host and all its subdomains if the path starts with
    the rule's. Of rules of one length, the first in alphabetical order.
    """
    branches = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        branches.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*branches) if branches else F.lit(None).cast("struct<rule: string, verdict: string>")


def term_counts(url: Column, strict: list[str], soft: list[str]) -> Column:
    """``struct(strict, soft)``: hits of strict terms, and distinct soft terms hit."""
    terms = {t.lower(): True for t in soft} | {t.lower(): False for t in strict}

    @F.pandas_udf("strict int, soft int")
    def counts(urls: pd.Series) -> pd.DataFrame:
        automaton = ahocorasick.Automaton()
        for t, is_soft in terms.items():
            automaton.add_word(t, (t, is_soft))
        if terms:
            automaton.make_automaton()
        rows = []
        for url in urls:
            hard, mild = 0, set()
            for end, (t, is_soft) in automaton.iter(url) if url and terms else ():
                start = end - len(t) + 1
                if (start == 0 or url[start - 1] not in ALNUM) and (end + 1 == len(url) or url[end + 1] not in ALNUM):
                    if is_soft:
                        mild.add(t)
                    else:
                        hard += 1
            rows.append((hard, len(mild)))
        return pd.DataFrame(rows, columns=["strict", "soft"], dtype="int32")

    return counts(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER))


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", strict: list[str] = STRICT,
    soft: list[str] = SOFT, soft_limit: int = SOFT_LIMIT, name: str = "url_check",
) -> DataFrame:
    """``pages`` with ``name = struct(host, path, rule, strict, soft, score, verdict)``.

    ``rules`` are ``(verdict, host/path)`` pairs. The verdict is the longest fitting
    rule's, else block for one strict term or ``soft_limit`` distinct soft ones, else
    allow. ``score`` is strict hits plus distinct soft terms divided by the limit. A null
    URL has empty host and path, fits no rule and is allowed. All columns stay, but one
    that is called ``name`` is replaced.
    """
    u, held = F.col(f"`{url}`"), free_name("judged", pages)
    found = pages.withColumn(held, F.struct(host_of(u).alias("host"), path_of(u).alias("path"), term_counts(u, strict, soft).alias("n")))
    at = lambda field: F.col(f"{held}.{field}")
    ruled = rule_of(at("host"), at("path"), rules)
    own = F.when((at("n.strict") > 0) | (at("n.soft") >= soft_limit), F.lit("block")).otherwise(F.lit("allow"))
    verdict = F.struct(
        at("host").alias("host"), at("path").alias("path"), ruled["rule"].alias("rule"), at("n.strict").alias("strict"), at("n.soft").alias("soft"),
        (at("n.strict") + at("n.soft") / float(soft_limit)).alias("score"), F.coalesce(ruled["verdict"], own).alias("verdict"),
    )
    return found.withColumn(name, verdict).drop(held)
