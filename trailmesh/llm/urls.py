"""URL filter: fixed host rules first, then a weighted vocabulary matched by Aho-Corasick.

A term counts where no letter or digit stands directly before or after it. One strict term
rejects a url, and so do ``soft_limit`` different soft terms.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRICT_TERMS = ("adult", "casino", "escort", "hentai", "porn", "sexcam", "viagra", "xxx")
SOFT_TERMS = (
    "ads", "bet", "bets", "betting", "bonus", "cheap", "dating", "deals", "farm", "free", "hot", "jackpot", "loan",
    "loans", "pill", "pills", "poker", "promo", "slots", "spam", "track", "tracker", "win", "winner",
)
WORD_CHARACTERS = frozenset(string.ascii_lowercase + string.digits)
LOWER = {ord(c): c.lower() for c in string.ascii_uppercase}


@dataclass(frozen=True)
class Rule:
    """``verdict`` for urls of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path; both empty for a null url or one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    lowered = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, both null without one (equal lengths: block first)."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block", r.name))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in reversed(ordered):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.name).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def term_counter(strict: Sequence[str], soft: Sequence[str]):
    """A Pandas UDF: text to (number of strict hits, number of different soft terms)."""
    weights = {**{t: False for t in soft}, **{t: True for t in strict}}
    built: list = []

    def automaton():
        if not built:
            found = ahocorasick.Automaton()
            for term, is_strict in weights.items():
                found.add_word(term, (term, is_strict))
            found.make_automaton()
            built.append(found)
        return built[0]

    @F.pandas_udf("strict_hits int, soft_terms int")
    def count(urls: pd.Series) -> pd.DataFrame:
        search, rows = automaton(), []
        for url in urls:
            strict_hits, soft_terms = 0, set()
            text = url.translate(LOWER) if url else ""
            for end, (term, is_strict) in search.iter(text):
                before, after = end - len(term), end + 1
                if before >= 0 and text[before] in WORD_CHARACTERS:
                    continue
                if after < len(text) and text[after] in WORD_CHARACTERS:
                    continue
                if is_strict:
                    strict_hits += 1
                else:
                    soft_terms.add(term)
            rows.append((strict_hits, len(soft_terms)))
        return pd.DataFrame(rows, columns=["strict_hits", "soft_terms"])

    return count


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = (), id_col: str = "page_id", url_col: str = "url",
               strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] = SOFT_TERMS,
               soft_limit: int = 2) -> DataFrame:
    """(id, host, path, rule, verdict, strict_hits, soft_terms), one row per input row.

    A null url, or one without ``://``, has an empty host and path and fits no rule; a null
    url is allowed. Repeated rows are judged each; other columns are not carried, so their
    names do not matter. An empty table gives an empty one. No shuffle takes place.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"))
    host, path = host_and_path(F.col("_url"))
    rows = rows.withColumns({"host": host, "path": path, "_hits": term_counter(strict, soft)(F.col("_url"))})
    rule, ruled = matching_rule(F.col("host"), F.col("path"), rules)
    rejected = (F.col("_hits.strict_hits") >= 1) | (F.col("_hits.soft_terms") >= soft_limit)
    return rows.select(
        F.col("_id").alias(id_col), "host", "path", rule.alias("rule"),
        F.coalesce(ruled, F.when(rejected, "block").otherwise("allow")).alias("verdict"),
        F.col("_hits.strict_hits").alias("strict_hits"), F.col("_hits.soft_terms").alias("soft_terms"),
    )
