"""Quality classifier with site evidence, by hierarchical empirical Bayes.

A document's own evidence is the log likelihood ratio of a few measures of its text, each in
fixed bins and within classes of length. Rates of bins are shrunk towards their rate over
all lengths. A site's evidence is the share of good documents on its host and, within the
host, under its path: the labels where there are some, else the classifier's probability.
Sparse paths are shrunk towards their host and sparse hosts towards the corpus, as strongly
as the spread between sites suggests. A document's own share is left out of its site.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmesh.session import checkpointed

SPACES = "[ \\t\\n\\r]+"
SYMBOL_RUN = "[!-/:-@\\[-`{-~]{2,}"
LONE_SYMBOLS = "(^|[ \\t\\n\\r])[!-/:-@\\[-`{-~]+([ \\t\\n\\r]|$)"
#: Upper edges of the bins of each measure; the last bin is open.
LENGTHS = (32, 128, 512)
EDGES = {
    "symbol_runs": (0.005, 0.02, 0.05, 0.1, 0.3),
    "lone_symbols": (0.005, 0.02, 0.05, 0.1, 0.3),
    "distinct_words": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "repeats": (0.005, 0.02, 0.05, 0.1, 0.2, 0.5),
    "word_length": (3.0, 4.0, 5.0, 6.0, 7.0, 8.0),
    "capitals": (0.01, 0.02, 0.05, 0.1, 0.3),
    "digits": (0.01, 0.05, 0.1, 0.2),
}
#: Weight, in documents, of a bin's rate over all lengths.
SHRINKAGE = 200.0
#: Bounds of the weight, in documents, of a prior for a site.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0


def bin_of(value: Column, edges: tuple) -> Column:
    """Number of edges that ``value`` reaches."""
    return sum(((value >= e).cast("int") for e in edges), F.lit(0))


def measures(text: Column) -> tuple[Column, dict[str, Column]]:
    """Number of words, and the measures as shares, from SQL functions only."""
    words = F.split(F.trim(text), SPACES)
    n = F.size(words)
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    same = F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: a == b)
    spaces = F.regexp_count(text, F.lit("[ \\t\\n\\r]"))
    return n, {
        "symbol_runs": F.regexp_count(text, F.lit(SYMBOL_RUN)) / n,
        "lone_symbols": F.regexp_count(text, F.lit(LONE_SYMBOLS)) / n,
        "distinct_words": F.size(F.array_distinct(words)) / n,
        "repeats": F.size(F.filter(same, lambda x: x)) / n,
        "word_length": (F.length(text) - spaces) / n,
        "capitals": F.regexp_count(text, F.lit("[A-Z]")) / chars,
        "digits": F.regexp_count(text, F.lit("[0-9]")) / chars,
    }


def binned(docs: DataFrame, id_col: str, text_col: str, host: Column, path: Column) -> DataFrame:
    """(id, host, path, length class, bins) per row; the text ends here."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(host.cast("string"), F.lit("")).alias("_host"),
                       F.coalesce(path.cast("string"), F.lit("")).alias("_path"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    n, values = measures(F.col("_text"))
    return rows.select("_id", "_host", "_path", bin_of(n, LENGTHS).alias("_length"),
                       *(bin_of(v, EDGES[k]).alias(k) for k, v in values.items()))


def ratios(counts: Counter, edges: dict = EDGES) -> dict[str, list[float]]:
    """Log likelihood ratios by measure, in the order length class, bin."""
    found = {}
    classes = range(len(LENGTHS) + 1)
    for name, limits in edges.items():
        bins = range(len(limits) + 1)
        shares = {}
        for good in (0, 1):
            whole = sum(counts[name, c, b, good] for c in classes for b in bins)
            overall = [(sum(counts[name, c, b, good] for c in classes) + 1) / (whole + len(bins)) for b in bins]
            for c in classes:
                inside = sum(counts[name, c, b, good] for b in bins)
                for b in bins:
                    shares[c, b, good] = (counts[name, c, b, good] + SHRINKAGE * overall[b]) / (inside + SHRINKAGE)
        found[name] = [math.log(shares[c, b, 1] / shares[c, b, 0]) for c in classes for b in bins]
    return found


def evidence(ratio: dict[str, list[float]]) -> Column:
    """The sum of the ratios of a row's bins."""
    def one(name: str) -> Column:
        place = F.col("_length") * (len(EDGES[name]) + 1) + F.col(name) + 1
        return F.element_at(F.array(*(F.lit(x) for x in ratio[name])), place)

    return sum((one(name) for name in EDGES), F.lit(0.0))


def prior_weight(groups: DataFrame, n: str, good: str, mean: str) -> Column:
    """Weight of a prior by moments: how much the rates of groups spread beyond chance.

    ``groups`` has a row per group: documents, expected good ones, and the mean they are
    shrunk to. Few, or equal, groups give the largest weight.
    """
    chance = F.sum(F.col(mean) * (1 - F.col(mean)))
    spread = F.sum(F.col(n) * F.pow(F.col(good) / F.col(n) - F.col(mean), 2)) - chance
    room = F.sum((F.col(n) - 1) * F.col(mean) * (1 - F.col(mean)))
    share = spread / F.when(room > 0, room)  # the intraclass correlation
    weight = F.when(share > 0, 1 / share - 1)
    return groups.agg(F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(MOST_WEIGHT), F.coalesce(
        weight, F.lit(MOST_WEIGHT)))).alias("weight"))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id",
             text_col: str = "text", label_col: str = "quality", threshold: float = 0.5) -> DataFrame:
    """(id, evidence, host_rate, path_rate, score, kept), one row per input row.

    ``labels`` holds ids and 0 or 1; several labels of an id count by their mean, null ones
    not at all. Every labelled document is counted; only the counts of bins, whose number is
    fixed, reach the driver. Null texts count as empty, null hosts and paths as ''. Rows that
    repeat an id are scored each. Without labels of both kinds, all evidence is 0. A document
    is kept if its probability of being good is at least ``threshold``; ties are kept.
    """
    rows = checkpointed(binned(docs, id_col, text_col, host, path))
    known = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_label"))
        .filter("_id is not null and _label is not null").groupBy("_id")
        .agg((F.avg("_label") >= 0.5).cast("int").alias("_label"))
    )
    rows = rows.join(known, "_id", "left")
    stacked = rows.filter("_label is not null").select("_length", "_label", F.explode(F.array(
        *(F.struct(F.lit(k).alias("name"), F.col(k).alias("bin")) for k in EDGES))).alias("m"))
    table = stacked.groupBy("m.name", "_length", "m.bin", "_label").count().collect()
    counts = Counter({(r[0], r[1], r[2], r[3]): r[4] for r in table})
    first = next(iter(EDGES))
    good, all_ = (sum(n for k, n in counts.items() if k[0] == first and k[3] in kinds) for kinds in ((1,), (0, 1)))
    both = 0 < good < all_
    rate = (good + 1) / (all_ + 2)
    ratio = ratios(counts) if both else {k: [0.0] * ((len(LENGTHS) + 1) * (len(e) + 1)) for k, e in EDGES.items()}
    odds = math.log(rate / (1 - rate))
    scored = checkpointed(rows.select("_id", "_host", "_path", "_label", evidence(ratio).alias("evidence")).withColumn(
        "_p", F.coalesce(F.col("_label").cast("double"), 1 / (1 + F.exp(-(F.col("evidence") + odds))))))
    paths = scored.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("_np"), F.sum("_p").alias("_sp"))
    hosts = paths.groupBy("_host").agg(F.sum("_np").alias("_nh"), F.sum("_sp").alias("_sh"))
    overall = hosts.agg(F.sum("_sh") / F.sum("_nh")).first()[0]
    overall = 0.5 if overall is None else min(max(overall, 1e-6), 1 - 1e-6)
    for_host = prior_weight(hosts.withColumn("_m", F.lit(overall)), "_nh", "_sh", "_m").first()[0]
    nested = paths.join(hosts, "_host")
    shrunk = (F.col("_sh") + for_host * overall) / (F.col("_nh") + for_host)
    for_path = prior_weight(nested.withColumn("_m", shrunk), "_np", "_sp", "_m").first()[0]
    # One row per path on the right; rows of a busy host or path are split by the adaptive join.
    joined = scored.join(nested, ["_host", "_path"], "left")
    host_rate = (F.col("_sh") - F.col("_p") + for_host * overall) / (F.col("_nh") - 1 + for_host)
    path_rate = (F.col("_sp") - F.col("_p") + for_path * F.col("host_rate")) / (F.col("_np") - 1 + for_path)
    score = 1 / (1 + F.exp(-(F.col("evidence") + F.log(F.col("path_rate") / (1 - F.col("path_rate"))))))
    return (
        joined.withColumn("host_rate", host_rate).withColumn("path_rate", path_rate).withColumn("score", score)
        .select(F.col("_id").alias(id_col), "evidence", "host_rate", "path_rate", "score",
                (F.col("score") >= threshold).alias("kept"))
    )
