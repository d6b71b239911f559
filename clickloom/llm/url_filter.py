"""URL filters by a path-template tree.

Rules decide the urls they fit: the longest rule whose host is the url's or a parent domain of it and whose path is the
beginning of the url's path. They also label those urls for the tree, which decides all others:

1. Paths are cut at slashes. Numbers, hexadecimal ids and dates become ``<n>``, ``<h>`` and ``<d>`` (an ending such as
   .html stays). Equal paths of a host are counted together; from here on rows are different paths, not urls.
2. Level by level, each host's tree grows: of a node's segments, those with less than ``min_share`` of its urls or less
   than ``min_urls`` are variable. A variable segment of ``min_urls`` whose labels (blocked, allowed, nothing) differ from
   those of the node's other variable segments by a likelihood-ratio test stays, however small its share: by itself if it
   has ``own_urls``, else with others of about the same labels (``*10:0``: tenths blocked and allowed). The rest become ``*``.
3. Sibling branches that are statistically similar are merged (``a|b``): a chi-square test over what rules say of their
   urls (blocked, allowed, nothing) and what comes below (an end, a number, a word) finds no difference.
4. A template is rejected if its smoothed purity (blocked + a * p) / (blocked + allowed + a) reaches ``reject``; p is the
   purity of all labelled urls, but half at most, so that templates without labels are never rejected.

Levels beyond ``depth`` are taken together as one ending, ``**``. Only counts of a node's segments of ``min_share`` and of
its pools, at most 1 / min_share + 67 rows, meet in one Python group to be merged; segments that stay by their own
evidence, of which a node may have any number, are not merged.

Defined cases: a null url and one without ``://`` have an empty host and path, fit no rule and are allowed; repeated
urls count as often as they occur; a null page id is an id; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import ascii_lower, if_small, written

#: verdict, host, path
Rule = tuple[str, str, str]
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: 0.1 % points of chi-square for 1 to 8 degrees of freedom.
CHI2 = (10.828, 13.816, 16.266, 18.467, 20.515, 22.458, 24.322, 26.124)


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lowered) and path."""
    text = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(text, URL, 1)), F.regexp_extract(text, URL, 2)


def ruled(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule as a string and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, domain, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # later ones, the longer, come first
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(start))
        name, verdict = F.when(fits, domain + start).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def segments(path: Column, depth: int) -> Column:
    """The generalised segments of a path, at most ``depth`` and one for the rest."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")

    def general(s: Column) -> Column:
        ending = F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1)
        stem = F.regexp_replace(s, r"\.[A-Za-z]{1,5}$", "")
        kind = (
            F.when(stem.rlike(r"^\d+$"), "<n>").when(stem.rlike(r"^\d{4}-\d\d?-\d\d?$"), "<d>")
            .when(stem.rlike(r"^(?=.*\d)[0-9a-fA-F-]{8,}$"), "<h>")
        )
        return F.coalesce(F.concat(kind, ending), s)

    whole = F.transform(parts, general)
    return F.when(F.size(whole) > depth, F.concat(F.slice(whole, 1, depth), F.array(F.lit("**")))).otherwise(whole)


def _merged(frame: pd.DataFrame) -> pd.DataFrame:
    """Label the kept segments of one node: similar ones share a label."""
    frame = frame.sort_values("seg", kind="stable").reset_index(drop=True)
    counts = np.array(frame["profile"].tolist(), float)
    pool = frame["pool"].tolist()
    groups: list[list[int]] = []
    for i in range(len(frame)):
        for group in groups:
            a, b = counts[group].sum(axis=0), counts[i]
            both = a + b
            used = both > 0
            expected = np.stack([a.sum() * both, b.sum() * both])[:, used] / both.sum()
            chi = ((np.stack([a, b])[:, used] - expected) ** 2 / expected).sum()
            if not (pool[i] or pool[group[0]]) and chi < CHI2[max(0, int(used.sum()) - 2)]:
                group.append(i)
                break
        else:
            groups.append([i])
    label = {i: "|".join(frame["seg"][group]) for group in groups for i in group}
    return pd.DataFrame({"host": frame["host"], "node": frame["node"], "seg": frame["seg"], "pool": frame["pool"], "label": [label[i] for i in range(len(frame))]})


def _differs() -> Column:
    """Whether a segment's labels differ from those of the other variable segments: likelihood ratio, 2 degrees of freedom."""
    own, rest = F.col("n"), F.col("n_pool") - F.col("n")
    likeness = F.lit(0.0)
    for c in ("blocked", "allowed", "none"):
        for has, of in ((F.col(c), own), (F.col(f"{c}_pool") - F.col(c), rest)):
            expected = F.col(f"{c}_pool") * of / F.col("n_pool")
            likeness = likeness + F.when(has > 0, 2 * has * F.log(has / expected)).otherwise(0.0)
    return (rest > 0) & (likeness >= CHI2[1])


def templates(paths: DataFrame, depth: int, min_share: float, min_urls: int, own_urls: int) -> DataFrame:
    """``paths`` (host, segs, n, blocked, allowed) with the template of each."""
    rows = written(paths.withColumn("node", F.lit("")), "url-level")
    deepest = rows.agg(F.max(F.size("segs"))).first()[0] or 0
    for level in range(deepest):
        seg = F.get("segs", F.lit(level))
        below = F.get("segs", F.lit(level + 1))
        kind = F.when(below.isNull(), 0).when(below.startswith("<"), 1).otherwise(2)
        here = rows.filter(F.size("segs") > level).withColumn("seg", seg).withColumn("kind", kind)
        by = here.groupBy("host", "node", "seg").agg(
            F.sum("n").alias("n"), *[F.sum(F.when(F.col("kind") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}")
                                     for k in range(3) for c in ("blocked", "allowed", "n")])
        totals = by.groupBy("host", "node").agg(F.sum("n").alias("total"))
        fixed = (F.col("n") >= min_urls) & (F.col("n") >= min_share * F.col("total"))
        labelled = by.withColumn("blocked", F.expr("blocked0 + blocked1 + blocked2")).withColumn("allowed", F.expr("allowed0 + allowed1 + allowed2"))
        shared = written(labelled.withColumn("none", F.expr("n - blocked - allowed")).join(totals, ["host", "node"]).withColumn("fixed", fixed), "url-shares")
        pools = shared.filter("not fixed").groupBy("host", "node").agg(*[F.sum(c).alias(f"{c}_pool") for c in ("n", "blocked", "allowed", "none")])
        variable = F.when(~F.col("fixed") & (F.col("n") >= min_urls), _differs()).otherwise(False)
        tenths = F.concat(F.lit("*"), *[x for c in ("blocked", "allowed") for x in (F.lit(":"), F.round(F.col(c) * 10 / F.col("n")).cast("int").cast("string"))][1:])
        kept = F.when(F.col("fixed") | F.col("own"), F.col("seg")).when(F.col("apart"), tenths).otherwise("*")
        judged = written(
            shared.join(pools, ["host", "node"], "left").withColumn("apart", variable).withColumn("own", F.col("apart") & (F.col("n") >= own_urls))
            .withColumn("kept", kept).withColumn("pool", ~F.col("fixed")), "url-segments")
        profile = [F.sum(F.col(f"{c}{k}")) for k in range(3) for c in ("blocked", "allowed")]
        profile += [F.sum(F.col(f"n{k}") - F.col(f"blocked{k}") - F.col(f"allowed{k}")) for k in range(3)]
        branches = judged.filter("not own").groupBy("host", "node", F.col("kept").alias("seg"), "pool").agg(F.array(*profile).alias("profile"))
        labels = branches.groupBy("host", "node").applyInPandas(_merged, "host string, node string, seg string, pool boolean, label string")
        labels = labels.withColumnRenamed("seg", "kept").withColumn("own", F.lit(False))
        named = written(judged.select("host", "node", "seg", "kept", "pool", "own").join(labels, ["host", "node", "kept", "pool", "own"], "left").select(
            "host", "node", "seg", F.coalesce("label", "seg").alias("label")), "url-labels")
        grown = rows.withColumn("seg", seg).join(if_small(named), ["host", "node", "seg"], "left")
        node = F.when(F.col("label").isNull(), F.col("node")).otherwise(F.concat("node", F.lit("/"), F.col("label")))
        rows = written(grown.withColumn("node", node).drop("seg", "label"), "url-level")
    return rows.withColumnRenamed("node", "template")


def judge(
    pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", depth: int = 6,
    min_share: float = 0.01, min_urls: int = 3, own_urls: int = 100, smoothing: float = 10.0, reject: float = 0.8,
) -> DataFrame:
    """Per page: id, host, path, rule, verdict, template, purity. Runs Spark jobs when called."""
    host, path = parsed(F.col(url_col))
    read = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, says = ruled(rules, F.col("host"), F.col("path"))
    urls = read.withColumn("rule", rule).withColumn("says", says).withColumn("segs", segments(F.col("path"), depth))
    count = lambda of: F.sum(F.when(F.col("says") == of, 1).otherwise(0))
    paths = urls.groupBy("host", "segs").agg(F.count("*").alias("n"), count("block").alias("blocked"), count("allow").alias("allowed"))
    tree = templates(paths, depth, min_share, min_urls, own_urls)
    counted = tree.groupBy("host", "template").agg(F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"))
    bad, good = tree.agg(F.sum("blocked"), F.sum("allowed")).first()
    prior = min(0.5, (bad or 0) / max(1, (bad or 0) + (good or 0)))
    purity = (F.col("blocked") + smoothing * prior) / (F.col("blocked") + F.col("allowed") + smoothing)
    pure = counted.select("host", "template", purity.alias("purity"))
    known = written(tree.select("host", "segs", "template").join(pure, ["host", "template"]), "url-templates")
    met = urls.join(if_small(known), ["host", "segs"])
    verdict = F.coalesce("says", F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    return met.select("id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
