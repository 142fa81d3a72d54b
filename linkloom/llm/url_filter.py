"""URL filter: fixed rules, and gradient-boosted trees on lexical features for the rest.

Host and path are cut out by column expressions and matched against (host, path) rules; the
longest fitting rule decides. URLs that a rule labels also train a gradient-boosted tree
model on lexical features (lengths, depth, digit ratio, entropy, parameter counts, suffix
statistics), which judges the URLs that no rule fits. Everything is DataFrame expressions: the
trees come from the ML library and are applied as one nested CASE expression each, so scoring
is part of the scan stage while the suffix tables are small enough to broadcast (they are measured).

The labelled URLs are taken once each, however many rows hold them. All of them make the suffix
statistics; training reads a bounded sample, the first ``TRAIN_URLS`` by hash.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.plans.materialize import materialize

TRAIN_URLS = 8192
TREES = 12
DEPTH = 4
BROADCAST_BYTES = 64 << 20   # measured size up to which a suffix table is broadcast
SUFFIX_PRIOR = 4.0   # labelled URLs that a suffix's block rate is smoothed by


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
         Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))

FEATURES = ("url_length", "host_length", "path_length", "depth", "host_labels", "hyphens", "digit_ratio", "path_digits",
            "entropy", "parameters", "query_length", "has_fragment", "suffix_rate", "suffix_seen", "second_rate",
            "first_segment_length")


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' without one."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(found, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to '?', '#' or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    """The rule's host or a subdomain of it, and a path that starts with the rule's."""
    return ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))


def matched(rules: tuple[Rule, ...], host: Column, path: Column, value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null (one length: longer host, then block, first)."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.verdict == "block")):
        out = F.when(fits(rule, host, path), F.lit(value(rule))).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Bits per character of a text's letter distribution; 0 for an empty one."""
    length = F.char_length(text).cast("double")
    chars = F.array_distinct(F.split(text, ""))
    share = lambda c: (length - F.char_length(F.replace(text, c, F.lit("")))) / length
    return F.when(length > 0, F.aggregate(
        F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))).otherwise(F.lit(0.0))


def suffix_of(host: Column, labels: int) -> Column:
    """The last labels of a host."""
    return F.substring_index(host, ".", -labels)


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` (with url, host, path) plus the features that need no statistics, as doubles."""
    url, host, path = F.coalesce(F.col("url"), F.lit("")), F.col("host"), F.col("path")
    digits = lambda c: F.char_length(F.regexp_replace(c, "[^0-9]", ""))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    columns = {
        "url_length": F.char_length(url), "host_length": F.char_length(host), "path_length": F.char_length(path),
        "depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")),
        "host_labels": F.size(F.split(host, r"\.")), "hyphens": F.char_length(F.regexp_replace(host, "[^-]", "")),
        "digit_ratio": ratio(digits(url), F.char_length(url)), "path_digits": digits(path),
        "entropy": _entropy(F.concat(host, path)),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "query_length": F.char_length(query), "has_fragment": F.instr(url, "#") > 0,
        "first_segment_length": F.char_length(F.regexp_extract(path, "^/([^/]*)", 1)),
    }
    return urls.withColumns({f"f_{k}": c.cast("double") for k, c in columns.items()} | {
        "suffix": suffix_of(host, 1), "second": suffix_of(host, 2)})


def _with_suffixes(features: DataFrame, one: DataFrame, two: DataFrame, prior: float) -> DataFrame:
    """Suffix statistics of all labelled URLs (tables hinted by :func:`_rates` if they are small)."""
    return (features.join(one, "suffix", "left").join(two, "second", "left")
            .withColumns({"f_suffix_rate": F.coalesce("one_rate", F.lit(prior)),
                          "f_suffix_seen": F.log1p(F.coalesce("one_seen", F.lit(0)).cast("double")),
                          "f_second_rate": F.coalesce("two_rate", F.lit(prior))}))


def _rates(labelled: DataFrame, key: str, name: str, prior: float) -> DataFrame:
    rate = (F.sum("label") + SUFFIX_PRIOR * prior) / (F.count(F.lit(1)) + SUFFIX_PRIOR)
    table = materialize(labelled.groupBy(key).agg(rate.alias(f"{name}_rate"), F.count(F.lit(1)).alias(f"{name}_seen")), f"url-{key}")
    size = table.agg(F.sum(F.octet_length(key) + 48)).first()[0] or 0
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def _tree(node, features: list[str]) -> Column:
    """A regression tree of the ML library as a CASE expression."""
    if node.numDescendants() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.col(features[split.featureIndex()]) <= F.lit(float(split.threshold())),
                  _tree(node.leftChild(), features)).otherwise(_tree(node.rightChild(), features))


def margin(model: GBTClassificationModel, features: list[str]) -> Column:
    """Weighted sum of the trees; above 0 means block."""
    total = F.lit(0.0)
    for tree, weight in zip(model.trees, model.treeWeights):
        total = total + F.lit(float(weight)) * _tree(tree._call_java("rootNode"), features)
    return total


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES,
               train_urls: int = TRAIN_URLS) -> DataFrame:
    """``(id, host, path, rule, verdict, score)`` for each row of ``pages``.

    ``verdict`` is the rule's where one fits; else block if the trees' probability of block
    (``score``, null where a rule decided) is above 0.5. A null URL or one without '://' has an
    empty host and path, fits no rule and is judged by the model. If the rules label no URL, every other
    URL is allowed; if they label URLs of one kind only, every other URL gets that verdict. Rows that
    repeat are judged alike; null ids are kept; other columns are not read; an empty table gives
    an empty result.
    """
    url = F.col(url_col).cast("string")
    base = pages.select(F.col(id_col), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    host, path = F.col("host"), F.col("path")
    base = base.withColumns({"rule": matched(rules, host, path, lambda r: r.text),
                             "ruled": matched(rules, host, path, lambda r: r.verdict)})
    # Each labelled URL once, whatever pages hold it: copies collapse before the exchange.
    labelled = (base.where("ruled IS NOT NULL").select("url", (F.col("ruled") == "block").cast("double").alias("label")).distinct()
                .select("url", "label", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")))
    labelled = materialize(labelled, "url-labelled")
    rows, blocked = labelled.agg(F.count(F.lit(1)), F.sum("label")).first()
    names = [f"f_{f}" for f in FEATURES]
    if not rows or blocked in (0, rows):
        verdict = "block" if rows and blocked else "allow"
        judged = base.withColumn("score", F.when(F.col("ruled").isNull(), F.lit(float(verdict == "block"))))
    else:
        prior = blocked / rows
        # A bounded top-k by hash for the trees; the statistics are of all labelled URLs.
        sample = materialize(lexical(labelled.orderBy(F.xxhash64("url"), "url").limit(train_urls)).coalesce(1), "url-sample")
        suffixes = labelled.select("label", suffix_of(host, 1).alias("suffix"), suffix_of(host, 2).alias("second"))
        one, two = (_rates(suffixes, key, name, prior) for key, name in (("suffix", "one"), ("second", "two")))
        two = two.drop("two_seen")
        # One partition in hash order: the bounded sample trains the same trees at every run.
        train = _with_suffixes(sample, one, two, prior).coalesce(1).sortWithinPartitions(F.xxhash64("url"), "url")
        train = materialize(train.select("label", array_to_vector(F.array(*names)).alias("features")), "url-train")
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, stepSize=0.3).fit(train.coalesce(1))
        scored = _with_suffixes(lexical(base), one, two, prior)
        judged = scored.withColumn("score", F.when(F.col("ruled").isNull(), 1 / (1 + F.exp(-2 * margin(model, names)))))
    return judged.select(id_col, "host", "path", "rule",
                         F.coalesce("ruled", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score")
