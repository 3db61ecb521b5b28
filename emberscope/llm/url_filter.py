"""URL verdicts: host and path rules, and gradient-boosted trees for what no rule names.

Everything is DataFrame expressions and Spark's own tree learner.  Rules are few and compiled
into one expression, the longest first.  URLs that a rule judges are the labelled examples;
the trees see lexical features only (lengths, depth, digits, character entropy, parameters,
labels of the host) and statistics of the host's suffix counted over the labelled URLs.  An
example's own fold of them is left out of its statistics, so its label never reaches its
features, and both verdicts weigh the same in all.  The trees are fitted on at most
``MOST_EXAMPLES`` examples, the first by a hash of the URL; the suffix statistics and all
verdicts cover every row.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule and
the trees' verdict; with examples of one verdict only, or none, that verdict (or allow) is
given to all; rows are judged one by one, so repeated rows and null ids are like others; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.llm.tables import settled

#: Fixed values: (verdict, host, path) of the production rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Labels that make a suffix of two labels with a country's.
SECOND_LEVEL = "ac|co|com|edu|gov|net|org"
ALLOW, BLOCK = "allow", "block"
MOST_EXAMPLES = 20_000
TREES, DEPTH, SEED = 20, 4, 7
_PRIOR = 10.0  # weight of the even rate that a suffix starts with
_FOLDS = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FEATURES = (
    "url_length", "host_length", "path_length", "depth", "digit_ratio", "host_entropy", "url_entropy", "n_parameters",
    "host_labels", "host_digits", "dashes", "fragment", "secure", "suffix_length", "suffix_block_rate",
)


def parts(pages: DataFrame) -> DataFrame:
    """The rows with ``host``, ``path`` and ``_rest``, what follows ``://`` (empty if nothing does)."""
    at = F.instr("_url", "://")
    rest = F.when(at > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("_rest", rest).withColumn("host", host).withColumn("path", path)


def _rule(rules: tuple) -> Column:
    """The longest fitting rule as a struct of its text and verdict, or null."""
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    cases = [
        F.when(
            ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path),
            F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, host, path in ranked
    ]
    return F.coalesce(*cases)


def _count_of(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")


def _entropy(text: Column) -> Column:
    """Bits per character; 0 for an empty text."""
    size = F.length(text).cast("double")
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    characters = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.when(size > 0, F.aggregate(characters, F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))).otherwise(F.lit(0.0))


def with_features(rows: DataFrame) -> DataFrame:
    """Lexical features of rows that have ``_url``, ``host`` and ``path``, and their suffix."""
    url, host, path = F.coalesce("_url", F.lit("")), F.col("host"), F.col("path")
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    query = F.regexp_extract(F.col("_rest"), r"^[^?#]*\?([^#]*)", 1)
    suffix = F.regexp_extract(host, rf"(?:^|\.)((?:(?:{SECOND_LEVEL})\.[a-z]{{2}})|[^.:]*)(?::\d*)?$", 1)
    flag = lambda c: c.cast("double")
    return rows.withColumns({
        "url_length": F.length(url).cast("double"), "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"),
        "depth": _count_of(path, "/"), "digit_ratio": _count_of(url, "[0-9]") / size,
        "host_entropy": _entropy(host), "url_entropy": _entropy(url),
        "n_parameters": F.when(query == "", F.lit(0.0)).otherwise(_count_of(query, "&") + 1),
        "host_labels": _count_of(host, "[.]"), "host_digits": _count_of(host, "[0-9]"), "dashes": _count_of(url, "[-_]"),
        "fragment": flag(F.instr(url, "#") > 0), "secure": flag(url.startswith("https")),
        "suffix": suffix, "suffix_length": F.length(suffix).cast("double"),
    })


class Trees:
    """Trees fitted on labelled rows (those of ``with_features``, with ``label`` 1 for block).

    ``constant`` is the block probability where the labels leave nothing to tell apart.
    """

    def __init__(self, labelled: DataFrame):
        labelled = labelled.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "_url"), F.lit(_FOLDS)))
        totals = settled(labelled.groupBy("suffix", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("blocked")), "url-suffixes")
        n_all, n_blocked = totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0.0))).first()
        self.constant = None if 0 < n_blocked < n_all else 1.0 if n_all and n_blocked == n_all else 0.0
        if self.constant is not None:
            return
        self.weights = n_all / (2 * (n_all - n_blocked)), n_all / (2 * n_blocked)  # of allow and block
        self.suffixes = totals.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))
        own = totals.select("suffix", "fold", F.col("n").alias("own_n"), F.col("blocked").alias("own_blocked"))
        examples = labelled.orderBy(F.xxhash64("_url"), "_url").limit(MOST_EXAMPLES).join(self.suffixes, "suffix").join(own, ["suffix", "fold"])
        examples = self._assembled(examples, F.col("n") - F.col("own_n"), F.col("blocked") - F.col("own_blocked"))
        weight = F.when(F.col("label") == 1, F.lit(self.weights[1])).otherwise(F.lit(self.weights[0])).alias("weight")
        examples = settled(examples.select("_features", "label", weight), "url-examples")
        learner = GBTClassifier(featuresCol="_features", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=SEED)
        self.model = learner.setPredictionCol("_prediction").setRawPredictionCol("_raw").setProbabilityCol("_probability").fit(examples)

    def _assembled(self, rows: DataFrame, n: Column, blocked: Column) -> DataFrame:
        """Feature vectors; the block rate of the suffix starts at one half."""
        n, blocked = F.coalesce(n, F.lit(0)).cast("double"), F.coalesce(blocked, F.lit(0.0))
        against, for_it = blocked * self.weights[1], (n - blocked) * self.weights[0]
        known = rows.withColumn("suffix_block_rate", (against + _PRIOR / 2) / (against + for_it + _PRIOR))
        return VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(known)

    def scored(self, rows: DataFrame) -> DataFrame:
        """The rows with ``block_probability``."""
        if self.constant is not None:
            return rows.withColumn("block_probability", F.lit(self.constant))
        known = self._assembled(rows.join(self.suffixes, "suffix", "left"), F.col("n"), F.col("blocked"))
        return self.model.transform(known).withColumn("block_probability", vector_to_array("_probability")[1])


def prepared(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, parts, features, and ``_rule``, the rule that fits."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("_url"))
    return with_features(parts(rows)).withColumn("_rule", _rule(rules))


def labelled(rows: DataFrame) -> DataFrame:
    """The rows that a rule judges, with that verdict as ``label``."""
    return rows.where("_rule IS NOT NULL").withColumn("label", (F.col("_rule.verdict") == BLOCK).cast("double"))


def verdicts(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict and the trees' block probability."""
    rows = prepared(pages, rules)
    return _judged(Trees(labelled(rows)).scored(rows))


def _judged(rows: DataFrame) -> DataFrame:
    own = F.when(F.col("block_probability") >= 0.5, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return rows.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", own).alias("verdict"), "block_probability")
