"""URL filters: rules first, gradient-boosted trees on lexical features for the rest; only DataFrame and JVM code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


#: The rules (host, path).
RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))

#: Parts of a url whose labelled history is a feature: the host's last two labels, the path's first part, and both.
LEVELS = ("host_suffix", "path_head", "suffix")
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digits", "entropy", "parameters", "marks", "secure", *(f"{x}_{y}" for x in LEVELS for y in ("seen", "share")))
#: Parts into which labelled urls fall by hash; a training row's statistics are those of the other parts.
FOLDS = 5
#: Statistics of at most so many suffixes (some 100 bytes each) are broadcast; more are joined by salted keys.
BROADCAST_ROWS, SALTS = 200_000, 16


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z as a-z) and path of a url; both empty for null or without ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(text, pattern, 1), upper, upper.lower()), F.regexp_extract(text, pattern, 2)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule (host and path together; of equally long ones the first) that fits; else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.host) + len(r.path)):
        fits = ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path))
        name, verdict = F.when(fits, F.lit(rule.host + rule.path)).otherwise(name), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def entropy(x: Column) -> Column:
    """Bits a character of the distribution of x's characters; 0 for an empty text. The characters are sorted and their runs summed."""
    chars = F.array_sort(F.filter(F.split(x, ""), lambda c: c != ""))
    bits = lambda n: F.when(n > 0, n * F.log2(n)).otherwise(0.0)
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def step(state: Column, c: Column) -> Column:
        same = state["c"] == c
        return F.struct(c.alias("c"), F.when(same, state["run"] + 1.0).otherwise(1.0).alias("run"), F.when(same, state["sum"]).otherwise(state["sum"] + bits(state["run"])).alias("sum"))

    n = F.greatest(F.char_length(x), F.lit(1)).cast("double")
    return F.greatest(F.lit(0.0), F.log2(n) - F.aggregate(chars, start, step, lambda state: state["sum"] + bits(state["run"])) / n)


def lexical(rows: DataFrame) -> DataFrame:
    """rows (url, host, path) with the lexical features that need no other row, and what LEVELS names."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    suffix, head = F.regexp_extract("host", r"([^.]+(\.[^.]+)?)$", 1), F.regexp_extract("path", r"^/[^/]*", 0)
    return rows.withColumns(
        {
            "length": F.char_length(url).cast("double"),
            "host_length": F.char_length("host").cast("double"),
            "path_length": F.char_length("path").cast("double"),
            "depth": F.regexp_count(F.col("path"), F.lit("/[^/]")).cast("double"),
            "labels": F.regexp_count(F.col("host"), F.lit("[^.]+")).cast("double"),
            "digits": F.regexp_count(url, F.lit("[0-9]")) / F.greatest(F.char_length(url), F.lit(1)),
            "entropy": entropy(url),
            "parameters": F.when(query == "", 0.0).otherwise(F.regexp_count(query, F.lit("&")) + 1.0),
            "marks": F.regexp_count(url, F.lit("[-_~%#]")).cast("double"),
            "secure": F.startswith(url, F.lit("https")).cast("double"),
            "host_suffix": suffix,
            "path_head": head,
            "suffix": F.concat(suffix, head),
        }
    )


def history(known: DataFrame, level: str) -> DataFrame:
    """For each value of a level in the labelled urls: their number and their blocks, by fold. known: lexical rows with label and fold."""
    counts = [F.count_if(F.col("fold") == f) for f in range(FOLDS)]
    blocks = [F.sum(F.when(F.col("fold") == f, F.col("label")).otherwise(0.0)) for f in range(FOLDS)]
    return known.groupBy(level).agg(F.array(*counts).alias("n"), F.array(*blocks).alias("b"))


def with_history(rows: DataFrame, stats: DataFrame, level: str, broadcast_rows: int) -> DataFrame:
    """rows with level_seen (log of the number) and level_share (of blocks, evened out); those of the row's fold, if it has one, are left out.

    A row with hidden true counts as one whose value nobody has seen.
    """
    held = stats.withColumnRenamed(level, "__value")
    on = F.col(level) == F.col("__value")
    if held.limit(broadcast_rows + 1).count() <= broadcast_rows:
        joined = rows.join(F.broadcast(held), on, "left")
    else:
        salted = held.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("__own", F.pmod(F.xxhash64("url", F.lit(3)), F.lit(SALTS)).cast("int")).join(salted, on & (F.col("__own") == F.col("__salt")), "left").drop("__own", "__salt")
    total = lambda c: sum((F.get(c, F.lit(f)) * F.when(F.col("fold") == f, 0).otherwise(1) for f in range(FOLDS)), F.lit(0))
    unseen = F.col("__value").isNull() | F.col("hidden")
    n, b = F.when(unseen, 0).otherwise(total("n")), F.when(unseen, 0.0).otherwise(total("b"))
    return joined.withColumns({f"{level}_seen": F.log1p(n.cast("double")), f"{level}_share": (b + 1) / (n + 2)}).drop("__value", "n", "b")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, labelled: DataFrame | None = None, sample: int = 4000, trees: int = 12, depth: int = 4, key: str = "page_id", url: str = "url", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Columns key, host, path, rule, verdict, score; one row per input row.

    labelled: columns url and verdict (block or allow) to train on; by default the pages on which a rule decides.
    The trees are fitted on the sample urls (parameter) with the least hashes. Suffix statistics cover all labelled
    urls: how many have the same host suffix, first part of the path, or both, and their share of blocks; for a url
    that is trained on only those of other folds count, and for every second one of those the suffix as a whole
    counts as unseen, so that the trees also learn to judge urls no rule has ever met. Verdict is the rule's, else
    the trees': block from 0.5. Without urls of both verdicts to learn from, what no rule decides is allowed (score
    0). Repeated pages, null urls and null keys stay.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    host, path = split_url(F.col("url"))
    base = pages.select(F.col(key).alias("k"), F.col(url).alias("url")).withColumn("host", host).withColumn("path", path)
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = base.withColumn("rule", name).withColumn("ruled", verdict)
    if labelled is None:
        known = rows.filter("ruled is not null").select("url", "host", "path", (F.col("ruled") == "block").cast("double").alias("label"))
    else:
        known = labelled.select("url", (F.col("verdict") == "block").cast("double").alias("label")).filter("label is not null").withColumn("host", host).withColumn("path", path)
    fold = F.pmod(F.xxhash64("url", F.lit(7)), F.lit(FOLDS)).cast("int")
    stats = {level: materialize(history(lexical(known).withColumn("fold", fold), level), f"urls-{level}") for level in LEVELS}

    def featured(some: DataFrame, training: bool) -> DataFrame:
        some = lexical(some).withColumn("fold", fold if training else F.lit(None).cast("int"))
        for level in LEVELS:
            hidden = F.pmod(F.xxhash64("url", F.lit(9)), F.lit(2)) == 0 if training and level == "suffix" else F.lit(False)
            some = with_history(some.withColumn("hidden", hidden), stats[level], level, broadcast_rows)
        return some

    chosen = known.withColumn("h", F.xxhash64("url")).orderBy("h", "url", "label").limit(sample)
    training = materialize(featured(chosen, True).select("label", *FEATURES), "urls-training")
    classes = {r["label"] for r in training.select("label").distinct().collect()}
    if len(classes) < 2:
        scored = rows.withColumn("score", F.lit(0.0))
    else:
        assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.3, seed=1, cacheNodeIds=False).fit(assembler.transform(training))
        scored = model.transform(assembler.transform(featured(rows, False))).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select(F.col("k").alias(key), "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
