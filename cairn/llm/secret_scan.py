"""Secret scans: a trigram inverted index picks each rule's candidates, the rule's regular expression decides.

Only DataFrame expressions. The index holds every trigram of bytes of the texts (folded to lower case), whatever the
rules ask for, so later rules can use it too. Documents are numbered in blocks of 64 and a posting is a block's 64-bit
map, so that postings are intersected 64 documents at a time. A rule's trigram query is a choice of trigram sets; a
document is a candidate if its postings cover one of them. Rules without mandatory trigrams scan every text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_few, drop, materialize
from .trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """A kind of secret: pattern (Java and Python syntax alike), and the least length of one of its groups.

    holds: for rules whose matches are mostly too short, what a text must hold for any to be kept (else all are tried).
    """

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    holds: str = ""


#: The three base kinds.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32, holds=r"[0-9a-f]{32}"),
)

#: Published token formats: source hosts, chat services, payment keys, private keys, signed web tokens.
EXTRA = (
    Rule("git", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("pay", r"[sr]k_live_[A-Za-z0-9]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

#: Bytes of text whose trigrams are listed at a time; longer texts are cut into overlapping pieces.
PIECE = 1 << 16
#: Candidates that are broadcast to the texts at most (some 100 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _queries(rules: tuple[Rule, ...]) -> dict[str, list[frozenset[str]]]:
    return {r.kind: trigram_query(r.pattern) for r in rules}


def _key_hash(key: str) -> Column:
    return F.xxhash64(F.col(key))


def postings(docs: DataFrame, text: str = "text", key: str = "doc_id", piece: int = PIECE) -> DataFrame:
    """The index, written to the shared folder: trigram, block, bits (of the block's documents that hold it), kh.

    The directory is part of it: for each document a row with an empty trigram, its own number for a block, and its
    key's hash as kh. Postings are sorted by trigram, so a query reads the parts of the files that hold its trigrams.
    A null text has no trigrams. Blocks are runs of rows of one input partition, so that most of a posting is put
    together before the shuffle. Places become rows inside generated code; no list of them outgrows a piece.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("n"), _key_hash(key).alias("kh"), F.encode(F.lower(F.coalesce(F.col(text), F.lit(""))), "UTF-8").alias("b"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.octet_length("b") - 3, F.lit(0)).cast("long"), F.lit(piece).cast("long"))
    pieces = F.transform(starts, lambda at: F.substring(F.col("b"), (at + 1).cast("int"), F.lit(piece + 2)))
    cut = numbered.select("n", "kh", F.posexplode(pieces).alias("p", "b"))
    # place 0 of a document's first piece stands for the document itself
    first, last = F.least("p", F.lit(1)), F.octet_length("b") - 2
    placed = cut.select("n", "kh", "b", F.explode(F.sequence(first, F.greatest(first, last))).alias("i"))
    itself = F.col("i") == 0
    rows = placed.select(
        F.when(itself, F.lit("")).otherwise(F.substring("b", F.col("i"), F.lit(3)).cast("string")).alias("trigram"),
        F.when(itself, F.col("n")).otherwise(F.expr("shiftright(n, 6)")).alias("block"),
        F.expr("shiftleft(1L, cast(n & 63 as int))").alias("bit"),
        F.when(itself, F.col("kh")).alias("kh"),
    )
    merged = rows.groupBy("trigram", "block").agg(F.bit_or("bit").alias("bits"), F.max("kh").alias("kh"))
    return materialize(merged.sortWithinPartitions("trigram", "block"), "trigrams")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Columns kh and kinds: the rules whose trigram query a document's postings satisfy, by its key's hash."""
    clauses = [(kind, n, t, len(way)) for kind, q in _queries(rules).items() for n, way in enumerate(q) for t in way]
    terms = index.sparkSession.createDataFrame(clauses, "kind string, way int, trigram string, size int")  # bounded by the rules
    asked = index.filter(F.col("trigram").isin(sorted({t for _, _, t, _ in clauses}))).select("trigram", "block", "bits")
    met = asked.join(F.broadcast(terms), "trigram").groupBy("block", "kind", "way", "size").agg(F.count("*").alias("n"), F.expr("bit_and(bits)").alias("bits"))
    whole = met.filter("n = size and bits <> 0").groupBy("block", "kind").agg(F.bit_or("bits").alias("bits"))
    each = whole.select("kind", "block", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).filter("bits & shiftleft(1L, i) <> 0").select("kind", F.expr("block * 64 + i").alias("block"))
    return each.join(index.filter("trigram = ''").select("block", "kh"), "block").groupBy("kh").agg(F.collect_set("kind").alias("kinds"))


def _length(x: Column) -> Column:
    return F.char_length(x)


def matches(text: Column, rule: Rule) -> Column:
    """All kept matches of a rule: array of (start, end) in code points, leftmost and non-overlapping."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    sized = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), _length) if rule.group else F.transform(whole, _length)
    between = F.transform(F.split(text, rule.pattern, -1), _length)
    parts = F.arrays_zip(between.alias("gap"), F.transform(whole, _length).alias("n"), sized.alias("size"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + part["gap"]
        end = start + part["n"]
        kept = F.when(part["size"] >= rule.least, F.array_append(state["out"], F.struct(start.alias("start"), end.alias("end")))).otherwise(state["out"])
        return F.struct(end.alias("at"), kept.alias("out"))

    # the last part has a gap, but no match
    return F.aggregate(F.slice(parts, 1, F.size(whole)), empty, step, lambda state: state["out"])


def _labelled(rank: int, kind: str):
    return lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA, text: str = "text", key: str = "doc_id", also: tuple[str, ...] = (), spans: str = "spans", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Columns key, also, and spans: array of (start, rank, kind, end), by start, then in the rules' order.

    One row per input row; a null text counts as empty; rows with equal or null keys are candidates together, but
    each text is verified by itself, so their spans are their own. Columns not named in also are left out. Up to
    broadcast_rows candidates go to the texts, which then aren't shuffled; more of them meet the texts by key.
    """
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), *(F.col(c).alias(f"also_{c}") for c in also))
    indexed = tuple(r for r in rules if _queries((r,))[r.kind])
    if indexed:
        index = postings(rows, "t", "k")
        picked = materialize(candidates(index, indexed), "candidates")
        drop(index)
        seen = rows.join(broadcast_if_few(picked, broadcast_rows), _key_hash("k") == F.col("kh"), "left")
    else:
        seen = rows.withColumn("kinds", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    parts = []
    for rank, rule in enumerate(rules):
        may = F.array_contains("kinds", rule.kind) if rule in indexed else F.lit(True)
        if rule.holds:
            may = may & F.col("t").rlike(rule.holds)
        parts.append(F.transform(F.when(may, matches(F.col("t"), rule)).otherwise(none), _labelled(rank, rule.kind)))
    return seen.select(F.col("k").alias(key), *(F.col(f"also_{c}").alias(c) for c in also), F.array_sort(F.concat(*parts)).alias(spans))


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA, text: str = "text", key: str = "doc_id", by: str = "[SECRET]") -> DataFrame:
    """docs with every span of a text replaced by `by`; overlapping spans are replaced once. Null texts stay null."""
    others = tuple(c for c in docs.columns if c not in (key, text))
    found = scan(docs.withColumn("__kept", F.col(text)), rules, text, key, (*others, "__kept"), "__spans")

    def step(state: Column, span: Column) -> Column:
        inside = span["start"] < state["at"]
        head = F.when(inside, F.lit("")).otherwise(F.concat(F.substring(F.col("__kept"), state["at"] + 1, span["start"] - state["at"]), F.lit(by)))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.concat(state["out"], head).alias("out"))

    clean = F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(F.col("__kept"), s["at"] + 1, F.char_length("__kept"))))
    new = F.when(F.size("__spans") > 0, clean).otherwise(F.col("__kept"))
    return found.select(*(new.alias(c) if c == text else F.col(c) for c in docs.columns))
