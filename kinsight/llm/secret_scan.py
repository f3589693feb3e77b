"""Operator 7: secret scans through a trigram inverted index. DataFrame functions only.

From each rule's regular expression a Boolean query over mandatory trigrams is
derived. The postings (trigram, document) of the trigrams in use are built over
all documents, intersected per document as bit masks, and the rules' queries
leave candidate (rule, document) pairs. Only candidates are verified with the
regular expression; rules without a mandatory trigram scan every document.

Positions come from the text between matches: splitting by the expression and
listing its matches gives alternating pieces whose lengths add up.

Defined results: a null text counts as empty; a document without a span has
counts of 0, an empty span list and the hash of the empty string; repeated rows
each give a row; other columns of the input are ignored. Documents are told
apart by id and content hash, so texts that share an id don't mix.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsight.llm.common import ascii_lower, written
from kinsight.llm.trigram_query import Query, trigram_query

#: Trigrams held by one mask column.
WORD = 62


@dataclass(frozen=True)
class SecretRule:
    """A match counts if the given group has at least so many characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


# The base rules, in the order in which they are listed.
BASE_RULES = (
    SecretRule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    SecretRule("access", r"AKIA[A-Z0-9]{12,}"),
    SecretRule("hex", r"[0-9a-f]{32,}"),
)
#: Further rules, after the base ones.
MORE_RULES = (
    SecretRule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    SecretRule("forge", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    SecretRule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)


def vocabulary(queries: list[Query]) -> list[str]:
    return sorted({t for q in queries for clause in q for option in clause for t in option})


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """The inverted index of the given trigrams: term (its number), doc_id, content."""
    lowered = docs.select("doc_id", "content", ascii_lower(F.col("text")).alias("lowered"))
    held = F.array_compact(F.array(*[F.when(F.col("lowered").contains(t), F.lit(i)) for i, t in enumerate(terms)]))
    return lowered.select("doc_id", "content", F.explode(held).alias("term"))


def meets(query: Query, terms: list[str]) -> Column:
    """Whether a document's masks meet a query."""
    number = {t: i for i, t in enumerate(terms)}

    def all_of(option: frozenset[str]) -> Column:
        words: dict[int, int] = {}
        for t in option:
            words[number[t] // WORD] = words.get(number[t] // WORD, 0) | 1 << number[t] % WORD
        return reduce(Column.__and__, [F.col(f"mask{w}").bitwiseAND(F.lit(m).cast("long")) == m for w, m in words.items()])

    clauses = [reduce(Column.__or__, [all_of(o) for o in clause]) for clause in query]
    return F.coalesce(reduce(Column.__and__, clauses), F.lit(False))


def candidates(docs: DataFrame, rules: list[SecretRule]) -> tuple[DataFrame, list[Column]]:
    """doc_id, content and masks of documents with postings; per rule the condition over the masks."""
    queries = [trigram_query(r.regex) for r in rules]
    terms = vocabulary(queries)
    n_words = -(-len(terms) // WORD)
    masks = [
        F.bit_or(F.when((F.col("term") / WORD).cast("int") == w, F.expr(f"shiftleft(1L, term % {WORD})")).otherwise(F.lit(0).cast("long"))).alias(f"mask{w}")
        for w in range(n_words)
    ]
    intersected = postings(docs, terms).groupBy("doc_id", "content").agg(*masks) if terms else None
    return intersected, [meets(q, terms) if q else F.lit(True) for q in queries]


def matches(text: Column, rule: SecretRule, order: int) -> Column:
    """Array of each match: rule, number, characters before it since the last match, its length, whether it counts."""
    between, whole = F.split(text, rule.regex, -1), F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else whole
    zipped = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("b"), whole.alias("w"), held.alias("h"))
    return F.transform(zipped, lambda x, i: F.struct(F.lit(order).alias("rule"), i.alias("i"), F.length(x["b"]).alias("gap"), F.length(x["w"]).alias("length"), (F.length(x["h"]) >= rule.least).alias("counts")))


def scan(docs: DataFrame, rules: tuple[SecretRule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, content and spans: array of (start, rule, end), sorted; one row per document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("content"))
    index, conditions = candidates(keyed, list(rules))
    if index is not None:
        index = index.withColumnsRenamed({"doc_id": "p_id", "content": "p_content"})
        keyed = keyed.join(index, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("content") == F.col("p_content")), "left")
    none = F.array().cast("array<struct<rule:int,i:int,gap:int,length:int,counts:boolean>>")
    found = F.concat(*[F.when(c, matches(F.col("text"), r, k)).otherwise(none) for k, (r, c) in enumerate(zip(rules, conditions))])
    # the row number is fixed once written
    scanned = written(keyed.select(F.monotonically_increasing_id().alias("row"), "doc_id", "content", found.alias("found")), "secret-matches")
    upto = Window.partitionBy("row", "rule").orderBy("i")
    spread = scanned.where(F.size("found") > 0).select("row", F.explode("found").alias("m")).select("row", "m.*")
    placed = spread.withColumn("end", F.sum((F.col("gap") + F.col("length")).cast("long")).over(upto)).where("counts")
    spans = placed.groupBy("row").agg(F.sort_array(F.collect_list(F.struct((F.col("end") - F.col("length")).alias("start"), "rule", "end"))).alias("spans"))
    return scanned.select("row", "doc_id", "content").join(spans, "row", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,rule:int,end:bigint>>")))


def summarise(scanned: DataFrame, rules: tuple[SecretRule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """Counts and digests of the spans."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    base = F.filter("spans", lambda s: s["rule"] < len(BASE_RULES))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rule"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(order: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rule"] == order)).cast("long")

    return scanned.select("doc_id", *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[SecretRule, ...] = BASE_RULES + MORE_RULES, marker: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, each stretch of spans in the text replaced by the marker."""
    spans = scan(docs, rules, id_col, text_col).where(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("content").alias("_content"), "spans").dropDuplicates(["_id", "_content"])
    # spans that touch or overlap become one stretch; pieces are what lies between stretches
    start = F.aggregate("_spans", F.struct(F.lit(-1).cast("long").alias("end"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out")), lambda acc, s: F.when(
        s["start"] <= acc["end"],
        F.struct(F.greatest(acc["end"], s["end"]).alias("end"), F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(F.struct(F.element_at(acc["out"], -1)["start"].alias("start"), F.greatest(acc["end"], s["end"]).alias("end")))).alias("out")),
    ).otherwise(F.struct(s["end"].alias("end"), F.concat(acc["out"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))).alias("out"))), lambda acc: acc["out"])
    met = docs.join(spans.withColumnRenamed("spans", "_spans"), F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_content")), "left")
    met = met.withColumn("_held", F.when(F.col("_spans").isNotNull(), start))
    text = F.col(text_col)
    pieces = F.transform("_held", lambda s, i: F.concat(text.substr((F.when(i > 0, F.element_at("_held", i)["end"]).otherwise(0) + 1).cast("int"), (s["start"] - F.when(i > 0, F.element_at("_held", i)["end"]).otherwise(0)).cast("int")), F.lit(marker)))
    last = text.substr((F.element_at("_held", -1)["end"] + 1).cast("int"), F.length(text))
    masked = F.when(F.col("_held").isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), last))
    return met.withColumn(text_col, masked).select(docs.columns)
