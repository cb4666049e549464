"""License scans by ordered signature rules, in DataFrame functions alone.

A text's words (runs of letters, digits and characters beyond ASCII, A-Z in lower case) are joined by
single spaces, with one space at either end; rules (license_rules.py) are regular expressions over that form and match
whole words. A rule is tried only if its keyword occurs. Detections are ordered by
start, longest first, then priority, and one that lies within a kept one of the same or a better
priority is suppressed. Everything happens within a row: no shuffle, no join, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytefacts.llm import common
from bytefacts.llm.license_rules import HAND, commons

#: Phrases that count as base places, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Put before matches; no word holds it.
MARK = "\x01"
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str  # over normalised words; matches whole words
    priority: int  # smaller is better
    confidence: float


def rules() -> list[Rule]:
    """The ordered rules: those written by hand, then those of Creative Commons by part and version."""
    return [Rule(*r) for r in [*HAND, *commons()]]


#: Every rule's pattern and every base phrase holds one of these, so a text without any is done.
STEMS = ("licen", "commons", "cc", "domain", "reserved", "confidential", "unauthorized", "permission", "redistribution", "endorse", "advertising", "altered", "warranty", "foundation", "misrepresented", "openssl", "cryptographic", "evil", "jpeg", "invariant", "compile")


def gated(text: Column) -> Column:
    """May any rule match? Plain searches, which cost far less than one regular expression over every text."""
    low = F.lower(text)
    out = low.contains(STEMS[0])
    for stem in STEMS[1:]:
        out = out | low.contains(stem)
    return out


def word_count(text: Column) -> Column:
    """Words of a text: gaps between runs of other characters, with one such run put at either end."""
    return (F.size(F.split(F.concat(F.lit(" "), text, F.lit(" ")), NOT_WORD, -1)) - 2).cast("long")


def normalised(text: Column) -> Column:
    """Words in lower case, each with one space before it, and one at the end."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, NOT_WORD, " ")), F.lit(" "))


def matches(norm: Column, pattern: Column | str, tag: list[Column]) -> Column:
    """Array of structs (start, end, *tag), in words of norm, of every match of pattern as whole words. Linear in the text.

    A mark is put before every match; a match starts at the word that has it.
    """
    rx = F.concat(F.lit("(?<= )(?:"), pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(")(?= )"))
    words = F.split(F.regexp_replace(norm, rx, F.lit(f"{MARK}$0")), " ", -1)
    starts = F.filter(F.transform(words, lambda w, i: F.when(w.startswith(MARK), i - 1)), lambda i: i.isNotNull())
    return F.zip_with(starts, F.regexp_extract_all(norm, rx, F.lit(0)), lambda i, hit: F.struct(i.alias("start"), (i + F.size(F.split(hit, " ", -1))).alias("end"), *tag))


def surviving(found: Column) -> Column:
    """Of detections (start, end, priority, label, confidence): those not within a kept one of the same or a better priority."""
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("to"), d["priority"].alias("priority"), d["label"].alias("label"), d["confidence"].alias("confidence"))))
    # ends[p]: how far the kept detections of priority p or better reach; all kept ones start no later
    levels = 4
    kept = F.aggregate(
        ordered,
        F.struct(F.array(*[F.lit(-1)] * levels).alias("ends"), F.array().cast("array<struct<label:string,confidence:double>>").alias("kept")),
        lambda acc, d: F.when(F.element_at(acc["ends"], d["priority"] + 1) >= -d["to"], acc).otherwise(
            F.struct(
                F.transform(acc["ends"], lambda e, p: F.when(p >= d["priority"], F.greatest(e, -d["to"])).otherwise(e)).alias("ends"),
                F.when(F.exists(acc["kept"], lambda k: (k["label"] == d["label"]) & (k["confidence"] >= d["confidence"])), acc["kept"]).otherwise(F.concat(acc["kept"], F.array(F.struct(d["label"].alias("label"), d["confidence"].alias("confidence"))))).alias("kept"),
            )
        ),
        lambda acc: acc["kept"],
    )
    return kept


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the best confidence of a surviving detection, 0 if there is none (a base place has 0.8).
    Null texts count as empty (no words, empty labels); null ids and repeated rows stay; extra columns are
    ignored; texts are scanned whole.
    """
    all_rules = rules()
    docs = common.documents(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    table = F.array(*(F.struct(F.lit(r.label).alias("label"), F.lit(f" {r.keyword}").alias("keyword"), F.lit(r.pattern).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(r.confidence).alias("confidence")) for r in all_rules))
    # texts without any keyword keep a null here and take no part in what follows
    norm = F.when(gated(F.col("text")), normalised(F.col("text")))
    rows = docs.select("doc_id", word_count(F.col("text")).alias("n_words"), norm.alias("norm"))
    base = F.concat(*(F.when(F.col("norm").contains(f" {p} "), matches(F.col("norm"), p, [F.lit(label).alias("label")])).otherwise(F.array().cast("array<struct<start:int,end:int,label:string>>")) for p, label in BASE.items()))
    likely = F.filter(table, lambda r: F.col("norm").contains(r["keyword"]))
    found = F.flatten(F.transform(likely, lambda r: matches(F.col("norm"), r["pattern"], [r["priority"].alias("priority"), r["label"].alias("label"), r["confidence"].alias("confidence")])))
    rows = rows.withColumn("base", F.when(F.col("norm").isNotNull(), base)).withColumn("kept", F.when(F.col("norm").isNotNull(), surviving(found)))
    starts = F.transform("base", lambda m: m["start"])
    some = F.size("base") > 0
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda m: m["label"])))
    labels = F.array_sort(F.array_union(base_labels, F.transform("kept", lambda k: k["label"])))
    best = F.greatest(F.coalesce(F.array_max(F.transform("kept", lambda k: k["confidence"])), F.lit(0.0)), F.when(some, 0.8).otherwise(0.0))
    return rows.select(
        "doc_id",
        "n_words",
        F.when(some, F.size("base")).otherwise(0).cast("long").alias("n_base"),
        F.when(some, F.array_min(starts)).cast("long").alias("first_word"),
        F.when(some, F.array_max(starts)).cast("long").alias("last_word"),
        F.coalesce(F.array_join(base_labels, ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join(labels, ","), F.lit("")).alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(common.read(spark, sf_dir, "documents"))
