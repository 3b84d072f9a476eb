"""License scan (operator 3): ordered signature rules, DataFrame functions only.

Texts without any keyword are set aside. On the others each rule whose keyword occurs, be it within a word, is tried; all
its matches become intervals. Intervals are swept from left to right, and one that lies within another of the same
or a higher priority is suppressed, of equal ones all but one. Everything happens within the row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.license_rules import rules
from tidemark.llm.shared import table

#: The phrases counted in any case, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
CONFIDENCE = {4: 1.0, 3: 0.9, 2: 0.75, 1: 0.5}
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PRIORITIES = (1, 2, 3, 4)
_DETECTION = "array<struct<start:int,end:int,priority:int,label:string>>"


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that later expressions read as a value; without the generator they would each compute it again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _running(items: Column, zero: Column, step, join, emit) -> Column:
    """``emit(state before the item, item)`` of every item of an array, the state folded by ``step`` and joined by ``join``.

    An array that grows item by item is copied each time, which costs the square of its length. So the items are cut into
    blocks of about the root of their number: the blocks' states are folded first, then each block from where it begins.
    """
    size = F.greatest(F.ceil(F.sqrt(F.size(items))).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), ((F.size(items) - 1) / size).cast("int")), lambda b: F.slice(items, b * size + 1, size))

    def within(begin: Column, block: Column) -> Column:
        none = F.struct(begin.alias("state"), F.filter(F.array(emit(zero, F.get(items, 0))), lambda x: F.lit(False)).alias("out"))
        return F.aggregate(block, none, lambda acc, d: F.struct(step(acc["state"], d).alias("state"), F.concat(acc["out"], F.array(emit(acc["state"], d))).alias("out")), lambda acc: acc["out"])

    def next_block(acc: Column, block: Column) -> Column:
        return F.struct(join(acc["state"], F.aggregate(block, zero, step)).alias("state"), F.concat(acc["begun"], F.array(F.struct(acc["state"].alias("begin"), block.alias("block")))).alias("begun"))

    first = F.filter(F.array(F.struct(zero.alias("begin"), items.alias("block"))), lambda x: F.lit(False))
    begun = F.aggregate(blocks, F.struct(zero.alias("state"), first.alias("begun")), next_block, lambda acc: acc["begun"])
    return F.when(F.size(items) > 0, F.flatten(F.transform(begun, lambda b: within(b["begin"], b["block"]))))


def _positions(words: Column, phrase: str) -> Column:
    """Starts of the phrase in the array of words."""
    parts = phrase.split(" ")
    starts = F.sequence(F.lit(0), F.size(words) - len(parts))
    full = F.filter(starts, lambda i: F.forall(F.array(*[F.get(words, i + k) == w for k, w in enumerate(parts)]), lambda ok: ok))
    return F.when(F.size(words) >= len(parts), full).otherwise(F.array().cast("array<int>"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: the id, ``n_words``, ``base`` (array of (start word, label)) and ``detections`` (array of
    start, end, priority, label; places in characters of the lower-cased text), both in order of place.

    Null is the empty text: no words, nothing found. Repeated rows and null ids stay; further columns are ignored.
    """
    source = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), source.alias("text"))
    # the full lower case has as many words as that of A-Z and all its keywords; without further bytes they are the same
    docs = _once(docs, "rough", F.lower("text"))
    keywords = F.array(*[F.lit(k) for k in sorted({k for _, _, k, _ in rules()} | {"license"})])
    docs = _once(docs, "present", F.filter(keywords, lambda k: F.contains(F.col("rough"), k)))
    docs = docs.withColumn("n_words", F.size(F.regexp_extract_all("rough", F.lit(_WORD), F.lit(0))).cast("long"))
    ascii_only = F.octet_length("text") == F.length("text")
    docs = _once(docs, "low", F.when(F.size("present") > 0, F.when(ascii_only, F.col("rough")).otherwise(F.translate("text", _UPPER, _LOWER)))).drop("text", "rough")
    named = F.array_contains("present", "license")
    docs = _once(docs, "words", F.when(named, F.regexp_extract_all("low", F.lit(_WORD), F.lit(0))).otherwise(F.array().cast("array<string>")))

    def labelled(phrase: str, label: str) -> Column:
        return F.transform(_positions(F.col("words"), phrase), lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))

    docs = docs.withColumn("base", F.array_sort(F.concat(*[labelled(p, label) for p, label in BASE.items()])))
    table_ = F.array(*[F.struct(F.lit(lb).alias("label"), F.lit(pr).alias("priority"), F.lit(kw).alias("keyword"), F.lit(rx).alias("pattern")) for lb, pr, kw, rx in rules()])
    hit = F.filter(table_, lambda r: F.array_contains(F.col("present"), r["keyword"]) & F.regexp_like(F.col("low"), r["pattern"]))
    docs = _once(docs, "hit", F.when(F.size("present") > 0, hit))
    parts = F.transform("hit", lambda r: F.struct(r["label"].alias("label"), r["priority"].alias("priority"), F.regexp_extract_all(F.col("low"), r["pattern"], F.lit(0)).alias("found"), F.split(F.col("low"), r["pattern"], -1).alias("between")))
    docs = _once(docs, "parts", parts)

    def gaps(p: Column) -> Column:
        """Per match: how far it lies behind the one before, and its length."""
        return F.transform(F.sequence(F.lit(0), F.size(p["found"]) - 1), lambda i: F.struct(F.length(F.get(p["between"], i)).alias("gap"), F.length(F.get(p["found"], i)).alias("size"), p["priority"].alias("priority"), p["label"].alias("label")))

    docs = _once(docs, "gaps", F.transform("parts", gaps))

    def places(one: Column) -> Column:
        def emit(before: Column, d: Column) -> Column:
            start = before["at"] + d["gap"]
            # by start, then the longer, then the higher priority
            return F.struct(start.alias("start"), (-start - d["size"]).alias("far"), (-d["priority"]).alias("rank"), d["label"].alias("label"))

        at = lambda acc, d: F.struct((acc["at"] + d["gap"] + d["size"]).alias("at"))
        return _running(one, F.struct(F.lit(0).alias("at")), at, lambda acc, block: F.struct((acc["at"] + block["at"]).alias("at")), emit)

    docs = _once(docs, "spans", F.array_sort(F.flatten(F.transform("gaps", places))))

    def reach(acc: Column, d: Column) -> Column:
        """to1 to to4: how far detections of at least that priority have reached."""
        return F.struct(*[F.when(-d["rank"] >= p, F.greatest(acc[f"to{p}"], -d["far"])).otherwise(acc[f"to{p}"]).alias(f"to{p}") for p in _PRIORITIES])

    def join(acc: Column, block: Column) -> Column:
        return F.struct(*[F.greatest(acc[f"to{p}"], block[f"to{p}"]).alias(f"to{p}") for p in _PRIORITIES])

    def judge(before: Column, d: Column) -> Column:
        priority = -d["rank"]
        to = F.when(priority == 4, before["to4"]).when(priority == 3, before["to3"]).when(priority == 2, before["to2"]).otherwise(before["to1"])
        return F.struct(d["start"].alias("start"), (-d["far"]).alias("end"), priority.alias("priority"), d["label"].alias("label"), (to < -d["far"]).alias("kept"))

    judged = _running(F.col("spans"), F.struct(*[F.lit(0).alias(f"to{p}") for p in _PRIORITIES]), reach, join, judge)
    kept = F.transform(F.filter(judged, lambda d: d["kept"]), lambda d: d.dropFields("kept"))
    kept = F.coalesce(kept.cast(_DETECTION), F.array().cast(_DETECTION))
    return _once(docs, "detections", kept).select(F.col("id").alias(id_col), "n_words", "base", "detections")


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses that every document names, by the base phrases and by the rules; ``score`` is the confidence of the best
    detection's priority. Null is the empty text, which names none; repeated rows stay."""
    found = scan(table(spark, sf_dir, "documents"))
    base, starts = F.col("base.label"), F.col("base.start")
    best = F.array_max("detections.priority")
    sure = F.when(best == 4, CONFIDENCE[4]).when(best == 3, CONFIDENCE[3]).when(best == 2, CONFIDENCE[2]).when(best == 1, CONFIDENCE[1])
    score = F.coalesce(sure, F.when(F.size("base") > 0, CONFIDENCE[3]), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        _joined(base).alias("base_labels"), _joined(F.concat(base, F.col("detections.label"))).alias("labels"), score.alias("score"),
    )
