"""Personal data in the bot's log lines, and the words that give it away (DataFrame functions only).

A line is a row with ``line_id`` and ``value`` (its text, as ``spark.read.text`` gives it).  Patterns find the protected
entities.  A word near an entity tells of it what their co-occurrence in the corpus says: the pointwise mutual
information of both, as a share of the information of the entity itself.  1 means that the word names the entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.session import materialize

# Kinds in their order, and their patterns.  Repetitions are possessive where nothing after them can take
# their characters; a match begins after the last one or where no run of its first characters is cut, as any leftmost match does.
KINDS = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9]++(?:[\x20-][0-9]++)*+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
# What a text of a kind must hold.
HINTS = ["@", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", r"[0-9](?:[\x20-]?[0-9]){11}", r"\+[0-9]"]
GENERAL, REMOVED = len(KINDS), len(KINDS) + 1
NAMES = [k[0] for k in KINDS] + ["general", "removed"]
TERM = r"\p{L}{4,}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPAN = "struct<start: bigint, kind: int, end: bigint, value: bigint>"
NEAR = "struct<start: bigint, kind: int, end: bigint, value: bigint, before: string, cut_before: boolean, after: string, cut_after: boolean>"


def _valid(match: Column, kind: int) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == 1:
        part = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(match, r"\."), lambda x: F.when(F.length(part(x)) > 3, F.lit(False)).otherwise(F.coalesce(part(x).try_cast("int"), F.lit(0)) <= 255))
    if kind == 2:
        return F.when(F.length(digits).between(12, 19), F.call_function("luhn_check", digits)).otherwise(False)
    return F.length(digits).between(9, 15) if kind == 3 else F.lit(True)


def _found(text: Column, kind: int, width: int) -> Column:
    """Spans of one kind with up to ``width`` characters on either side, as far as the next match of the kind."""
    pattern = KINDS[kind][1]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    rows = F.arrays_zip(whole.alias("m"), F.slice(between, F.lit(1), F.size(whole)).alias("p"), F.slice(between, F.lit(2), F.size(whole)).alias("n"))
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{NEAR}>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        span = F.struct(
            start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.xxhash64(F.lit(kind), x["m"]).alias("value"), F.substring(x["p"], -width, width).alias("before"),
            (F.length(x["p"]) > width).alias("cut_before"), F.substring(x["n"], 1, width).alias("after"), (F.length(x["n"]) > width).alias("cut_after"),
        )
        return F.struct(end.alias("at"), F.when(_valid(x["m"], kind), F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.when(text.rlike(HINTS[kind]), F.aggregate(rows, empty, step, lambda acc: acc["spans"])).otherwise(empty["spans"])


def entities(lines: DataFrame, line_id: str = "line_id", value: str = "value", width: int = 40) -> DataFrame:
    """Stored rows ``row_id, line_id, near, filled``: one per line, with its protected entities by place and kind and what stands around them."""
    t = lines.select(F.col(line_id).alias("line_id"), F.coalesce(F.col(value).cast("string"), F.lit("")).alias("text"))
    near = F.array_sort(F.concat(*[_found(F.col("text"), k, width) for k in range(len(KINDS))]))
    return materialize(t.select(F.monotonically_increasing_id().alias("row_id"), "line_id", near.alias("near"), (F.length("text") > 0).alias("filled")))


def lowered(text: Column) -> Column:
    """The text with the letters A-Z in lower case."""
    return F.translate(text, UPPER, LOWER)


def _terms(window: Column, at: Column, cut_first: Column | bool, cut_last: Column | bool) -> Column:
    """Whole words of a window with their places; a word at an edge where the text was cut is none."""
    whole, between = F.regexp_extract_all(window, F.lit(TERM), F.lit(0)), F.split(window, TERM, -1)
    rows = F.arrays_zip(whole.alias("m"), F.slice(between, F.lit(1), F.size(whole)).alias("p"))
    kind = "array<struct<start: bigint, end: bigint, term: string>>"
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("terms"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        kept = ~(F.lit(cut_first) & (start == 0)) & ~(F.lit(cut_last) & (end == F.length(window)))
        term = F.struct((at + start).alias("start"), (at + end).alias("end"), lowered(x["m"]).alias("term"))
        return F.struct(end.alias("at"), F.when(kept, F.array_append(acc["terms"], term)).otherwise(acc["terms"]).alias("terms"))

    return F.aggregate(rows, empty, step, lambda acc: acc["terms"])


def contexts(base: DataFrame) -> DataFrame:
    """``row_id, value, start, end, term``: the words around each entity."""
    s = base.select("row_id", F.explode("near").alias("s")).select("row_id", "s.*")
    before = _terms(F.col("before"), F.col("start") - F.length("before"), F.col("cut_before"), False)
    after = _terms(F.col("after"), F.col("end"), False, F.col("cut_after"))
    return s.select("row_id", "value", F.explode(F.concat(before, after)).alias("t")).select("row_id", "value", "t.start", "t.end", "t.term")


def disclosures(base: DataFrame, lines: DataFrame, value: str = "value", together: int = 2) -> DataFrame:
    """``value, term, joint, disclosure`` of every entity and word that meet in at least ``together`` lines.

    Disclosure is ln(joint N / (e t)) / ln(N / e), where N, e and t are the lines that are not empty, those of the
    entity and those with the word; 0 where the entity is in all lines.
    """
    joint = contexts(base).select("value", "term", "row_id").distinct().groupBy("value", "term").agg(F.count(F.lit(1)).alias("joint"))
    joint = materialize(joint.filter(F.col("joint") >= together))
    once = base.select("row_id", F.explode(F.array_distinct(F.transform("near", lambda s: s["value"]))).alias("value"))
    carriers = once.groupBy("value").agg(F.count(F.lit(1)).alias("carriers"))
    words = lines.select(F.explode(F.array_distinct(F.regexp_extract_all(lowered(F.col(value).cast("string")), F.lit(TERM), F.lit(0)))).alias("term"))
    spread = words.groupBy("term").agg(F.count(F.lit(1)).alias("spread"))  # counted before any join, so that words are never shuffled one by one
    every = base.agg(F.count_if("filled").cast("double").alias("lines"))
    met = joint.join(carriers, "value").join(spread, "term").crossJoin(F.broadcast(every))
    own = F.ln(F.col("lines") / F.col("carriers"))
    told = F.ln(F.col("joint") * F.col("lines") / (F.col("carriers").cast("double") * F.col("spread")))
    return met.select("value", "term", "joint", F.round(F.when(own > 0, told / own).otherwise(0.0), 9).alias("disclosure"))


def scan(lines: DataFrame, line_id: str = "line_id", value: str = "value", general: float = 0.5, remove: float = 0.8, together: int = 2, width: int = 40, salts: int = 16) -> DataFrame:
    """``line_id, row_id, base, told, spans`` of every line: protected entities, words that disclose them, both in order.

    Spans are (start, kind, end) in code points, end exclusive.  A word of at least four letters within ``width``
    characters of an entity, met with it in at least ``together`` lines, is to be generalised from a disclosure of
    ``general`` on and removed from ``remove`` on.  Entities are text that matches a kind's pattern, leftmost first and
    apart, and holds: parts of an address up to 255, 12 to 19 digits with a right check digit, 9 to 15 digits of a number.
    Null and empty texts have no spans; every input row gives one row, repeated ones too, and repeated lines count as
    lines; an empty table stays empty; further columns are ignored.
    """
    base = entities(lines, line_id, value, width)
    found = disclosures(base, lines, value, together).filter(F.col("disclosure") >= general)
    kind = F.when(F.col("disclosure") >= remove, REMOVED).otherwise(GENERAL)
    telling = materialize(found.select("value", "term", kind.cast("int").alias("kind")))
    # An entity of many lines is dealt over the salts.
    salted = telling.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    near = contexts(base).withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int"))
    span = F.struct("start", "kind", "end", F.lit(None).cast("bigint").alias("value"))
    told = near.join(salted, ["value", "term", "salt"]).groupBy("row_id").agg(F.array_sort(F.collect_set(span)).cast(f"array<{SPAN}>").alias("told"))
    empty = F.array().cast(f"array<{SPAN}>")
    slim = F.transform("near", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    both = base.select("row_id", "line_id", slim.alias("base")).join(told, "row_id", "left").withColumn("told", F.coalesce("told", empty))
    return both.withColumn("spans", F.array_sort(F.concat("base", "told"))).select("line_id", "row_id", "base", "told", "spans")


def written(spans: Column) -> Column:
    """``kind:start:end`` comma-joined."""
    names = F.array(*[F.lit(n) for n in NAMES])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])))


def sanitised(value: Column, spans: Column) -> Column:
    """The text with spans, in order of start, replaced: entities and general words by their kind, removed words by nothing; overlapping spans once."""
    masks = F.array(*[F.lit(f"[{n.upper()}]") for n in NAMES[:-2]], F.lit("[WORD]"), F.lit(""))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        kept = F.concat(acc["out"], F.substring(value, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.element_at(masks, s["kind"] + 1))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, kept).otherwise(acc["out"]).alias("out"))

    tail = lambda acc: F.concat(acc["out"], F.substring(value, acc["at"].cast("int") + 1, F.length(value)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, tail)).otherwise(value)
