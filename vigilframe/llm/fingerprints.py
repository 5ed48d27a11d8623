"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

For each of SAMPLES samples and each term of a text there are r and c from Gamma(2, 1) and b from U(0, 1), all from
hashes of term and sample. A term of weight w stands for t = floor(ln w / r + b), y = exp(r (t - b)) and
a = c / (y exp(r)); the sample is the (term, t) with the least a. Two texts take the same sample with the
probability of their generalised Jaccard similarity, sum of least weights over sum of greatest; terms are words and
weights their counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilframe.llm.common import WORD
from vigilframe.session import stage

#: Samples in a fingerprint, and hex digits kept of each: samples that differ look alike once in 65,536 times.
SAMPLES, DIGITS = 32, 4
#: ln a is kept in steps of 2^-22 so that it fits, with 16 bits of the sample, in one long that can be compared.
STEPS = float(1 << 22)


def _sample(term: Column, weights: list[Column], number: int) -> list[Column]:
    """For each weight, a long that orders by ln a and ends with 16 bits of (term, t)."""
    first, second = F.xxhash64(term, F.lit(2 * number)), F.xxhash64(term, F.lit(2 * number + 1))

    def uniform(value: Column, shift: int, bits: int) -> Column:
        return (F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(0.5)) / F.lit(float(1 << bits))

    r = -F.log(uniform(first, 32, 32) * uniform(first, 0, 32))
    ln_c = F.log(-F.log(uniform(second, 40, 24) * uniform(second, 16, 24)))
    b = uniform(second, 0, 16)
    found = []
    for ln_w in weights:
        t = F.floor(ln_w / r + b)
        ln_a = ln_c - r * (t - b) - r
        mark = F.xxhash64(first, t).bitwiseAND(F.lit(0xFFFF))
        found.append(F.shiftleft(F.floor(ln_a * F.lit(STEPS)), 16).bitwiseOR(mark))
    return found


def _signatures(occurrences: DataFrame, keys: list[str], marks: list[str]) -> DataFrame:
    """(keys, signature of each mark) from rows (keys, term, marks): marks say in which texts the occurrence counts."""
    counts = occurrences.groupBy(*keys, "term").agg(*[F.sum(mark).alias(mark) for mark in marks])
    logs = counts.select(*keys, "term", *[F.when(F.col(mark) > 0, F.log(F.col(mark).cast("double"))).alias(mark) for mark in marks])
    least = []
    for number in range(SAMPLES):
        for mark, value in zip(marks, _sample(F.col("term"), [F.col(mark) for mark in marks], number), strict=True):
            least.append(F.min(value).alias(f"{mark}_{number}"))
    return logs.groupBy(*keys).agg(*least).select(*keys, *[
        F.concat(*[F.lower(F.lpad(F.hex(F.col(f"{mark}_{number}").bitwiseAND(F.lit(0xFFFF))), DIGITS, "0")) for number in range(SAMPLES)]).alias(mark)
        for mark in marks
    ])


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def likeness(left: Column, right: Column) -> Column:
    """Share of samples that two fingerprints have in common, an estimate of their texts' generalised Jaccard similarity."""
    same = [(F.substring(left, 1 + DIGITS * number, DIGITS) == F.substring(right, 1 + DIGITS * number, DIGITS)).cast("int") for number in range(SAMPLES)]
    total = same[0]
    for one in same[1:]:
        total = total + one
    return total / F.lit(float(SAMPLES))


def fingerprints(docs: DataFrame, keys: list[str], text_columns: dict[str, str]) -> DataFrame:
    """(keys, a fingerprint per text) where ``text_columns`` maps the name of a fingerprint to the column of its text.

    Keys must tell the rows apart. If ``docs`` is already dealt out by keys, nothing is shuffled: a row's words are
    counted and sampled where the row is. Null and empty texts have the fingerprint of no samples, all zeros.
    """
    names = list(text_columns)
    marks = [f"mark_{place}" for place in range(len(names))]
    each = docs.select(*keys, *[words(F.coalesce(F.col(text_columns[name]), F.lit(""))).alias(f"words_{place}") for place, name in enumerate(names)])
    spread = each.select(
        *keys, *[F.size(f"words_{place}").alias(f"size_{place}") for place in range(len(names))],
        F.posexplode_outer(F.concat(*[F.col(f"words_{place}") for place in range(len(names))])).alias("place", "word"),
    )
    ends, last = [], F.lit(0)
    for place in range(len(names)):
        ends.append((last, last + F.col(f"size_{place}")))
        last = last + F.col(f"size_{place}")
    flagged = spread.select(*keys, F.xxhash64("word").alias("term"), *[
        ((F.col("place") >= low) & (F.col("place") < high)).cast("int").alias(mark) for (low, high), mark in zip(ends, marks, strict=True)
    ])
    blank = F.lit("0" * (SAMPLES * DIGITS))
    return _signatures(flagged, keys, marks).select(*keys, *[F.coalesce(mark, blank).alias(name) for mark, name in zip(marks, names, strict=True)])


def following(rows: DataFrame, order: list[str], carried: list[str]) -> DataFrame:
    """``rows`` with ``next``, a struct of the columns ``carried`` of the row that comes after in ``order``; the last has the first.

    Rows are dealt out by range and each range finds its own followers; the first row of each range, one row per
    range, serves the last row of the range before.
    """
    ranged = stage(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    item = F.struct(*[F.col(name) for name in (*order, *carried)])
    heads = ranged.groupBy("range").agg(F.min(item).alias("head"))
    by_range = Window.orderBy("range")
    wrapped = F.coalesce(F.lead("head").over(by_range), F.first("head").over(by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    after = stage(heads.select("range", wrapped.alias("after")))
    within = F.lead(item).over(Window.partitionBy("range").orderBy(*order))
    return ranged.withColumn("next", within).join(after, "range").withColumn("next", F.coalesce("next", "after")).drop("range", "after")


def edited_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like each other they and the next text's are.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document's, in ascending order of id (equal ids by a hash of the text, null ids first); after the last comes the
    first. Null texts count as empty; rows that repeat id and text follow one another and each has its row; an empty table
    gives an empty result; other columns of ``docs`` are not read.
    """
    text, doc_id = F.coalesce(F.col(text_column), F.lit("")), F.col(id_column).cast("long")
    # a key without nulls, so that joins and groups go by the same columns and rows are dealt out once
    rows = docs.select(
        doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-(1 << 63)).cast("long")).alias("key"),
        F.xxhash64(text, doc_id.isNull()).alias("tie"), text.alias("text"),
    )
    key = ["key", "tie"]
    sized = rows.select("doc_id", *key, F.char_length("text").alias("n_chars")).groupBy("doc_id", *key).agg(
        F.max("n_chars").cast("long").alias("n_chars"), F.count(F.lit(1)).alias("times"))
    order = stage(following(sized, key, []).select(
        "doc_id", *key, "n_chars", "times", F.floor(F.col("n_chars") / 4).cast("int").alias("cut"),
        F.col("next.key").alias("next_key"), F.col("next.tie").alias("next_tie"),
    ))
    texts = rows.groupBy(*key).agg(F.first("text").alias("text"))
    # what each text lends to the one before it: only that piece travels
    wanted = order.select(F.col("next_key").alias("key"), F.col("next_tie").alias("tie"), F.col("key").alias("for_key"), F.col("tie").alias("for_tie"), "cut")
    lent = texts.join(wanted, key).select(F.col("for_key").alias("key"), F.col("for_tie").alias("tie"), F.expr("substring(text, 1, cut)").alias("head"))
    whole = texts.join(order.select(*key, "cut", "n_chars", "times"), key).join(lent, key)
    # of rows that repeat id and text, all but the last are followed by their own text
    kinds = F.when(F.col("times") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    kept = F.expr("substring(text, 1, cast(n_chars - cut AS int))")
    both = whole.select(*key, "text", "head", "cut", "n_chars", F.explode(kinds).alias("repeat")).select(
        *key, "repeat", "text",
        F.concat(kept, F.when(F.col("repeat") == 1, F.expr("substring(text, 1, cut)")).otherwise(F.col("head"))).alias("edited"),
    )
    marked = fingerprints(both, [*key, "repeat"], {"fingerprint": "text", "edited_fingerprint": "edited"})
    digests = both.select(*key, "repeat", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    found = stage(marked.join(digests, [*key, "repeat"]))
    last = found.where("repeat = 0").select(F.col("key").alias("next_key"), F.col("tie").alias("next_tie"), F.col("fingerprint").alias("following"))
    placed = found.join(order.drop("cut"), key).join(last, ["next_key", "next_tie"])
    result = placed.withColumn("next_fingerprint", F.when(F.col("repeat") == 1, F.col("fingerprint")).otherwise(F.col("following")))
    times = F.when(F.col("repeat") == 1, F.col("times") - 1).otherwise(F.lit(1).cast("long"))
    return result.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times))).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
