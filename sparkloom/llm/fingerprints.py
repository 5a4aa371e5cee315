"""Document fingerprints by winnowing, in DataFrame expressions only.

Every run of K words is hashed from the hashes of its words; of every W consecutive hashes the least is
chosen, the rightmost among equals, and kept with its position. Two texts that share a run of W + K - 1
words therefore share a fingerprint. A hash and its position are one long, so that the least long is the
least hash at the rightmost position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, W = 4, 8
#: Rows of a bucket of neighbouring doc_ids, and the most buckets of equal width (they are counted on the driver).
BUCKET_ROWS, MOST_BUCKETS = 500, 65_536
_SPACE = " \t\n\x0b\f\r"
_LOW = (1 << 31) - 1


def word_hashes(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_SPACE))
    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: F.xxhash64(w)))


def grams(words: Column, k: int = K) -> Column:
    """Hash and position of each run of k words, in one long: 31 bits of hash, then how far from the end of the range the position is."""
    last = F.greatest(F.size(words) - k, F.lit(0))
    gram = lambda i: F.shiftleft(F.xxhash64(*(F.get(words, i + j) for j in range(k))).bitwiseAND(_LOW), 32).bitwiseOR(F.lit(_LOW) - i.cast("long"))
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), last), gram))


def winnow(gram: Column, w: int = W) -> Column:
    """The chosen longs, in the order of their positions."""
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size(gram) - w + 1, F.lit(1))), lambda i: F.array_min(F.slice(gram, i, F.lit(w))))
    return F.when(F.size(gram) == 0, gram).otherwise(F.array_distinct(windows))


def add_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`, the fingerprint of the column `text` as an array of longs (null text: empty array)."""
    rest = [F.col(f"`{c}`") for c in df.columns]
    step = df.select(*rest, word_hashes(F.coalesce(F.col(text), F.lit(""))).alias(out))
    step = step.select(*rest, grams(F.col(out)).alias(out))
    return step.select(*rest, winnow(F.col(out)).alias(out))


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, 32)))


def positions(fingerprint: Column) -> Column:
    return F.transform(fingerprint, lambda x: F.lit(_LOW) - x.bitwiseAND(_LOW))


def as_text(fingerprint: Column) -> Column:
    """hash:position of each chosen gram, in hexadecimal and decimal figures, joined by blanks."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, 32))), F.lit(":"), (F.lit(_LOW) - x.bitwiseAND(_LOW)).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two fingerprints; 1 where both are empty."""
    x, y = hashes(a), hashes(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def _dealt(rows: DataFrame) -> tuple[DataFrame, list[tuple[int, object]]]:
    """`rows` with a column bucket, ranges of doc_id (null: a range of its own), and the ranges' numbers and first doc_ids in order.

    Ranges are of equal width at first; where ids lie in clumps, a range with too many rows is cut again between its
    own ends, until each holds few or a single doc_id. Bounds are computed in doubles, so ids may span all 64
    bits; they are monotonic, which is all that ranges need. At most MOST_BUCKETS / 8 ranges are cut at a time.
    """
    spark, ids = rows.sparkSession, rows.select("doc_id")
    low, high, n = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    size = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    most = max(20 * BUCKET_ROWS, 8 * (n // size))
    place = lambda low, width: F.floor((F.col("doc_id").cast("double") - low) / width).cast("int")
    first = F.lit(0) if low is None else place(F.lit(float(low)), F.lit(max((float(high) - float(low)) / size, 1.0)))
    steps = [lambda df: df.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(first))]
    while True:
        dealt = ids
        for step in steps:
            dealt = step(dealt)
        cells = [tuple(r) for r in dealt.groupBy("bucket").agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).collect()]
        full = [(b, float(lo), max((float(hi) - float(lo)) / (c // BUCKET_ROWS), 1.0), c // BUCKET_ROWS + 2) for b, lo, hi, c in cells if c > most and lo is not None and float(lo) < float(hi)]
        if not full:
            break
        own, at = [], max(b for b, *_ in cells) + 1
        for b, lo, width, parts in full:
            own.append((b, lo, width, at))
            at += parts
        cuts = spark.createDataFrame(own, "bucket int, low double, width double, at int")
        steps.append(lambda df, cuts=cuts: df.join(F.broadcast(cuts), "bucket", "left").withColumn("bucket", F.when(F.col("at").isNull(), F.col("bucket")).otherwise(F.col("at") + place(F.col("low"), F.col("width")))).drop("low", "width", "at"))
    for step in steps:
        rows = step(rows)
    return rows, [(b, lo) for b, lo, _, _ in sorted(cells, key=lambda c: (c[1] is not None, c[1]))]


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """doc_id, text (null: empty), next_text, bucket, wrap, extra; and the window over which rows follow each other.

    Rows are in the order of doc_id, then of text; after the last comes the first. They are dealt to ranges of
    doc_id, and each range also gets the first rows of the range after it, marked extra, so that one
    exchange is enough and no task orders the whole table. Drop extra rows after the last use of the window.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt, cells = _dealt(rows)
    order = Window.partitionBy("bucket").orderBy("wrap", "doc_id", "text")
    if cells:
        before = [(first, cells[k - 1][0], int(k == 0)) for k, (_, first) in enumerate(cells)]  # at most MOST_BUCKETS and those cut anew
        places = docs.sparkSession.createDataFrame(before, f"first_id {docs.schema['doc_id'].dataType.simpleString()}, bucket int, wrap int")
        doubled = rows.join(F.broadcast(places), F.col("doc_id").eqNullSafe(F.col("first_id"))).select("doc_id", "text", "bucket", "wrap", F.lit(1).alias("extra"))
        dealt = dealt.select("doc_id", "text", "bucket", F.lit(0).alias("wrap"), F.lit(0).alias("extra")).union(doubled)
    else:
        dealt = dealt.withColumn("wrap", F.lit(0)).withColumn("extra", F.lit(0))
    return dealt.withColumn("next_text", F.lead("text").over(order)), order


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited, fp, edited_fp (arrays of longs), near_edited, near_next of each row of `docs`.

    edited is the text whose last quarter gives way to the beginning of the next row's. A null text counts as
    empty, an empty one has an empty fingerprint and is wholly like another. A text of any length is fingerprinted
    whole, as one array of its hashes. Rows of one doc_id follow each other in the order of their texts, nulls
    first, in one task; the only row follows itself. Of equal hashes in a window the rightmost is chosen. Other
    columns are ignored whatever their names; an empty table gives no rows.
    """
    rows, order = with_next(docs)
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - quarter), F.substring("next_text", F.lit(1), quarter))
    rows = rows.select("doc_id", "bucket", "wrap", "extra", "text", F.when(F.col("extra") == 0, edited).otherwise(F.lit("")).alias("edited"))
    rows = add_fingerprint(rows, "text", "fp").withColumn("next_fp", F.lead("fp").over(order)).filter("extra = 0")
    rows = add_fingerprint(rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "edited", "fp", "next_fp"), "edited", "edited_fp")
    return rows.select("doc_id", "n_chars", "edited", "fp", "edited_fp", likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
