"""Document fingerprints by one-permutation MinHash with optimal densification. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stacklight.llm.common import ascii_lower, table, written

#: 2**BIN_BITS bins; each keeps the LOW low-order bits of its smallest shingle hash.
BIN_BITS, LOW = 8, 8
BINS = 1 << BIN_BITS
WORDS = 5
#: Draws for an empty bin before the remaining bins are ranked at once.
DRAWS = 16
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of a group whose successors one task finds, about.
GROUP = 1024
RANGES = 256


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once."""
    return F.transform(F.array(value), then)[0]


def _bin(x: Column) -> Column:
    return F.shiftright(x, 64 - BIN_BITS) + F.lit(BINS // 2)


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << LOW) - 1).cast("long"))


def shingles(text: Column, words: int = WORDS) -> Column:
    """array<long>: hashes of the text's word shingles; a shorter text is one shingle, a blank text has none."""

    def of(h: Column) -> Column:
        n = F.size(h)
        runs = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))
        return F.when(n >= words, runs).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))

    clean = F.btrim(ascii_lower(text), F.lit(BLANKS))
    split = F.when(F.length(clean) > 0, F.split(clean, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))
    return let(F.transform(split, lambda w: F.xxhash64(w)), of)


def _firsts(hashes: Column) -> Column:
    """The smallest hash of each bin that has one. Bins are the hashes' leading bits, so these lead their runs in sorted order."""
    return let(F.sort_array(hashes), lambda s: F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1)))))


def _densified(firsts: Column) -> Column:
    """Each bin's low bits. An empty bin copies a bin that has a hash, drawn by hashes of (empty bin, attempt) alone, so two
    texts draw alike; each empty bin draws for itself, as optimal densification asks."""

    def fill(bins: Column) -> Column:
        sparse = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.get(firsts, (F.array_position(bins, b.cast("long")) - 1).cast("int")))

        def filled(d: Column) -> Column:
            def one(x: Column, b: Column) -> Column:
                draws = [F.get(d, F.pmod(F.xxhash64(b, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(DRAWS)]
                mask = F.lit(~((1 << LOW) - 1)).cast("long")
                rest = F.array_min(F.transform(firsts, lambda y: F.xxhash64(b, _bin(y)).bitwiseAND(mask).bitwiseOR(_low(y))))
                return _low(F.coalesce(x, *draws, rest)).cast("short")

            return F.transform(d, one)

        return let(sparse, filled)

    return let(F.transform(firsts, _bin), fill)


def minhash(text: Column) -> Column:
    """array<short> of BINS values, or an empty array for a text without words."""

    def dense(f: Column) -> Column:
        n = F.size(f)
        return F.when(n == BINS, F.transform(f, lambda x: _low(x).cast("short"))).when(n > 0, _densified(f)).otherwise(F.array().cast("array<short>"))

    return let(shingles(text), lambda h: let(_firsts(h), dense))


def packed(values: Column) -> Column:
    """The values as one string of hex digits, LOW bits each."""
    digits = LOW // 4
    return F.lower(F.array_join(F.transform(values, lambda x: F.substring(F.hex(x.cast("long") + F.lit(1 << LOW)), 2, digits)), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance: the share of equal values, less the share that 2**-LOW of the others match by chance.
    Two texts without words resemble each other fully, one without words no other."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-LOW
    raw = (same / F.lit(float(BINS)) - chance) / (1 - chance)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), raw))


def with_first_of_next(docs: DataFrame) -> DataFrame:
    """`docs` (id long, text string) with grp and extra: rows are dealt to groups of ascending id, and each group gets one
    more row (extra = 1), the first of the group after it; the last group gets the very first row.

    Groups come from the ids' quantiles and even cuts between them; only RANGES bounds reach the driver.
    """
    d = docs.withColumn("th", F.xxhash64("text"))
    marks = [i / RANGES for i in range(1, RANGES)]
    n, low, high, bounds = d.agg(F.count("*"), F.min("id"), F.max("id"), F.percentile_approx("id", marks, 10000)).first()
    bounds = sorted({low or 0, *(bounds or [])})
    ends = [*bounds[1:], (high or 0) + 1]
    per_range = max(1, n // max(1, len(bounds)) // GROUP)
    steps = F.array(*[F.lit(max(1, -(-(b - a) // per_range))).cast("long") for a, b in zip(bounds, ends)])
    starts = F.array(*[F.lit(b).cast("long") for b in bounds])
    rng = F.when(F.col("id").isNull(), F.lit(-1)).otherwise(F.size(F.filter(starts, lambda b: b <= F.col("id"))) - 1)
    d = d.withColumn("rng", rng).withColumn("sub", F.when(F.col("rng") < 0, F.lit(0)).otherwise(F.floor((F.col("id") - F.get(starts, F.col("rng"))) / F.get(steps, F.col("rng")))).cast("long"))
    heads = d.groupBy("rng", "sub").agg(F.min(F.struct("id", "th")).alias("head"))
    # the group before: within a range by its rows, between the at most RANGES + 1 ranges by a window over those
    ranges = heads.groupBy("rng").agg(F.max("sub").alias("last"))
    around = ranges.select("rng", F.lag(F.struct("rng", "last")).over(Window.orderBy("rng")).alias("before"))
    final = ranges.agg(F.max(F.struct("rng", "last")).alias("final"))
    before = heads.withColumn("prev", F.lag("sub").over(Window.partitionBy("rng").orderBy("sub")))
    before = before.join(F.broadcast(around), "rng").crossJoin(F.broadcast(final))  # RANGES + 1 rows and one row
    to = F.when(F.col("prev").isNotNull(), F.struct(F.col("rng").alias("rng"), F.col("prev").alias("last"))).otherwise(F.coalesce("before", "final"))
    # written, so that its size is known before the texts would be shuffled to meet it
    before = written(before.select(F.col("head.id").alias("hid"), F.col("head.th").alias("hth"), to.alias("to")), "heads")
    extra = d.join(before, F.col("id").eqNullSafe(F.col("hid")) & (F.col("th") == F.col("hth"))).select("id", "text", "th", F.col("to.rng").alias("rng"), F.col("to.last").alias("sub"))
    extra = extra.dropDuplicates(["rng", "sub"])
    return d.withColumn("extra", F.lit(0)).unionByName(extra.withColumn("extra", F.lit(1)))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text, edited, n_chars, values, edited_values, near_edited, near_next) of each row of `docs`.

    edited: the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document by
    ascending id; after the last comes the first, and a single row follows itself. Null texts are empty. Rows
    without an id come before all others; rows that share an id are ordered by a hash of their text, and equal rows follow each
    other. Very long texts take time in proportion to n log n; an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_first_of_next(base).withColumn("values", minhash(F.col("text")))
    w = Window.partitionBy("rng", "sub").orderBy("extra", "id", "th")
    rows = rows.withColumns({"next_text": F.lead("text").over(w), "next_values": F.lead("values").over(w)}).where("extra = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"), "values", "next_values").withColumn("edited_values", minhash(F.col("edited")))
    return rows.select(
        F.col("id").alias(id_col), "text", "edited", "n_chars", "values", "edited_values",
        likeness(F.col("values"), F.col("edited_values")).alias("near_edited"), likeness(F.col("values"), F.col("next_values")).alias("near_next"),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edited_fingerprints(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("values")).alias("fingerprint"), packed(F.col("edited_values")).alias("edited_fingerprint"), "near_edited", "near_next",
    )
