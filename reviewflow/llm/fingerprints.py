"""Document fingerprints by one-permutation MinHash.

Every word shingle is hashed once. The low bits of the hash name one of BINS
bins, the rest is its value; a bin keeps its least value. An empty bin takes the
value of the first filled bin on a pseudo-random walk through all bins that is
the same for every document (optimal densification). Of each value the low BITS
bits are stored, packed; likeness corrects the share of equal bins for chance.
Work is an expression over one row: nothing is exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewflow.session import stored

BINS = 256
BITS = 4  # one hexadecimal digit a bin
SHINGLE = 5
PROBES = 12  # steps of the walk tried one by one before it is solved
_VALUE = 33  # bits of a value; 2**32 marks an empty bin
_PACK = 16  # bins in a long


def _walks() -> tuple[list[int], list[int], list[int]]:
    """Per bin the start of its walk, its odd step, and the step's inverse modulo BINS."""
    starts, steps = [], []
    state = 0x2545F491
    for _ in range(BINS):
        for out in (starts, steps):
            state = (state * 1103515245 + 12345) % (1 << 31)
            out.append((state >> 9) % BINS)
    steps = [s | 1 for s in steps]
    return starts, steps, [pow(s, -1, BINS) for s in steps]


def _rolled(words: Column, size: int) -> Column:
    """The hashes of the shingles of an array of word hashes."""
    shingle = lambda i: F.xxhash64(*[F.element_at(words, (i + j).cast("int")) for j in range(size)])
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), shingle)).when(
        F.size(words) > 0, F.array(F.xxhash64(F.array_join(words.cast("array<string>"), " ")))
    )


def _first_of_bin(entries: str) -> Column:
    bin_of = lambda x: F.shiftright(x, _VALUE)
    return F.filter(entries, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col(entries), i - 1))))


def fingerprint(df: DataFrame, texts: dict[str, str], size: int = SHINGLE) -> DataFrame:
    """``df`` with, per entry of ``texts`` (new column: text column), the packed fingerprint.

    It is an array of longs, 16 bins each, and empty for a text without words. A
    text with fewer than ``size`` words has one shingle, its words. Words are
    separated by white space (0x20, 0x09-0x0D) and compared in lower case.
    """
    kept = df.columns
    starts, steps, inverses = (F.array(*[F.lit(x) for x in xs]) for xs in _walks())
    # Each step is a projection of its own and names its input twice, so that no
    # array is computed again for each element.
    step: dict[str, Column] = {}
    for new, text in texts.items():
        words = F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+")
        step[f"_{new}_w"] = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))
    df = df.withColumns(step)
    for new in texts:
        rolled = _rolled(F.col(f"_{new}_w"), size)
        step[f"_{new}_h"] = F.transform(rolled, lambda h: F.shiftleft(h.bitwiseAND(F.lit(BINS - 1)), _VALUE).bitwiseOR(
            F.shiftrightunsigned(h, 32)
        ))
    df = df.withColumns({k: v for k, v in step.items() if k.endswith("_h")})
    blanks = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.shiftleft(j.cast("long"), _VALUE).bitwiseOR(F.lit(1 << 32)))
    df = df.withColumns({f"_{n}_o": F.when(F.size(f"_{n}_h") > 0, F.sort_array(F.concat(f"_{n}_h", blanks))) for n in texts})
    # The first entry of each bin: its least value, or the mark of an empty bin.
    df = df.withColumns({f"_{n}_f": F.when(F.size(f"_{n}_o") > 0, _first_of_bin(f"_{n}_o")) for n in texts})
    value = lambda x: F.when(x.bitwiseAND(F.lit(1 << 32)) == 0, x.bitwiseAND(F.lit((1 << 32) - 1)))
    df = df.withColumns({f"_{n}_v": F.when(F.size(f"_{n}_f") > 0, F.transform(f"_{n}_f", value)) for n in texts})
    filled = lambda n: F.filter(
        F.transform(f"_{n}_v", lambda x, j: F.when(x.isNotNull(), j)), lambda j: j.isNotNull()
    )
    df = df.withColumns({f"_{n}_e": F.when(F.size(f"_{n}_v") > 0, filled(n)) for n in texts})

    def densified(n: str) -> Column:
        values, full = F.col(f"_{n}_v"), F.col(f"_{n}_e")

        def fill(x, i):
            start, move, back = F.get(starts, i), F.get(steps, i), F.get(inverses, i)
            tries = [F.get(values, (start + r * move) % BINS) for r in range(PROBES)]
            # The step at which the walk meets each filled bin; the least one wins.
            met = F.array_min(F.transform(full, lambda j: F.pmod((j - start) * back, F.lit(BINS)) * BINS + j))
            return F.coalesce(x, *tries, F.get(values, (met % BINS).cast("int")))

        return F.transform(values, fill)

    df = df.withColumns({f"_{n}_d": F.when(F.size(f"_{n}_e") > 0, densified(n)) for n in texts})
    packed = lambda n: F.transform(
        F.sequence(F.lit(0), F.lit(BINS // _PACK - 1)),
        lambda b: F.aggregate(
            F.slice(F.col(f"_{n}_d"), (b * _PACK + 1).cast("int"), F.lit(_PACK)), F.lit(0).cast("long"),
            lambda a, v: F.shiftleft(a, BITS).bitwiseOR(v.bitwiseAND(F.lit((1 << BITS) - 1))),
        ),
    )
    df = df.withColumns({n: F.when(F.size(f"_{n}_d") > 0, packed(n)).otherwise(F.array().cast("array<long>")) for n in texts})
    return df.select(*kept, *texts)


def as_text(packed: Column) -> Column:
    """One hexadecimal digit per bin; empty for a text without words."""
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), F.lit(_PACK), F.lit("0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, 0 to 1.

    Bins of unlike texts agree by chance in one of 2**BITS cases, for which the
    share of equal bins is corrected. Two texts without words are alike, one
    without words is unlike any other.
    """
    low = F.lit(0x1111111111111111)

    def equal(x, y):
        d = x.bitwiseXOR(y)
        any_bit = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseOR(F.shiftrightunsigned(d, 3))
        return _PACK - F.bit_count(any_bit.bitwiseAND(low))

    same = F.aggregate(F.zip_with(a, b, equal), F.lit(0), lambda s, v: s + v) / F.lit(float(BINS))
    chance = 1 / (1 << BITS)
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .otherwise(F.greatest((same - chance) / (1 - chance), F.lit(0.0)))
    )


def next_documents(docs: DataFrame) -> DataFrame:
    """The rows with next_key in place of at: the key of the next by descending ``at``; after the last, the first.

    Rows are sorted in ranges, each of which needs only the first row of the range
    that follows it; no task sees all of them. ``docs`` holds key and at, in which
    no two rows are equal; other columns are kept.
    """
    ranged = docs.repartitionByRange(F.col("at").desc()).withColumn("range", F.spark_partition_id())
    ranged = stored(ranged, "id-ranges")  # keeps the ranges fixed
    heads = ranged.groupBy("range").agg(F.max_by("key", "at").alias("head"))  # a row per partition
    order = Window.orderBy("range")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("range", F.coalesce(F.lead("head").over(order), F.first("head").over(whole)).alias("after"))
    inside = F.lead("key").over(Window.partitionBy("range").orderBy(F.col("at").desc()))
    return (
        ranged.withColumn("inside", inside).join(F.broadcast(heads), "range")
        .withColumn("next_key", F.coalesce("inside", "after")).select(*[c for c in docs.columns if c != "at"], "next_key")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, both fingerprints (text and packed), near_edited, near_next.

    The edited text is the text whose last third (rounded down) of code points is
    replaced by as many, or all, first ones of the next document's, in descending
    doc_id; after the last comes the first. A null text is empty. Rows that share a
    doc_id follow each other by descending SHA-256 of their texts, rows without a
    doc_id in the same way after all others; copies come in any order, which
    shows in no value. Other columns are not read.

    Texts are shuffled once by key; what travels to a neighbour is the part that it
    needs. The key is the doc_id, or a row number where ids repeat or lack.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    repeated = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    if stored(repeated, "id-repeats").isEmpty():
        rows, at = rows.withColumn("key", F.col("doc_id")), F.col("doc_id")
    else:
        rows = stored(rows.withColumn("key", F.monotonically_increasing_id()), "numbered-rows")
        at = F.struct("doc_id", F.sha2("text", 256), "key")
    follow = next_documents(rows.select("key", "doc_id", at.alias("at"), F.length("text").cast("long").alias("n_chars")))
    follow = stored(follow, "next-ids")
    # Both joins read the same two columns, so that one shuffle of the texts serves both.
    rows = rows.select("key", "text")
    wanted = follow.select(F.col("next_key").alias("key"), F.col("key").alias("for_key"), F.expr("n_chars div 3").cast("int").alias("k"))
    given = rows.join(wanted.hint("shuffle_hash"), "key").select(
        F.col("for_key").alias("key"), F.left("text", F.col("k")).alias("given"), F.col("k")
    )
    both = rows.join(given, "key").select(
        "key", "text",
        F.concat(F.left("text", F.length("text") - F.col("k")), "given").alias("edited"),
    )
    both = both.withColumn("edited_sha256", F.sha2("edited", 256))
    made = fingerprint(both, {"packed": "text", "edited_packed": "edited"}).drop("text", "edited")
    made = stored(made.join(follow, "key"), "fingerprints")
    after = made.select(F.col("key").alias("next_key"), F.col("packed").alias("next_packed"))
    return made.join(after, "next_key").select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("packed")).alias("fingerprint"),
        as_text(F.col("edited_packed")).alias("edited_fingerprint"), "packed", "edited_packed",
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"),
        likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )
