"""Document fingerprints by a homomorphic multiset hash, in DataFrame operations only.

A text is a multiset of paragraph pieces: a paragraph ends at a line feed, and is cut further at sentence ends and after
200 characters, so that texts of one long paragraph can be compared too; the pieces hold every character of the text.
Each piece is hashed into a wide vector, and the fingerprint is the sum of these vectors, lane by lane:

* 8 lanes of 32 bits from four 64-bit hashes, modulo 2**32, for equality;
* the number of pieces, modulo 2**32;
* 128 lanes of +1 or -1 from the bits of two of the hashes, modulo 2**16. Their difference between two texts is a
  random projection of the difference between the two multisets, from which ``likeness`` estimates what they share.

Sums don't depend on the order of the pieces, and a piece can be added or taken away by adding or subtracting its vector
(``combine``). The estimate's standard deviation is below 0.09; equal fingerprints give exactly 1.

Defined cases: a null text is the empty text, which has no pieces and a fingerprint of zeros; the empty text is like the
empty text (1.0) and unlike any other (0.0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.common import with_ordered_bucket

PIECE = r"[^\n.!?]{0,200}[\n.!?]+|[^\n.!?]{1,200}"
HASHES, SIGNED = 4, 2
SUMS = 2 * HASHES + 1
LANES = 64 * SIGNED
#: Bits of a hash that are counted side by side in one long, and how many pieces that is good for: four counts of 16
#: bits for usual texts, two of 32 bits for any text.
PACKED = ((4, 0x0001000100010001, 1 << 15), (2, 0x0000000100000001, 1 << 31))


def lanes(text: Column) -> Column:
    """The fingerprint as an array: SUMS lanes modulo 2**32, then LANES signed lanes within 16 bits.

    Counts are kept in halves of 32 bits, so nothing overflows below 2**31 pieces, more than a string can hold.
    """
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))

    def of(hashes: list[Column]) -> Column:
        n = F.size(hashes[0]).cast("long")
        low = [F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + x.bitwiseAND(F.lit(0xFFFFFFFF))) for h in hashes]
        high = [F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + F.shiftrightunsigned(x, 32)) for h in hashes]
        sums = F.array(*[x.bitwiseAND(F.lit(0xFFFFFFFF)) for x in (n, *low, *high)])
        quad, pair = ([_bit_sums(h, n, fields, mask) for h in hashes[:SIGNED]] for fields, mask, _ in PACKED)
        return F.concat(sums, *(F.when(n < PACKED[0][2], q).otherwise(p) for q, p in zip(quad, pair)))

    def hashed(all_pieces: Column) -> Column:
        return F.struct(*(_hashes(all_pieces, k).alias(f"h{k}") for k in range(HASHES)))

    # Arrays of one element, so that pieces and hashes are computed once for all lanes.
    once = F.transform(F.array(pieces), hashed)
    return F.transform(once, lambda x: of([x[f"h{k}"] for k in range(HASHES)]))[0]


def _hashes(pieces: Column, seed: int) -> Column:
    return F.transform(pieces, lambda p: F.xxhash64(F.lit(seed), p))


def _bit_sums(hashes: Column, n: Column, fields: int, mask: int) -> Column:
    """64 lanes: for each bit of the hashes, those that have it set less those that don't."""
    width = 64 // fields
    counts = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.aggregate(
        hashes, F.lit(0).cast("long"), lambda a, x: a + F.call_function("shiftright", x, j).bitwiseAND(F.lit(mask))))

    def lane(at: int) -> Column:
        return F.transform(counts, lambda c: _signed16(
            2 * F.shiftrightunsigned(c, at * width).bitwiseAND(F.lit((1 << width) - 1)) - n))

    return F.concat(*(lane(at) for at in range(fields)))


def _signed16(x: Column) -> Column:
    return (x + 32768).bitwiseAND(F.lit(0xFFFF)) - 32768


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint after adding (or, with sign -1, taking away) the pieces that ``b`` is the fingerprint of."""
    return F.zip_with(
        F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), b,
        lambda s, y: F.when(s["i"] < SUMS, (s["x"] + sign * y).bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(_signed16(s["x"] + sign * y)),
    )


def text_form(fingerprint: Column) -> Column:
    """Hexadecimal: 8 digits for each sum, 4 for each signed lane."""
    return F.array_join(F.transform(fingerprint, lambda x, i: F.when(i < SUMS, F.lpad(F.hex(x), 8, "0")).otherwise(
        F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFF))), 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Shared part of two texts' pieces, from 0 to 1: twice the inner product over the sum of the squared norms."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(F.slice(x, SUMS + 1, LANES), F.slice(y, SUMS + 1, LANES), lambda p, q: p * q), F.lit(0).cast("long"), lambda s, v: s + v)
    norms = dot(a, a) + dot(b, b)
    estimate = F.when(norms > 0, 2.0 * dot(a, b) / norms).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), estimate)))


def with_next(docs: DataFrame, id_col: str, columns: list[str], text_col: str = "text") -> DataFrame:
    """Add ``next``: the struct of ``columns`` of the next row by ascending id; the last row meets the first.

    Rows are dealt out by ordered buckets of the id; a window over one bucket finds the next row, and the first rows of
    the following bucket are read again as its guests. Null ids come first; equal ids are ordered by ``columns``.
    """
    spark = docs.sparkSession
    placed = with_ordered_bucket(docs, id_col, "__bucket", text_col)
    firsts = sorted(tuple(r) for r in placed.groupBy("__bucket").agg(F.min(id_col)).collect())  # one row per bucket
    if not firsts:
        return docs.withColumn("next", F.struct(*columns))
    hosts = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    host = spark.createDataFrame([(first, host) for first, host in hosts], T.StructType([
        T.StructField("__first", docs.schema[id_col].dataType), T.StructField("__host", T.IntegerType())]))
    wrap = firsts[-1][0] if len(firsts) == 1 else None
    guests = docs.join(F.broadcast(host), F.col(id_col).eqNullSafe(F.col("__first"))).drop("__first").withColumnRenamed("__host", "__bucket")
    late = F.lit(2) if wrap is not None else F.when(F.col("__bucket") == firsts[-1][0], 2).otherwise(1)
    both = placed.withColumn("__guest", F.lit(0)).unionByName(guests.withColumn("__guest", late))
    order = W.partitionBy("__bucket").orderBy("__guest", F.col(id_col).asc_nulls_first(), *columns)
    led = both.withColumn("next", F.lead(F.struct(*columns)).over(order))
    return led.filter(F.col("__guest") == 0).drop("__guest", "__bucket")


def edited(text: Column, following: Column) -> Column:
    """The last half of the text (rounded down) replaced by as many characters from the front of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))
