"""Document fingerprints by consistent weighted sampling.

The weighted set of a text is its words with their counts. For each of SAMPLES
positions every word draws r and c from Gamma(2, 1) and b from (0, 1), all from
hashes of the word and the position, and for its weight w takes t = floor(ln w / r + b)
and a = c / exp(r (t - b + 1)). The word with the smallest a is the sample, kept
with its t as a 24-bit hash. Two texts agree at a position with probability equal
to their generalised Jaccard similarity, sum of minima over sum of maxima.

Only DataFrame functions are used. Two fingerprints of one document, of its
text and of an edited text, share one pass: words are counted in both, so the
draws of a word are made once. A sample is packed into one integer (a in the upper
bits), so a minimum per position is a plain combined aggregate without sorting.
Documents are dealt out by ranges of their ids; the text moves once, and all
later steps of a document stay in its partition.

Null text counts as empty; a text without words has an empty fingerprint, whose
likeness is 1 to another empty one and 0 to any other. Rows with a null id take no
part. Of rows that share an id, each counts, in the order of their texts. Other
columns are not read, so names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.registry import query, table
from panelcast.sources.stage import write_stage

SAMPLES = 32
#: Documents in a range of ids, on average.
RANGE_ROWS = 1000
#: Stands for the document itself among its words; no word holds a line feed.
SELF = "\n"


def _uniform(h: Column, shift: int, bits: int) -> Column:
    return (F.shiftrightunsigned(h, shift).bitwiseAND((1 << bits) - 1) + F.lit(0.5)) / float(1 << bits)


def packed_sample(term: Column, log_weight: Column, position: int) -> Column:
    """Rank of a word's draw at a position in the upper 39 bits, hash of (word, t) in the lower 24; null without weight."""
    one, two = F.xxhash64(term, F.lit(2 * position)), F.xxhash64(term, F.lit(2 * position + 1))
    r = -F.log(_uniform(one, 43, 21) * _uniform(one, 22, 21))
    b = _uniform(one, 1, 21)
    log_c = F.log(-F.log(_uniform(two, 32, 32) * _uniform(two, 0, 32)))
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t - b + 1)
    # With 21 and 32-bit draws, log_a lies between -53 - ln w and 4 - ln w.
    place = ((log_a + 128) * float(1 << 31)).cast("long")
    return F.shiftleft(place, 24).bitwiseOR(F.xxhash64(term, t).bitwiseAND((1 << 24) - 1))


def words(text: Column) -> Column:
    """Words between blanks and the control characters 9 to 13."""
    return F.split(text, "[\\x20\\x09-\\x0D]+", -1)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two fingerprints, given as arrays of samples."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(equal / F.size(a))


def with_edits(docs: DataFrame) -> DataFrame:
    """Per row of (id, text): place (``part``, ``nth``), place of the next row by descending id, and the edited text.

    The edit puts the first floor(n / 2) code points of the next document, or all of them,
    in place of the last floor(n / 2) code points.
    """
    stats = docs.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).head()
    low, high, n = (stats[0] or 0), (stats[1] or 0), stats[2]
    width = min(1 << 62, max(1, -(-(high - low + 1) * RANGE_ROWS // max(1, n))))
    docs = docs.withColumn("part", F.floor((F.col("id").cast("double") - F.lit(float(low))) / F.lit(float(width))).cast("long"))
    # One row per range: its first document, which follows the last one of the range above.
    tops = docs.groupBy("part").agg(F.max(F.struct("id", "text")).alias("top"))
    tops = write_stage(tops, "fingerprint-ranges")
    down = Window.orderBy(F.desc("part"))  # a row per range
    chain = tops.select("part", F.coalesce(F.lead("part").over(down), F.first("part").over(down)).alias("next_part"))
    first = tops.select(F.col("part").alias("next_part"), F.col("top.text").alias("top_text"))
    chain = write_stage(chain.join(first, "next_part"), "fingerprint-chain")
    order = Window.partitionBy("part").orderBy(F.desc("id"), F.desc("text"))
    rows = docs.select("*", F.row_number().over(order).alias("nth"), F.lead("text").over(order).alias("next_text"))
    rows = rows.join(chain, "part")
    last = F.col("next_text").isNull()
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.left("text", size - half), F.left(F.when(last, F.col("top_text")).otherwise(F.col("next_text")), half))
    return rows.select(
        "id", "part", "nth", F.when(last, F.col("next_part")).otherwise(F.col("part")).alias("next_part"),
        F.when(last, 1).otherwise(F.col("nth") + 1).alias("next_nth"), size.alias("n_chars"), "text", edited.alias("edited"),
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_chars``, ``edited_sha256``, the two fingerprints, ``near_edited`` and ``near_next``."""
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("id is not null")
    rows = with_edits(docs)
    sha = F.sha2("edited", 256)
    quarters = [F.conv(F.substring(sha, 16 * k + 1, 16), 16, -10).cast("long").alias(f"s{k}") for k in range(4)]
    facts = ["id", "next_part", "next_nth", "n_chars", "s0", "s1", "s2", "s3"]
    rows = rows.select("part", "nth", *facts[:4], *quarters, F.array(F.struct(F.lit(1).alias("o"), F.lit(0).alias("e"), F.concat(F.array(F.lit(SELF)), words(F.col("text"))).alias("w")), F.struct(F.lit(0).alias("o"), F.lit(1).alias("e"), words(F.col("edited")).alias("w"))).alias("texts"))
    rows = rows.select("part", "nth", *facts, F.explode("texts").alias("x")).select("part", "nth", *facts, "x.o", "x.e", F.explode("x.w").alias("word"))
    mine = F.col("word") == SELF
    rows = rows.where("word <> ''").select(
        "part", "nth", "o", "e", F.when(~mine, F.xxhash64("word")).alias("term"), *[F.when(mine, F.col(c)).alias(c) for c in facts]
    )
    counts = rows.groupBy("part", "nth", "term").agg(F.sum("o").alias("o"), F.sum("e").alias("e"), *[F.max(c).alias(c) for c in facts])
    known = F.col("term").isNotNull()
    counts = counts.select("part", "nth", "term", *facts, F.log(F.when(known, F.col("o"))).alias("lo"), F.log(F.when(known, F.col("e"))).alias("le"))
    samples = [F.min(packed_sample(F.col("term"), F.col(w), k)).alias(f"{w}{k}") for k in range(SAMPLES) for w in ("lo", "le")]
    each = counts.groupBy("part", "nth").agg(*[F.max(c).alias(c) for c in facts], *samples)

    def signature(w: str) -> Column:
        low = [F.col(f"{w}{k}").bitwiseAND((1 << 24) - 1).cast("int") for k in range(SAMPLES)]
        return F.when(F.col(f"{w}0").isNull(), F.array().cast("array<int>")).otherwise(F.array(*low))

    each = write_stage(each.select("part", "nth", *facts, signature("lo").alias("own"), signature("le").alias("other")), "fingerprints")
    following = each.select(F.col("part").alias("next_part"), F.col("nth").alias("next_nth"), F.col("own").alias("following"))

    def text_of(samples: str) -> Column:
        return F.array_join(F.transform(samples, lambda x: F.lower(F.lpad(F.hex(x), 6, "0"))), "")

    hexes = [F.lower(F.lpad(F.hex(f"s{k}"), 16, "0")) for k in range(4)]
    return each.join(following, ["next_part", "next_nth"], "left").select(
        F.col("id").alias(id_col), F.col("n_chars").cast("long").alias("n_chars"), F.concat(*hexes).alias("edited_sha256"),
        text_of("own").alias("fingerprint"), text_of("other").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


@query("op3_fingerprints")
def op3_fingerprints(spark, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likenesses."""
    return fingerprints(table(spark, folder, "documents"))
