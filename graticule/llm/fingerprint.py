"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is a bag of words, each weighted by its number of occurrences. For each of `SAMPLES` samples and each word,
two Gamma(2, 1) variates r and c and a uniform b are derived from a hash of word and sample alone. With weight w,

    t = floor(ln w / r + b),    ln a = ln c - r (t - b + 1),

and the word with the least a, together with its t, is the document's sample. Two documents agree in a sample with a
probability equal to their generalised Jaccard similarity, the sum of the lesser weights over the sum of the greater
ones; the share of agreeing samples estimates it. The variates come from tables of quantiles at equal probabilities; a
and (word, t) are packed in one long number, so that a sample is a grouped minimum.

The text and its edited form (its end replaced by the beginning of the next document) are fingerprinted in one pass: the
rows are dealt by doc_id once, and words, weights and samples follow from there without another exchange.

Edge cases: a null or empty text, or one of white space only, has no words and the fingerprint of zeros; two such
fingerprints are alike (1). Documents follow each other by distinct doc_id; where rows repeat a doc_id, the text of the
least hash stands for them as the next document, and every row is returned. Equal rows of one id are fingerprinted once and
written as often as they occur; an id of more than `HOT` rows is dealt in parts by the hash of the text, so that one id
(or null) may hold any share of the rows. A very long text is split into words where it's read; a row holds no more than
one text and its edited form. A null doc_id counts as the least long number, which itself isn't told from null. A single
document is its own next one. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graticule.llm.common import cut, maybe_broadcast, repeated

#: Samples of a fingerprint, and how many of them are taken from one row at once.
SAMPLES = 64
AT_ONCE = 4
#: Stands for a missing doc_id.
NO_ID = -(2**63)
#: Rows of one doc_id that are dealt together.
HOT = 4096
#: Entries of a quantile table.
QUANTILES = 4096
_SPACE = r"[\x20\x09-\x0D]+"


def gamma_quantiles(spark: SparkSession, n: int, of: Callable[[Column], Column]) -> Column:
    """A function of the quantiles of Gamma(2, 1) at (i + 1/2) / n, as an array in a scalar subquery.

    The distribution function is 1 - (1 + x) exp(-x), which is inverted by bisection. As a subquery, the table is read by
    position in compiled code and isn't spelled out in plans.
    """
    want = (F.col("id") + 0.5) / float(n)
    middle = lambda s: (s["low"] + s["high"]) / 2

    def halve(s: Column, _: Column) -> Column:
        below = 1 - (1 + middle(s)) * F.exp(-middle(s)) < want
        return F.struct(F.when(below, middle(s)).otherwise(s["low"]).alias("low"), F.when(below, s["high"]).otherwise(middle(s)).alias("high"))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(60.0).alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, halve, middle)
    rows = spark.range(0, n, 1, 1).select("id", of(found).alias("v"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "v"))), lambda x: x["v"]).alias("table")).scalar()


def next_ids(keys: DataFrame) -> DataFrame:
    """(key, next_key) for every distinct key in ascending order, the last followed by the first.

    The keys are range-partitioned; each range is numbered in itself and then linked to the range that follows.
    """
    ranged = cut(keys.distinct().repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    heads = ranged.groupBy("part").agg(F.min("key").alias("head"))
    following = F.lead("head").over(Window.orderBy("part"))
    heads = heads.select("part", F.coalesce(following, F.min("head").over(Window.partitionBy())).alias("beyond"))
    inside = F.lead("key").over(Window.partitionBy("part").orderBy("key"))
    linked = ranged.withColumn("after", inside).join(F.broadcast(heads), "part")  # heads: one row for each range
    return linked.select("key", F.coalesce("after", "beyond").alias("next_key"))


def signatures(texts: DataFrame, sides: list[str], partition: list[str], samples: int = SAMPLES) -> DataFrame:
    """For each row, named by the columns `partition`, one array of samples for each of its text columns `sides`.

    Where the rows are dealt by (some of) the columns `partition`, nothing is exchanged. Rows without any word are left out.
    """
    columns = [f"_w{i}" for i in range(len(sides))]
    each = texts.select(*partition, F.explode(F.array(*[F.struct(F.col(s).alias("text"), *[F.lit(int(s == o)).cast("long").alias(c) for o, c in zip(sides, columns, strict=True)]) for s in sides])).alias("_side"))
    words = each.select(*partition, *[F.col(f"_side.{c}").alias(c) for c in columns], F.explode(F.split("_side.text", _SPACE)).alias("_word")).where("_word <> ''")
    words = words.select(*partition, F.xxhash64("_word").alias("_h"), *columns)
    weighed = words.groupBy(*partition, "_h").agg(*[F.sum(c).alias(c) for c in columns])
    logs = [F.when(F.col(c) > 0, F.log(F.col(c).cast("double"))).alias(f"_l{i}") for i, c in enumerate(columns)]
    rounds = samples // AT_ONCE
    rows = weighed.select(*partition, "_h", *logs, F.explode(F.array(*[F.lit(i) for i in range(rounds)])).alias("_round"))

    spark = texts.sparkSession
    rate, inverse, log_c = (gamma_quantiles(spark, QUANTILES, of) for of in (lambda x: x, lambda x: 1 / x, F.log))
    mask = QUANTILES - 1
    bits = QUANTILES.bit_length() - 1
    hashes = [F.xxhash64("_h", F.col("_round") * AT_ONCE + j).alias(f"_x{j}") for j in range(AT_ONCE)]
    rows = rows.select(*partition, "_round", "_h", *[f"_l{i}" for i in range(len(sides))], *hashes)
    least = []
    for j in range(AT_ONCE):
        x = F.col(f"_x{j}")
        at_r = x.bitwiseAND(F.lit(mask)).cast("int")
        at_c = F.shiftright(x, bits).bitwiseAND(F.lit(mask)).cast("int")
        b = (F.shiftright(x, 2 * bits).bitwiseAND(F.lit(0xFFFF)).cast("double") + 0.5) / 65536.0
        for i in range(len(sides)):
            t = F.floor(F.col(f"_l{i}") * F.get(inverse, at_r) + b)
            log_a = F.get(log_c, at_c) - F.get(rate, at_r) * (t.cast("double") - b + 1.0)
            name = F.col("_h").bitwiseXOR(t * F.lit(0x9E3779B1)).bitwiseAND(F.lit(0xFFFFFFFF))
            packed = F.shiftleft(F.floor((log_a + 128.0) * float(1 << 22)), 32).bitwiseOR(name)
            least.append(F.min(packed).alias(f"_m{i}_{j}"))
    found = rows.groupBy(*partition, "_round").agg(*least)
    arrays = [F.array(*[F.coalesce(F.col(f"_m{i}_{j}").bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(0)) for j in range(AT_ONCE)]).alias(s) for i, s in enumerate(sides)]
    gathered = found.select(*partition, F.struct("_round", *arrays).alias("_part")).groupBy(*partition).agg(F.array_sort(F.collect_list("_part")).alias("_parts"))
    return gathered.select(*partition, *[F.flatten(F.col(f"_parts.{s}")).alias(s) for s in sides])


def likeness(one: Column, two: Column) -> Column:
    """Share of agreeing samples."""
    agree = F.aggregate(F.zip_with(one, two, lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    return agree / F.size(one)


def as_text(samples: Column) -> Column:
    """Four hexadecimal digits for each sample (samples are kept as 16 bits)."""
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.hex(x.cast("int") + 32768), 4, "0")), "")


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and the next document's are."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.select(key.alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = rows.select("key", F.length("text").alias("n"), F.xxhash64("text").alias("mark"))
    per_key = cut(sizes.groupBy("key").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("mark").alias("mark")))
    links = cut(next_ids(per_key.select("key")))
    asked = links.join(per_key.select("key", "n"), "key").select("next_key", F.col("key").alias("asker"), F.floor(F.col("n") / 4).cast("int").alias("quarter"))

    repeated_ids = per_key.where("rows > 1").limit(1).count() > 0
    if repeated_ids:  # equal rows become one, keys of many rows several
        rows = rows.groupBy("key", "text").agg(F.count(F.lit(1)).alias("many")).withColumn("mark", F.xxhash64("text"))
        hot = cut(per_key.where(F.col("rows") > HOT).select("key", F.ceil(F.col("rows") / HOT).cast("int").alias("parts")))
        hot = maybe_broadcast(hot, hot.count())
        texts = rows.join(hot, "key", "left").withColumn("part", F.pmod(F.col("mark"), F.coalesce("parts", F.lit(1))).cast("int")).select("key", "part", "mark", "many", "text")
        spoken = rows.join(per_key.select("key", "mark"), ["key", "mark"]).dropDuplicates(["key"]).select("key", "text")
        place = ["key", "part"]
    else:  # as named here and as next document: one exchange serves both
        texts = spoken = rows.select("key", "text")
        place = ["key"]

    def for_parts(facts: DataFrame) -> DataFrame:
        """The facts of a key for each of its parts."""
        if not repeated_ids:
            return facts
        return facts.join(hot, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")

    heads = spoken.join(asked, spoken["key"] == asked["next_key"]).select(F.col("asker").alias("key"), F.substring("text", F.lit(1), F.col("quarter")).alias("head"))
    both = texts.join(for_parts(heads), place)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("head", F.lit(1), quarter))
    both = both.withColumn("edited", edited).withColumn("mark", F.xxhash64("text"))

    signed = signatures(both, ["text", "edited"], [*place, "mark"], samples)
    signed = signed.select(*place, F.col("mark"), *[F.transform(s, lambda x: (x.bitwiseAND(F.lit(0xFFFF)) - 32768).cast("smallint")).alias(a) for s, a in (("text", "own"), ("edited", "changed"))])
    facts = both.select(*place, "mark", *(["many"] if repeated_ids else []), n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    # where no key is repeated, the key alone is the join's key: both sides are dealt by it already
    signed = cut(facts.join(signed, [*place, "mark"], "left") if repeated_ids else facts.join(signed.drop("mark"), place, "left"))

    nothing = F.array_repeat(F.lit(-32768).cast("smallint"), samples)
    after = signed.select(F.col("key").alias("next_key"), F.col("mark").alias("next_mark"), F.col("own").alias("next_own"))
    following = links.join(per_key.select(F.col("key").alias("next_key"), F.col("mark").alias("next_mark")), "next_key")
    following = following.join(after, ["next_key", "next_mark"]).select("key", "next_own")
    out = signed.join(for_parts(following), place)
    out = repeated(out, "many", "_nth", HOT) if repeated_ids else out
    out = out.select(F.nullif("key", F.lit(NO_ID)).alias("doc_id"), "n_chars", "edited_sha256", *[F.coalesce(c, nothing).alias(c) for c in ("own", "changed", "next_own")])
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
