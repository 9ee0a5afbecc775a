"""Mix sources to target weights by Sainte-Laguë apportionment of token blocks.

DataFrame functions only.  The plan is:

1. one scan of the texts counts words; what follows moves narrow rows only;
2. a small table of sources gets weights, targets (water-filling under a cap of
   ``max_repeat`` times a source's size) and, for each output shard, an integer
   number of words by Sainte-Laguë's highest quotients, so that a source however
   small gets its target;
3. each source's documents are laid end to end in seeded order, by a prefix sum
   in two steps: inside (source, hash range) and over the sums of the ranges.
   A source with a third of all rows is dealt over thousands of ranges;
4. the source is cut in equal blocks (the last is shorter) and a seeded
   permutation lays them in order; the quota takes that order's first words, and
   a document takes the words it has among them.

Defined cases: null source is a source of its own, last in order; null or empty
text has size 0 and takes nothing; a source without words has target 0; an
empty table gives an empty result; repeated rows are documents of their own
(those equal in doc_id and text are laid out in one task);
the table of sources (a row each, not a document) passes single tasks, so there
may be millions of sources, not billions; other columns of the input are ignored by ``plan_mix`` and kept by ``mix``
(columns named, but for case, like a needed or an added one give way).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadloom.functions.frames import carry, pick
from quadloom.plans.scratch import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Multiplies block numbers in the seeded permutation; a prime above any number of blocks in a source.
PRIME = 2147483647
#: Columns of ``mix``, of which the first stays.
ADDED = ("mix_repeat", "row_key_a", "row_key_b", "_a", "_b", "_n", "_at", "_size", "_spans", "_mine", "_tokens")
RANGES = 12  # bits of the hash that name a range
ONE_WORD = 1 << 62  # so many blocks that each is one word
SPANS = "array<struct<repeat:int,shard:int,first:bigint,words:bigint>>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key() -> list[Column]:
    return [F.xxhash64(F.lit(n), "doc_id", "text").alias(f"row_key_{n}") for n in "ab"]


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_repeat: int = 2) -> DataFrame:
    """``sizes`` (source, source_size) with ``rank``, ``weight``, ``target``: one row per source.

    Targets are ``weight * level``, cut at ``max_repeat * source_size``.  The
    level at which they sum to ``share`` of all sizes is found in closed form:
    in the order of cap per weight, sources below the level are exactly a prefix.
    """
    everything = Window.partitionBy()
    by_rank = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.withColumn("rank", F.row_number().over(by_rank))
    t = t.withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    t = t.withColumn("ratio", F.col("cap") / F.col("weight"))
    t = t.withColumn("_all", F.sum("source_size").over(everything) * F.lit(float(share)))
    t = t.withColumn("_w", F.sum("weight").over(everything))
    t = t.withColumn("_cap_before", F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0)))
    t = t.withColumn("_w_before", F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0)))
    t = t.withColumn("_level", (F.col("_all") - F.col("_cap_before")) / (F.col("_w") - F.col("_w_before")))
    # the level holds from the first source on whose cap is not below it
    t = t.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("ratio"), F.struct("ratio", "rank", "_level"))).over(everything)["_level"])
    t = t.withColumn("target", F.coalesce(F.least("cap", F.col("weight") * F.col("_level")), F.col("cap")))
    return t.select("source", "source_size", "rank", "weight", "target")


def block_quotas(targets: DataFrame, shards: int, blocks: int, max_repeat: int) -> DataFrame:
    """Adds ``block`` (its tokens), ``n_blocks`` (of the source), ``quota`` (seats in all) and
    ``until`` (array: seats up to and with each shard).

    The house of shard s holds the first ``(s + 1) / shards`` of all seats.  Sainte-Laguë
    grows from one house to the next without taking a seat back, so the differences are
    the shards' own quotas.  Seats at the rounding divisor are exact for their own sum;
    from there the highest (lowest) quotients gain (lose) the few missing seats.
    """
    everything = Window.partitionBy()
    t = targets.withColumn("_sum", F.sum("target").over(everything))
    t = t.withColumn("block", F.greatest(F.lit(1.0), F.ceil(F.col("_sum") / blocks)).cast("long"))
    t = t.withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    t = t.withColumn("_seats", F.round(F.col("_sum") / F.col("block")).cast("long"))
    t = t.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    t = t.withColumn("_house", F.floor(F.col("_seats") * (F.col("shard") + 1) / shards).cast("long"))
    base = F.floor(F.try_divide(F.col("target") * F.col("_house"), F.col("_sum")) + 0.5).cast("long")
    t = t.withColumn("_base", F.coalesce(base, F.lit(0).cast("long")))
    t = t.withColumn("_miss", F.col("_house") - F.sum("_base").over(Window.partitionBy("shard")))
    t = t.withColumn("_n", F.count("*").over(Window.partitionBy("shard")))
    # if all seats are to change by d, a source with share s of n sources' targets changes by s * (d + n) + 1 at most,
    # so the candidates of all sources are some 3 * n, not n * d
    most = F.floor(F.coalesce(F.try_divide("target", "_sum"), F.lit(0.0)) * (F.abs("_miss") + F.col("_n"))) + 2
    step = F.when(F.col("_miss") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(1).cast("long"), F.least(F.abs("_miss"), most.cast("long"))))
    t = t.withColumn("_step", F.explode(step))
    up, seat = F.col("_miss") > 0, F.col("_base") + F.col("_step")
    quotient = F.when(up, F.col("target") / (2 * seat - 1)).otherwise(-F.col("target") / (2 * (F.col("_base") - F.col("_step")) + 1))
    possible = (F.col("target") > 0) & (up | (F.col("_step") <= F.col("_base")))
    t = t.withColumn("_q", F.when(possible, quotient))
    t = t.withColumn("_place", F.row_number().over(Window.partitionBy("shard").orderBy(F.col("_q").desc_nulls_last(), F.when(up, F.col("rank")).otherwise(-F.col("rank")), "_step")))
    moved = F.sum(F.when((F.col("_place") <= F.abs("_miss")) & F.col("_q").isNotNull(), F.signum("_miss").cast("long")).otherwise(0))
    keys = ["source", "source_size", "rank", "weight", "target", "block", "n_blocks"]
    t = t.groupBy(*keys, "shard", "_base").agg(moved.alias("_moved"))
    t = t.withColumn("_until", F.least(F.col("_base") + F.col("_moved"), F.col("n_blocks") * max_repeat))
    t = t.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("shard", "_until"))).alias("_u"))
    t = t.withColumn("until", F.col("_u._until")).drop("_u")
    return t.withColumn("quota", F.element_at("until", -1))


def plan_mix(
    docs: DataFrame, seed: int = 17, weights=(5, 2, 1), share: float = 1.5, max_repeat: int = 2, shards: int = 16, blocks: int = 16384
) -> DataFrame:
    """What the mix takes of each row of ``docs`` (doc_id, text, source).

    Returns doc_id, source, size, row_key_a, row_key_b, source_size, target, taken and ``spans``:
    array of (repeat, shard, first word from 0, words).  ``blocks`` is about the
    number of blocks of the whole mix, which are the grain of the selection only:
    words are apportioned one by one, and a source takes its quota to the word.
    """
    if max_repeat < 1 or shards < 1 or blocks < shards:
        raise ValueError("max_repeat and shards are 1 or more, blocks no fewer than shards")
    d = pick(docs, "doc_id", "text", "source")
    d = d.select("doc_id", "source", word_count(F.col("text")).alias("size"), *row_key())
    d = materialize(d, "mix-sizes")
    # a null source gets a key of its own that no named source can have
    d = d.withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    # by the whole row, so that rows of one or no doc_id are dealt too
    d = d.withColumn("_h", F.xxhash64(F.lit(seed), "row_key_a"))
    d = d.withColumn("_range", F.shiftrightunsigned("_h", 64 - RANGES))
    inside = Window.partitionBy("_key", "_range").orderBy("_h", "row_key_a", "row_key_b").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_upto", F.sum("size").over(inside))
    ranges = d.groupBy("_key", "_range").agg(F.sum("size").alias("_sum"), F.first("source").alias("source"))
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("_key", "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    sizes = ranges.groupBy("_key").agg(F.first("source").alias("source"), F.sum("_sum").alias("source_size"))
    targets = source_targets(sizes.drop("_key"), weights, share, max_repeat)
    # blocks of one word: quotas and shards' ends are in words
    quotas = block_quotas(targets, shards, ONE_WORD, max_repeat)
    quotas = quotas.withColumn("block", F.greatest(F.lit(1.0), F.ceil(F.sum("target").over(Window.partitionBy()) / blocks)).cast("long"))
    quotas = quotas.withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    quotas = quotas.withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source", "rank", "weight")
    d = d.join(offsets, ["_key", "_range"]).join(quotas, "_key")
    end = F.col("_offset") + F.col("_upto")
    d = d.withColumn("_end", end).withColumn("_start", end - F.col("size"))
    shift = F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), "_key"), F.greatest("n_blocks", F.lit(1)))
    d = d.withColumn("_shift", shift)
    # the last block lacks some words, so the blocks after it in the permutation come that much sooner
    d = d.withColumn("_lacks", F.col("n_blocks") * F.col("block") - F.col("source_size"))
    d = d.withColumn("_last", ((F.col("n_blocks") - 1) * F.lit(PRIME) + F.col("_shift")) % F.greatest("n_blocks", F.lit(1)))

    def cut(b: Column) -> Column:
        lo = F.greatest(F.col("_start"), b * F.col("block"))
        hi = F.least(F.col("_end"), (b + 1) * F.col("block"))
        place = (b * F.lit(PRIME) + F.col("_shift")) % F.col("n_blocks")
        begin = place * F.col("block") - F.when(place > F.col("_last"), F.col("_lacks")).otherwise(0)
        return F.struct((begin + lo - b * F.col("block")).alias("at"), (lo - F.col("_start")).alias("first"), (hi - lo).alias("words"))

    def shard_at(word: Column) -> Column:
        return F.size(F.filter("until", lambda u: u <= word))

    def taken_in(r: int) -> Column:
        def spans(x: Column) -> Column:
            """The words of a cut that the quota takes, a span for each shard they lie in."""
            lo = x["at"] + r * F.col("source_size")
            hi = F.least(lo + x["words"], F.col("quota"))

            def span(k: Column) -> Column:
                begin = F.greatest(lo, F.when(k > 0, F.element_at("until", F.greatest(k, F.lit(1)))).otherwise(0))
                return F.struct(F.lit(r).alias("repeat"), k.alias("shard"), (x["first"] + begin - lo).alias("first"), (F.least(hi, F.element_at("until", k + 1)) - begin).alias("words"))

            inside = F.transform(F.sequence(shard_at(lo), shard_at(hi - 1)), span)
            return F.when(lo < hi, F.filter(inside, lambda y: y["words"] > 0)).otherwise(F.array().cast(SPANS))

        return F.flatten(F.transform("_cuts", spans))

    blocks_of = F.sequence((F.col("_start") / F.col("block")).cast("long"), ((F.col("_end") - 1) / F.col("block")).cast("long"))
    d = d.withColumn("_cuts", F.when(F.col("size") > 0, F.transform(blocks_of, cut)))
    d = d.withColumn("spans", F.coalesce(F.concat(*[taken_in(r) for r in range(max_repeat)]), F.array().cast(SPANS)))
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return d.select("doc_id", "source", "size", "row_key_a", "row_key_b", "source_size", "target", taken.alias("taken"), "spans")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows: ``docs`` with the words taken as ``text``, one row per repeat, plus ``mix_repeat``.

    A document whose blocks are all taken keeps its text unchanged; of others the
    spans are cut with the white space after each word and joined in order.
    Rows are found again by a 128-bit hash of doc_id and text.
    """
    docs = carry(docs, ("doc_id", "text", "source"), ADDED)
    plan = plan_mix(docs, **options)
    plan = plan.groupBy("row_key_a", "row_key_b").agg(F.first("size").alias("_size"), F.collect_list("spans").alias("_lists"))
    plan = plan.select(F.col("row_key_a").alias("_a"), F.col("row_key_b").alias("_b"), "_size", F.posexplode("_lists").alias("_at", "_spans"))
    plan = plan.filter(F.size("_spans") > 0)
    kept = docs.columns
    d = docs.select(*kept, *row_key())
    # equal rows take the plans of their kind in turn; the subtraction keeps the number out of the join's keys
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("row_key_a", "row_key_b").orderBy("row_key_a")) - 1)
    d = d.join(plan, (F.col("row_key_a") == F.col("_a")) & (F.col("row_key_b") == F.col("_b")) & (F.col("_n") - F.col("_at") == 0))
    repeats = F.array_distinct(F.col("_spans.repeat"))
    d = d.withColumn("mix_repeat", F.explode(repeats))
    mine = F.filter("_spans", lambda x: x["repeat"] == F.col("mix_repeat"))
    d = d.withColumn("_mine", mine)
    whole = F.aggregate("_mine", F.lit(0).cast("long"), lambda a, x: a + x["words"]) == F.col("_size")
    tokens = F.regexp_extract_all("text", F.lit(rf"({WORD}[\x20\x09-\x0D]*)"), F.lit(1))
    part = F.array_join(F.transform("_mine", lambda x: F.array_join(F.slice("_tokens", (x["first"] + 1).cast("int"), x["words"].cast("int")), "")), "")
    d = d.withColumn("_tokens", F.when(~whole, tokens))
    d = d.withColumn("text", F.when(whole, F.col("text")).otherwise(part))
    return d.select(*kept, "mix_repeat")
