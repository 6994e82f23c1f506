"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources in code point order (NULL last) weigh 3, 1, 2, 3, 1, 2, ... and share `SHARE` times the words of the
corpus; no target is above `MOST` times its source's words, and what is left over goes to the other sources
by weight. Every source is one stream of documents in seeded order, cut into blocks of about `BLOCK` words
(equal within a source), and dealt into shards of about `SHARD` words. Blocks go to sources, and a source's
blocks to its shards, by the highest quotients target / (2k + 1), at most `MOST` times the blocks there are.
In a shard every block is taken as often as its quota allows, and those first in seeded order once more.

Only sizes, offsets and block numbers are moved. Windows run over one shard (a bounded number of words) or
over one row per source or shard. Highest quotients are found without listing them all: the divisor lies
between total / (seats + half the parties) and total / (seats - half the parties), and only the quotients in
between, about three per party, are ranked.

Nulls: a NULL text has size 0; NULL is a source of its own, the last. A document of size 0 takes nothing.
Repeated rows are documents of their own; which of equal rows takes what does not matter. Result columns
replace input columns of the same name. An empty table gives an empty result. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnstile.llm import common as C

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
BLOCK, SHARD = 64, 1 << 20
SEED = 17


def apportion(parties: DataFrame, votes: str, cap: str, seats: str, name: str, by: list[str]) -> DataFrame:
    """parties with `name`, their seats by the Sainte-Lague method within each group `by`: `seats` (the same
    for a group) go to the highest quotients votes / (2k + 1), k < cap. Ties go to the first `_order`."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    p = parties.withColumn("_total", F.sum(F.col(votes).cast("double")).over(group)).withColumn("_n", F.count("*").over(group))
    p = p.withColumn("_v", F.col(votes).cast("double"))
    # Seats of a party are votes / divisor, rounded; the sum of roundings is off by half the parties at most.
    low = F.when(F.col(seats) * 2 > F.col("_n"), F.floor(F.col("_v") / (F.col("_total") / (F.col(seats) - F.col("_n") / 2)) + 0.5)).otherwise(0)
    # A cap can leave one more seat a party to the others.
    high = F.floor(F.col("_v") / (F.col("_total") / (F.col(seats) + F.col("_n") * 1.5)) + 0.5) + 1
    zero = (F.col("_total") > 0) & (F.col("_v") > 0)
    p = p.withColumn("_low", F.when(zero, F.greatest(F.lit(0), F.least(low - 1, F.col(cap)))).otherwise(0).cast("long"))
    p = p.withColumn("_high", F.when(zero, F.least(high, F.col(cap))).otherwise(0).cast("long"))
    p = p.withColumn("_left", F.col(seats) - F.sum("_low").over(group))
    k = F.expr("explode(sequence(_low, _high - 1))")
    q = p.where("_high > _low").select(*by, "_order", "_v", "_left", k.alias("_k"))
    rank = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    q = q.withColumn("_rank", F.row_number().over(rank.orderBy((F.col("_v") / (2 * F.col("_k") + 1)).desc(), "_order", "_k")))
    won = q.where("_rank <= _left").groupBy(*by, "_order").agg(F.count("*").alias("_won"))
    out = p.join(won, [*by, "_order"], "left").withColumn(name, F.col("_low") + F.coalesce("_won", F.lit(0)))
    return out.drop("_total", "_n", "_v", "_low", "_high", "_left", "_won")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) with _r, the source's place, and its target."""
    s = sizes.withColumn("_r", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("_r") - 1) % len(WEIGHTS) + 1).cast("int"))
    s = s.withColumn("_w", w).withColumn("_cap", F.col("source_size") * float(MOST))
    everyone = Window.partitionBy(F.lit(0))
    order = everyone.orderBy(F.col("_cap") / F.col("_w"), "_r")
    s = s.withColumn("_budget", F.sum("source_size").over(everyone) * SHARE)
    # Filled in order of cap by weight: what is left when all before are full, for a unit of weight.
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    s = s.withColumn("_unit", (F.col("_budget") - before) / F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("_place", F.row_number().over(order))
    free = F.when(F.col("_cap") > F.col("_unit") * F.col("_w"), F.struct("_place", "_unit"))
    s = s.withColumn("_level", F.min(free).over(everyone)["_unit"])
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_level") * F.col("_w")))
    return s.select("source", "source_size", "_r", target.alias("target"))


def word_count(text: Column | str) -> Column:
    """Number of words of a text, NULL 0."""
    return F.coalesce(F.regexp_count(text, F.lit(C.WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with what mix() needs: source, size and the seeded key that orders a source's documents."""
    key = F.xxhash64(F.lit(SEED), F.col(id_col).cast("string"), F.col(text_col))
    return docs.withColumn("_key", key).withColumn("_source", F.col(source_col)).withColumn("size", word_count(text_col))


def mix(docs: DataFrame) -> DataFrame:
    """docs (from sized()) with source_size, target, taken and _takes, the runs (begin, end, times) of a
    document's words in blocks that are taken, in order."""
    docs = docs.drop("source_size", "target", "taken")
    sizes = docs.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"))
    src = targets(sizes).withColumn("_blocks", F.when(F.col("source_size") > 0, F.greatest(F.lit(1), F.round(F.col("source_size") / BLOCK))).otherwise(0).cast("long"))
    src = src.withColumn("_step", F.when(F.col("_blocks") > 0, F.col("source_size") / F.col("_blocks")))
    src = src.withColumn("_votes", F.coalesce(F.col("target") / F.col("_step"), F.lit(0.0))).withColumn("_order", F.col("_r"))
    src = src.withColumn("_seats", F.round(F.sum("_votes").over(Window.partitionBy(F.lit(0)))).cast("long")).withColumn("_most", F.col("_blocks") * MOST)
    src = C.store(apportion(src, "_votes", "_most", "_seats", "_quota", []).withColumnRenamed("source", "_from"), "sources")

    docs = docs.join(src.select("_from", "source_size", "_r", "target", "_step", "_blocks"), F.col("_source").eqNullSafe(F.col("_from")))
    docs = docs.withColumn("_shard", F.pmod(F.col("_key"), F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / SHARD)))
    shards = docs.groupBy("_r", "_shard").agg(F.sum("size").alias("_words"))
    shards = shards.withColumn("_base", F.sum("_words").over(Window.partitionBy("_r").orderBy("_shard")) - F.col("_words"))
    shards = shards.join(src.select("_r", "_step", "_blocks", "_quota"), "_r")
    # Block i begins at word ceil(i * step) and belongs to the shard where it begins.
    at = lambda word: F.when(F.col("_blocks") > 0, F.least(F.ceil(word / F.col("_step")), F.col("_blocks"))).otherwise(0)
    shards = shards.withColumn("_first", at(F.col("_base"))).withColumn("_end", at(F.col("_base") + F.col("_words")))
    shards = shards.withColumn("_own", F.col("_end") - F.col("_first")).withColumn("_order", F.col("_shard")).withColumn("_most", F.col("_own") * MOST)
    shards = C.store(apportion(shards, "_own", "_most", "_quota", "_share", ["_r"]), "shards")

    blocks = shards.where("_own > 0").select("_r", "_shard", "_own", "_share", F.explode(F.sequence("_first", F.col("_end") - 1)).alias("_i"))
    place = F.row_number().over(Window.partitionBy("_r", "_shard").orderBy(F.xxhash64(F.lit(SEED), "_r", "_i"), "_i"))
    blocks = blocks.withColumn("_times", F.expr("_share div _own") + (place <= F.expr("_share % _own")).cast("long")).select("_r", "_i", "_times")

    docs = docs.join(shards.select("_r", "_shard", "_base"), ["_r", "_shard"])
    run = Window.partitionBy("_r", "_shard").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    docs = docs.withColumn("_at", F.col("_base") + F.sum("size").over(run) - F.col("size"))
    docs = docs.withColumn("_at", F.when(F.col("size") > 0, F.col("_at")))  # the one of its source, else NULL
    last = lambda word: F.least(F.floor(word / F.col("_step")), F.col("_blocks") - 1)
    spans = docs.where("size > 0").select("_r", "_at", "size", "_step", "_blocks", F.explode(F.sequence(F.greatest(last(F.col("_at")) - 1, F.lit(0)), last(F.col("_at") + F.col("size") - 1))).alias("_i"))
    begin = F.greatest(F.ceil(F.col("_i") * F.col("_step")), F.col("_at"))
    # The blocks are cut evenly; the last one ends with the source.
    end = F.when(F.col("_i") + 1 == F.col("_blocks"), F.col("_at") + F.col("size")).otherwise(F.least(F.ceil((F.col("_i") + 1) * F.col("_step")), F.col("_at") + F.col("size")))
    spans = spans.select("_r", "_i", "_at", (begin - F.col("_at")).alias("b"), (end - F.col("_at")).alias("e")).where("e > b")
    # Sizes behind an explode are guessed far too small, and neither side has a bound to broadcast by.
    spans = spans.join(blocks.where("_times > 0").hint("merge"), ["_r", "_i"])
    takes = spans.groupBy("_r", "_at").agg(F.sum(F.expr("(e - b) * _times")).alias("_taken"), F.sort_array(F.collect_list(F.struct("b", "e", F.col("_times").alias("times")))).alias("_takes"))
    out = docs.join(takes.hint("merge"), ["_r", "_at"], "left").withColumn("taken", F.coalesce("_taken", F.lit(0)).cast("long"))
    return out.drop("_r", "_at", "_shard", "_from", "_step", "_blocks", "_base", "_taken", "_key", "_source")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself, with the columns of docs: a document once with the words taken once or more, and
    once more with those taken twice. A text taken whole is kept as it is, else its words are joined by
    single spaces; documents that take nothing are not in the mix."""
    others = F.struct(*[c for c in docs.columns if c != text_col])
    rows = docs.select(others.alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_from_source"), F.col(text_col).alias("_text"))
    m = mix(sized(rows, "_id", "_from_source", "_text")).where("taken > 0")
    m = m.withColumn("_pass", F.explode(F.expr(f"sequence(1L, {MOST}L)")))
    m = m.withColumn("_runs", F.expr("filter(_takes, t -> t.times >= _pass)")).where("size(_runs) > 0")
    whole = F.expr("aggregate(_runs, 0L, (n, t) -> n + t.e - t.b) = size")
    words = F.split(F.regexp_replace("_text", r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    cut = F.array_join(F.flatten(F.transform("_runs", lambda t: F.slice(words, (t["b"] + 1).cast("int"), (t["e"] - t["b"]).cast("int")))), " ")
    text = F.when(whole, F.col("_text")).otherwise(cut).alias(text_col)
    return m.select(*[text if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])
