"""A mix of sources to target weights: Sainte-Lague apportionment of equal-token blocks, then seeded block selection.

1. Targets. Sources in code point order (null last) weigh ``WEIGHTS`` in turn and share ``SHARE`` of all words; a target
   stops at ``LIMIT`` times its source's words, and the excess is shared again by weight until none is above.
2. Blocks. The words of a source, its documents in seeded order, are one stream that is cut into blocks of ``BLOCK`` words.
   Blocks go to sources by highest quotients target / (2j + 1), so a source's quota is an integer. A source's stream is cut
   into ``SHARDS`` stretches, one for each output shard, and each gets an integer part of the quota (``quotas``).
3. Selection. With ``quota = passes * blocks + rest``, every block is taken ``passes`` times, and of each shard's stretch as many
   blocks once more as its part of ``rest`` says. Those are spread evenly from a seeded start, so whether a block is chosen,
   and how many are chosen before it, is a formula: no list of blocks is made or moved.

Offsets of documents in their stream come from sums per seeded bucket, so a source of any size spans many tasks. The seeded order
is that of a hash of id, text and the number among equal rows, so rows without an id and repeated rows fall into all buckets.

Nulls: a null text has no words; a null source is a source of its own, last in order; a null ``doc_id`` sorts like the text
"null". Repeated rows are documents of their own; they are counted first and numbered from the count. Documents without words take
none. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import let
from ..plans.numbering import number_rows
from ..sources.storage import settle, stored
from .keys import SPACES, WORD, unrolled

WEIGHTS = (3, 1, 2)
#: Share of all words that the mix takes, as a fraction.
SHARE = (3, 2)
LIMIT = 2
BLOCK = 64
#: Output shards, each with quotas of its own.
SHARDS = 24
SEED = 20
#: Rows whose offsets are summed by one sort.
BUCKET_ROWS = 50_000
#: Equal rows that one task numbers.
COPIES = 10_000


def sized(documents: DataFrame) -> DataFrame:
    """Distinct documents without text: words, a hash of the text, and the number of equal rows."""
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_text"),
    )
    return rows.groupBy("doc_id", "source", "size", "_text").agg(F.count("*").alias("_n"))


def ordered(counted: DataFrame, seed: int = SEED) -> DataFrame:
    """A row per document again, with ``_nth`` among equal rows, from 0, and the place in the seeded order."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "_text", "_nth")
    return unrolled(counted, COPIES).withColumn("_order", F.md5(name.cast("binary")))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds ``rank``, ``weight`` and ``target`` to ``source``, ``source_size``, ``n``."""
    ranked = number_rows(sources, [], [F.col("source").asc_nulls_last()], "rank")
    by_turn = F.lit(weights[-1])
    for i, weight in enumerate(weights[:-1]):
        by_turn = F.when((F.col("rank") - 1) % len(weights) == i, weight).otherwise(by_turn)
    ranked = settle(ranked.withColumn("weight", by_turn.cast("long")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    # The level is a fraction of integers; a source is full if its limit is at or below level * weight.
    above, below, full_before = SHARE[0] * total, 1, -1
    level = F.lit(None).cast("double")
    full = F.lit(False)
    while True:
        sums = ranked.agg(
            F.sum(F.when(full, F.col("source_size") * LIMIT)).alias("limits"),
            F.sum(F.when(~full, F.col("weight"))).alias("weights"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if sums["n"] == full_before or not sums["weights"]:
            break
        full_before = sums["n"]
        above, below = SHARE[0] * total - SHARE[1] * (sums["limits"] or 0), SHARE[1] * sums["weights"]
        level = F.lit(float(above)) / F.lit(float(below))
        full = (F.col("source_size") * LIMIT).cast("decimal(38,0)") * F.lit(below).cast("decimal(18,0)") <= F.col(
            "weight"
        ).cast("decimal(10,0)") * F.lit(above).cast("decimal(28,0)")
    return ranked.withColumn(
        "target", F.when(full, (F.col("source_size") * LIMIT).cast("double")).otherwise(level * F.col("weight"))
    )


def apportioned(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds ``blocks`` (blocks of the source's stream) and ``quota`` (blocks that the mix takes).

    Seats are given to the highest quotients target / (2j + 1). A divisor that gives at most all seats and one that gives
    at least all differ by one seat per source on average, so only the quotients between the two are compared.
    """
    settled = settle(sources)
    sums = settled.agg(F.sum("target").alias("t"), F.count("*").alias("s")).first()
    mass, half = float(sums["t"] or 0.0), sums["s"] / 2
    seats = int(mass / block + 0.5)
    scale = mass or 1.0
    low = F.floor(F.col("target") * F.lit((seats - half) / scale) + 0.5) - 1
    high = F.floor(F.col("target") * F.lit((seats + half) / scale) + 0.5) + 1
    ranged = settled.withColumn("_low", F.greatest(low, F.lit(0)))
    ranged = ranged.withColumn("_high", F.greatest(high, F.col("_low")))
    left = seats - (ranged.agg(F.sum("_low")).first()[0] or 0)
    open_seats = (
        ranged.filter("target > 0 AND _high > _low")
        .select("rank", "target", F.explode(F.sequence("_low", F.col("_high") - 1)).alias("j"))
        .select("rank", "j", (F.col("target") / (2 * F.col("j") + 1)).alias("quotient"))
    )
    order = [F.col("quotient").desc(), F.col("rank").asc(), F.col("j").asc()]
    won = number_rows(open_seats, [], order, "seat").filter(F.col("seat") <= left)
    won = won.groupBy("rank").agg(F.count("*").alias("_won"))
    blocks = F.ceil(F.col("source_size") / block)
    return (
        ranged.join(won, "rank", "left")
        .withColumn("blocks", blocks.cast("long"))
        .withColumn("quota", F.least(F.col("_low") + F.coalesce("_won", F.lit(0)), LIMIT * F.col("blocks")).cast("long"))
        .drop("_low", "_high", "_won")
    )


def _parts(a: Column, b: Column, c: Column) -> Column:
    """``a * b div c`` without overflow."""
    return F.call_function("div", a.cast("decimal(20,0)") * b.cast("decimal(18,0)"), c.cast("decimal(18,0)"))


def _stretch(shard: Column, rest: Column, shards: int) -> Column:
    """A shard's stretch of ``blocks`` blocks: its first block, its length, the part of ``rest`` before it and its own."""
    edge = lambda s: F.call_function("div", s * F.col("blocks"), F.lit(shards).cast("long"))
    before = lambda s: _parts(edge(s), rest, F.col("blocks"))
    return F.struct(
        edge(shard).alias("first"),
        (edge(shard + 1) - edge(shard)).alias("length"),
        before(shard).alias("before"),
        (before(shard + 1) - before(shard)).alias("extra"),
    )


def quotas(sources: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``source``, ``shard``, ``blocks`` of the shard's stretch and ``quota`` that the mix takes of them, for sources with
    ``blocks`` and ``quota``. The quotas of a source's shards are in proportion to their stretches, rounded to integers whose
    sum is the source's quota.
    """
    each = sources.filter("blocks > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    whole = F.call_function("div", F.col("quota"), F.col("blocks"))
    each = each.withColumn("_of", _stretch(F.col("shard").cast("long"), F.col("quota") % F.col("blocks"), shards))
    quota = whole * F.col("_of.length") + F.col("_of.extra")
    return each.select("source", "shard", F.col("_of.length").alias("blocks"), quota.alias("quota"))


def _chosen(words: Column, block: int, shards: int) -> Column:
    """Words of chosen blocks among the first ``words`` of a source's stream."""
    at = F.floor(words / block)

    def before(number: Column) -> Column:
        """Blocks that are chosen once more before the block ``number``: those of earlier shards, and those that its own shard
        chooses before it, counted from the seeded start.
        """
        shard = F.call_function("div", (number + 1) * F.lit(shards).cast("long") - 1, F.col("blocks"))

        def inside(of: Column) -> Column:
            start = F.col("_start") % of["length"]
            steps = lambda x: _parts(x, of["extra"], of["length"])
            return of["before"] + steps(number - of["first"] + start) - steps(start)

        return let(shard, lambda s: let(_stretch(s, F.col("_rest"), shards), inside))

    return before(at) * block + (before(at + 1) - before(at)) * (words - at * block)


def mixed(documents: DataFrame, block: int = BLOCK, seed: int = SEED, shards: int = SHARDS) -> DataFrame:
    """``doc_id``, ``size``, ``source``, ``source_size``, ``target``, ``taken``; ``passes`` and ``offset`` in the stream."""
    counted = stored(sized(documents), "words")
    rows = ordered(counted, seed)
    sources = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size"), F.sum("_n").alias("n"))
    sources = settle(apportioned(targets(sources), block))
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit(""))).cast("binary")), 1, 8), 16, 10)
    sources = sources.select(
        "source",
        "source_size",
        "target",
        "blocks",
        F.ceil(F.col("n") / BUCKET_ROWS).alias("_buckets"),
        F.expr("CASE WHEN blocks > 0 THEN quota div blocks ELSE 0 END").alias("passes"),
        F.expr("CASE WHEN blocks > 0 THEN quota % blocks ELSE 0 END").alias("_rest"),
        F.when(F.col("blocks") > 0, start.cast("long") % F.col("blocks")).otherwise(0).alias("_start"),
    )
    same = rows["source"].eqNullSafe(sources["source"])
    placed = rows.join(sources, same).drop(sources["source"])
    # The first digits of the seeded order give the bucket, so buckets follow one another in that order.
    digits = F.conv(F.substring("_order", 1, 6), 16, 10).cast("long")
    placed = placed.withColumn("_bucket", F.floor(digits * F.col("_buckets") / 16**6))
    earlier = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = placed.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    sums = sums.select(
        F.col("source").alias("_source"),
        F.col("_bucket").alias("_in"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
    )
    inside = W.partitionBy("source", "_bucket").orderBy("_order").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_in")))
    placed = placed.withColumn("offset", F.col("_before") + F.col("_inside"))
    more = _chosen(F.col("offset") + F.col("size"), block, shards) - _chosen(F.col("offset"), block, shards)
    taken = F.when(F.col("blocks") > 0, F.col("passes") * F.col("size") + more).otherwise(0)
    return placed.withColumn("taken", taken.cast("long")).select(
        "doc_id", "size", "source", "source_size", "target", "taken", "passes", "offset",
        "blocks", "_rest", "_start", "_text", "_nth",
    )


def mixed_documents(documents: DataFrame, block: int = BLOCK, seed: int = SEED, shards: int = SHARDS) -> DataFrame:
    """The mix itself, with the columns of ``documents``: a row per whole pass over a document, and one for the words of the
    blocks that are taken once more. ``n_chars`` is that of the text in the row.
    """
    plan = mixed(documents, block, seed, shards).filter("taken > 0")
    plan = plan.select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "_text", "size", "taken", "passes", "offset",
        "blocks", "_rest", "_start", F.col("_nth").alias("_copy"),
    )
    # Equal rows are told apart by number, so that each meets its own line of the plan.
    # Columns go by number, so that no name of theirs can clash.
    numbered = documents.select(
        *(documents[f"`{c}`"].alias(f"_c{i}") for i, c in enumerate(documents.columns)),
        F.col("text"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_digest"),
    )
    same = W.partitionBy("doc_id", "source", "_digest").orderBy(F.lit(0))
    numbered = numbered.withColumn("_nth", (F.row_number().over(same) - 1).cast("long"))
    met = numbered.join(
        plan,
        F.col("doc_id").eqNullSafe(F.col("_id"))
        & F.col("source").eqNullSafe(F.col("_source"))
        & (F.col("_digest") == F.col("_text"))
        & (F.col("_nth") == F.col("_copy")),
    )
    # What holds for a whole document is made before its words are looked at, or Spark would make it again for each word: the
    # words, as pieces with the spaces after them, and how often each block that the document reaches into is chosen.
    first = F.floor(F.col("offset") / block)
    last = F.floor((F.col("offset") + F.col("size") - 1) / block)
    partial = F.col("taken") % F.col("size") > 0
    choice = F.transform(F.sequence(first, last), lambda b: _chosen((b + 1) * block, block, shards) - _chosen(b * block, block, shards))
    whole = F.struct(
        F.when(partial, F.split("text", f"(?<=[{SPACES}])(?=[^{SPACES}])")).alias("pieces"),
        # Spaces before the first word are a piece of their own, and stay with that word.
        F.when(F.col("text").rlike(f"^[{SPACES}]"), 1).otherwise(0).alias("lead"),
        F.when(partial, choice).alias("choice"),
        first.alias("first"),
    )
    met = met.select("*", F.explode(F.array(whole)).alias("w"))
    word = lambda i: F.col("offset") + F.greatest(i - F.col("w.lead"), F.lit(0))
    at = lambda i: (F.floor(word(i) / block) - F.col("w.first")).cast("int")
    rest = F.array_join(F.filter("w.pieces", lambda _, i: F.get("w.choice", at(i)) > 0), "")
    extra = F.col("taken") - F.col("passes") * F.col("size")
    again = F.when(extra >= F.col("size"), F.col("text")).when(extra > 0, rest)
    copies = F.concat(F.array_repeat("text", F.col("passes").cast("int")), F.array_compact(F.array(again)))
    out = met.select(*(f"_c{i}" for i in range(len(documents.columns))), F.explode(copies).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text")}
    return out.select([new.get(f.name, F.col(f"_c{i}")).cast(f.dataType).alias(f.name) for i, f in enumerate(documents.schema)])


#: The same mix in SQL: the level of the targets from running sums, and all quotients ranked.
ORACLE = r"""
WITH b AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(text, '')) AS digest
  FROM documents
), d AS (
  SELECT doc_id, source, size, md5('20:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || digest || ':'
    || (row_number() OVER (PARTITION BY doc_id, source, digest) - 1)) AS place FROM b
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s
), f AS (
  SELECT *, row_number() OVER r AS k,
    CAST(3 * sum(source_size) OVER () - 2 * (sum(2 * source_size) OVER r - 2 * source_size) AS BIGINT) AS above,
    CAST(2 * (sum(weight) OVER () - (sum(weight) OVER r - weight)) AS BIGINT) AS below
  FROM w WINDOW r AS (ORDER BY 2 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), l AS (
  SELECT min(k) AS k, CAST(min_by(above, k) AS DOUBLE) / CAST(min_by(below, k) AS DOUBLE) AS level
  FROM f WHERE CAST(2 * source_size AS HUGEINT) * below > CAST(weight AS HUGEINT) * above
), t AS (
  SELECT f.source, source_size, rank,
    CASE WHEN l.k IS NULL OR f.k < l.k THEN CAST(2 * source_size AS DOUBLE) ELSE level * weight END AS target,
    CAST(ceil(source_size / 64) AS BIGINT) AS blocks
  FROM f, l
), q AS (
  SELECT rank, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, rank, j) AS seat
  FROM (SELECT rank, target, unnest(range(0, 2 * blocks + 3)) AS j FROM t WHERE target > 0)
), u AS (
  SELECT t.source, source_size, target, blocks, least(2 * blocks, coalesce(won, 0)) AS quota,
    CASE WHEN blocks > 0 THEN CAST('0x' || substr(md5('20/' || coalesce(t.source, '')), 1, 8) AS BIGINT) % blocks END AS start
  FROM t LEFT JOIN (
    SELECT rank, count(*) AS won FROM q WHERE seat <= (SELECT CAST(floor(sum(target) / 64 + 0.5) AS BIGINT) FROM t) GROUP BY rank
  ) USING (rank)
), p AS (
  SELECT doc_id, size, source_size, target, blocks, CAST(start AS HUGEINT) AS start, quota // blocks AS passes, quota % blocks AS rest,
    coalesce(sum(size) OVER (
      PARTITION BY d.source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
), c AS (
  SELECT *, unnest([low, low + size]) AS words, unnest([-1, 1]) AS sign, unnest([1, 0]) AS once FROM p
), n AS (
  SELECT *, words // 64 AS whole, unnest([words // 64, words // 64 + 1]) AS block,
    unnest([64 - (words - words // 64 * 64), words - words // 64 * 64]) AS part FROM c
), e AS (
  SELECT *, ((block + 1) * 24 - 1) // blocks AS shard FROM n
), g AS (
  SELECT *, CAST(shard * blocks // 24 AS HUGEINT) AS first, CAST((shard + 1) * blocks // 24 AS HUGEINT) AS next FROM e
), h AS (
  SELECT *, first * rest // blocks AS before, next * rest // blocks - first * rest // blocks AS extra, next - first AS length,
    start % (next - first) AS turn FROM g
)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN blocks > 0 THEN once * (block - whole = 0)::INT * passes * size
    + sign * part * (before + (block - first + turn) * extra // length - turn * extra // length) ELSE 0 END) AS BIGINT) AS taken
FROM h GROUP BY doc_id, size, source_size, target, low
"""
