"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources share blocks of equally many words: block k of a source with target t has
the quotient t / (2k - 1), and the highest quotients win. A source's blocks are
shared among its shards in the same way by their words, which gives every shard a
whole quota that it fills on its own: whole copies as often as the quota's words
allow, then a seeded choice among its blocks. Nothing but the per-shard sums crosses
shards. A source of w words has sqrt(w / SHARD_WORDS) shards, so both the sums of a
source and the rows of a shard grow with the root of its size, and no shard is so
small that rounding to blocks would miss the target. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BLOCK = 16  # words
SHARD_WORDS = 1024  # words of a shard of a source as small; a shard grows with the root of its source
REPEATS = 3  # a target stops at so many times its source's size
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _number(key: Column, at: int) -> Column:
    """Eight hex digits of a seeded digest as a whole number."""
    return F.conv(F.substring(F.md5(key.cast("binary")), at, 8), 16, 10).cast("long")


def _step(n_blocks: Column) -> Column:
    # A multiplier without a common factor with the number of blocks.
    return F.when(n_blocks % 1000003 != 0, F.lit(1000003)).otherwise(F.lit(1000033)).cast("long")


def apportion(df: DataFrame, votes: str, seats: str, within: list[str], key: list[str], out: str) -> DataFrame:
    """Sainte-Lague seats of each row as column ``out``.

    ``seats`` are shared among the rows of a group ``within`` by ``votes``. Two
    divisors bracket the right one, so that all but some two seats per row are
    settled by a division and only the rest are ranked by quotient (ties by
    ``key``). No votes: no seats.
    """
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    v = F.col(votes).cast("double")
    df = df.withColumns(
        {
            "__v": F.sum(v).over(group),
            "__m": F.sum(F.when(v > 0, 1.0).otherwise(0.0)).over(group) / 2 + 1,
        }
    )
    share = lambda n: F.floor(v * n / F.col("__v") + 0.5)
    some = F.col("__v") > 0
    low = F.when(some, F.greatest(F.lit(0).cast("long"), share(F.col(seats) - F.col("__m")) - 1)).otherwise(0)
    high = F.when(some & (v > 0), share(F.col(seats) + F.col("__m")) + 1).otherwise(0)
    df = df.withColumns({"__low": low.cast("long"), "__high": high.cast("long")})
    df = df.withColumn("__left", F.col(seats) - F.sum("__low").over(group))
    open_ = df.where(F.col("__high") > F.col("__low")).withColumn(
        "__k", F.explode(F.sequence(F.col("__low") + 1, F.col("__high")))
    )
    rank = (Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))).orderBy(
        (v / (2 * F.col("__k") - 1)).desc(), *[F.col(k).asc_nulls_last() for k in key], F.col("__k")
    )
    won = (
        open_.withColumn("__rank", F.row_number().over(rank))
        .where(F.col("__rank") <= F.col("__left"))
        .groupBy(*within, *key)
        .agg(F.count(F.lit(1)).alias("__won"))
    )
    on = None
    for c in [*within, *key]:
        same = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        on = same if on is None else on & same
    joined = df.alias("a").join(won.alias("b"), on, "left")
    return joined.select(
        "a.*", (F.col("a.__low") + F.coalesce(F.col("b.__won"), F.lit(0))).alias(out)
    ).drop("__v", "__m", "__low", "__high", "__left")


def _targets(sources: DataFrame) -> DataFrame:
    """Weights by code point, and targets filled up to a common level of words per weight."""
    every = Window.partitionBy(F.lit(0))
    ranked = sources.withColumn("__r", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    ranked = ranked.withColumns(
        {
            "weight": F.get(weights, (F.col("__r") % len(WEIGHTS)).cast("int")),
            "cap": (REPEATS * F.col("source_size")).cast("double"),
        }
    )
    by_level = every.orderBy(F.col("cap") / F.col("weight"), "__r")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = ranked.withColumns(
        {
            "__level": (
                F.sum(F.col("source_size").cast("double")).over(every)
                - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
            )
            / F.sum("weight").over(after),
        }
    )
    # The first source, by cap per weight, whose cap the common level doesn't reach.
    level = F.min(F.when(F.col("__level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("__r"), F.col("__level").alias("l")))).over(every)["l"]
    return ranked.withColumn("target", F.least("cap", F.col("weight") * level)).drop("__r", "__level")


def _name(id_col: str, text_col: str) -> Column:
    """What a row is drawn by: its id, or its text if it has none."""
    own = F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text_col).cast("binary")), F.lit(""))
    return F.concat(F.lit(SEED + "/"), own)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    carry: tuple[str, ...] = (), made: str = "",
) -> DataFrame:
    """How much of every document the mix takes.

    Returns ``id_col``, the ``carry`` columns, ``size`` (words), ``source_size``,
    ``target``, ``taken`` (words, repeats counted), ``passes`` (whole copies) and
    ``blocks`` (word ranges [from, to) taken once more). Sources in code point order
    (null last, one source of its own) weigh 5, 2, 1 and so on; a target stops at
    three times its source's size and the excess goes to the others by weight.

    ``made`` is put before the names of made columns, should carried ones clash.

    Null and empty texts have size 0 and are never taken. Ids may repeat or be null.
    Reruns give the same mix: order and choice depend on ids, texts and ``SEED``.
    A shard whose quota passes three copies of it has no more to give; as targets stop
    there, the other shards of its source are as full, and the seat stays empty.
    """
    spark = docs.sparkSession
    names = [id_col, *[c for c in carry if c != id_col]]
    # Carried columns travel in one struct, out of the way of the made ones.
    rows = docs.select(
        F.struct(*[F.col(c) for c in names]).alias("__row"),
        F.col(id_col).alias("__id"),
        F.col(source_col).alias("__source"),
        n_words(F.col(text_col)).alias("size"),
        _name(id_col, text_col).alias("__name"),
        F.xxhash64(F.col(text_col)).alias("__text"),
    )
    scratch = Scratch(spark, "mixing")
    sizes = scratch.write(
        rows.groupBy(F.col("__source").alias("source"), _number(F.col("__name"), 1).alias("draw")).agg(F.sum("size").alias("size")),
        "sizes",
    )
    sources = _targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    every = Window.partitionBy(F.lit(0))
    sources = sources.withColumns(
        {
            "__total": F.floor(F.sum("source_size").over(every) / BLOCK),
            "shards": F.greatest(F.lit(1).cast("long"), F.floor(F.sqrt(F.col("source_size") / float(SHARD_WORDS)))),
        }
    )
    sources = scratch.write(apportion(sources, "target", "__total", [], ["source"], "source_blocks"), "sources")
    cells = (
        sizes.alias("x")
        .join(sources.alias("y"), F.col("x.source").eqNullSafe(F.col("y.source")))
        .groupBy("x.source", (F.col("x.draw") % F.col("y.shards")).alias("cell"), "y.source_size", "y.target", "y.source_blocks")
        .agg(F.sum("x.size").alias("cell_size"))
    )
    quotas = apportion(cells, "cell_size", "source_blocks", ["source"], ["cell"], "quota")
    n_blocks = F.greatest(F.lit(1).cast("long"), F.floor(F.col("cell_size") / BLOCK + 0.5))
    shift = _number(F.concat_ws("/", F.lit(SEED), F.coalesce("source", F.lit("")), F.col("cell").cast("string")), 17)
    quotas = quotas.withColumns({"n_blocks": n_blocks, "shift": shift, "__words": F.col("quota") * BLOCK})
    whole = F.least(F.lit(REPEATS).cast("long"), F.floor(F.col("__words") / F.col("cell_size")))
    rest = F.floor((F.col("__words") - F.col("whole") * F.col("cell_size")) / BLOCK + 0.5)
    quotas = quotas.withColumn("whole", F.when(F.col("cell_size") > 0, whole).otherwise(0).cast("long")).withColumn(
        "more", F.when((F.col("cell_size") > 0) & (F.col("whole") < REPEATS), F.least(rest, F.col("n_blocks"))).otherwise(0).cast("long")
    )
    quotas = scratch.write(quotas.select("source", "cell", "source_size", "target", "n_blocks", "shift", "whole", "more"), "quotas")
    scratch.drop("sizes")
    stream = (
        # Rows without words take no part, and stay in a group of their own.
        Window.partitionBy("source", F.when(F.col("size") > 0, F.col("cell")).otherwise(-1 - F.col("cell")))
        .orderBy(F.substring(F.md5(F.col("__name").cast("binary")), 9, 16), F.col("__id"), F.col("size"), F.col("__text"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    dealt = rows.join(sources.select(F.col("source").alias("__of"), "shards"), F.col("__source").eqNullSafe(F.col("__of")))
    dealt = dealt.withColumn("__cell", _number(F.col("__name"), 1) % F.col("shards")).drop("__of", "shards")
    placed = (
        dealt.join(quotas, F.col("__source").eqNullSafe(F.col("source")) & (F.col("__cell") == F.col("cell")))
        .withColumn("__at", F.coalesce(F.sum("size").over(stream), F.lit(0)))
    )
    n, more = F.col("n_blocks"), F.col("more")
    end = F.col("__at") + F.col("size")
    first = F.least(n - 1, F.floor(F.col("__at") / BLOCK))
    last = F.least(n - 1, F.floor((end - 1) / BLOCK))
    won = F.filter(
        F.sequence(first, last),
        lambda b: (b % n * (_step(n) % n) + F.col("shift")) % n < more,
    )
    # Words of a block within the document, counted from its first word.
    ranges = F.transform(
        won,
        lambda b: F.struct(
            (F.greatest(b * BLOCK, F.col("__at")) - F.col("__at")).alias("from"),
            (F.least(F.when(b == n - 1, end).otherwise((b + 1) * BLOCK), end) - F.col("__at")).alias("to"),
        ),
    )
    placed = placed.withColumn("passes", F.col("whole")).withColumn(
        "blocks",
        F.when(F.col("size") > 0, ranges).otherwise(F.array().cast("array<struct<from:bigint,to:bigint>>")),
    )
    extra = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, x: a + x["to"] - x["from"])
    return placed.select(
        *[F.col("__row")[c].alias(c) for c in names],
        *[
            c.alias(made + n)
            for n, c in {
                "size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"),
                "taken": F.col("passes") * F.col("size") + extra, "passes": F.col("passes"), "blocks": F.col("blocks"),
            }.items()
        ],
    )


def oracle() -> str:
    """The same mix in SQL."""
    low = f"""greatest(0, CAST(floor(v * (seats - m) / tot + 0.5) AS BIGINT) - 1)"""
    high = f"""CAST(floor(v * (seats + m) / tot + 0.5) AS BIGINT) + 1"""

    def seats(name: str, source: str, by: str, key: str) -> str:
        part = f"PARTITION BY {by}" if by else ""
        keys = ", ".join(x for x in (by, key) if x)
        same = " AND ".join(f"b.{x} IS NOT DISTINCT FROM k.{x}" for x in keys.split(", "))
        return f"""
{name}_v AS (SELECT *, sum(v) OVER ({part}) AS tot,
                    sum(CASE WHEN v > 0 THEN 1e0 ELSE 0e0 END) OVER ({part}) / 2 + 1 AS m FROM {source}),
{name}_b AS (SELECT *, CASE WHEN tot > 0 THEN {low} ELSE 0 END AS lo,
                    CASE WHEN tot > 0 AND v > 0 THEN {high} ELSE 0 END AS hi FROM {name}_v),
{name}_l AS (SELECT *, seats - sum(lo) OVER ({part}) AS remaining FROM {name}_b),
{name}_k AS (SELECT *, unnest(range(lo + 1, hi + 1)) AS k FROM {name}_l WHERE hi > lo),
{name}_r AS (SELECT *, row_number() OVER ({part} ORDER BY v / (2 * k - 1) DESC, {key} NULLS LAST, k) AS rk FROM {name}_k),
{name}_w AS (SELECT {keys}, count(*) AS won FROM {name}_r WHERE rk <= remaining GROUP BY {keys}),
{name} AS (SELECT k.*, CAST(k.lo + coalesce(b.won, 0) AS BIGINT) AS got FROM {name}_l k LEFT JOIN {name}_w b ON {same})"""

    return f"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                      md5('{SEED}/' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')) AS h FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM s0),
s2 AS (SELECT *, CAST([{', '.join(map(str, WEIGHTS))}][r % {len(WEIGHTS)} + 1] AS DOUBLE) AS weight,
              CAST({REPEATS} * source_size AS DOUBLE) AS cap FROM s1),
s3 AS (SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER ()
                  - coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
                 / sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM s2),
lev AS (SELECT lev AS l FROM s3 WHERE lev <= cap / weight ORDER BY cap / weight, r LIMIT 1),
s4 AS (SELECT source, source_size, least(cap, weight * l) AS target, least(cap, weight * l) AS v,
              CAST(floor(sum(source_size) OVER () / {float(BLOCK)}) AS BIGINT) AS seats FROM s3, lev),
{seats('top', 's4', '', 'source')},
d AS (SELECT sized.*, CAST('0x' || h[1:8] AS BIGINT) % greatest(1, CAST(floor(sqrt(y.source_size / {float(SHARD_WORDS)})) AS BIGINT)) AS cell
      FROM sized JOIN top y ON sized.source IS NOT DISTINCT FROM y.source),
cells AS (SELECT source, cell, CAST(sum(size) AS BIGINT) AS cell_size FROM d GROUP BY source, cell),
q0 AS (SELECT x.*, y.source_size, y.target, y.got AS seats, CAST(x.cell_size AS DOUBLE) AS v
       FROM cells x JOIN top y ON x.source IS NOT DISTINCT FROM y.source),
{seats('low', 'q0', 'source', 'cell')},
q1 AS (SELECT source, cell, cell_size, source_size, target, got * {BLOCK} AS w,
              greatest(1, CAST(floor(cell_size / {float(BLOCK)} + 0.5) AS BIGINT)) AS n,
              CAST('0x' || md5('{SEED}/' || coalesce(source, '') || '/' || cell)[17:24] AS BIGINT) AS shift FROM low),
q2 AS (SELECT *, CASE WHEN cell_size > 0 THEN least({REPEATS}, w // cell_size) ELSE 0 END AS whole,
              CASE WHEN n % 1000003 <> 0 THEN 1000003 ELSE 1000033 END AS step FROM q1),
q AS (SELECT *, CASE WHEN cell_size > 0 AND whole < {REPEATS}
                     THEN least(n, CAST(floor((w - whole * cell_size) / {float(BLOCK)} + 0.5) AS BIGINT)) ELSE 0 END AS more FROM q2),
p AS (SELECT d.doc_id, d.size, q.* EXCLUDE (source, cell),
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source, d.cell ORDER BY h[9:24], d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source AND d.cell = q.cell),
won AS (SELECT *, list_filter(range(least(n - 1, a // {BLOCK}), least(n - 1, (a + size - 1) // {BLOCK}) + 1),
                              lambda b: (b % n * (step % n) + shift) % n < more) AS bs FROM p),
got AS (SELECT *, CASE WHEN size > 0 THEN coalesce(list_sum(list_transform(bs, lambda b: least(CASE WHEN b = n - 1 THEN a + size ELSE (b + 1) * {BLOCK} END, a + size)
                                                          - greatest(b * {BLOCK}, a))), 0) ELSE 0 END AS extra FROM won)
SELECT doc_id, size, source_size, target, CAST(whole * size + extra AS BIGINT) AS taken FROM got"""


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: whole copies, and one row of the blocks taken once more.

    A row of blocks keeps its words in order, one space apart. Copies keep their id.
    """
    names = docs.columns
    out = mix(docs, carry=tuple(c for c in names if c != "doc_id"), made="__")
    some = F.size("__blocks") > 0

    def chosen(words: Column) -> Column:
        cut = lambda b: F.slice(words, (b["from"] + 1).cast("int"), (b["to"] - b["from"]).cast("int"))
        return F.array_join(F.flatten(F.transform(F.col("__blocks"), cut)), " ")

    # The words are bound to a variable: taken once per row, not once per block.
    parts = F.transform(F.array(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))), chosen)
    copies = out.withColumn(
        "__texts",
        F.concat(
            F.array_repeat(F.col("text"), F.when(F.col("__size") > 0, F.col("__passes").cast("int")).otherwise(0)),
            F.when(some, parts).otherwise(F.array().cast("array<string>")),
        ),
    )
    out = copies.withColumn("text", F.explode("__texts"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*names)
