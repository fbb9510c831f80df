"""Mix sources to target weights: exact quotas, a splitting tree over output shards, permuted blocks.

Everything is DataFrame code. A source's documents, in a hashed order, form a stream of words. The stream of
a second pass, in another order, follows. A source's target fixes how many blocks of its stream the mix
takes. A binary tree deals these blocks out to equal shards: at each node the left half gets a
multivariate-hypergeometric sample of the node's blocks, as if all had been shuffled and cut, but from
counts alone. A shard's quota is then the next run of blocks of the permuted stream, so blocks never overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

WEIGHTS = (3, 1, 2)
SHARE = 1.5  # of all words
REPEAT = 2  # passes over a source at most
BLOCK_WORDS = 64
SHARD_WORDS = 1 << 20
RUN_ROWS = 2048  # documents that are put in order in one window
SEED = 20
# Source totals are broadcast up to so many rows (three numbers and a name each), and joined beyond.
BROADCAST_SOURCES = 20_000
# Pieces (four numbers each) likewise.
BROADCAST_PIECES = 1 << 20

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """source, sid (0, 1, ... by code point, null last), source_size, rows, target.

    A target grows with the source's weight until it reaches `repeat` times the source's size; the
    others share what is left by weight. One level fits all sources that did not stop: the first, by
    size over weight, that the level does not fill.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy(F.col("limit") / F.col("weight"), "sid")
    before, rest = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    levels = (
        totals.withColumn("sid", F.row_number().over(by_name) - 1)
        .withColumns({"weight": weight.cast("double"), "limit": F.col("source_size").cast("double") * repeat})
        .withColumn("words", F.sum("source_size").over(whole) * share)
        .withColumn(
            "level",
            (F.col("words") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest),
        )
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("limit"))
    )
    level = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("limit") / F.col("weight"))).over(whole)
    target = F.least("limit", F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return levels.withColumn("target", target).select("source", "sid", "source_size", "rows", "target")


# A hypergeometric draw: of `n` draws without replacement from `good` + `bad` items, how many are good.
# The probabilities come from their ratios, in two sweeps around the mode: the first sums them, the second finds
# the value at which the sum passes the share `u`. Ten standard deviations and ten values bound the sweep; what lies
# beyond has less than 1e-20 of the probability.
_DRAW = """
aggregate(array(struct(
    cast({good} as double) as g, cast({bad} as double) as b, cast({n} as double) as n)), 0L, (unused, x) ->
  aggregate(array(struct(x.g as g, x.b as b, x.n as n,
      floor((x.n + 1) * (x.g + 1) / (x.g + x.b + 2)) as mode,
      10 + ceil(10 * sqrt(x.n * x.g * x.b * greatest(x.g + x.b - x.n, 0D)
          / greatest((x.g + x.b) * (x.g + x.b) * (x.g + x.b - 1), 1D))) as wide)), 0L, (unused2, y) ->
    aggregate(array(struct(y.g as g, y.b as b, y.n as n,
        cast(greatest(0D, y.n - y.b, y.mode - y.wide) as bigint) as lo,
        cast(least(y.n, y.g, y.mode + y.wide) as bigint) as hi)), 0L, (unused3, z) ->
      aggregate(
        sequence(z.lo, z.hi),
        struct(1D as p, 0D as sum, z.lo as k,
          {u} * aggregate(sequence(z.lo, z.hi), struct(1D as p, 0D as sum),
            (a, k) -> struct(
              a.p * (z.g - k) * (z.n - k) / ((k + 1D) * greatest(z.b - z.n + k + 1, 1D)) as p, a.sum + a.p as sum),
            a -> a.sum) as goal),
        (a, k) -> struct(
          a.p * (z.g - k) * (z.n - k) / ((k + 1D) * greatest(z.b - z.n + k + 1, 1D)) as p,
          a.sum + a.p as sum,
          if(a.sum < a.goal, k, a.k) as k,
          a.goal as goal),
        a -> a.k))))
"""


def hypergeometric(good: str, bad: str, n: str, u: str) -> str:
    """SQL for one draw; the arguments are SQL expressions, `u` uniform in (0, 1]."""
    return _DRAW.format(good=good, bad=bad, n=n, u=u)


def split_quotas(quotas: DataFrame, depth: int, seed: int = SEED) -> DataFrame:
    """shard, quotas: one row for each of 2 ** depth shards, from one row whose `quotas` has a count per source.

    Each level halves every node. Its left half takes source after source: a hypergeometric draw from what is
    left of the half's places. Counts add up exactly at every node.
    """
    nodes = quotas.select(F.lit(0).cast("long").alias("shard"), "quotas")
    for level in range(depth):
        draw = hypergeometric(
            "q", "acc.rest - q", "acc.places", f"(pmod(xxhash64({seed}, {level}, shard, i), 1048576 * 1024) + 1) / 1073741824D"
        )
        total = "aggregate(quotas, 0L, (a, q) -> a + q)"
        left = f"""
            aggregate(quotas, struct({total} as rest, {total} div 2 as places, cast(array() as array<bigint>) as taken),
              (acc, q) -> aggregate(array(struct(size(acc.taken) as i)), acc, (acc, at) ->
                aggregate(array({draw.replace(", i)", ", at.i)")}), acc, (acc, x) ->
                  struct(acc.rest - q as rest, acc.places - x as places, concat(acc.taken, array(x)) as taken))),
              acc -> acc.taken)"""
        halves = F.expr("array(struct(shard * 2 as shard, taken as quotas), struct(shard * 2 + 1 as shard, zip_with(quotas, taken, (q, x) -> q - x) as quotas))")
        nodes = nodes.withColumn("taken", F.expr(left)).select(F.explode(halves).alias("half")).select("half.*")
        if level == 9:
            nodes = nodes.repartition("shard")
    return nodes


def sized(docs: DataFrame, key: str | None = None) -> DataFrame:
    """row_id, doc_id, source, size: one row for each row of `docs`, written once. `key` names a column of unique numbers."""
    row_id = F.col(key) if key else F.monotonically_increasing_id()
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row_id.alias("row_id"))
    return written(rows, "sizes")


def streams(sizes: DataFrame, sources: DataFrame, repeat: int = REPEAT, seed: int = SEED) -> DataFrame:
    """row_id, sid, begin: where each row lies in its source's stream, once per pass.

    The hashed order is cut into runs of about RUN_ROWS rows, so a large source takes many windows.
    """
    keys = sizes.join(sources, sizes.source.eqNullSafe(sources.source)).select(
        "row_id", "sid", "doc_id", "size", "source_size", "rows", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))).alias("turn")
    )
    order = F.xxhash64(F.lit(seed), F.col("turn"), F.col("doc_id"), F.col("size"))
    runs = F.ceil(F.col("rows") / RUN_ROWS)
    keys = keys.withColumn("place", order).withColumn("run", F.pmod(F.shiftrightunsigned("place", 20), runs))
    by_run = Window.partitionBy("sid", "turn", "run").orderBy("place", "size", "row_id")
    inside = F.sum("size").over(by_run.rowsBetween(Window.unboundedPreceding, -1))
    placed = keys.withColumn("inside", F.coalesce(inside, F.lit(0)))
    starts = keys.groupBy("sid", "turn", "run").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("sid", "turn").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("sid", "turn", "run", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    begin = F.col("turn") * F.col("source_size") + F.col("start") + F.col("inside")
    return placed.join(starts, ["sid", "turn", "run"]).select("row_id", "sid", "size", "turn", begin.alias("begin"))


def mix_pieces(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    repeat: int = REPEAT,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
    key: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, sources, pieces). A piece is words first_word to last_word (from 0, end exclusive) of a row.

    pieces: shard, place (local order), row_id, turn, first_word, last_word. Null texts have no words and are
    in no piece; null sources form one source, the last; null and equal doc_ids are ordinary rows. An empty
    table gives no pieces. Other columns are ignored.
    """
    sizes = sized(docs, key)
    sources = written(source_targets(sizes, weights, share, repeat), "sources")
    blocks = F.ceil(F.floor(F.col("target") + 0.5) / block_words).cast("long")
    small = sources.agg(F.count("*"), F.sum(blocks)).first()
    if small[0] <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    depth = max(0, (-(-(small[1] or 0) * block_words // shard_words) - 1).bit_length())
    quotas = sources.agg(F.sort_array(F.collect_list(F.struct("sid", blocks.alias("q")))).alias("of"))
    quotas = quotas.select(F.col("of.q").alias("quotas"))
    shards = split_quotas(quotas, depth, seed).select("shard", F.posexplode("quotas").alias("sid", "q"))
    runs = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    limit = F.floor(F.col("target") + 0.5).cast("long")
    ranges = shards.withColumn("end", F.sum("q").over(runs)).where("q > 0").join(sources, "sid")
    width = F.greatest(F.lit(block_words), F.ceil(limit / F.lit(1 << depth))).cast("long")
    ranges = ranges.select(
        "shard",
        "sid",
        ((F.col("end") - F.col("q")) * block_words).alias("from"),
        F.least(F.col("end") * block_words, limit).alias("to"),
        width.alias("width"),
    )
    ranges = ranges.withColumn("bin", F.explode(F.expr("sequence(`from` div width, (`to` - 1) div width)")))
    rows = streams(sizes, sources, repeat, seed).join(sources.select("sid", limit.alias("limit"), width.alias("width")), "sid")
    rows = rows.where("size > 0 and begin < limit").withColumn("stop", F.least(F.expr("begin + size"), F.col("limit")))
    rows = rows.withColumn("bin", F.explode(F.expr("sequence(begin div width, (stop - 1) div width)"))).drop("width", "limit")
    first, last = F.greatest("begin", "from"), F.least("stop", "to")
    pieces = rows.join(ranges, ["sid", "bin"]).where(first < last).where(F.expr("bin = greatest(begin, `from`) div width"))
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "row_id", "turn", first), "row_id", "turn", first)
    pieces = pieces.select(
        "shard",
        F.row_number().over(local).alias("place"),
        "row_id",
        "turn",
        (first - F.col("begin")).alias("first_word"),
        (last - F.col("begin")).alias("last_word"),
    )
    return sizes, sources, pieces


def taken_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row for each row of `docs`."""
    sizes, sources, pieces = mix_pieces(docs)
    taken = pieces.groupBy("row_id").agg(F.sum(F.expr("last_word - first_word")).alias("taken"))
    rows = sizes.join(sources, sizes.source.eqNullSafe(sources.source)).join(taken, "row_id", "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def cut_words(text: Column, first: Column, last: Column) -> Column:
    """Words first to last (from 0, end exclusive) of a text, with the white space between them as it is."""
    starts = F.regexp_replace(text, rf"({WORD})", "\u0000$1")  # a mark before every word
    parts = F.split(starts, "\u0000")
    return F.rtrim(F.array_join(F.slice(parts, (first + 2).cast("int"), (last - first).cast("int")), ""))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows with the columns of `docs`, a row for each turn that takes some of a document.

    Whole documents keep their text as it is. Where a quota ends inside a document, its text is cut there.
    """
    key = "_row"
    while key in map(str.lower, docs.columns):
        key += "_"
    docs, columns = written(docs.withColumn(key, F.monotonically_increasing_id()), "numbered"), docs.columns
    sizes, _, pieces = mix_pieces(docs, key=key)
    # Where only shards part a document, its pieces are neighbours; joined again they are one text.
    taken = pieces.groupBy("row_id", "turn").agg(F.min("first_word").alias("first"), F.max("last_word").alias("last"))
    taken = taken.join(sizes.select("row_id", "size"), "row_id")
    taken = written(taken.select(F.col("row_id").alias(key), F.struct("first", "last", "size").alias(f"{key}_piece")), "taken")
    if taken.count() <= BROADCAST_PIECES:
        taken = F.broadcast(taken)
    found = docs.join(taken, key)
    whole = (F.col(f"{key}_piece.first") == 0) & (F.col(f"{key}_piece.last") == F.col(f"{key}_piece.size"))
    cut = F.when(whole, F.col("text")).otherwise(cut_words(F.col("text"), F.col(f"{key}_piece.first"), F.col(f"{key}_piece.last")))
    return found.withColumn("text", cut).select(*columns)
