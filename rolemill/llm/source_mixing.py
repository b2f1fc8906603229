"""Temperature mixing of sources.

Source token shares p are raised to an exponent in [0, 1] and normalised. The exponent is bisected:
it is the largest at which the weights' entropy reaches the target share of the maximum, and not
below the smallest at which no source is repeated more often than the limit. Weights times the
budget give each source a quota: whole passes over all its blocks, then a part of one more pass,
which takes blocks in the order of a permutation of its own while they fit in the quota.

A document's block and a block's place in a pass are hashes, so only one small row per source
(passes, cut) meets the documents; no text is shuffled or gathered. The running sums that find the
cut go by about sqrt(blocks) ranges of a source's blocks and then by the blocks of one range, so
no window holds all blocks of a hot source. The driver sees two sums per tried exponent, no more.

Defined results: a null source is a source of its own; a source without tokens has weight 0 and
gives no rows; documents without tokens follow their block; rows of equal id and text share a block,
others are spread, also where ids are null or equal; an empty table gives no rows; extra columns are kept, but for
ones named mix_pass or mix_block, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolemill.llm.common import read, rows_of, spread_row, token_count, whole_row, written

#: Bisection steps taken by one Spark job: 2**LEVELS - 1 exponents are tried together.
LEVELS, ROUNDS = 4, 10


@dataclass(frozen=True)
class Mix:
    target_entropy: float = 0.95  # of log(number of sources)
    max_repeats: float = 4.0  # passes over one source
    budget_ratio: float = 1.0  # of all tokens of the input
    block_tokens: int = 8192
    seed: int = 7


def _digits(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("long")


def _source_key(source: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def _tried(sources: DataFrame, total: int, budget: float, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy, passes over the most repeated source) at each exponent."""
    p = F.col("tokens") / F.lit(float(total))
    wanted = []
    for a in exponents:
        power = F.pow(p, F.lit(float(a)))
        wanted += [F.sum(power), F.sum(power * F.ln(p)), F.max(power / F.col("tokens"))]
    found = sources.agg(*[w.alias(f"c{i}") for i, w in enumerate(wanted)]).first()
    out = []
    for i, a in enumerate(exponents):
        s, t, r = found[3 * i], found[3 * i + 1], found[3 * i + 2]
        out.append((_log(s) - a * t / s, r / s * budget))
    return out


def _log(x: float) -> float:
    import math

    return math.log(x)


def _bisect(sources: DataFrame, total: int, budget: float, at_least) -> float:
    """Largest exponent in [0, 1] at which ``at_least`` holds, if it holds from 0 up to there; 0 if nowhere."""
    lo, hi = 0.0, 1.0
    if at_least(*_tried(sources, total, budget, [1.0])[0]):
        return 1.0
    parts = 2**LEVELS
    for _ in range(ROUNDS):
        points = [lo + (hi - lo) * k / parts for k in range(1, parts)]
        holds = [at_least(*x) for x in _tried(sources, total, budget, points)]
        k = holds.index(False) if False in holds else len(holds)
        lo, hi = ([lo, *points, hi])[k], ([lo, *points, hi])[k + 1]
    return lo


def exponent(sources: DataFrame, total: int, budget: float, mix: Mix) -> float:
    """The exponent for (source_key, tokens); all tokens are positive."""
    most = _log(sources.count())
    flat = _bisect(sources, total, budget, lambda h, _: h >= mix.target_entropy * most - 1e-9)
    if _tried(sources, total, budget, [flat])[0][1] <= mix.max_repeats:
        return flat
    # passes fall as the exponent rises; the largest exponent that still breaks the limit
    return max(flat, _bisect(sources, total, budget, lambda _, r: r > mix.max_repeats))


def _own_key() -> Column:
    """What a document's block is a hash of: its id and text, so rows without an id, or of one id, are spread too."""
    return F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))


def mixing_plan(documents: DataFrame, mix: Mix) -> DataFrame:
    """One row per source that is taken: source_key, blocks, passes, and the cut of the last pass."""
    thin = rows_of(
        documents,
        {"source_key": _source_key(), "id": _own_key(), "tokens": token_count()},
        "tokens",
    )
    sources = written(thin.groupBy("source_key").agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return sources.selectExpr("source_key", "1L blocks", "0L passes", "0L cut_range", "0L cut", "1L ranges").limit(0)
    budget = total * mix.budget_ratio
    a = exponent(sources, total, budget, mix)
    power = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(float(a)))
    scale = sources.agg(F.sum(power)).first()[0]
    quota = F.round(power / F.lit(scale) * F.lit(float(budget))).cast("long")
    blocks = F.ceil(F.col("tokens") / F.lit(mix.block_tokens)).cast("long")
    plan = sources.select(
        "source_key",
        blocks.alias("blocks"),
        F.floor(quota / F.col("tokens")).cast("long").alias("passes"),
        (quota % F.col("tokens")).alias("rest"),
        F.ceil(F.sqrt(blocks)).cast("long").alias("ranges"),
    )
    placed = place(thin.join(plan, "source_key"), mix)
    totals = placed.groupBy("source_key", "rest", "ranges", "block", "place").agg(F.sum("tokens").alias("tokens"))
    totals = written(totals.withColumn("range", _range()), "blocks")
    by_range = totals.groupBy("source_key", "rest", "range").agg(F.sum("tokens").alias("tokens"))
    running = by_range.withColumn("upto", F.sum("tokens").over(Window.partitionBy("source_key").orderBy("range")))
    # the range in which the quota ends, and what the ranges before it hold
    cross = (
        running.where("upto > rest")
        .groupBy("source_key")
        .agg(F.min(F.struct("range", (F.col("upto") - F.col("tokens")).alias("before"))).alias("x"))
        .select("source_key", F.col("x.range").alias("range"), F.col("x.before").alias("before"))
    )
    inside = totals.join(cross, ["source_key", "range"]).withColumn(
        "upto", F.col("before") + F.sum("tokens").over(Window.partitionBy("source_key").orderBy("place"))
    )
    cuts = inside.groupBy("source_key").agg(
        F.max("range").alias("cut_range"),
        F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("place"))), F.lit(-1)).alias("cut"),
    )
    return written(plan.join(cuts, "source_key").select("source_key", "blocks", "passes", "ranges", "cut_range", "cut"), "mix", gone=[thin, sources, totals])


def _range() -> Column:
    return F.floor(F.col("place") / F.lit(float(2**48)) * F.col("ranges")).cast("long")


def place(docs: DataFrame, mix: Mix) -> DataFrame:
    """Add a document's block and the block's place in the partial pass; needs id, blocks, passes."""
    block = F.pmod(_digits(F.lit("doc"), F.col("id")), F.col("blocks"))
    docs = docs.withColumn("block", block)
    return docs.withColumn("place", _digits(F.lit(mix.seed), F.col("passes"), F.col("source_key"), F.col("block")))


def mix_sources(documents: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Rows of ``documents`` as often as the mix takes them, with ``mix_pass`` and ``mix_block``.

    Needs doc_id, text and source. Within a pass, blocks are read in the order of their hashed places.
    """
    plan = mixing_plan(documents, mix)
    inner = documents.select(whole_row(documents).alias("row"), _source_key().alias("source_key"), _own_key().alias("id"))
    placed = place(inner.join(plan, "source_key"), mix)
    last = (_range() < F.col("cut_range")) | ((_range() == F.col("cut_range")) & (F.col("place") <= F.col("cut")))
    copies = F.col("passes") + F.when(last, 1).otherwise(0)
    taken = placed.withColumn("copies", copies).where("copies > 0")
    passes = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    copied = taken.select("row", passes.alias("mix_pass"), F.col("block").alias("mix_block"))
    return spread_row(copied, documents.columns, ["mix_pass", "mix_block"])


def mixing_query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "source", "mix_pass", "mix_block")


SQL = r"""
WITH RECURSIVE thin AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS k, coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, '')) AS id,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens
  FROM documents
), s AS (SELECT k, sum(tokens)::DOUBLE AS n FROM thin GROUP BY k HAVING sum(tokens) > 0),
tot AS (SELECT sum(n) AS total, ln(count(*)) AS most, list(n / (SELECT sum(n) FROM s)) AS ps FROM s),
flat(step, lo, hi) AS (
  SELECT 0, CASE WHEN list_sum(list_transform(ps, lambda p: -p * ln(p))) >= 0.95 * most - 1e-9 THEN 1.0::DOUBLE ELSE 0.0 END, 1.0::DOUBLE FROM tot
  UNION ALL
  SELECT step + 1,
    CASE WHEN ln(z) - m * t / z >= 0.95 * most - 1e-9 THEN m ELSE lo END,
    CASE WHEN ln(z) - m * t / z >= 0.95 * most - 1e-9 THEN hi ELSE m END
  FROM (SELECT step, lo, hi, most, (lo + hi) / 2 AS m,
          list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2))) AS z,
          list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2) * ln(p))) AS t FROM flat, tot
        WHERE step < 40 AND lo < 1)
), a0 AS (SELECT lo AS a FROM flat ORDER BY step DESC LIMIT 1),
r0 AS (SELECT a, list_max(list_transform(ps, lambda p: pow(p, a) / p)) / list_sum(list_transform(ps, lambda p: pow(p, a))) AS rep FROM a0, tot),
reps(step, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE FROM r0 WHERE rep > 4
  UNION ALL
  SELECT step + 1, CASE WHEN rep > 4 THEN m ELSE lo END, CASE WHEN rep > 4 THEN hi ELSE m END
  FROM (SELECT step, lo, hi, (lo + hi) / 2 AS m,
          list_max(list_transform(ps, lambda p: pow(p, (lo + hi) / 2) / p)) / list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2))) AS rep
        FROM reps, tot WHERE step < 40)
), a AS (SELECT greatest((SELECT a FROM a0), coalesce((SELECT lo FROM reps ORDER BY step DESC LIMIT 1), 0)) AS a),
w AS (SELECT k, n, pow(n / total, a) / (SELECT sum(pow(n / total, a)) FROM s, tot, a) AS weight, total FROM s, tot, a),
plan AS (
  SELECT k, ceil(n / 8192)::BIGINT AS blocks, round(weight * total)::BIGINT // n::BIGINT AS passes,
         round(weight * total)::BIGINT % n::BIGINT AS rest FROM w
), b AS (
  SELECT t.*, blocks, passes, rest,
         ('0x' || substr(md5('doc|' || id), 1, 12))::BIGINT % blocks AS block FROM thin t JOIN plan USING (k)
), sums AS (
  SELECT k, passes, rest, block, ('0x' || substr(md5('7|' || passes || '|' || k || '|' || block), 1, 12))::BIGINT AS place,
         sum(tokens) AS tokens FROM b GROUP BY ALL
), taken AS (
  SELECT k, block, passes + CASE WHEN sum(tokens) OVER (PARTITION BY k ORDER BY place) <= rest THEN 1 ELSE 0 END AS copies FROM sums
)
SELECT doc_id, source, mix_pass, block AS mix_block
FROM b JOIN taken USING (k, block), LATERAL (SELECT unnest(range(copies)) AS mix_pass)
"""
