"""Near-duplicate lines by a deletion-neighbourhood join.

A line's words (A-Z lower-cased, split at white space) are its letters: the edit bound is one word
put in, left out or replaced, where the longer line has at least ``MIN_WORDS`` words; shorter lines
must be equal. Each distinct line emits its variants, the line and the line without each one word,
as hashed keys; two lines within the bound meet on an equal variant. A key keeps only its earliest
line of each kind, so a key that a third of all lines share costs one row per map task and no
pairs. The earliest line found is then verified by edit distance.

A line is dropped if an earlier line (by doc_id, then line number, then the text's hash, which tells
apart rows of equal or null ids) is equal or within the bound. Of
two lines within one edit, half of the words at one end are the same; lines that share no such half
with another line need not emit variants. This changes no result.

Defined results: blank lines and null texts are left as they are; null doc_ids come last and are equal
to each other; rows with equal doc_id and text are judged alike, rows with equal doc_id and other text
by their own lines;
a document whose lines are all dropped keeps an empty text; an empty table gives no rows; extra
columns are kept, but for one named lines_dropped, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.llm.arrow_text import chunks, mix, words
from rolemill.llm.common import read, spread_row, whole_row, written
from rolemill.session import ship_package

MIN_WORDS = 8
LAST = 2**63 - 1
#: Kinds of variants: the line itself, a word left out, and the gap of a word at its place.
OWN, CUT, GAP = 0, 1, 2

_B1, _B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, _U)
    p[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(p, dtype=_U)


def _line_borders(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, text of each line, number in it); a text has one line more than it has newlines."""
    cuts = np.flatnonzero(data == 10) + 1
    # a cut at a text's very end starts its last, empty line; it belongs to the text before it
    owner = np.searchsorted(offsets, cuts - 1, side="right") - 1
    texts = np.arange(len(offsets) - 1)
    starts = np.concatenate([offsets[:-1], cuts])
    owner = np.concatenate([texts, owner])
    order = np.lexsort((np.concatenate([np.zeros(len(texts)), np.ones(len(cuts))]), starts, owner))
    starts, owner = starts[order], owner[order]
    first = np.searchsorted(owner, texts)
    return starts, owner, np.arange(len(owner)) - first[owner]


def _line_keys(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(words, key, second key, and the keys of two heads and two tails) of lines.

    The halves are measured for the line's own length and for one word less: of lines with n and
    n+1 words both emit the halves for n. A line shares a half with each line a single edit away.
    """
    _, _, h, first = words(data, np.append(starts, len(data)))
    n = np.diff(first)
    if not len(h):
        none = np.zeros(len(n), _U)
        return n, none, none, none, none, none, none
    with np.errstate(over="ignore"):
        # sums of word times base**place, places counted from the chunk's start and then shifted back
        back = _powers(pow(_B1, -1, 1 << 64), len(h) + 1)
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(h * _powers(_B1, len(h)), dtype=_U)])
        stretch = lambda a, size: (sums[a + size] - sums[a]) * back[np.minimum(a, len(h))]
        size = n.astype(_U)
        key = mix(stretch(first[:-1], n) + size)
        other = np.concatenate([np.zeros(1, _U), np.cumsum(mix(h + _U(_B2)) * _powers(_B2, len(h)), dtype=_U)])
        shift = _powers(pow(_B2, -1, 1 << 64), len(h) + 1)[np.minimum(first[:-1], len(h))]
        second = mix((other[first[1:]] - other[first[:-1]]) * shift + size)
        halves = []
        for length in (n, n - 1):
            half = np.maximum((length - 1) // 2, 0)
            tag = length.astype(_U) * _U(_B2)
            halves.append(mix(stretch(first[:-1], half) + tag + _U(1)))
            halves.append(mix(stretch(first[1:] - half, half) + tag + _U(2)))
    return n, key, second, *halves


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    signed = lambda x: pa.array(x.view(np.int64))
    for batch in batches:
        doc, text_hash = (batch.column(c).to_numpy() for c in ("doc", "text_hash"))
        for begin, _, data, offsets in chunks(batch.column("text")):
            starts, owner, number = _line_borders(data, offsets)
            n, *keys = _line_keys(data, starts)
            full = n > 0
            owner = owner[full] + begin
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[owner]), pa.array(text_hash[owner]), pa.array(number[full].astype(np.int32)), pa.array(n[full].astype(np.int32)), *(signed(k[full]) for k in keys)],
                ["doc", "text_hash", "no", "n", "key", "key2", "h1", "h2", "h3", "h4"],
            )


def _rows(docs: DataFrame) -> DataFrame:
    """(doc, text_hash, text): what names a row, and its text."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc")
    return docs.where("text IS NOT NULL").select(doc, F.xxhash64("text").alias("text_hash"), "text")


def occurrences(docs: DataFrame) -> DataFrame:
    """Every line that has words, as hashes."""
    shape = "doc long, text_hash long, no int, n int, key long, key2 long, h1 long, h2 long, h3 long, h4 long"
    return _rows(docs).mapInArrow(_lines, shape)


def place() -> Column:
    """The order of lines. No two lines share a place, but those of rows equal in id and text."""
    return F.struct("doc", "no", "text_hash")


def with_partner(first: DataFrame) -> DataFrame:
    """(key, key2, place): the distinct lines that share a half with another; no other line is an edit from one."""
    long = first.where(F.col("n") >= MIN_WORDS - 1)
    halves = long.select("key", F.explode(F.array("h1", "h2", "h3", "h4")).alias("half"))
    shared = halves.groupBy("half").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("half")
    hit = halves.join(shared, "half", "left_semi").select("key").distinct()
    return long.join(hit, "key", "left_semi").select("key", "key2", "place.*")


def _line_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The asked lines of each text, words in lower case with one space between."""
    upper = bytes(range(256)).lower()
    for batch in batches:
        ats, lines = [], []
        for text, asked in zip(batch.column("text"), batch.column("asked")):
            parts = text.as_py().split("\n")
            for line in asked.as_py():
                ats.append(line["at"])
                lines.append(b" ".join(parts[line["no"]].encode("utf-8", "surrogatepass").translate(upper).split()).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([pa.array(ats, pa.int64()), pa.array(lines, pa.string())], ["at", "line"])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, kind, key) of each line's deletion neighbourhood, in time linear in its length.

    GAP: a word is missing at a place of a line of this length; all such lines are one replacement
    apart. CUT: a word left out; OWN: the line itself. A CUT is one edit from an equal OWN.
    """
    for batch in batches:
        for begin, _, data, offsets in chunks(batch.column("line")):
            _, _, h, first = words(data, offsets, lower=False)
            row, kind, key = [], [], []
            with np.errstate(over="ignore"):
                for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
                    w, n = h[a:b], b - a
                    p = _powers(_B1, n + 1)
                    here = np.concatenate([np.zeros(1, _U), np.cumsum(w * p[:n], dtype=_U)])
                    own = mix(here[-1:] + _U(n))
                    parts = [own]
                    if n >= MIN_WORDS:
                        # the words behind a gap move down by one place
                        moved = np.concatenate([np.zeros(1, _U), np.cumsum(w[1:] * p[: n - 1], dtype=_U)])
                        rest = here[:n] + (moved[-1] - moved)
                        gaps = mix(rest * _U(_B2) + np.arange(1, n + 1).astype(_U) * _U(_B1) + _U(n))
                        parts += [np.unique(mix(rest + _U(n - 1))), gaps]
                    for k, part in zip((OWN, CUT, GAP), parts):
                        row.append(np.full(len(part), begin + i))
                        kind.append(np.full(len(part), k, np.int32))
                        key.append(part)
            if not row:
                continue
            at = batch.column("at").take(pa.array(np.concatenate(row)))
            yield pa.RecordBatch.from_arrays([at, pa.array(np.concatenate(kind)), pa.array(np.concatenate(key).view(np.int64))], ["at", "kind", "key"])


def within_one_edit(a: Column, b: Column) -> Column:
    """At most one word put in, left out or replaced, and the longer line has MIN_WORDS words."""
    x, y = F.split(a, " "), F.split(b, " ")
    n, m = F.size(x), F.size(y)
    differ = F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q))
    start = F.coalesce(F.array_position(differ, True), F.lit(0)).cast("int")  # from 1; 0: none
    tail = lambda w, k: F.slice(w, k, F.greatest(F.size(w) - k + 1, F.lit(0)))
    same_tail = (
        F.when(n == m, tail(x, start + 1) == tail(y, start + 1))
        .when(n == m + 1, tail(x, start + 1) == tail(y, start))
        .when(m == n + 1, tail(x, start) == tail(y, start + 1))
        .otherwise(F.lit(False))
    )
    return (F.greatest(n, m) >= MIN_WORDS) & ((start == 0) | same_tail)


def near_earlier(docs: DataFrame, lines: DataFrame, first: DataFrame) -> DataFrame:
    """(key, key2): distinct lines that have an earlier line within one edit, as a written table."""
    # numbered in the order of their places, so that what follows compares numbers
    partner = with_partner(first).orderBy("doc", "no", "text_hash").withColumn("at", F.monotonically_increasing_id())
    partner = written(partner, "with-partner")
    asked = lines.join(partner, ["key", "key2", "doc", "no", "text_hash"]).groupBy("doc", "text_hash").agg(F.collect_set(F.struct("no", "at")).alias("asked"))
    texts = _rows(docs).join(asked, ["doc", "text_hash"]).select("text", "asked")
    near = written(texts.mapInArrow(_line_texts, "at long, line string"), "near-lines")
    emitted = near.mapInArrow(_variants, "at long, kind int, key long")
    earliest = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("at")))
    met = emitted.groupBy("key").agg(earliest(OWN).alias("own"), earliest(CUT).alias("cut"), earliest(GAP).alias("gap"), F.min("at").alias("x"), F.max("at").alias("y"))
    met = emitted.join(met.where("x <> y").drop("x", "y"), "key")
    other = F.when(F.col("kind") == OWN, F.col("cut")).when(F.col("kind") == CUT, F.col("own")).otherwise(F.col("gap"))
    pairs = met.select("at", other.alias("first")).where("first < at").distinct()
    ahead = near.select(F.col("at").alias("first"), F.col("line").alias("first_line"))
    checked = pairs.join(near, "at").join(ahead, "first").where(within_one_edit(F.col("line"), F.col("first_line")))
    late = checked.select("at").distinct().join(partner, "at").select("key", "key2")
    return written(late, "late", gone=[near, partner])


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc, text_hash, dropped): the numbers of the lines to drop, of rows that lose any; a written table."""
    ship_package(docs.sparkSession)
    lines = written(occurrences(docs), "lines")
    halves = [F.max(h).alias(h) for h in ("h1", "h2", "h3", "h4")]
    first = lines.groupBy("key", "key2").agg(F.min(place()).alias("place"), F.count("*").alias("times"), F.max("n").alias("n"), *halves)
    first = written(first, "first-lines")
    late = near_earlier(docs, lines, first)
    judged = first.select("key", "key2", "place", "times").join(late.withColumn("near", F.lit(True)), ["key", "key2"], "left").where("times > 1 OR near")
    judged = written(judged.select("key", "key2", F.col("place").alias("first"), F.coalesce("near", F.lit(False)).alias("near")), "judged", gone=[first, late])
    out = lines.select("doc", "text_hash", "no", "key", "key2").join(judged, ["key", "key2"]).where(F.col("near") | (place() > F.col("first")))
    return written(out.groupBy("doc", "text_hash").agg(F.collect_set("no").alias("dropped")), "dropped", gone=[lines, judged])


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``, and ``lines_dropped``."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    keyed = docs.select(whole_row(docs).alias("row"), "text", doc.alias("doc"), F.xxhash64("text").alias("text_hash"))
    split = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("dropped"))
    text = F.array_join(F.transform(kept, lambda i: split[i]), "\n")
    met = keyed.join(dropped_lines(docs), ["doc", "text_hash"], "left")
    new = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(text)
    lost = F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped"))
    out = met.select(F.col("row").withField("text", new).alias("row"), lost.alias("lines_dropped"))
    return spread_row(out, docs.columns, ["lines_dropped"])


def line_query(spark, sf_dir: str) -> DataFrame:
    return line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH l AS (
  SELECT doc_id, no, raw, trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents)
), f AS (SELECT line, min((doc_id, no)) AS pos, string_split(line, ' ') AS w FROM l WHERE line <> '' GROUP BY line),
g AS (
  SELECT line, pos, w, len(w) AS n, i, array_to_string(w[:i - 1] || w[i + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM f WHERE len(w) >= 8)
),
gap AS (SELECT n, i, rest, min(pos) AS pos FROM g GROUP BY ALL),
cut AS (SELECT rest, min(pos) AS pos FROM g GROUP BY ALL),
near AS (
  SELECT line FROM g JOIN gap USING (n, i, rest) WHERE gap.pos < g.pos
  UNION SELECT g.line FROM g JOIN f ON f.line = g.rest WHERE f.pos < g.pos
  UNION SELECT f.line FROM f JOIN cut ON cut.rest = f.line WHERE cut.pos < f.pos
),
j AS (
  SELECT l.doc_id, l.no, l.raw, l.line <> '' AND (n.line IS NOT NULL OR (l.doc_id, l.no) > f.pos) AS dropped
  FROM l LEFT JOIN f ON f.line = l.line LEFT JOIN near n ON n.line = l.line
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(o.text, '') END AS text, coalesce(o.lines_dropped, 0)::INT AS lines_dropped
FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(raw, chr(10) ORDER BY no) FILTER (WHERE NOT coalesce(dropped, false)) AS text,
         count(*) FILTER (WHERE dropped) AS lines_dropped
  FROM j GROUP BY doc_id
) o USING (doc_id)
"""
