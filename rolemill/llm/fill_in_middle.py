"""Fill-in-the-middle transformation of texts, cut at line ends.

A text's units are its lines with their line ends. The texts of an Arrow batch are viewed as 64-bit
words of UTF-8: the bytes that end a unit are marked arithmetically, eight at a time, and counted
with ``bitwise_count``. A cut after k units is then a search in the running counts for the word and
a select of the bit inside it. Code points are counted from the same words, so no text becomes a
list of lines or of characters.

Where to cut, and in which order the parts stand, follows from hashes of the seed and the document's
id, so a task that runs again gives the same result. ``restored`` turns an output into its text.

Defined results: a null text counts as empty; an empty text, one that holds a marker, and one beyond
the rate is ``plain``: its output is the text and its character counts are null. A null id counts as an
empty one. Rows of one id are cut by the same numbers, each by its own text; repeated rows give
repeated results. Extra columns stay; one with the name of an added column is replaced by it. A long
text is a piece of work of its own, in memory of a few times its size. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.llm.arrow_text import chunks
from rolemill.llm.common import read, spread_row, whole_row
from rolemill.session import ship_package

SEED, RATE, SPM_RATE = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]

_EACH = np.uint64(0x0101010101010101)
_LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
_NEWLINES = np.uint64(0x0A0A0A0A0A0A0A0A)
_ONE = np.uint64(1)


class Marks:
    """One bit for each marked byte of a buffer, with rank and select over them."""

    def __init__(self, bits: np.ndarray):
        # a further empty word, so that a rank may be asked at the very end
        self.bits = np.concatenate([bits, np.zeros(1, np.uint64)])
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marked bytes before each position."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        below = (_ONE << (byte * np.uint64(8))) - _ONE
        return self.before[word] + np.bitwise_count(self.bits[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th marked byte, from 1."""
        word = np.searchsorted(self.before, k, side="left") - 1
        left = k - self.before[word]
        bits = self.bits[word]
        for step in range(1, 8):
            bits = np.where(left > step, bits & (bits - _ONE), bits)
        lowest = bits & (~bits + _ONE)
        return word * 8 + (np.bitwise_count(lowest - _ONE) >> 3)


def _words(data: np.ndarray) -> np.ndarray:
    padded = np.zeros(-(-len(data) // 8) * 8, np.uint8)
    padded[: len(data)] = data
    return padded.view("<u8")


def unit_ends(words: np.ndarray, offsets: np.ndarray) -> Marks:
    """The last byte of every unit: line feeds, and the last byte of a text."""
    other = words ^ _NEWLINES
    bits = ~(((other & _LOW7) + _LOW7) | other | _LOW7)
    last = offsets[1:][np.diff(offsets) > 0] - 1
    np.bitwise_or.at(bits, last >> 3, np.uint64(0x80) << ((last & 7).astype(np.uint64) * np.uint64(8)))
    return Marks(bits)


def continuations(words: np.ndarray) -> Marks:
    """Bytes that don't begin a code point."""
    return Marks((words >> np.uint64(7)) & ~(words >> np.uint64(6)) & _EACH)


def cut(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """(units, end of prefix, end of middle, characters of prefix, of middle) of each text.

    The ends are positions in ``data``, after the smaller and the larger of the two numbers modulo units + 1.
    """
    start, end = offsets[:-1], offsets[1:]
    words = _words(data)
    ends, inner = unit_ends(words, offsets), continuations(words)
    base = ends.rank(start)
    n = ends.rank(end) - base
    a, b = first % (n + 1), second % (n + 1)

    def after(units: np.ndarray) -> np.ndarray:
        at = start.copy()
        some = units > 0
        at[some] = ends.select(base[some] + units[some]) + 1
        return at

    p, m = after(np.minimum(a, b)), after(np.maximum(a, b))
    chars = lambda x: x - inner.rank(x)
    return n, p, m, chars(p) - chars(start), chars(m) - chars(p)


def _transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    prefix, suffix, middle = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    for batch in batches:
        column = lambda name, b=batch: b.column(name).to_numpy(zero_copy_only=False)
        plain, spm, h1, h2 = (column(c) for c in ("plain", "spm", "h1", "h2"))
        for low, high, data, offsets in chunks(batch.column("text")):
            n, p, m, prefix_chars, middle_chars = cut(data, offsets, h1[low:high], h2[low:high])
            same = plain[low:high].astype(bool)
            turned = spm[low:high].astype(bool)
            raw = data.tobytes()
            outputs = []
            for s, x, y, e, as_is, swap in zip(offsets[:-1].tolist(), p.tolist(), m.tolist(), offsets[1:].tolist(), same.tolist(), turned.tolist()):
                if as_is:
                    outputs.append(raw[s:e])
                elif swap:
                    outputs.append(b"".join([suffix, raw[y:e], prefix, raw[s:x], middle, raw[x:y]]))
                else:
                    outputs.append(b"".join([prefix, raw[s:x], suffix, raw[y:e], middle, raw[x:y]]))
            form = np.where(same, "plain", np.where(turned, "spm", "psm"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row").slice(low, high - low),
                    pa.array(n.astype(np.int64)),
                    pa.array(form.tolist(), pa.string()),
                    pa.array(prefix_chars.astype(np.int64), mask=same),
                    pa.array(middle_chars.astype(np.int64), mask=same),
                    pa.array(outputs, pa.binary()).cast(pa.string()),
                ],
                ["row", *ADDED],
            )


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE
) -> DataFrame:
    """The rows with n, form, prefix_chars, middle_chars and output.

    ``rate`` per cent of the ids are transformed, and ``spm_rate`` per cent of those have the suffix first.
    """
    ship_package(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    number = lambda i: F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(whole_row(docs).alias("row"), text.alias("text"), digest.alias("digest"))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    judged = rows.select(
        "row",
        "text",
        ((F.col("text") == "") | marked | (number(2) % 100 >= rate)).alias("plain"),
        (number(3) % 100 < spm_rate).alias("spm"),
        number(0).alias("h1"),
        number(1).alias("h2"),
    )
    kind = docs.select(whole_row(docs).alias("row")).schema["row"].dataType.simpleString()
    out = judged.mapInArrow(_transform, f"row {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return spread_row(out, docs.columns, ADDED)


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text an output was made of. No part holds a marker, so each marker stands once."""
    output = F.col(output) if isinstance(output, str) else output
    form = F.col(form) if isinstance(form, str) else form
    middle = F.substring_index(output, MIDDLE, -1)
    rest = F.substring_index(output, MIDDLE, 1)
    psm = F.concat(F.substring_index(F.substring_index(rest, SUFFIX, 1), PREFIX, -1), middle, F.substring_index(rest, SUFFIX, -1))
    spm = F.concat(F.substring_index(rest, PREFIX, -1), middle, F.substring_index(F.substring_index(rest, PREFIX, 1), SUFFIX, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fim_query(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(), 256).alias("restored_sha256"),
    )


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS units,
         ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM d
), c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
         coalesce(array_to_string(units[b + 1:], ''), '') AS suffix
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
