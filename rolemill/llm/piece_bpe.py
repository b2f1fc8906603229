"""SentencePiece (BPE, byte fallback) encoding and decoding by vectorised merge rounds.

Texts become one flat array of symbols. It is cut into words wherever two neighbouring characters
stand side by side in no piece of the vocabulary: no merge can cross such a place, so the words
don't influence each other, and a word that occurs often in a window is merged once. In a round
every word looks for the smallest rank among its pairs, merges all pairs of that rank from left to
right at once, and the arrays are compacted; words without a pair leave. Rounds end when none is left.

Merging all at once gives what one merge at a time gives unless a new symbol makes a pair with a
neighbour that is due no later than the pairs being merged (runs of blanks do: their pieces share one
rank). Such words take that round by a sweep from left to right, which settles those new pairs first.

The vocabulary is read on the driver and broadcast; its size is that of the model, not of the data.
Executors need neither the model's file nor its library.

Defined results: a null text counts as empty; an empty text has the end id only; bytes that aren't
UTF-8 count as U+FFFD; U+2581 is a blank, as in the library, and comes back as one. Repeated rows give
repeated results; extra columns stay, and one with the name of an added column is replaced by it. A
text beyond a window's size is worked on in windows that end between words; a word is never cut, so
memory grows with the longest word, and with the ids of the longest text. An empty table gives no rows.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolemill.llm.arrow_text import _powers, chunks, mix
from rolemill.llm.common import read, spread_row, whole_row
from rolemill.session import ship_package

BLANK = 0x2581
#: Characters of a window; it may be longer only where one word is.
WINDOW = 1 << 18
NEVER = np.iinfo(np.int32).max
_CHARS = 0x110000
_FILTER_BITS = 22


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("rolemill-each-byte", _each_byte)


@dataclass
class Vocabulary:
    """What encoding and decoding need of a model, as arrays.

    A symbol is a piece's id, or ``size`` plus the code point of a character that is no piece.
    """

    size: int
    of_char: np.ndarray  # symbol of each code point
    pairs: np.ndarray  # sorted left * (size + _CHARS) + right
    ranks: np.ndarray  # of each pair: place of the product's score, best first
    products: np.ndarray
    joined: np.ndarray  # filter over hashes of neighbouring characters inside pieces
    byte_ids: np.ndarray
    surface: np.ndarray  # bytes that pieces are decoded to, end to end
    surface_at: np.ndarray
    is_byte: np.ndarray
    blank_first: np.ndarray  # pieces that begin with a blank
    end_id: int

    @cached_property
    def pair_dict(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.pairs.tolist(), zip(self.ranks.tolist(), self.products.tolist())))

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, product) of pairs; NEVER where they don't merge."""
        wanted = left * (self.size + _CHARS) + right
        at = np.searchsorted(self.pairs, wanted)
        found = self.pairs[np.minimum(at, len(self.pairs) - 1)] == wanted
        at = np.where(found, at, 0)
        return np.where(found, self.ranks[at], NEVER), self.products[at]


def _pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def load_vocabulary(model_file: str) -> Vocabulary:
    """The arrays of a SentencePiece model; ValueError for kinds that this operator doesn't encode."""
    from sentencepiece import sentencepiece_model_pb2 as kinds

    model = kinds.ModelProto()
    with open(model_file, "rb") as data:
        model.ParseFromString(data.read())
    norm, trained = model.normalizer_spec, model.trainer_spec
    plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
    of_kind = {p.type for p in model.pieces}
    piece = kinds.ModelProto.SentencePiece
    if not plain or trained.model_type != 2 or not trained.byte_fallback or trained.treat_whitespace_as_suffix or of_kind & {piece.USER_DEFINED, piece.UNUSED}:
        raise ValueError("only BPE models with byte fallback, a leading blank and no other normalisation")
    size = len(model.pieces)
    normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == piece.NORMAL}
    places = {s: r for r, s in enumerate(sorted({model.pieces[i].score for i in normal.values()}, reverse=True))}

    of_char = size + np.arange(_CHARS, dtype=np.int64)
    for text, i in normal.items():
        if len(text) == 1:
            of_char[ord(text)] = i
    symbol = lambda text: int(of_char[ord(text)]) if len(text) == 1 else normal.get(text)
    merges, beside = [], set()
    for text, i in normal.items():
        beside.update(zip(text, text[1:]))
        for at in range(1, len(text)):
            left, right = symbol(text[:at]), symbol(text[at:])
            if left is not None and right is not None:
                merges.append((left * (size + _CHARS) + right, places[model.pieces[i].score], i))
    pairs, ranks, products = (np.array(x, np.int64) for x in zip(*sorted(merges)))
    joined = np.zeros(1 << _FILTER_BITS, bool)
    joined[_pair_hash(np.array([ord(a) for a, _ in beside]), np.array([ord(b) for _, b in beside]))] = True

    byte_ids = np.zeros(256, np.int32)
    surfaces = []
    for i, p in enumerate(model.pieces):
        if p.type == piece.BYTE:
            byte_ids[int(p.piece[3:5], 16)] = i
            surfaces.append(bytes([int(p.piece[3:5], 16)]))
        elif p.type == piece.CONTROL:
            surfaces.append(b"")
        elif p.type == piece.UNKNOWN:
            surfaces.append(trained.unk_surface.encode())
        else:
            surfaces.append(p.piece.replace(chr(BLANK), " ").encode())
    return Vocabulary(
        size,
        of_char,
        pairs,
        ranks.astype(np.int32),
        products,
        joined,
        byte_ids,
        np.frombuffer(b"".join(surfaces), np.uint8),
        np.concatenate([[0], np.cumsum([len(s) for s in surfaces])]),
        np.array([p.type == piece.BYTE for p in model.pieces]),
        np.array([p.type == piece.NORMAL and p.piece.startswith(chr(BLANK)) for p in model.pieces]),
        next(i for i, p in enumerate(model.pieces) if p.piece == trained.eos_piece),
    )


# --- encoding -------------------------------------------------------------------------


def sweep(symbols: list[int], rank: int, vocabulary: Vocabulary) -> list[int]:
    """One word's merges of pairs due at ``rank``, or at new pairs due no later, in order."""
    pairs, wide = vocabulary.pair_dict, vocabulary.size + _CHARS
    none = (NEVER, -1)
    due = lambda a, b: pairs.get(a * wide + b, none)
    out: list[int] = []
    at, n = 0, len(symbols)
    while at < n:
        here = symbols[at]
        at += 1
        new = False
        while True:
            # before its first merge a symbol can only meet its right neighbour
            left = due(out[-1], here) if new and out else none
            right = due(here, symbols[at]) if at < n else none
            if min(left[0], right[0]) > rank:
                break
            if left[0] <= right[0]:
                out.pop()
                here = left[1]
            else:
                here = right[1]
                at += 1
            new = True
        out.append(here)
    return out


def _round(sym, word, rank, product, vocabulary):
    """One round over flat arrays: every word has a pair. Returns the next arrays."""
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    sizes = np.diff(np.append(starts, len(sym)))
    least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
    hits = np.flatnonzero(rank == least)
    # of overlapping pairs every second one from the left is merged
    first = np.concatenate([[True], hits[1:] != hits[:-1] + 1])
    run = np.maximum.accumulate(np.where(first, np.arange(len(hits)), 0))
    hits = hits[(np.arange(len(hits)) - run) % 2 == 0]
    made = product[hits]

    changed = np.zeros(len(sym), bool)
    alive = np.ones(len(sym), bool)
    after = sym.copy()
    after[hits], changed[hits], alive[hits + 1] = made, True, False
    before = np.maximum(hits - 1, 0)
    before = np.where(alive[before], before, np.maximum(hits - 2, 0))
    follows = np.minimum(hits + 2, len(sym) - 1)
    in_word = (before < hits) & (word[before] == word[hits])
    left = np.where(in_word, vocabulary.look_up(after[before], made)[0], NEVER)
    in_word = (follows == hits + 2) & (word[follows] == word[hits])
    right = np.where(in_word, vocabulary.look_up(made, sym[follows])[0], NEVER)
    early = np.unique(word[hits[np.minimum(left, right) <= least[hits]]])
    for w in early.tolist():
        low, high = np.searchsorted(word, [w, w + 1])
        swept = sweep(sym[low:high].tolist(), int(least[low]), vocabulary)
        after[low : low + len(swept)] = swept
        changed[low:high] = True
        alive[low:high] = np.arange(high - low) < len(swept)

    sym, word, rank, product, changed = after[alive], word[alive], rank[alive], product[alive], changed[alive]
    nearby = np.zeros(len(sym), bool)
    same = word[1:] == word[:-1]
    nearby[:-1] = (changed[:-1] | changed[1:]) & same
    last = np.append(~same, True)
    rank[last] = NEVER
    ask = np.flatnonzero(nearby)
    rank[ask], product[ask] = vocabulary.look_up(sym[ask], sym[ask + 1])
    return sym, word, rank, product


def merge_words(sym: np.ndarray, word: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, word of each) after all merges; ``word`` doesn't decrease."""
    rank = np.full(len(sym), NEVER, np.int32)
    product = np.full(len(sym), -1, np.int64)
    ask = np.flatnonzero(word[1:] == word[:-1])
    rank[ask], product[ask] = vocabulary.look_up(sym[ask], sym[ask + 1])
    left_sym, left_word = [], []
    while len(sym):
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        sizes = np.diff(np.append(starts, len(sym)))
        going = np.repeat(np.minimum.reduceat(rank, starts) < NEVER, sizes)
        left_sym.append(sym[~going])
        left_word.append(word[~going])
        sym, word, rank, product = sym[going], word[going], rank[going], product[going]
        if len(sym):
            sym, word, rank, product = _round(sym, word, rank, product, vocabulary)
    sym, word = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left_sym, left_word))
    order = np.argsort(word, kind="stable")
    return sym[order], word[order]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, … of each range, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _same_words(chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one of each different word, the place of each word in it), compared by their characters."""
    up, down = _powers(1 << max(20, int(len(chars)).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * up[: len(chars)], dtype=np.uint64)])
        hashes = mix((sums[starts + sizes] - sums[starts]) * down[starts] + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, shown, place = np.unique(hashes, return_index=True, return_inverse=True)
    model = shown[place]
    alike = sizes == sizes[model]
    at = np.flatnonzero(alike)
    own = chars[_ranges(starts[at], sizes[at])]
    other = chars[_ranges(starts[model[at]], sizes[at])]
    unlike = np.add.reduceat(own != other, np.cumsum(sizes[at]) - sizes[at]) if len(at) else np.zeros(0)
    alike[at[unlike > 0]] = False
    odd = np.flatnonzero(~alike)  # two words of one hash: each stands for itself
    place = place.copy()
    place[odd] = len(shown) + np.arange(len(odd))
    return np.concatenate([shown, odd]), place


def _encode_words(chars: np.ndarray, cuts: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids of each word) of the words that begin at ``cuts``."""
    sizes = np.diff(np.append(cuts, len(chars)))
    shown, place = _same_words(chars, cuts, sizes)
    sym = vocabulary.of_char[chars[_ranges(cuts[shown], sizes[shown])]]
    sym, word = merge_words(sym, np.repeat(np.arange(len(shown)), sizes[shown]), vocabulary)
    # characters that are no piece become the ids of their bytes
    odd = np.flatnonzero(sym >= vocabulary.size)
    as_bytes = [chr(c).encode("utf-8", "replace") for c in (sym[odd] - vocabulary.size).tolist()]
    wide = np.ones(len(sym), np.int64)
    wide[odd] = [len(b) for b in as_bytes]
    ids = np.repeat(sym, wide)
    word = np.repeat(word, wide)
    if len(odd):
        at = (np.cumsum(wide) - wide)[odd]
        ids[_ranges(at, wide[odd])] = vocabulary.byte_ids[np.frombuffer(b"".join(as_bytes), np.uint8)]
    count = np.bincount(word, minlength=len(shown))
    first = np.cumsum(count) - count
    counts = count[place]
    return ids[_ranges(first[place], counts)].astype(np.int32), counts


def _characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets in them) with a blank before each text that isn't empty, blanks escaped."""
    raw = data.tobytes()
    try:
        chars = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        at = leads[offsets]
    except UnicodeDecodeError:
        texts = [raw[a:b].decode("utf-8", "rolemill-each-byte") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    filled = at[:-1][np.diff(at) > 0]
    chars = np.insert(chars, filled, 0x20)
    shift = np.concatenate([[0], np.cumsum(np.diff(at) > 0)])
    return np.where(chars == 0x20, np.uint32(BLANK), chars), at + shift


def encode(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets in them) of texts given as bytes and offsets, each with the end id."""
    chars, at = _characters(data, offsets)
    parts, per_text = [], np.zeros(len(at) - 1, np.int64)
    start = 0
    while start < len(chars):
        reach = window
        while True:
            end = min(start + reach, len(chars))
            piece = chars[start : end + 1]  # one more, to know whether a word ends there
            cut = np.empty(len(piece), bool)
            cut[0] = True
            cut[1:] = ~vocabulary.joined[_pair_hash(piece[:-1], piece[1:])]
            low, high = np.searchsorted(at, [start, start + len(piece)])
            cut[at[low:high] - start] = True
            if end == len(chars):
                break
            last = np.flatnonzero(cut)[-1]
            if last:
                end = start + last
                break
            reach *= 2
        cuts = np.flatnonzero(cut[: end - start])
        ids, counts = _encode_words(chars[start:end], cuts, vocabulary)
        parts.append(ids)
        of = np.searchsorted(at, cuts + start, side="right") - 1
        per_text += np.bincount(of, weights=counts, minlength=len(per_text)).astype(np.int64)
        start = end
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    ends = np.cumsum(per_text + 1)
    out = np.empty(len(flat) + len(per_text), np.int32)
    inside = np.ones(len(out), bool)
    inside[ends - 1] = False
    out[inside] = flat
    out[~inside] = vocabulary.end_id
    return out, np.concatenate([[0], ends])


# --- decoding -------------------------------------------------------------------------


def decode(ids: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> list[bytes]:
    """UTF-8 of each text: pieces with their blanks, byte ids joined, the first blank of a text left out."""
    low = vocabulary.surface_at[ids]
    size = vocabulary.surface_at[ids + 1] - low
    # the blank that encoding put first; ids that give nothing may stand before it
    gives = np.flatnonzero(size > 0)
    nearest = np.searchsorted(gives, offsets[:-1])
    some = nearest < len(gives)
    head = np.where(some, gives[np.minimum(nearest, max(len(gives) - 1, 0))] if len(gives) else 0, 0)
    some &= head < offsets[1:]
    head = head[some]
    head = head[vocabulary.blank_first[ids[head]]]
    low[head] += 1
    size[head] -= 1
    data = vocabulary.surface[_ranges(low, size)].tobytes()
    ends = np.concatenate([[0], np.cumsum(size)])[offsets]
    texts = [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    for i, text in enumerate(texts):
        try:
            text.decode("utf-8")
        except UnicodeDecodeError:  # ids of bytes that make no character
            texts[i] = text.decode("utf-8", "rolemill-each-byte").encode()
    return texts


# --- frames ---------------------------------------------------------------------------


def _broadcast(spark: SparkSession, model_file: str):
    ship_package(spark)
    return spark.sparkContext.broadcast(load_vocabulary(model_file))


def _text_array(texts: list[bytes]) -> pa.Array:
    return pa.array(texts, pa.binary()).cast(pa.string())


def encode_texts(docs: DataFrame, model_file: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """The rows with ``ids``, array of int, the end id last; with ``decoded`` also their text.

    Decoding in the same pass spares each task a second Python worker.
    """
    shared = _broadcast(docs.sparkSession, model_file)
    added = ["ids", "decoded"] if decoded else ["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text"), WINDOW):
                ids, ends = encode(data, offsets, shared.value)
                out = [batch.column("row").slice(low, high - low), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))]
                if decoded:
                    out.append(_text_array(decode(ids, ends, shared.value)))
                yield pa.RecordBatch.from_arrays(out, ["row", *added])

    rows = docs.select(whole_row(docs).alias("row"), F.col(text_col).alias("text"))
    kind = f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>" + (", decoded string" if decoded else "")
    return spread_row(rows.mapInArrow(run, kind), docs.columns, added)


def decode_ids(docs: DataFrame, model_file: str, ids_col: str = "ids") -> DataFrame:
    """The rows with ``decoded``; null and empty lists of ids give an empty text, null ids nothing."""
    shared = _broadcast(docs.sparkSession, model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            texts = decode(ids, np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("row"), _text_array(texts)], ["row", "decoded"])

    given = F.filter(F.coalesce(F.col(ids_col), F.array().cast("array<int>")), lambda i: i.isNotNull()).alias("ids")
    rows = docs.select(whole_row(docs).alias("row"), given)
    return spread_row(rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, decoded string"), docs.columns, ["decoded"])


def piece_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = encode_texts(read(spark, sf_dir, "documents").select("doc_id", "text"), model, decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
