"""Operator 8: SentencePiece encoding and decoding as a relational lattice.

A text is cut into units: spaces (as the model's marks) and what follows of one
class of characters, letters, others, or one digit or line end. No piece of the
model crosses such a cut, which is checked when the piece table is read, so a
unit's ids depend on the unit alone. Of every distinct unit all substrings of up
to the longest piece's length are exploded and equi-joined to the piece table;
the edges found are grouped by unit and folded with Spark's higher-order
aggregate.

The fold depends on the kind of model. In a unigram model ids are the path of
the best score sum: Viterbi (`fold_viterbi`). In a BPE model scores are merge
ranks, and a best sum isn't what the model means, so there the edges are folded
in order of rank: an edge takes effect where exactly two symbols fill it
(`fold_merges`). Pieces of a trained BPE model have worse ranks than their parts,
so one pass over the edges gives the ids of the library.

Decoding maps ids to the bytes of their pieces and joins the bytes; byte pieces
need no other way.

A corpus is encoded by its distinct units. The most frequent words (what stands
between two spaces, of one or more units) and units, a bounded number of bounded
length, get codes and are broadcast; texts become their codes, packed in bundles
of documents, with holes for the other units, whose ids are joined to the
bundles by a shuffle. Codes and holes then give way to ids. As a document's row the query returns its ids in order, how
many there are, how many of them are bytes, whether they decode to its text
(compared by 128 bits of BLAKE2, so texts aren't shuffled; marks in a text count
as spaces, as the model reads them), and a hash of the ids in their order.
`encode` returns the ids beside other columns, and `decode` their text.

Defined cases: a null or empty text has no pieces and is complete; texts of any
length are encoded whole, and so are units: one of over BITS characters, such as
a thousand equal letters, is cut where no piece can cross, and parts that are
still longer merge where they stand, by a heap of their pairs (`merge_long`);
characters that the model lacks become byte pieces; repeated rows each get their
row; an empty table gives an empty one; other columns of the input aren't
carried by `count_encoded`.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from zstandard import ZstdCompressor, ZstdDecompressor

from bookflow.llm.common import forget, table, written

MARK = "▁"
#: Units up to this many characters hold their boundaries in one long.
BITS = 62
#: Most words and most units with codes, their characters, and how often a task has to see a word to propose it.
HOT_LIMIT, HOT_UNITS, HOT_CHARS, HOT_TIMES = 60_000, 300_000, 32, 8
#: Distinct words that a task holds before it hands them on, and bytes of text in a bundle of documents, about.
GROUP_WORDS, BUNDLE_BYTES = 150_000, 2_000_000
#: Places of an edge's rank, id, start and length in one long: 18, 18, 20 and 7 bits.
_RANK, _ID, _START = 1 << 45, 1 << 27, 1 << 7
_WIDEST, _LONGEST = (1 << 18) - 1, (1 << 7) - 1
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
#: Spaces and a run of letters, a digit, a line end or a run of others.
_UNIT = re.compile(rf" *(?:[{_LETTERS}]+|[0-9]|\n|[^{_LETTERS}0-9\n ]+)| +")
_ONE_CLASS = re.compile(rf"[{_LETTERS}]{{2}}|[^{_LETTERS}0-9\n]{{2}}")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The piece table of a model file: texts, scores, ranks by text, which are bytes, and the pairs of characters inside pieces."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(n)]
        self.scores = [model.get_score(i) for i in range(n)]
        self.byte = {int(self.texts[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ranked = sorted(self.plain, key=lambda i: (-self.scores[i], i))
        self.rank = {self.texts[i]: r for r, i in enumerate(self.ranked)}
        self.longest = max(len(self.texts[i]) for i in self.plain)
        self.inside = {t[k : k + 2] for i in self.plain for t in [self.texts[i]] for k in range(len(t) - 1)}
        if n > _WIDEST or self.longest > _LONGEST:
            raise ValueError("this model has too many or too long pieces for one long an edge")
        if any(pair[0] != MARK and (pair[1] == MARK or not _ONE_CLASS.fullmatch(pair)) for pair in self.inside):
            raise ValueError("pieces of this model cross spaces or classes of characters; units can't be encoded alone")


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def units(text: str) -> list[str]:
    """The units of a text in order, with spaces for marks."""
    return _UNIT.findall(" " + text.replace(MARK, " ")) if text else []


def bundles_of(texts: pa.StringArray, most: int) -> Iterator[tuple[int, int]]:
    """First and end row of stretches of `texts` of about `most` bytes; a longer text is one alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield first, k
            first, held = k, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes)


def words_of(texts: pa.StringArray) -> tuple[pa.ListArray, np.ndarray]:
    """The words of each text, what stands between single spaces, and which texts aren't such words: empty ones, and those with spaces in a row or at an end. Marks count as spaces."""
    plain = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
    found = pc.split_pattern(plain, " ")
    empty = pc.equal(found.flatten(), "").to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(empty)])
    ends = found.offsets.to_numpy() - found.offsets[0].as_py()
    return found, at[ends[1:]] > at[ends[:-1]]


def units_of_words(distinct: list[str]) -> tuple[list[str], np.ndarray]:
    """The units of distinct words one after the other, and the number of units of each. Only a word's first unit has a space."""
    found = _UNIT.findall(" " + " ".join(distinct)) if distinct else []
    starts = np.fromiter((u[0] == " " for u in found), bool, len(found))
    return found, np.diff(np.append(np.flatnonzero(starts), len(found)))


def short_units(unit: str, inside: set[str]) -> list[str]:
    """A unit with marks, or its parts where it is too long for one long: it is cut where no piece can cross."""
    if len(unit) <= BITS:
        return [unit]
    starts = [0, *(k for k in range(1, len(unit)) if unit[k - 1 : k + 1] not in inside), len(unit)]
    return [unit[a:b] for a, b in zip(starts, starts[1:], strict=False)]


def merge_long(unit: str, path: str) -> list[int]:
    """The ids of a unit of any length: neighbouring symbols merge in order of rank, the leftmost first."""
    model = pieces(path)
    symbols, after = list(unit), list(range(1, len(unit) + 1))
    before = list(range(-1, len(unit) - 1))
    heap: list[tuple[int, int, str]] = []

    def propose(left: int) -> None:
        right = after[left]
        if right < len(symbols):
            both = symbols[left] + symbols[right]
            rank = model.rank.get(both)
            if rank is not None:
                heapq.heappush(heap, (rank, left, both))

    for k in range(len(symbols)):
        propose(k)
    while heap:
        _, left, both = heapq.heappop(heap)
        right = after[left] if symbols[left] else len(symbols)
        if right == len(symbols) or symbols[left] + symbols[right] != both:
            continue
        symbols[left], symbols[right] = both, ""
        after[left] = after[right]
        if after[left] < len(symbols):
            before[after[left]] = left
        propose(left)
        if before[left] >= 0:
            propose(before[left])
    out = []
    for symbol in filter(None, symbols):
        rank = model.rank.get(symbol)
        out += [model.ranked[rank]] if rank is not None else [model.byte.get(b, 0) for b in symbol.encode()]
    return out


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """`piece, id, rank` of the model's plain pieces, the best score first; as many rows as the model has pieces."""
    model = pieces(path)
    return spark.createDataFrame([(model.texts[i], i, r) for r, i in enumerate(model.ranked)], "piece string, id int, rank long")


def lattice(words: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """From distinct `unit`s: `unit, edges` and other columns, each edge rank, id, start and length in one long.

    The empty substring at the start of each unit stands for a unit without any
    piece, and is dropped again; so no second join with the units is needed. The
    join's key is a hash of the text, as a long is found faster than a string,
    and the texts are compared where it is found.
    """
    n = F.char_length("unit")
    others = [c for c in words.columns if c != "unit"]
    starts = words.select("*", n.alias("n_chars"), F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    starts = starts.select("unit", *others, "start", F.substring(F.col("unit"), F.col("start") + 1, longest).alias("suffix"), F.least(F.lit(longest), F.col("n_chars") - F.col("start")).alias("most"))
    least = F.when(F.col("start") == 0, 0).otherwise(1)
    spans = starts.select("unit", *others, "start", "suffix", F.explode(F.sequence(least, F.col("most"))).alias("len"))
    empty = table.sparkSession.createDataFrame([("", 0, _WIDEST)], "piece string, id int, rank long")
    known = table.select("piece", "id", "rank").unionByName(empty).select(F.xxhash64("piece").alias("code"), F.col("piece").alias("whole"), (F.col("rank") * _RANK + F.col("id").cast("long") * _ID).alias("front"))
    part = spans.withColumn("piece", F.substring(F.col("suffix"), F.lit(1), F.col("len"))).withColumn("code", F.xxhash64("piece"))
    same = F.startswith("piece", "whole") & (F.octet_length("whole") >= F.octet_length("piece"))
    found = part.join(F.broadcast(known), (part["code"] == known["code"]) & same)
    edge = F.col("front") + F.col("start") * _START + F.col("len")
    edges = found.select("unit", *others, edge.alias("edge")).groupBy("unit").agg(F.sort_array(F.collect_list("edge")).alias("edges"), *(F.first(c).alias(c) for c in others))
    return edges.withColumn("edges", F.expr("slice(edges, 1, size(edges) - 1)"))


# The parts of an edge as SQL inside lambdas.
_S, _L, _I = "cast(shiftright(e, 7) & 1048575 as int)", "cast(e & 127 as int)", "cast(shiftright(e, 27) & 262143 as int)"


def fold_merges(edges: DataFrame) -> DataFrame:
    """`unit, edges` with `held`, the edges between neighbouring boundaries after all merges.

    A unit's boundaries are the bits of one long. An edge is two masks: its ends
    must be boundaries, and it merges where just one boundary is inside.
    """
    masks = f"transform(edges, e -> named_struct('e', e, 'ends', shiftleft(shiftleft(1L, {_L}) | 1L, {_S}), 'inner', shiftleft(shiftleft(1L, {_L} - 1) - 1L, {_S} + 1)))"
    bits = "aggregate(filter(masks, x -> x.inner <> 0), shiftleft(1L, char_length(unit) + 1) - 1, (m, x) -> if((m & x.ends) = x.ends and bit_count(m & x.inner) = 1, m & ~x.inner, m))"
    held = "transform(filter(masks, x -> (bits & x.ends) = x.ends and (bits & x.inner) = 0), x -> x.e)"
    return edges.withColumn("masks", F.expr(masks)).withColumn("bits", F.expr(bits)).withColumn("held", F.expr(held)).drop("masks", "bits")


def fold_viterbi(table: DataFrame, unknown: float = -1e4) -> Column:
    """The best path for `unit, edges`, with the scores of `table` by rank: an array of edges in order. A character without piece costs `unknown`.

    The fold goes over end positions; its state is the best score and the last
    edge of each prefix, from which the path is read back.
    """
    scores = [r.score for r in table.select("rank", "score").orderBy("rank").collect()]  # the piece table
    score = f"element_at(split('{','.join(map(repr, scores))}', ','), cast(shiftright(e, 45) as int) + 1)"
    best = (
        "aggregate(sequence(1, char_length(unit)), array(named_struct('s', 0D, 'e', 0L)), (a, k) -> concat(a, array("
        f"array_max(concat(array(named_struct('s', element_at(a, k).s + {unknown}D, 'e', cast(-1 as bigint))), transform(filter(edges, e -> {_S} + {_L} = k), "
        f"e -> named_struct('s', element_at(a, {_S} + 1).s + cast({score} as double), 'e', e)))))))"
    )
    back = (
        f"aggregate(sequence(1, char_length(unit)), named_struct('at', char_length(unit), 'path', cast(array() as array<bigint>)), (p, k) -> if(p.at = 0, p, "
        f"named_struct('at', p.at - if(element_at(best, p.at + 1).e < 0, 1, cast(element_at(best, p.at + 1).e & 127 as int)), 'path', concat(array(element_at(best, p.at + 1).e), p.path))))"
    )
    return F.expr(f"transform(array({best}), best -> {back}.path)[0]")


def _constant(values: list) -> str:
    """A constant array as SQL; the optimizer splits it once."""
    return f"split('{','.join(map(str, values))}', ',')"


def encoded(words: DataFrame, path: str) -> DataFrame:
    """`unit, ids` and other columns of distinct units, by the merges of a BPE model, and `held`, the edges that the ids are of; the characters between them are bytes."""
    spark, model = words.sparkSession, pieces(path)
    table = piece_table(spark, path)
    byte_ids = _constant([model.byte.get(b, 0) for b in range(256)])
    folded = fold_merges(lattice(words, table, model.longest))
    whole = f"transform(sort_array(transform(held, e -> shiftleft(cast({_S} as bigint), 32) + {_I})), x -> cast(x & 4294967295L as int))"
    gone = "aggregate(held, 0L, (n, e) -> n + (e & 127)) = char_length(unit)"
    own = f"transform(held, e -> named_struct('s', {_S}, 'ids', array({_I})))"
    places = f"array_except(sequence(0, char_length(unit) - 1), flatten(transform(held, e -> sequence({_S}, {_S} + {_L} - 1))))"
    hexes = "hex(encode(substr(unit, s + 1, 1), 'UTF-8'))"
    as_bytes = f"transform(sequence(1, length({hexes}) div 2), k -> cast(element_at({byte_ids}, cast(conv(substr({hexes}, 2 * k - 1, 2), 16, 10) as int) + 1) as int))"
    parts = f"array_sort(concat({own}, transform({places}, s -> named_struct('s', s, 'ids', {as_bytes}))))"
    return folded.withColumn("ids", F.expr(f"if({gone}, {whole}, flatten(transform({parts}, p -> p.ids)))")).drop("edges")


@lru_cache(maxsize=2)
def piece_bytes(path: str) -> list[bytes]:
    """The bytes that each id stands for, with a space for the mark."""
    model = pieces(path)
    of_byte = {i: bytes([b]) for b, i in model.byte.items()}
    return [of_byte.get(i, t.replace(MARK, " ").encode()) for i, t in enumerate(model.texts)]


def spell(ids: list[int], table: list[bytes]) -> bytes:
    """The bytes of the text of `ids`, without the space that encoding puts first."""
    return b"".join([table[i] for i in ids])[1:]


def _fingerprint(spelled: bytes | memoryview) -> bytes:
    return blake2b(spelled, digest_size=16).digest()


def _summed(items: list[pa.Array], counts: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """Distinct items and the sums of their counts."""
    table = pa.table([pa.concat_arrays(items), pa.concat_arrays(counts)], ["item", "n"]).group_by("item").aggregate([("n", "sum")])
    return table["item"].combine_chunks(), table["n_sum"].to_numpy()


def _counted(docs: DataFrame, text: str, path: str) -> DataFrame:
    """`item, is_word, n`: every distinct unit of up to BITS characters of all documents, with marks, and the words that some task has often, and how often each occurs. Tasks count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = pieces(path).inside
        held: list[tuple[pa.Array, pa.Array]] = []
        odd: Counter = Counter()

        def out() -> pa.RecordBatch:
            made: Counter = Counter()
            for unit, n in odd.items():
                for one in short_units(unit.replace(" ", MARK), inside):
                    if len(one) <= BITS:
                        made[one] += n
            units_seen, times = [pa.array(list(made), pa.string())], [pa.array(list(made.values()), pa.int64())]
            often, often_n = pa.array([], pa.string()), np.zeros(0, np.int64)
            if held:
                distinct, n = _summed([h[0] for h in held], [h[1] for h in held])
                found, sizes = units_of_words(distinct.to_pylist())
                each = np.repeat(n, sizes)
                for k in [k for k, u in enumerate(found) if len(u) > BITS]:
                    parts = [one for one in short_units(found[k].replace(" ", MARK), inside) if len(one) <= BITS]
                    units_seen.append(pa.array(parts, pa.string()))
                    times.append(pa.array([int(each[k])] * len(parts), pa.int64()))
                    found[k] = ""
                units_seen.append(pc.replace_substring(pa.array(found, pa.string()), " ", MARK))
                times.append(pa.array(each))
                many = (n >= HOT_TIMES) & (pc.utf8_length(distinct).to_numpy() < HOT_CHARS)
                often, often_n = distinct.filter(pa.array(many)), n[many]
            item, n = _summed(units_seen, times)
            real = pc.not_equal(item, "")
            item, n = item.filter(real), n[real.to_numpy(zero_copy_only=False)]
            held.clear()
            odd.clear()
            is_word = np.arange(len(item) + len(often)) >= len(item)
            return pa.RecordBatch.from_arrays([pa.concat_arrays([item, often]), pa.array(is_word), pa.array(np.concatenate([n, often_n]))], names=["item", "is_word", "n"])

        for batch in batches:
            texts = batch.column(0).cast(pa.string())
            for first, end in bundles_of(texts, BUNDLE_BYTES):
                part = texts.slice(first, end - first)
                found, is_odd = words_of(part)
                for k in np.flatnonzero(is_odd).tolist():
                    odd.update(units(part[k].as_py() or ""))
                counted = pc.value_counts(found.filter(pa.array(~is_odd)).flatten())
                held.append((counted.field(0), counted.field(1)))
                if sum(len(h[0]) for h in held) + len(odd) >= GROUP_WORDS:
                    if len(held) > 1:
                        item, n = _summed([h[0] for h in held], [h[1] for h in held])
                        held[:] = [(item, pa.array(n))]
                    if len(held[0][0]) + len(odd) >= GROUP_WORDS:
                        yield out()
        yield out()

    return docs.select(text).mapInArrow(run, "item string, is_word boolean, n long").groupBy("item", "is_word").agg(F.sum("n").alias("n"))


#: Ids as three bytes each, the first byte first.
_PACKED = "unhex(array_join(transform(ids, i -> lpad(hex(i), 6, '0')), ''))"


def unpacked(raw: bytes) -> np.ndarray:
    three = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
    return three[:, 0] << 16 | three[:, 1] << 8 | three[:, 2]


def short_codes(codes: np.ndarray) -> bytes:
    """Codes below 2^21 as one to three bytes each, seven bits a byte, the lowest first."""
    size = 1 + (codes >= 1 << 7) + (codes >= 1 << 14)
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(3):
        more = size > k
        out[start[more] + k] = (codes[more] >> 7 * k & 127) | (size[more] > k + 1) * 128
    return out.tobytes()


def long_codes(raw: bytes) -> np.ndarray:
    """What `short_codes` has packed."""
    part = np.frombuffer(raw, np.uint8)
    last = np.flatnonzero(part < 128)
    start = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    place = np.arange(len(part)) - np.repeat(start, last - start + 1)
    return np.add.reduceat((part & 127).astype(np.int64) << 7 * place, start) if len(start) else np.zeros(0, np.int64)


class Hot:
    """The codes of frequent words and units, from 1 on, with their ids one after the other, where each code's begin, and what the ids of each decode to. Code 0 is a hole."""

    def __init__(self, known_words: list[tuple[str, int, bytes]], known_units: list[tuple[str, int, bytes]], path: str):
        known = [*((r, False) for r in known_words), *((r, True) for r in known_units)]
        known.sort(key=lambda r: (-r[0][1], r[1], r[0][0]))
        table, ids = piece_bytes(path), [unpacked(r[2]) for r, _ in known]
        self.words = {r[0]: c + 1 for c, (r, is_unit) in enumerate(known) if not is_unit}
        self.units = {r[0].replace(MARK, " "): c + 1 for c, (r, is_unit) in enumerate(known) if is_unit}
        self.ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        self.begins = np.concatenate([[0, 0], np.cumsum([*map(len, ids)])]).astype(np.int64)
        self.spelled = pa.array([b"", *(b"".join([table[i] for i in part.tolist()]) for part in ids)], pa.binary())


def _coded(items: list[str], known: dict[str, int]) -> np.ndarray:
    """The code of each item, 0 where it has none."""
    return np.fromiter(map(known.get, items, repeat(0)), np.int64, len(items))


def _most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """At most `limit` rows of the greatest `n`. The least is found from a count of levels, an eighth of a power of two each."""
    level = F.floor(F.log2("n") * 8)
    sizes = sorted(((r.level, r.rows) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect()), reverse=True)  # at most 8 * 63 rows
    least, total = 1 << 20, 0
    for at, there in sizes:
        total += there
        if total > limit:
            break
        least = at
    return counts.filter(level >= least)


def _hot(counted: DataFrame, vocabulary: DataFrame, limit: int, unit_limit: int, path: str) -> Hot:
    cut = F.udf(lambda word: [u.replace(" ", MARK) for u in _UNIT.findall(" " + word)], "array<string>", useArrow=True)
    often = _most_frequent(counted.filter("is_word").select(F.col("item").alias("word"), "n"), limit)
    parts = often.select("word", "n", F.posexplode(cut("word")).alias("at", "unit")).join(vocabulary.select("unit", "ids"), "unit")
    whole = parts.groupBy("word", "n").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    known_words = whole.select("word", "n", F.expr("unhex(array_join(transform(parts, p -> hex(p.ids)), ''))").alias("ids")).toArrow()  # at most `limit` short rows
    known_units = _most_frequent(vocabulary.filter(F.char_length("unit") <= HOT_CHARS), unit_limit).select("unit", "n", "ids").toArrow()  # at most `unit_limit` short rows
    rows = lambda t: list(zip(*(c.to_pylist() for c in t.columns), strict=True))
    return Hot(rows(known_words), rows(known_units), path)


_BUNDLE = ("bundle", "is_rest", "doc_ids", "prints", "sizes", "codes", "slots", "own", "rest")


def _bundle(number: int, doc_ids: pa.Array, texts: pa.StringArray, hot_words: dict[str, int], hot_units: dict[str, int], path: str) -> list[pa.RecordBatch]:
    """Documents in codes: two rows of the written table. All words without a code, and texts that aren't words, are cut into units once for each distinct one."""
    inside = pieces(path).inside
    found, is_odd = words_of(texts)
    kept = found.filter(pa.array(~is_odd))
    sizes = np.zeros(len(texts), np.int64)
    sizes[~is_odd] = pc.list_value_length(kept).to_numpy(zero_copy_only=False)
    sizes[is_odd] = 1  # an odd text is one item, without a code
    begins = np.cumsum(sizes) - sizes
    codes = np.zeros(int(sizes.sum()), np.int64)
    item = np.full(len(codes), -1)
    plain = np.ones(len(codes), bool)
    plain[begins[is_odd]] = False
    flat = kept.flatten().dictionary_encode()
    distinct, of = flat.dictionary.to_pylist(), flat.indices.to_numpy()
    of_distinct = _coded(distinct, hot_words)
    codes[plain] = of_distinct[of] if len(of) else 0
    new = np.flatnonzero(of_distinct == 0)
    place = np.full(len(distinct) + 1, -1)
    place[new] = np.arange(len(new))
    item[plain] = place[of]
    parts, each = units_of_words([distinct[k] for k in new.tolist()])
    each = each.tolist()
    for k in np.flatnonzero(is_odd).tolist():
        item[begins[k]] = len(each)
        own_units = units(texts[k].as_py() or "")
        parts += own_units
        each.append(len(own_units))
    # Units too long for one long give way to their parts.
    if parts and max(map(len, parts)) > BITS:
        of = np.repeat(np.arange(len(each)), each)
        short = [short_units(u.replace(" ", MARK), inside) for u in parts]
        of = np.repeat(of, [len(x) for x in short])
        parts, each = [u.replace(MARK, " ") for x in short for u in x], np.bincount(of, minlength=len(each)).tolist()
    unit_codes = _coded(parts, hot_units)
    unknown = unit_codes == 0
    slots = np.full(len(parts), -1)
    late = pc.replace_substring(pa.array([parts[k] for k in np.flatnonzero(unknown).tolist()], pa.string()), " ", MARK)
    is_long = pc.utf8_length(late).to_numpy(zero_copy_only=False) > BITS
    names = late.filter(pa.array(~is_long)).dictionary_encode()
    long_names = late.filter(pa.array(is_long)).dictionary_encode()
    late_slots = np.zeros(len(late), np.int64)
    late_slots[~is_long] = 2 * names.indices.to_numpy().astype(np.int64)
    late_slots[is_long] = 2 * long_names.indices.to_numpy().astype(np.int64) + 1
    slots[unknown] = late_slots
    own = [np.array(merge_long(u, path), ">i4").reshape(-1, 1).view(np.uint8)[:, 1:].tobytes() for u in long_names.dictionary.to_pylist()]
    # Items without a code give way to the codes of their units.
    each = np.array(each, np.int64)
    first = np.cumsum(each) - each
    is_new = item >= 0
    times = np.where(is_new, each[item] if len(each) else 0, 1)
    ends = np.cumsum(times)
    of = np.repeat(np.arange(len(codes)), times)
    unit = np.repeat(np.where(is_new, first[item] if len(each) else 0, 0), times) + np.arange(len(of)) - np.repeat(ends - times, times)
    is_unit = is_new[of]
    unit[~is_unit] = 0
    stream = np.where(is_unit, unit_codes[unit] if len(parts) else 0, codes[of])
    holes = slots[unit[is_unit & (stream == 0)]] if len(parts) else np.zeros(0, np.int64)
    bounds = np.concatenate([[0], ends])[np.concatenate([begins, [len(codes)]])]
    pack = ZstdCompressor(level=3).compress
    prints = b"".join(_fingerprint((t or "").replace(MARK, " ").encode("utf-8", "surrogatepass")) for t in texts.to_pylist())
    binaries = [prints, pack(np.diff(bounds).astype("<i4").tobytes()), pack(short_codes(stream)), pack(short_codes(holes))]
    lists = [pa.array([doc_ids.to_pylist()], pa.list_(pa.int64())), *(pa.array([b], pa.binary()) for b in binaries), pa.array([own], pa.list_(pa.binary())), pa.nulls(1, pa.list_(pa.string()))]
    rest = [*(pa.nulls(1, x.type) for x in lists[:-1]), pa.array([names.dictionary.to_pylist()], pa.list_(pa.string()))]
    return [pa.RecordBatch.from_arrays([pa.array([number]), pa.array([k]), *x], names=list(_BUNDLE)) for k, x in enumerate((lists, rest))]


def _bundled(docs: DataFrame, doc_id: str, text: str, path: str, hot: Hot) -> DataFrame:
    """For each bundle a row (`is_rest` 0) of `bundle, doc_ids, prints`, the texts' fingerprints, `sizes`, the codes of each text, `codes` of all, `own`, the ids of holes that are known already, of units too long to be shuffled, and `slots`: for each hole twice its place in `rest`, or one more than twice its place in `own`; and a row (`is_rest` 1) with `rest`, the distinct units of the holes."""
    shared = docs.sparkSession.sparkContext.broadcast((hot.words, hot.units))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column(1).cast(pa.string())
            for first, end in bundles_of(texts, BUNDLE_BYTES):
                yield from _bundle(number, batch.column(0).slice(first, end - first), texts.slice(first, end - first), *shared.value, path)
                number += 1

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "bundle long, is_rest long, doc_ids array<long>, prints binary, sizes binary, codes binary, slots binary, own array<binary>, rest array<string>")


def _filled(batches: Iterator[pa.RecordBatch], path: str, hot_ids: np.ndarray, begins: np.ndarray, spelled: pa.Array) -> Iterator[pa.RecordBatch]:
    """From `doc_ids, prints, sizes, codes, slots, found, own` of bundles a row for each document: codes and holes become ids, and what the ids decode to is compared with the text."""
    table, unpack = piece_bytes(path), ZstdDecompressor().decompress
    is_byte = np.zeros(len(table), bool)
    is_byte[list(pieces(path).byte.values())] = True
    for batch in batches:
        for row in range(batch.num_rows):
            doc_ids, prints, sizes, codes, slots, found, own = (c[row].as_py() for c in batch.columns)
            ends = np.concatenate([[0], np.cumsum(np.frombuffer(unpack(sizes), "<i4"))])
            codes, slots = long_codes(unpack(codes)), long_codes(unpack(slots))
            late = [unpacked(v) for v in (*found, *own)]
            lengths = np.array([*map(len, late)], np.int64)
            late_begins = len(hot_ids) + np.cumsum(lengths) - lengths
            item = np.where(slots & 1, len(found), 0) + (slots >> 1)
            holes = np.flatnonzero(codes == 0)
            first, size = begins[codes], begins[codes + 1] - begins[codes]
            first[holes], size[holes] = late_begins[item], lengths[item]
            upto = np.concatenate([[0], np.cumsum(size)])
            ids = np.concatenate([hot_ids, *late])[np.arange(upto[-1]) + np.repeat(first - upto[:-1], size)].astype(np.int32)
            bounds = upto[ends]
            byte_ids = np.concatenate([[0], np.cumsum(is_byte[ids])])[bounds]
            late_spelled = pa.array([b"".join([table[x] for x in v.tolist()]) for v in late], pa.binary())
            at = codes.copy()
            at[holes] = len(spelled) + item
            text = pa.concat_arrays([spelled, late_spelled]).take(pa.array(at)).cast(pa.large_binary())
            cut = np.frombuffer(text.buffers()[1], np.int64)[text.offset :][ends]
            data = memoryview(text.buffers()[2] or b"")
            complete = [_fingerprint(data[a + 1 : b]) == prints[16 * k : 16 * k + 16] for k, (a, b) in enumerate(zip(cut.tolist(), cut[1:].tolist(), strict=False))]
            whole = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), whole, pa.array(np.diff(bounds), pa.int64()), pa.array(np.diff(byte_ids), pa.int64()), pa.array(complete, pa.bool_())], names=["doc_id", "ids", "n_pieces", "n_bytes", "complete"])
            del found, own, late, late_spelled, text, data, ids, at
        pa.default_memory_pool().release_unused()


def count_encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, hot_limit: int = HOT_LIMIT, unit_limit: int = HOT_UNITS) -> DataFrame:
    """`doc_id, ids, n_pieces, n_bytes, complete, ids_digest` for each row of `docs`: the ids in order, and whether they decode to the text."""
    path = path or default_model()
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = written(_counted(docs, text, path), "pieces-counted")
    distinct = counted.filter("NOT is_word").select(F.col("item").alias("unit"), "n").repartition(parts, "unit")
    vocabulary = written(encoded(distinct, path).select("unit", "n", F.expr(_PACKED).alias("ids")), "pieces-vocabulary")
    hot = _hot(counted, vocabulary, min(hot_limit, 1 << 20), min(unit_limit, 1 << 19), path)
    forget(counted)
    bundles = written(_bundled(docs, doc_id, text, path, hot), "pieces-bundles", by="is_rest")
    pairs = bundles.filter("is_rest = 1").select("bundle", F.posexplode("rest").alias("slot", "unit"))
    found = pairs.join(vocabulary.drop("n"), "unit").groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("slot", "ids"))).alias("found"))
    found = written(found.select("bundle", F.expr("transform(found, f -> f.ids)").alias("found")), "pieces-found")
    forget(vocabulary)
    forget(bundles, part="is_rest=1")
    shared = docs.sparkSession.sparkContext.broadcast((hot.ids, hot.begins, hot.spelled))
    both = bundles.filter("is_rest = 0").join(found, "bundle", "left").select("doc_ids", "prints", "sizes", "codes", "slots", F.coalesce("found", F.array().cast("array<binary>")).alias("found"), "own")
    filled = both.mapInArrow(lambda batches: _filled(batches, path, *shared.value), "doc_id long, ids array<int>, n_pieces long, n_bytes long, complete boolean")
    return filled.withColumn("ids_digest", F.xxhash64("ids"))


def encode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """`docs` with `ids` (in place of a column of that name), the array of piece ids of `text`, null for a null: its units are exploded, encoded once each, and put back in order."""
    path = path or default_model()

    @F.udf("array<string>", useArrow=True)
    def cut(value):
        inside = pieces(path).inside
        return None if value is None else [one for unit in units(value) for one in short_units(unit.replace(" ", MARK), inside)]

    @F.udf("array<int>", useArrow=True)
    def merged(unit):
        return merge_long(unit, path)

    rows = written(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct("*").alias("_doc"), cut(F.col(text)).alias("_units")), "pieces-units")
    places = rows.select("_row", F.posexplode("_units").alias("_at", "unit"))
    short = F.char_length("unit") <= BITS
    vocabulary = written(encoded(places.filter(short).select("unit").distinct(), path), "pieces-vocabulary")
    found = places.filter(short).join(vocabulary.drop("held"), "unit").unionByName(places.filter(~short).withColumn("ids", merged("unit"))).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", "ids"))).alias("_parts"))
    ids = F.flatten(F.transform("_parts", lambda p: p["ids"]))
    both = rows.select("_row", "_doc", (F.size("_units") == 0).alias("_none")).join(found, "_row", "left")
    return both.select(*[F.col("_doc")[c].alias(c) for c in docs.columns if c != "ids"], F.when(F.col("_none"), F.array().cast("array<int>")).otherwise(ids).alias("ids"))


def decode(encoded_docs: DataFrame, ids: str = "ids", into: str = "decoded", path: str | None = None) -> DataFrame:
    """The same rows with the text of their ids."""
    path = path or default_model()

    @F.udf("string", useArrow=True)
    def text_of(value):
        return None if value is None else spell(value, piece_bytes(path)).decode("utf-8", "replace")

    return encoded_docs.withColumn(into, text_of(F.col(ids)))


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return count_encoded(table(spark, sf_dir, "documents"))
