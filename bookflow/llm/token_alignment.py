"""Operator 12: alignment of two tokenizers over the same bytes.

Tokens never cross a lone space in front of a word, in either tokenizer, so texts
are cut there into stretches. Which tokens share a group depends only on where the
tokens of both sides end in a stretch, its shape, and many stretches have the same.
Python tokenises: it hands on bundles of texts as numbers of their stretches, each
distinct stretch of a bundle once, with its ids and the number of its shape, and
each shape once, where the task meets it first. Spark's higher-order functions align
the shapes:

1. `array_intersect` of both arrays of ends gives the cuts.
2. The place of each cut among a side's tokens comes from sorting the cuts into
   that side's ends: every cut then stands right before the token that ends there.
3. `sequence`, `transform` and `slice` build the groups between cuts, and from
   each group its links, all pairs of a token of the one and of the other side.
4. Ids take the places of a shape's tokens (`filled`, a look-up of whole arrays).
   A text's groups and links are those of its stretches, in order; `aggregate`
   counts them.

The stretches of the most texts (at most `hot_limit`, of at most HOT_CHARS
characters) are aligned once and go to all tasks as one bounded array; the others,
which are rare by construction, are aligned in the bundles that hold them, whose
size is bounded, so no text and no stretch is shuffled. A task keeps a bounded number
of shapes and forgets them all beyond it. An id pair's count is the
number of texts that hold it, pre-aggregated before it is shuffled. Sums over a
text are those of its stretches, each of which has the sums of its links. What is
hot or kept changes the route and never the result.

Defined cases: texts that are null or empty, and those whose tokens' bytes don't
give the space and the text again on both sides, have no tokens: zeros, and an
empty string instead of a hash. Texts of any length are taken whole. Repeated
rows (also of one doc_id) each get their row and each count as a text; a null
doc_id stays null. An empty table gives an empty one; other columns of the input
aren't carried.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.llm.common import forget, often_seen, table, trim_memory, written
from bookflow.llm.token_counts import _BESIDE, _SAFE

#: Most stretches and id pairs that go to all tasks, the longest length of such a stretch, and in how many texts of a group one must be to be proposed.
HOT_LIMIT, HOT_PAIRS, HOT_CHARS, HOT_DOCS = 200_000, 1 << 18, 32, 2
#: Characters of stretches that are aligned in one row, and of texts in a bundle, about.
ROW_CHARS, BUNDLE_CHARS = 200_000, 1_000_000
#: Stretches that are tokenised in one string, and most shapes that a task keeps, and their tokens.
TOGETHER, SHAPES, SHAPE_TOKENS = 256, 1 << 17, 1 << 21
#: Bytes of bundles in an Arrow batch, about.
BATCH_BYTES, _BYTES = "2m", "spark.sql.execution.arrow.maxBytesPerBatch"
_SHIFT, _LOW = 1 << 32, (1 << 32) - 1


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, then the others in order from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=2)
def _loaded(path_a: str, path_b: str):
    """Both encoders of lists of texts, and the bytes of both vocabularies by id."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    byte_of = _byte_of()
    bytes_a = [b""] * a.get_vocab_size()
    for piece, k in a.get_vocab().items():
        bytes_a[k] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
    pieces = map(b.id_to_piece, range(b.get_piece_size()))
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
    return lambda texts: [e.ids for e in a.encode_batch_fast(texts, add_special_tokens=False)], lambda texts: b.encode(texts, num_threads=1), bytes_a, bytes_b


def stretches(text: str) -> list[str]:
    """The space and the text, cut before each lone space; each part begins with a space, which is left out."""
    whole = " " + text
    if whole[-1] == " " or _BESIDE.search(whole):
        first, *rest = _SAFE.split(whole)
        return [first[1:], *rest]
    return text.split(" ")


def frequent(docs: DataFrame, text: str, limit: int) -> list[str]:
    """At most `limit` stretches, those of the most texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return often_seen(batches, lambda value: [s for s in set(stretches(value)) if len(s) < HOT_CHARS] if value else (), HOT_DOCS)

    counted = docs.select(text).mapInArrow(run, "item string, n long").groupBy("item").agg(F.sum("n").alias("n"))
    return counted.orderBy(F.col("n").desc(), "item").limit(limit).select("item").toArrow()["item"].to_pylist()  # short strings, limit at most


_INTS = ("n_a", "n_b", "ids_a", "ids_b", "shapes", "ends_a", "ends_b", "shape_ends")
#: Of a stretch two numbers in each long: tokens of both sides, and groups and links. Sums over a text stay below 2^31, as arrays do.
_PACKED = {"tokens": ("n_a", "n_b"), "groups": ("n_groups", "n_links")}
_SHAPED = f"stretches array<int>, {', '.join(f'{c} array<int>' for c in _INTS)}, first int"
_TEXT = pa.struct([("row", pa.int64()), ("doc_id", pa.int64()), ("held", pa.list_(pa.int32()))])
_OWN = pa.struct([("k", pa.int32()), *((c, pa.int64()) for c in _PACKED), ("written", pa.string()), ("links", pa.list_(pa.int64()))])
_OWN_TYPE = "array<struct<k:int,tokens:long,groups:long,written:string,links:array<long>>>"


def _joined(arrays: list) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *arrays]).astype(np.int64)


def _cell(values) -> pa.ListArray:
    """One row of an array of whole numbers."""
    ints = pa.array(np.asarray(values, np.int32))
    return pa.ListArray.from_arrays(pa.array([0, len(ints)], pa.int32()), ints)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one range after the other."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def _together(parts: list[str], path_a: str, path_b: str) -> tuple[list[int], list[np.ndarray]]:
    """Which stretches have tokens that give their bytes, and of these in that order the numbers of tokens, their ids and where they end, of the one and then of the other side.

    Stretches that neither begin nor end in white space are tokenised many at a time,
    as they would be in a text, and alone where the bytes or the ends differ.
    """
    encode_a, encode_b, bytes_a, bytes_b = _loaded(path_a, path_b)
    length_a, length_b = _lengths(path_a, path_b)
    safe, alone = [], []
    for k, s in enumerate(parts):
        (safe if s and not s[0].isspace() and not s[-1].isspace() else alone).append(k)
    held = [*(safe[k : k + TOGETHER] for k in range(0, len(safe), TOGETHER)), *([k] for k in alone)]
    good: list[int] = []
    found: list[list] = [[] for _ in range(6)]
    while held:
        again = []
        texts = [" ".join([parts[k] for k in ks]) for ks in held]
        for ks, text, a, b in zip(held, texts, encode_a([" " + t for t in texts]), encode_b(texts), strict=True):
            raw = b" " + text.encode()
            if b"".join(map(bytes_a.__getitem__, a)) == raw and b"".join(map(bytes_b.__getitem__, b)) == raw:
                size = np.array([len(parts[k]) for k in ks] if text.isascii() else [len(parts[k].encode()) for k in ks]) + 1
                ends, ids = size.cumsum(), (np.array(a, np.int64), np.array(b, np.int64))
                sides = [length[i].cumsum() for length, i in zip((length_a, length_b), ids, strict=True)]
                at = [np.searchsorted(side, ends) for side in sides]
                if all((side[k] == ends).all() for side, k in zip(sides, at, strict=True)):
                    good += ks
                    for n, (side, last) in enumerate(zip(sides, at, strict=True)):
                        each = np.diff(last, prepend=-1)
                        found[n].append(each)
                        found[2 + n].append(ids[n])
                        found[4 + n].append(side - np.repeat(ends - size, each))
                    continue
            if len(ks) > 1:
                again += [[k] for k in ks]
        held = again
    return good, [_joined(x) for x in found]


def _tokenizer(path_a: str, path_b: str) -> Callable[[list[str]], tuple[np.ndarray, list[pa.Array]]]:
    """From stretches to their places, those first whose tokens give their bytes, and the columns _INTS and `first`: of these the numbers of tokens, over all of them, one after the other, the ids, and the numbers of their shapes; of the shapes that are new here, from number `first` on, the ends of tokens and of shapes, one after the other. Where `first` is 0 all earlier shapes are forgotten."""
    seen: dict[tuple[bytes, bytes], int] = {}
    kept = 0

    def tokenise(parts: list[str]) -> tuple[np.ndarray, list[pa.Array]]:
        nonlocal kept
        if len(seen) > SHAPES or kept > SHAPE_TOKENS:
            seen.clear()
            kept = 0
        good, (n_a, n_b, ids_a, ids_b, ends_a, ends_b) = _together(parts, path_a, path_b)
        raw_a, raw_b = ends_a.astype("<i4").tobytes(), ends_b.astype("<i4").tobytes()
        to_a, to_b = (4 * n_a.cumsum()).tolist(), (4 * n_b.cumsum()).tolist()
        first, shapes = len(seen), []
        from_a = from_b = 0
        for a, b in zip(to_a, to_b, strict=True):
            shapes.append(seen.setdefault((raw_a[from_a:a], raw_b[from_b:b]), len(seen)))
            from_a, from_b = a, b
        new = list(islice(seen, first, None))
        sides = [[np.frombuffer(shape[side], "<i4").astype(np.int64) for shape in new] for side in (0, 1)]
        size = np.array([x[-1] for x in sides[0]], np.int64)
        begin = np.cumsum(size) - size
        ends = [_joined(side) + np.repeat(begin, [*map(len, side)]) for side in sides]
        kept += len(ends[0]) + len(ends[1])
        place = np.full(len(parts), -1)
        place[good] = np.arange(len(good))
        place[place < 0] = np.arange(len(good), len(parts))
        ints = [n_a, n_b, ids_a, ids_b, shapes, *ends, begin + size]
        return place, [*map(_cell, ints), pa.array([first], pa.int32())]

    return tokenise


@lru_cache(maxsize=2)
def _lengths(path_a: str, path_b: str) -> list[np.ndarray]:
    return [np.array([*map(len, t)], np.int64) for t in _loaded(path_a, path_b)[2:]]


def cut(docs: DataFrame, doc_id: str, text: str, hot: list[str], path_a: str, path_b: str) -> DataFrame:
    """Bundles: `bundle, texts, one, stretches`, _INTS and `first`. `one` is 1. `texts` are structs `row, doc_id, held`, the numbers of their stretches in order, those below 0 being places among the bundle's own, from -1 down; `stretches` has the numbers of these."""
    shared = docs.sparkSession.sparkContext.broadcast({s: k for k, s in enumerate(hot)})  # hot_limit short strings at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tokenise = shared.value.get, _tokenizer(path_a, path_b)
        rest: dict[str, int] = {}
        texts: list[tuple[int, int | None, np.ndarray]] = []

        def bundle() -> pa.RecordBatch:
            place, ints = tokenise(list(rest))
            own = np.append(-1 - place, 0)  # for no own stretch at all
            cells = [{"row": row, "doc_id": key, "held": np.where(held < 0, own[np.maximum(-1 - held, 0)], held).astype(np.int32)} for row, key, held in texts]
            out = [pa.array([texts[0][0]]), pa.array([cells], pa.list_(_TEXT)), pa.array([1], pa.int32()), _cell(np.arange(len(rest))), *ints]
            rest.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays(out, names=["bundle", "texts", "one", "stretches", *_INTS, "first"])

        chars = 0
        for batch in batches:
            for row, key, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                value = cell.as_py()
                parts = stretches(value) if value else []
                numbers = [known(s) for s in parts]
                for at in [k for k, c in enumerate(numbers) if c is None]:
                    numbers[at] = -1 - rest.setdefault(parts[at], len(rest))
                texts.append((row, key, np.array(numbers, np.int32)))
                chars += len(value or "")
                if chars >= BUNDLE_CHARS:
                    yield bundle()
                    chars = 0
        if texts:
            yield bundle()
        del known, tokenise
        trim_memory()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"bundle long, texts array<struct<row:long,doc_id:long,held:array<int>>>, one int, {_SHAPED}")


def tokenised(hot: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """`stretches` (their codes), _INTS and `first` of the rows `stretch, code`, ROW_CHARS characters in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenise = _tokenizer(path_a, path_b)

        def out(held: list[tuple[str, int]]) -> pa.RecordBatch:
            place, ints = tokenise([s for s, _ in held])
            codes = [held[k][1] for k in np.argsort(place)]
            return pa.RecordBatch.from_arrays([_cell(codes), *ints], names=["stretches", *_INTS, "first"])

        held, chars = [], 0
        for batch in batches:
            for s, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((s, code))
                chars += len(s) + 1
                if chars >= ROW_CHARS:
                    yield out(held)
                    held, chars = [], 0
        if held:
            yield out(held)

    return hot.select("stretch", "code").mapInArrow(run, _SHAPED)


def _sorted_in(cuts: str, ends: str) -> Column:
    """Cuts and ends as one ascending array: the offset in the upper half, and in the lower half 0 of a cut, or the number of the end."""
    above = lambda c: c.cast("long") * F.lit(_SHIFT)
    return F.sort_array(F.concat(F.transform(cuts, above), F.transform(ends, lambda e, i: above(e) + i + F.lit(1))))


def _places(merged: str) -> Column:
    """The numbers, from 1, of the ends that follow a cut."""
    after = F.filter(merged, lambda x, k: F.get(F.col(merged), k - F.lit(1)).bitwiseAND(F.lit(_LOW)) == 0)
    return F.transform(after, lambda x: x.bitwiseAND(F.lit(_LOW)).cast("int"))


def _sum(values: Column) -> Column:
    """The sum, null where a value is."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda n, x: n + x)


def _item(name: str, k: Column) -> Column:
    return F.get(F.col(name), k)


def _bound(values: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over `values`, which are computed once, however often a lambda in it asks for them."""
    return F.get(F.transform(F.array(values), body), F.lit(0))


def _group(k: Column) -> Column:
    """Of group `k`, from 0: the numbers of its tokens, from 0: from `a0` or `b0` to before `a1` or `b1`."""
    before = lambda side: F.coalesce(_item(f"places_{side}", k - F.lit(1)), F.lit(0))
    return F.struct(before("a").alias("a0"), _item("places_a", k).alias("a1"), before("b").alias("b0"), _item("places_b", k).alias("b1"))


def _pair(a: Column, b: Column) -> Column:
    return a.cast("long") * F.lit(_SHIFT) + b


def _links(g: Column) -> Column:
    """All pairs of a group, the number of the one token times 2^32 and of the other; nearly all groups have one of each side."""
    numbers = lambda side: F.sequence(g[f"{side}0"], g[f"{side}1"] - F.lit(1))
    single = (g["a1"] - g["a0"] == 1) & (g["b1"] - g["b0"] == 1)
    return F.when(single, F.array(_pair(g["a0"], g["b0"]))).otherwise(F.flatten(F.transform(numbers("a"), lambda a: F.transform(numbers("b"), lambda b: _pair(a, b)))))


def aligned(bundles: DataFrame) -> DataFrame:
    """`bundles` with `ends_a`, `ends_b` and `shape_ends` replaced by `places_a` and `places_b`, where groups end among the tokens of the new shapes, `last`, where shapes end among the groups, and `links`, pairs of numbers of tokens."""
    # Every column is used at least twice in the next step or bound, so that none is merged into a lambda and computed for each element.
    cuts = bundles.withColumn("cuts", F.array_intersect("ends_a", "ends_b"))
    merged = cuts.withColumns({"merged_a": _sorted_in("cuts", "ends_a"), "merged_b": _sorted_in("cuts", "ends_b"), "merged_s": _sorted_in("shape_ends", "cuts")})
    placed = merged.withColumns({"places_a": _places("merged_a"), "places_b": _places("merged_b"), "last": _places("merged_s")})
    numbers = F.slice(F.sequence(F.lit(0), F.size("cuts")), F.lit(1), F.size("cuts"))
    links = F.flatten(F.transform(F.transform(numbers, _group), _links))
    return placed.select(*(c for c in bundles.columns if c not in ("ends_a", "ends_b", "shape_ends")), "places_a", "places_b", "last", links.alias("links"))


@lru_cache(maxsize=2)
def _decimals(least: int) -> pa.StringArray:
    """Each number below `least` in decimal four times: with a comma, a bar and a semicolon behind it, and alone."""
    numbers = pa.array(np.repeat(np.arange(least), 4)).cast(pa.string())
    return pc.binary_join_element_wise(numbers, pa.array([",", "|", ";", ""]).take(pa.array(np.tile(np.arange(4), least))), "")


class _Shapes:
    """Aligned shapes by number: of each its groups' numbers of tokens, and its links."""

    def __init__(self):
        self.groups_a = self.groups_b = self.links = np.zeros(0, np.int64)
        self.n_groups = self.n_links = np.zeros(0, np.int64)

    def add(self, places_a: np.ndarray, places_b: np.ndarray, last: np.ndarray, links: np.ndarray) -> None:
        groups_a, groups_b, n_groups = (np.diff(x, prepend=0) for x in (places_a, places_b, last))
        before = np.append(0, np.cumsum(groups_a * groups_b))
        n_links = before[last] - before[last - n_groups]
        begin = (np.append(0, places_a)[last - n_groups] << 32) + np.append(0, places_b)[last - n_groups]
        for name, more in (("groups_a", groups_a), ("groups_b", groups_b), ("links", links - np.repeat(begin, n_links)), ("n_groups", n_groups), ("n_links", n_links)):
            setattr(self, name, np.concatenate([getattr(self, name), more]))

    def filled(self, stretches: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, shapes: np.ndarray) -> pa.StructArray:
        """The structs _OWN of stretches, whose tokens' ids take the places of those of their shapes."""
        n_groups, n_links = self.n_groups[shapes], self.n_links[shapes]
        links = self.links[_ranges((np.cumsum(self.n_links) - self.n_links)[shapes], n_links)]
        at_a, at_b = np.repeat(np.cumsum(n_a) - n_a, n_links) + (links >> 32), np.repeat(np.cumsum(n_b) - n_b, n_links) + (links & _LOW)
        pairs = (ids_a[at_a] << 32) + ids_b[at_b]
        group = _ranges((np.cumsum(self.n_groups) - self.n_groups)[shapes], n_groups)
        size_a, size_b = self.groups_a[group], self.groups_b[group]
        size = size_a + size_b
        begin = np.cumsum(size) - size
        token = np.zeros(int(size.sum()), np.int64)
        token[_ranges(begin, size_a)], token[_ranges(begin + size_a, size_b)] = 4 * ids_a, 4 * ids_b
        token[begin + size_a - 1] += 1
        token[begin + size - 1] += 2
        token[np.cumsum(n_a + n_b) - 1] += 1
        spelled = _decimals(1 << int(token.max(initial=0) // 4).bit_length()).take(pa.array(token))
        _, ends, data = spelled.buffers()
        ends = np.frombuffer(ends, np.int32)[: len(token) + 1] if len(token) else np.zeros(1, np.int32)
        written = pa.StringArray.from_buffers(len(shapes), pa.py_buffer(ends[np.append(0, np.cumsum(n_a + n_b))].tobytes()), data or pa.py_buffer(b""))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_links)), pa.int32()), pa.array(pairs))
        good = [pa.array((n_a << 32) + n_b), pa.array((n_groups << 32) + n_links), written, lists]
        none = len(stretches) - len(shapes)
        return pa.StructArray.from_arrays([pa.array(stretches, pa.int32()), *(pa.concat_arrays([x, pa.nulls(none, x.type)]) for x in good)], fields=list(_OWN))


def filled(bundles: DataFrame) -> DataFrame:
    """Columns of `aligned` before `stretches`, and `own`, structs `k, tokens, groups, written, links`: of each stretch its number, the numbers of its tokens, groups and links (_PACKED), the groups written out, and its links (the first id times 2^32 and the second). All but the first are null where the bytes differ. A task's rows come in the order in which its shapes were met."""
    kept = bundles.columns[: bundles.columns.index("stretches")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = _Shapes()
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda *names: [batch.column(c)[row].values.to_numpy().astype(np.int64) for c in names]  # noqa: B023, E731
                if batch.column("first")[row].as_py() == 0:
                    shapes = _Shapes()
                shapes.add(*get("places_a", "places_b", "last", "links"))
                own = shapes.filled(*get("stretches", "n_a", "n_b", "ids_a", "ids_b", "shapes"))
                cell = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, 1) for c in kept), cell], names=[*kept, "own"])
                del own, cell
            del batch
            pa.default_memory_pool().release_unused()
        del shapes
        trim_memory()

    types = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in bundles.select(*kept).schema)
    return bundles.mapInArrow(run, f"{types}own {_OWN_TYPE}")


def _each_text(bundles: DataFrame, hot: DataFrame, told: Callable[[Column, Column], list[Column]]) -> DataFrame:
    """A row of what `told` makes of each text, given its struct and those of its stretches as an array in order. `own` and, in the one row of `hot`, `hot` are sorted by number."""
    both = bundles.join(F.broadcast(hot), "one")  # one row of hot_limit structs at most
    item = lambda k: F.when(k >= 0, F.get(F.col("hot"), k)).otherwise(F.get(F.col("own"), F.lit(-1) - k))
    of = lambda t: _bound(F.transform(t["held"], item), lambda items: F.struct(*told(t, items)))
    # inline_outer, as of inline a filter on its size is derived and pushed into the steps before, with all of them copied into it; no bundle is empty
    return both.select(F.inline_outer(F.transform("texts", of)))


def _gathered(rows: DataFrame, *key: str) -> DataFrame:
    """The structs `held` of `rows`, in order, as one array for each key."""
    return rows.groupBy(*key).agg(F.array_sort(F.collect_list("held")).alias("held"))


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", paths: tuple[str, str] | None = None, hot_limit: int = HOT_LIMIT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three written tables: bundles `bundle, texts, own, one`; the hot stretches as one row `hot, one`, like `own`; and `row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs` of each text, with each linked id pair once."""
    spark, paths = docs.sparkSession, paths or default_tokenizers()
    known = frequent(docs, text, hot_limit)
    before = spark.conf.get(_BYTES, None)
    spark.conf.set(_BYTES, BATCH_BYTES)  # bundles go to Python a few at a time
    try:
        bundles = written(filled(aligned(cut(docs, doc_id, text, known, *paths))).select("bundle", "texts", "own", "one"), "align-bundles", large_rows=True)
    finally:
        spark.conf.unset(_BYTES) if before is None else spark.conf.set(_BYTES, before)
    codes = spark.createDataFrame(pa.table({"stretch": pa.array(known, pa.string()), "code": pa.array(range(len(known)), pa.int32())}))
    rows = written(filled(aligned(tokenised(codes, *paths))).select(F.inline_outer("own")), "align-stretches")
    hot = written(rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("hot"), (F.count(F.lit(1)) * 0 + 1).cast("int").alias("one")), "align-hot")
    forget(rows)

    def told(t: Column, items: Column) -> list[Column]:
        sums = [_sum(items[c]).alias(c) for c in _PACKED]
        digest = F.sha2(F.array_join(items["written"], ";").cast("binary"), 256).alias("groups_sha256")
        return [t["row"].alias("row"), t["doc_id"].alias("doc_id"), *sums, digest, F.array_distinct(F.flatten(items["links"])).alias("pairs")]

    good = F.coalesce("groups", F.lit(0)) > 0  # null where a stretch has none, 0 where there is no stretch
    halves = [(n, half) for c, names in _PACKED.items() for n, half in zip(names, (F.shiftright(c, 32), F.col(c).bitwiseAND(F.lit(_LOW))), strict=True)]
    sums = [F.when(good, half).otherwise(0).alias(n) for n, half in halves]
    rows = _each_text(bundles, hot, told).select("row", "doc_id", *sums, F.when(good, F.col("groups_sha256")).otherwise("").alias("groups_sha256"), F.when(good, F.col("pairs")).alias("pairs"))
    return bundles, hot, written(rows, "align-texts")


def pair_counts(alignment: DataFrame) -> DataFrame:
    """`pair, count, best` of the `pairs` of texts: in how many texts each is, and whether no other pair of its first id is in more."""
    counts = written(alignment.select(F.explode("pairs").alias("pair")).groupBy("pair").count(), "align-pairs")
    first = F.shiftright("pair", 32)
    most = counts.groupBy(first.alias("first")).agg(F.max("count").alias("most"))
    out = written(counts.withColumn("first", first).join(most, "first").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "align-counts")
    forget(counts)
    return out


def stretch_sums(items: DataFrame, counts: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """From `of, k, links` of stretches to `of, held`: for each `of` the structs `k, best, count` of its stretches in order, the links whose pair is best and the sum of the links' counts."""
    known = F.broadcast(counts.orderBy(F.col("count").desc(), "pair").limit(hot_pairs))  # hot_pairs rows at most
    each = items.select("of", "k", F.explode_outer("links").alias("pair"))
    found = each.join(known, "pair", "left")
    sums = lambda held: held.groupBy("of", "k").agg(F.coalesce(F.sum(F.col("best").cast("long")), F.lit(0)).alias("best"), F.coalesce(F.sum("count"), F.lit(0)).alias("count"))
    rest = each.join(known.select("pair"), "pair", "left_anti").join(counts.join(known.select("pair"), "pair", "left_anti"), "pair")
    both = sums(found).unionByName(sums(rest)).groupBy("of", "k").agg(F.sum("best").alias("best"), F.sum("count").alias("count"))
    return _gathered(both.select("of", F.struct("k", "best", "count").alias("held")), "of")


def alignment_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", paths: tuple[str, str] | None = None, hot_limit: int = HOT_LIMIT, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """`doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256` for each row of `docs`."""
    bundles, hot, base = align(docs, doc_id, text, paths, hot_limit)
    counts = pair_counts(base)
    of = lambda table, name, number: table.select(number.alias("of"), F.explode(name).alias("x")).select("of", "x.k", "x.links")
    own = written(stretch_sums(of(bundles, "own", F.col("bundle")), counts, hot_pairs).select(F.col("of").alias("bundle"), F.col("held").alias("own")), "align-sums", large_rows=True)
    known = written(stretch_sums(of(hot, "hot", F.col("one")), counts, hot_pairs).select(F.col("of").alias("one"), F.col("held").alias("hot")), "align-hot-sums")
    forget(counts)
    summed = hot.select("one").join(known, "one", "left")
    texts = bundles.select("bundle", "texts", "one").join(own, "bundle", "left")
    of_row = _each_text(texts, summed, lambda t, items: [t["row"].alias("row"), _sum(items["best"]).alias("n_best"), _sum(items["count"]).alias("count_sum")])
    linked = lambda c: F.when(F.col("groups_sha256") != "", F.col(c)).otherwise(0).alias(c)
    return base.drop("pairs").join(of_row, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", linked("n_best"), linked("count_sum"), "groups_sha256")


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    return alignment_counts(table(spark, sf_dir, "documents"))
