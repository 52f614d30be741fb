"""Operator 1: personal data by patterns and a skip-chain conditional random field.

Base spans come from fixed patterns. Over them runs a CRF whose nodes are the
base spans, held at their kind, and every other word with a digit, `@` or `+`.
Nodes a word apart are chained. All occurrences of a form, however far apart,
share one node for the form, and a potential ties each of them to it. Forms are
those of a kind: of an email the lower-cased address, of an IP address its four
numbers, of a card or phone number its digits, and of these also what is left
without leading groups as long as it is most of the number, so that it is known
without its country code. Neighbouring words of digits that together have the
form of a base span are one node. The digits of an IP address are no form: 12345
isn't 1.23.4.5. A form of a base span is held at the
span's kind, so repeats don't outvote the pattern. Loopy sum-product passes
messages along chains and forms until they settle.

What is learnt, from at most SAMPLE_DOCS documents, those of the least hash:
node weights by a multinomial logistic regression of the base labels on word
shapes (without the words that share a form with a base span, which are what the
field decides), chain weights from counts of neighbouring labels, and the
potential of forms from how often two base spans of one form agree in kind.
The field of a document is held and solved inside one Arrow batch; documents
without digit, `@` and `+` are passed over by a byte search.

Defined cases: a null text is empty: no spans, the hash of the empty string;
texts and words of any length are read whole, in linear time; repeated rows each
get their row; an empty table gives an empty one; without labels to fit, no span
is added. Other columns of the input aren't carried by `find`, and all are by
`redact`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.llm.common import table

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, LEAST_PROBABILITY = 20_000, 0.5
#: What counts of agreeing and other pairs start from; messages have settled when none moves more.
PAIRS, SETTLED, HALVED = 0.1, 1e-3, 16
#: What holds a label against any number of messages.
HELD = 1e9

# The base patterns.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Words of the field; data files have no spaces, but these signs.
_WORD = re.compile(r"[^\x20\x09-\x0D\"',;={}\[\]<>|]+")
_DIGITS = re.compile(r"[0-9]+")
_GROUP = re.compile(r"[+(]*[0-9][0-9().-]*")
_SIGNS = "0123456789@+"

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """By kind, then start. An address is found from its `@`: the run of allowed characters before it is where a leftmost match begins."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1) if start < at else done
        at = text.find("@", max(at + 1, done))
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m[0]) if m.end() - m.start() <= 40 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


#: Shape tests of a word; each is one bit of a node's features.
def _shape(word: str, digits: str) -> int:
    n = len(digits)
    tests = (
        "@" in word, word.count(".") == 3, "." in word, "+" in word, "-" in word, "(" in word or ")" in word,
        n == 0, 1 <= n <= 3, 4 <= n <= 6, 7 <= n <= 9, 10 <= n <= 15, 16 <= n <= 19, n > 19, n == len(word),
        16 <= n <= 19 and luhn(digits), any(map(str.isalpha, word)), "=" in word or '"' in word, len(word) > 30,
    )
    return sum(bool(t) << i for i, t in enumerate(tests))


FEATURES = 18
_EDGES = "\"'`.,;:!?#$%&*<>[]{}|()"


Node = tuple[int, int, int, int, tuple[str, ...], int]


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _ip_form(groups: list[str]) -> str:
    """The form of four numbers up to 255, else nothing."""
    short = [g.lstrip("0") or "0" for g in groups]
    return "ip " + ".".join(short) if len(short) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in short) else ""


def _word_forms(groups: list[str]) -> tuple[str, ...]:
    """What digits could be: a number, and an IP address if they are four that fit."""
    ip = _ip_form(groups)
    return ("".join(groups), ip) if ip else ("".join(groups),) if groups else ()


def _base_forms(kind: int, word: str) -> tuple[str, ...]:
    groups = _DIGITS.findall(word)
    if kind < 2:
        return (word.lower(),) if kind == 0 else (_ip_form(groups),)
    size = sum(map(len, groups))
    tails = ("".join(groups[k:]) for k in range(len(groups)))
    return tuple(sorted({t for t in tails if 2 * len(t) > size}))


def nodes(text: str, base: list[Span]) -> list[Node]:
    """`start, end, kind (0 none), shape, forms, word number` in text order. A base span is one node; other nodes are words outside of base spans, and neighbouring words that have a base span's form together."""
    out = [(s, e, kind + 1, _shape(text[s:e], _digits(text[s:e])), _base_forms(kind, text[s:e]), -1) for kind, s, e in base]
    known = {f for node in out for f in node[4]}
    longest = max((sum(map(str.isdigit, f)) for f in known if "@" not in f), default=0)
    spans, k = sorted((s, e) for _, s, e in base), 0
    groups: list[tuple[int, int, list[str], int]] = []

    def close() -> None:
        at = 0
        while at < len(groups):
            taken, held, size = groups[at][2], sum(map(len, groups[at][2])), 1
            joined = list(taken)
            for k in range(at + 1, len(groups)):  # at most as many words as the longest form has digits
                joined = joined + groups[k][2]
                held += sum(map(len, groups[k][2]))
                if held > longest:
                    break
                if known.intersection(_word_forms(joined)):
                    taken, size = joined, k + 1 - at
            last = groups[at + size - 1]
            out.append((groups[at][0], last[1], 0, _shape(text[groups[at][0] : last[1]], "".join(taken)), _word_forms(taken), last[3]))
            at += size
        groups.clear()

    for number, m in enumerate(_WORD.finditer(text)):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        word = m[0]
        if k < len(spans) and spans[k][0] < m.end() or not any(c in word for c in _SIGNS):
            close()
            continue
        bare = word.strip(_EDGES)
        if not bare:
            close()
            continue
        start = m.start() + word.index(bare)
        if groups and groups[-1][1] < m.start() - 3:
            close()
        if _GROUP.fullmatch(bare):
            groups.append((start, start + len(bare), _DIGITS.findall(bare), number))
            continue
        close()
        digits = _digits(bare)
        forms = (bare.lower(),) if "@" in bare else _word_forms(_DIGITS.findall(bare))
        out.append((start, start + len(bare), 0, _shape(bare, digits), forms, number))
    close()
    return sorted(out)


def _bits(shapes: np.ndarray) -> np.ndarray:
    return np.concatenate([(shapes[:, None] >> np.arange(FEATURES)) & 1, np.ones((len(shapes), 1), np.int64)], axis=1).astype(np.float64)


Model = tuple[np.ndarray, np.ndarray, float]


def fit(counts: list[tuple[int, int, int]], chains: list[tuple[int, int, int]], pairs: list[tuple[int, int, int]], steps: int = 300, pull: float = 1e-3) -> Model:
    """Node weights from (shape, label, times), chain weights from (label, next label, times), and the forms' potential from (label, another label of the form, times)."""
    size = len(KINDS) + 1
    weights, chain = np.zeros((FEATURES + 1, size)), np.zeros((size, size))
    if counts:
        shape, label, times = (np.array(c) for c in zip(*sorted(counts), strict=True))
        x, goal, share = _bits(shape), np.eye(size)[label], (times / times.sum())[:, None]
        speed = np.zeros_like(weights)
        for _ in range(steps):
            score = x @ weights
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            slope = x.T @ ((p - goal) * share) + pull * weights
            speed = 0.9 * speed - slope
            weights += speed
    table = np.ones((size, size))
    for a, b, n in chains:
        table[a, b] += n
    chain = np.log(table / table.sum()) - np.log(table.sum(1, keepdims=True) / table.sum()) - np.log(table.sum(0, keepdims=True) / table.sum())
    agree, other = (sum(n for a, b, n in pairs if (a == b) is same) for same in (True, False))
    return weights, np.clip(chain, -2, 2), float(max(0.0, np.log((agree + PAIRS) / (other + PAIRS))))


def marginals(unary: np.ndarray, pairs: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Loopy sum-product in logarithms: `unary` by node and label, `pairs` of nodes, `tables` by pair, label, label. Messages pass until they settle; every HALVED rounds their step is halved, so they do on any graph."""
    n = len(pairs)
    if not n:
        return np.exp(unary - np.logaddexp.reduce(unary, axis=1, keepdims=True))
    source = np.concatenate([pairs[:, 0], pairs[:, 1]])
    target = np.concatenate([pairs[:, 1], pairs[:, 0]])
    table = np.concatenate([tables, tables.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
    sent = np.zeros((2 * n, unary.shape[1]))
    step, k = 1.0, 0
    while True:
        belief = unary.copy()
        np.add.at(belief, target, sent)
        fresh = np.logaddexp.reduce((belief[source] - sent[back])[:, :, None] + table, axis=1)
        fresh -= np.logaddexp.reduce(fresh, axis=1, keepdims=True)
        moved = step * np.abs(fresh - sent).max()
        sent = sent + step * (fresh - sent)
        k += 1
        if k % HALVED == 0:
            step /= 2
        if moved < SETTLED:
            break
    belief = unary.copy()
    np.add.at(belief, target, sent)
    return np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True))


def edges(found: list[Node]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Chain pairs, of neighbouring words; and the occurrences of each form that has more than one."""
    chain = [(i, i + 1) for i in range(len(found) - 1) if found[i][5] >= 0 and found[i + 1][5] == found[i][5] + 1]
    at: dict[str, list[int]] = {}
    for i, node in enumerate(found):
        for form in node[4]:
            at.setdefault(form, []).append(i)
    return chain, [own for own in at.values() if len(own) > 1]


def field(found: list[Node], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`unary, pairs, tables` of a document's graph: the nodes, and after them one node for each form."""
    weights, chained, agree = model
    chain, forms = edges(found)
    unary = np.concatenate([_bits(np.array([n[3] for n in found])) @ weights, np.zeros((len(forms), weights.shape[1]))])
    for i, node in enumerate(found):
        if node[2]:
            unary[i, node[2]] = HELD
    tied = []
    for k, own in enumerate(forms):
        hub = len(found) + k
        for i in own:
            tied.append((i, hub))
            if found[i][2]:
                unary[hub, found[i][2]] = HELD
    tables = np.concatenate([np.repeat(chained[None], len(chain), 0), np.repeat((agree * np.eye(weights.shape[1]))[None], len(tied), 0)])
    return unary, np.array([*chain, *tied], np.int64).reshape(-1, 2), tables


def spans(text: str | None, model: Model) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that the field adds."""
    if not text or not any(c in text for c in _SIGNS):
        return [], []
    base = base_spans(text)
    found = nodes(text, base)
    if all(n[2] for n in found):
        return base, []
    graph = field(found, model)
    belief = marginals(*graph)
    added = [(int(b.argmax()) - 1, n[0], n[1]) for n, b in zip(found, belief[: len(found)], strict=True) if not n[2] and b.argmax() and b.max() >= LEAST_PROBABILITY]
    return base, sorted(added)


def listed(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(found))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS) -> Model:
    """The field's weights, from the documents of the least hash."""
    drawn = docs.select(F.xxhash64(F.col(doc_id)).alias("h")).orderBy("h").limit(sample_docs)
    least = drawn.agg(F.max("h")).first()[0]
    if least is None:
        return fit([], [], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[int, int, int], int] = {}
            for cell in batch.column(0):
                value = cell.as_py()
                if value and any(c in value for c in _SIGNS):
                    found = nodes(value, base_spans(value))
                    chain, forms = edges(found)
                    held = [[i for i in own if found[i][2]] for own in forms]
                    open_ = {i for own, based in zip(forms, held, strict=True) if based for i in own if not found[i][2]}
                    keys = [(0, node[3], node[2]) for i, node in enumerate(found) if i not in open_]
                    keys += [(1, found[a][2], found[b][2]) for a, b in chain if a not in open_ and b not in open_]
                    keys += [(2, found[a][2], found[b][2]) for based in held for a, b in zip(based, based[1:], strict=False)]
                    for key in keys:
                        seen[key] = seen.get(key, 0) + 1
            rows = list(zip(*seen, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows), pa.array(list(seen.values()), pa.int64())], names=["what", "a", "b", "times"])

    counted = docs.filter(F.xxhash64(F.col(doc_id)) <= least).select(text).mapInArrow(run, "what long, a long, b long, times long")
    rows = counted.groupBy("what", "a", "b").agg(F.sum("times").alias("times")).collect()  # shapes and labels: at most 2^18 times 5 rows
    pick = lambda what: [(r.a, r.b, r.times) for r in rows if r.what == what]
    return fit(pick(0), pick(1), pick(2))


def find(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, n_email, n_ip, n_card, n_phone` (base spans), `base_sha256, spans, n_added`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, all_spans, more = [], [], [], []
            for cell in batch.column(1):
                base, added = spans(cell.as_py(), model)
                counts.append([sum(s[0] == k for s in base) for k in range(4)])
                shas.append(hashlib.sha256(listed(base).encode()).hexdigest())
                all_spans.append(listed(base + added))
                more.append(len(added))
            per_kind = list(zip(*counts, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in per_kind), pa.array(shas, pa.string()), pa.array(all_spans, pa.string()), pa.array(more, pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    out = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, out)


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with each span of `text` replaced by its kind in angle brackets, such as <EMAIL>; overlapping spans are replaced as one, named after the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            out = []
            for cell in batch.column(at):
                value = cell.as_py()
                base, added = spans(value, model)
                parts, done = [], 0
                for s, e, k in sorted((s, e, k) for k, s, e in base + added):
                    if s >= done:
                        parts += [value[done:s], f"<{KINDS[k].upper()}>"]
                    done = max(done, e)
                out.append("".join([*parts, value[done:]]) if parts else value)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op1_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, train(docs))
