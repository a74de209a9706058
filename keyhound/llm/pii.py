"""Personal data: base patterns, and a skip-chain conditional random field that adds spans.

Base kinds are found by their patterns, leftmost and without overlap inside a kind; matches that fail the
further conditions (parts of an address, check digits, number of digits) are dropped and not retried.  The
expressions are linear on long texts.

The random field has a node for every token with a digit or ``@`` and for every token that repeats the name
of an e-mail address of the document.  Where neighbouring groups of digits (joined over blanks, brackets,
dots, dashes and slashes, not behind a letter) repeat digits of a phone number or card, they are one node in
place of their tokens, however they are grouped: the end of a phone number (after zeros dialled first), or
any stretch of a card, of at least ``LEAST`` digits.  Such a node has no shape of its own: its edges decide.
Fewer digits, such as a card's last four, tell too little and are no repeat.  Labels are the four kinds and
none.  Potentials are learned piece by piece from base labels of all documents, counted by tasks:
of a token's shape and label, of the labels of neighbouring nodes, and of the labels of tokens that repeat one
another.  Distant tokens of equal letters and digits, or of equal last eight digits, or that repeat digits as
said, are joined by skip edges (each to the next of its group, so a token that repeats a thousand times has a
thousand edges).  Loopy message passing spreads the labels of base spans, which are fixed.  A free token joined
to a base span, directly or over others, gets a span when its marginal for a kind is at least ``SURE``.  Base
spans stay as they are.

Positions are code points, ends exclusive.  Defined cases: a null text is empty; texts without a digit and
``@`` have no spans; without any learned potential nothing is added; repeated rows are rows of their own;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from keyhound.llm import flat

# The kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_SPANS = ArrayType(ArrayType(IntegerType()))

SURE = 0.9
LEAST = 7
ROUNDS = 12
_NONE = len(KINDS)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_GROUP = re.compile(r"[0-9]+")
_BETWEEN = re.compile(r"[\s().\[\]/\u2010-\u2015-]{1,4}")
_LONGEST = 21  # digits of a card, or of a phone number after zeros dialled first
_CARD_KIND, _PHONE_KIND = 2, 3
_TOKEN = re.compile(r"[^\s,;:()<>\[\]{}\"']+")
_MARKED = np.zeros(256, bool)
_MARKED[48:58] = _MARKED[64] = True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        else:
            done = max(done, start)
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for k, sign in enumerate(reversed(digits)):
        value = int(sign) * (1 + k % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([x for x in text if "0" <= x <= "9"])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``kind, start, end`` by kind and start."""
    out = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and m.end() - m.start() <= 37:
            digits = _digits(m[0])
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _shape(token: str) -> str:
    digits = len(_digits(token))
    size = next(k for k, top in enumerate((0, 3, 6, 8, 12, 15, 19, 1 << 62)) if digits <= top)
    letters = any(x.isalpha() for x in token)
    return f"{size}{min(token.count('.'), 4)}{'@' in token:d}{token[0] == '+':d}{'-' in token:d}{letters:d}"


Node = tuple[int, int, str, int, str]


class Parts:
    """The ends of phone numbers, and the stretches of ``LEAST`` digits of cards."""

    def __init__(self, spans: Iterable[tuple[int, str]]):
        self.tails: set[str] = set()
        self.grams: set[str] = set()
        for kind, whole in spans:
            if kind == _PHONE_KIND:
                digits = _digits(whole)
                self.tails.update(digits[k:] for k in range(len(digits) - LEAST + 1))
            elif kind == _CARD_KIND:
                self.grams.update(grams(_digits(whole)))

    def __bool__(self) -> bool:
        return bool(self.tails or self.grams)

    def phone(self, digits: str) -> bool:
        zeros = 2 if digits[:2] == "00" else digits[:1] == "0"
        return any(digits[k:] in self.tails for k in range(zeros + 1))

    def card(self, digits: str) -> bool:
        return bool(self.grams) and LEAST <= len(digits) <= 19 and all(x in self.grams for x in grams(digits))


def grams(digits: str) -> list[str]:
    return [digits[k : k + LEAST] for k in range(len(digits) - LEAST + 1)]


def runs(text: str, spans: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Neighbouring groups of digits outside ``spans`` (start, end, kind, in order).  A group behind a letter is in none; a letter ends a run."""
    held: list[tuple[int, int]] = []
    k = done = 0
    for m in _GROUP.finditer(text):
        start, end = m.span()
        while k < len(spans) and spans[k][0] < end:
            done = max(done, spans[k][1])
            k += 1
        before = text[max(start - 1, 0) : start]
        inside = start < done or before.isalnum() or before in ("_", "@")
        if held and (inside or not _BETWEEN.fullmatch(text, held[-1][1], start)):
            yield held
            held = []
        if not inside:
            held.append((start, end))
    if held:
        yield held


def repeats(text: str, run: list[tuple[int, int]], parts: Parts) -> Iterator[tuple[int, int]]:
    """The longest stretches of groups that repeat digits of a base span, from the last group on."""
    last = len(run) - 1
    while last >= 0:
        digits, first = "", None
        for k in range(last, -1, -1):
            start, end = run[k]
            if len(digits) + end - start > _LONGEST:
                break
            digits = text[start:end] + digits
            if parts.phone(digits) or parts.card(digits):
                first = k
        if first is None:
            last -= 1
            continue
        start, end = run[first][0], run[last][1]
        if text[max(start - 1, 0) : start] in ("(", "[") and (")" in text[start:end] or "]" in text[start:end]):
            start -= 1
        yield start, end
        last = first - 1


def nodes(text: str, base: list[tuple[int, int, int]]) -> list[Node]:
    """``start, end, token, label, whole``: label -1 where no base span touches, else the span as ``whole``.

    Groups of digits that repeat a base span have an empty token.
    """
    names = {text[a : text.index("@", a)].lower() for kind, a, _ in base if kind == 0}
    names = {x for x in names if len(x) >= 5}
    spans = sorted((a, b, kind) for kind, a, b in base)
    parts = Parts((kind, text[a:b]) for kind, a, b in base)
    joined = sorted(x for run in runs(text, spans) for x in repeats(text, run, parts)) if parts else []
    out: list[Node] = [(a, b, "", -1, text[a:b]) for a, b in joined]
    k = near = 0
    for m in _TOKEN.finditer(text):
        start, end = m.start(), m.end()
        while end > start and text[end - 1] in ".!?":
            end -= 1
        token = text[start:end]
        if not token or not (re.search("[0-9@]", token) or (names and token.lower() in names)):
            continue
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        inside = k < len(spans) and spans[k][0] < end
        while near < len(joined) and joined[near][1] <= start:
            near += 1
        if not inside and near < len(joined) and joined[near][0] < end:
            continue  # its digits have a node of their own
        whole = text[spans[k][0] : spans[k][1]] if inside else token
        out.append((start, end, token, spans[k][2] if inside else -1, whole))
    return sorted(out) if joined else out


def skip_edges(found: list[Node]) -> list[tuple[int, int]]:
    """Pairs of nodes that repeat one another, each with the next of its group."""
    groups: dict[str, list[int]] = defaultdict(list)
    parts = Parts({(label, whole) for _, _, _, label, whole in found if label >= 0})
    for k, (_, _, _, label, token) in enumerate(found):
        plain = "".join([x for x in token.lower() if x.isalnum()])
        digits = _digits(token)
        if len(plain) >= 5:
            groups["=" + plain].append(k)
        if "@" in token and len(name := token.lower().split("@")[0]) >= 5:
            groups["=" + "".join([x for x in name if x.isalnum()])].append(k)
        if len(digits) >= 8:
            groups["8" + digits[-8:]].append(k)
        if label == _PHONE_KIND or (label < 0 and plain == digits and parts.phone(digits)):
            groups["p" + digits[-LEAST:]].append(k)
        if label == _CARD_KIND:
            for x in dict.fromkeys(grams(digits)):
                groups["c" + x].append(k)
        elif label < 0 and plain == digits and parts.card(digits):
            groups["c" + digits[-LEAST:]].append(k)
    return sorted({(a, b) for x in groups.values() for a, b in zip(x, x[1:], strict=False)})


def _chain_edges(found: list[Node]) -> list[tuple[int, int]]:
    return [(k, k + 1) for k in range(len(found) - 1) if found[k + 1][0] - found[k][1] <= 3]


def _reached(found: list[Node], edges: list[tuple[int, int]]) -> set[int]:
    """Free nodes joined to a base span by skip edges."""
    beside = defaultdict(list)
    for a, b in edges:
        beside[a].append(b)
        beside[b].append(a)
    seen = {k for k, x in enumerate(found) if x[3] >= 0}
    open_ = list(seen)
    while open_:
        for k in beside[open_.pop()]:
            if k not in seen:
                seen.add(k)
                open_.append(k)
    return {k for k in seen if found[k][3] < 0}


def marginals(unary: np.ndarray, edges: np.ndarray, pairwise: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities by loopy message passing; ``pairwise`` has a table of log potentials per edge."""
    if not len(edges):
        belief = unary
    else:
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        tables = np.concatenate([pairwise, pairwise.transpose(0, 2, 1)])
        half, messages = len(edges), np.zeros((len(source), unary.shape[1]))
        back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
        for _ in range(rounds):
            belief = unary.copy()
            np.add.at(belief, target, messages)
            outgoing = belief[source] - messages[back]
            new = np.logaddexp.reduce(outgoing[:, :, None] + tables, axis=1)
            new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
            messages = 0.5 * messages + 0.5 * new
        belief = unary.copy()
        np.add.at(belief, target, messages)
    belief = belief - belief.max(1, keepdims=True)
    p = np.exp(belief)
    return p / p.sum(1, keepdims=True)


def added_spans(text: str, base: list[tuple[int, int, int]], model: dict) -> list[tuple[int, int, int]]:
    if not base or not model["shape"]:
        return []
    found = nodes(text, base)
    skips = skip_edges(found)
    free = _reached(found, skips)
    if not free:
        return []
    chains = _chain_edges(found)
    unary = np.full((len(found), _NONE + 1), -20.0)
    for k, (_, _, token, label, _) in enumerate(found):
        if label >= 0:
            unary[k, label] = 0.0
        elif not token:
            unary[k] = 0.0
        else:
            unary[k] = model["shape"].get(_shape(token), model["prior"])
    edges = np.array([*skips, *chains], np.int64).reshape(-1, 2)
    tables = np.concatenate([np.repeat(model["skip"][None], len(skips), 0), np.repeat(model["chain"][None], len(chains), 0)])
    p = marginals(unary, edges, tables)
    out = []
    for k in sorted(free):
        kind = int(p[k, :_NONE].argmax())
        if p[k, kind] >= SURE:
            out.append((kind, found[k][0], found[k][1]))
    return out


def train(docs: DataFrame) -> dict:
    """Log potentials from base labels in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int, int], int] = defaultdict(int)
        for batch in batches:
            for text in _marked_texts(batch):
                if text is None:
                    continue
                base = base_spans(text)
                found = nodes(text, base)
                labels = [x[3] if x[3] >= 0 else _NONE for x in found]
                skips = skip_edges(found)
                unknown = _reached(found, skips)  # repeats of a base span are no examples of none
                for k, (_, _, token, _, _) in enumerate(found):
                    if k not in unknown:
                        counts["=" + _shape(token), labels[k], 0] += 1
                for name, edges in (("skip", skips), ("chain", _chain_edges(found))):
                    for a, b in edges:
                        if a not in unknown and b not in unknown:
                            counts[name, labels[a], labels[b]] += 1
        keys = list(counts)
        yield pa.record_batch(
            [pa.array([k[0] for k in keys], pa.string()), *(pa.array([k[i] for k in keys], pa.int32()) for i in (1, 2)), pa.array([counts[k] for k in keys], pa.int64())],
            ["what", "a", "b", "n"],
        )

    # Shapes and labels are few, whatever the number of documents.
    rows = docs.select("text").mapInArrow(count, "what string, a int, b int, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()
    shapes: dict[str, np.ndarray] = {}
    pairs = {"skip": np.full((_NONE + 1, _NONE + 1), 0.1), "chain": np.full((_NONE + 1, _NONE + 1), 1.0)}
    for row in rows:
        if row["what"][0] == "=":
            shapes.setdefault(row["what"][1:], np.full(_NONE + 1, 0.5))[row["a"]] += row["n"]
        else:
            pairs[row["what"]][row["a"], row["b"]] += row["n"]
            pairs[row["what"]][row["b"], row["a"]] += row["n"]
    everything = sum(shapes.values(), np.full(_NONE + 1, 0.5))
    model: dict = {"shape": {k: np.log(v / v.sum()) for k, v in shapes.items()}, "prior": np.log(everything / everything.sum())}
    for name, table in pairs.items():
        joint = table / table.sum()
        # Repeated tokens attract each other's labels even where the documents hold no repetition.
        strength = np.log(joint / (joint.sum(1)[:, None] * joint.sum(0)[None, :]))
        model[name] = np.clip(strength, -6, 6) + (3 * np.eye(_NONE + 1) if name == "skip" else 0)
    return model


def _marked_texts(batch: pa.RecordBatch) -> Iterator[str | None]:
    """The text of each row that has a digit or ``@``, else None."""
    for piece, data, offsets in flat.pieces(batch):
        marked = flat.row_sums(_MARKED[data], offsets[:-1], offsets[1:]) > 0
        texts = piece.column("text")
        for row, yes in enumerate(marked.tolist()):
            yield texts[row].as_py() if yes else None


def find(docs: DataFrame, model: dict, keep: list[str], names: tuple[str, str] = ("base", "spans")) -> DataFrame:
    """Columns ``keep`` of ``docs``, and as ``names`` the base and all spans: lists of kind number, start and end."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add(names[0], _SPANS).add(names[1], _SPANS)
    kind = pa.list_(pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, spans = [], []
            for text in _marked_texts(batch):
                own = base_spans(text) if text is not None else []
                base.append(own)
                spans.append(sorted([*own, *added_spans(text, own, shared.value)]) if own else own)
            yield pa.record_batch([*(batch.column(x) for x in keep), pa.array(base, kind), pa.array(spans, kind)], [*keep, *names])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def listing(spans: list[list[int]]) -> str:
    return ",".join([f"{KINDS[kind]}:{start}:{end}" for kind, start, end in spans])


def digests(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    key = found.select("doc_id").schema
    for kind in KINDS:
        key = key.add(f"n_{kind}", "long")
    schema = key.add("base_sha256", "string").add("spans", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = batch.column("base").to_pylist()
            counts = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in range(_NONE)]
            sums = pa.array([hashlib.sha256(listing(x).encode()).hexdigest() for x in base], pa.string())
            spans = pa.array([listing(x) for x in batch.column("spans").to_pylist()], pa.string())
            yield pa.record_batch([batch.column("doc_id"), *counts, sums, spans], schema.names)

    return found.select("doc_id", "base", "spans").mapInArrow(run, schema)


def masked(docs: DataFrame, model: dict) -> DataFrame:
    """The same columns, with every span of ``text`` replaced by its kind in angle brackets."""
    names = docs.columns
    found = find(docs, model, [*names], ("__base", "__spans"))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for k, spans in enumerate(batch.column("__spans").to_pylist()):
                if spans:
                    texts[k] = _mask(texts[k], spans)
            columns = {x: batch.column(x) for x in names}
            columns["text"] = pa.array(texts, batch.schema.field("text").type)
            if "n_chars" in columns:
                changed = [len(t) if s else n for t, s, n in zip(texts, batch.column("__spans").to_pylist(), columns["n_chars"].to_pylist(), strict=True)]
                columns["n_chars"] = pa.array(changed, columns["n_chars"].type)
            yield pa.record_batch(list(columns.values()), names)

    return found.select(*names, "__spans").mapInArrow(run, schema)


def _mask(text: str, spans: list[list[int]]) -> str:
    """Overlapping spans are replaced together, by the kind of the first."""
    out, done = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= done:
            out += [text[done:start], f"<{KINDS[kind].upper()}>"]
            done = end
        else:
            done = max(done, end)
    return "".join([*out, text[done:]])
