"""Personal data by patterns and a skip-chain conditional random field.

Base patterns find email addresses, IP addresses, payment cards and phone
numbers. Tokens with a digit or an at sign are the nodes of the field;
neighbours are linked, and so are distant tokens that repeat one another or
share their digits or local part. Its labels are none, the four kinds of the
patterns and ``secret`` (keys and passwords that are assigned to a name).

Emission, transition and skip potentials are trained by pseudo-likelihood on
a bounded sample of documents, labelled by the patterns. Each is taken twice:
as it stands, and with its mentions written in other forms that no pattern
matches, where some are stripped of their features but for a key they share
with another mention. So the emissions learn to find spans unaided and the
skip potentials learn how far a mention says what its repeats are.

Loopy message passing then settles the labels of each document, where tokens
in base spans keep theirs. Each repeat is linked to the nearest certain
mention, and messages run until they stop changing. A token that no base span
covers gets a span of its own where the field is sure of its kind; cards and
phone numbers of several tokens side by side are one span.
"""

from __future__ import annotations

import hashlib
import pickle
import random
import re
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import hash_sample, texts
from .blobs import tidied

KINDS = ("email", "ip", "card", "phone", "secret")
#: Kinds that have a base pattern.
BASE = 4
ANY = re.compile("[0-9@]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A start inside a run of digits cannot match where the run's start did not.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str):
    """Matches of local part, at sign and domain, found from the at sign so
    that long runs without one cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def ip_ok(found: str) -> bool:
    parts = [p.lstrip("0") or "0" for p in found.split(".")]
    return all(len(p) <= 3 and int(p) <= 255 for p in parts)


def digits_of(found: str) -> str:
    return "".join(DIGIT.findall(found))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    out = []
    if not ANY.search(text):
        return out
    out += [(0, *s) for s in emails(text)]
    if "." in text:
        out += [(1, *m.span()) for m in IP.finditer(text) if ip_ok(m[0])]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "+(@")
SIZES = (0, 2, 3, 6, 9, 12, 16, 1 << 30)
LENGTHS = (6, 9, 12, 15, 19, 1 << 30)
FEATURES = 21 + len(SIZES) + len(LENGTHS)
#: A value of 16 signs or more that is assigned to a name of a secret; labels
#: of the training sample only.
SECRET = re.compile(r"(?i)(?:token|secret|password|passwd|pwd|(?:api|access|private)[_-]?key)[\x20\"']{0,2}[:=][\x20\"']{0,2}([A-Za-z0-9_+/=.-]{16,})")
#: Kinds whose mentions may have spaces within.
JOINED = (2, 3)
ASSIGNED = re.compile(r"[:=][\x20\"'(\[{]*$")


@dataclass
class Nodes:
    """The field of one text."""

    spans: list[tuple[int, int]]
    x: np.ndarray  # features
    labels: np.ndarray  # of base spans: 0 none, else kind + 1
    chain: np.ndarray  # pairs of neighbours
    skip: np.ndarray  # pairs of distant mentions, each with the last one before
    links: np.ndarray  # (surer, less sure) pairs of distant mentions


def token_features(token: str, before: bool, after: bool, left: str = "") -> np.ndarray:
    """``left``: the few signs before the token."""
    x = np.zeros(FEATURES, dtype=np.float32)
    digits, core = digits_of(token), token.strip(EDGE)
    at, parts = core.find("@"), core.split(".")
    dotted = len(parts) == 4 and core.replace(".", "").isdigit() and core.isascii()
    hollow = re.sub(r"[-./_:()+\x20]", "", core)
    letters = any(c.isalpha() for c in core)
    x[:21] = (
        1, at > 0, at > 0 and "." in core[at:], token[0] == "+", token[0] == "(", letters, dotted,
        ip_ok(core) if dotted and all(parts) else 0, "=" in token, "-" in token, core.isascii() and core.isdigit(), 16 <= len(digits) <= 19 and luhn(digits), before, after,
        hollow.isdigit() and hollow != core, 16 <= len(digits) <= 19 and luhn(digits) and hollow == digits, len(parts) == 4 and hollow.isdigit() and all(p.isdigit() and len(p) < 4 for p in parts),
        letters and core.isalnum() and core.isascii(), bool(ASSIGNED.search(left)), "=" in token and any(c in token for c in "\"'"), re.fullmatch("[0-9a-f]{16,}|[0-9A-F]{16,}", core) is not None,
    )
    x[21 + next(k for k, n in enumerate(SIZES) if len(digits) <= n)] = 1
    x[21 + len(SIZES) + next(k for k, n in enumerate(LENGTHS) if len(core) <= n)] = 1
    return x


def keys_of(token: str) -> set[tuple[str, str]]:
    """What a token may share with a distant mention of the same thing."""
    core, digits = token.strip(EDGE).lower(), digits_of(token)
    out = {("same", core)} if len(core) >= 6 else set()
    if "@" in core[1:]:
        out.add(("same", core.split("@")[0]))
    if len(digits) >= 7:
        out.add(("digits", digits))
    return out


def nearest_links(keys: list[set], labels: np.ndarray) -> set[tuple[int, int]]:
    """(surer, less sure) links along which labels travel. Mentions in base spans are sure; the
    others get their level by the number of keys from one. All open mentions
    of a key are linked to the nearest of its lowest level, however many
    repeats lie between. Mentions that no base span reaches have no link."""
    by_key: dict[tuple[str, str], list[int]] = defaultdict(list)
    for i, own in enumerate(keys):
        for key in own:
            by_key[key].append(i)
    level = {i: 0 for i in range(len(keys)) if labels[i]}
    out, edge, done = set(), list(level), set()
    while edge:
        fresh = []
        for key in sorted({key for i in edge for key in keys[i]} - done):
            done.add(key)
            low = min(level[i] for i in by_key[key] if i in level)
            hubs = np.array([i for i in by_key[key] if level.get(i) == low])
            for i in by_key[key]:
                if not labels[i] and level.get(i) != low:
                    at = int(np.searchsorted(hubs, i))
                    hub = min(hubs[max(at - 1, 0) : at + 1].tolist(), key=lambda h: (abs(h - i), h))
                    out.add((hub, i))
                    if i not in level:
                        fresh.append(i)
        # a level is given only after all keys of the one before were looked at
        n = max(level.values()) + 1
        edge = sorted(set(fresh))
        level |= dict.fromkeys(edge, n)
    return out


def nodes_of(text: str, base: list[tuple[int, int, int]]) -> Nodes:
    found = list(TOKEN.finditer(text))
    spans, covered = [m.span() for m in found], sorted((s, e, k) for k, s, e in base)
    labels, at = np.zeros(len(spans), dtype=np.int64), 0
    for i, (s, e) in enumerate(spans):
        while at < len(covered) and covered[at][1] <= s:
            at += 1
        if at < len(covered) and covered[at][0] < e:
            labels[i] = covered[at][2] + 1
    near = [i for i in range(len(spans) - 1) if spans[i + 1][0] - spans[i][1] == 1]
    beside = np.zeros((len(spans), 2), dtype=bool)
    beside[[i + 1 for i in near], 0] = beside[near, 1] = True
    x = np.array([token_features(m[0], *b, text[max(m.start() - 4, 0) : m.start()]) for m, b in zip(found, beside, strict=True)]).reshape(-1, FEATURES)
    last: dict[tuple[str, str], int] = {}
    skip = set()
    keys = [keys_of(m[0]) for m in found]
    for i, own in enumerate(keys):
        for key in own:
            if key in last:
                skip.add((last[key], i))
            last[key] = i
    pairs = lambda p: np.array(sorted(p), dtype=np.int64).reshape(-1, 2)
    return Nodes(spans, x, labels, pairs((i, i + 1) for i in near), pairs(skip), pairs(nearest_links(keys, labels)))


@dataclass
class Field:
    emit: np.ndarray  # labels x features
    chain: np.ndarray  # left label x right label
    skip: np.ndarray  # symmetric

    def marginals(self, n: Nodes, damping: float = 0.5, still: float = 1e-6) -> np.ndarray:
        """Loopy sum-product until no message changes by ``still``; tokens in
        base spans keep their label, and all mentions that hang on another
        answer it with one voice, so that no number of repeats outvotes it.
        Messages that circle for longer than the
        longest chain takes are damped more and more, so that they settle."""
        k = len(self.emit)
        own = n.x @ self.emit.T
        sure = n.labels > 0
        own[sure] = -1e9
        own[sure, n.labels[sure]] = 0.0
        edges = np.concatenate([n.chain, n.links])
        pots = np.concatenate([np.repeat(self.chain[None], len(n.chain), 0), np.repeat(self.skip[None], len(n.links), 0)])
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pots = np.concatenate([pots, pots.transpose(0, 2, 1)])
        back = np.roll(np.arange(len(src)), len(edges))
        hung = np.bincount(n.links[:, 0], minlength=len(own))[n.links[:, 0]]
        voice = np.concatenate([np.ones(len(edges) + len(n.chain)), 1 / hung])[:, None]
        messages = np.full((len(src), k), -np.log(k))
        patience, rounds, change = 2 * len(n.spans) + 50, 0, np.inf
        while len(src) and change > still:
            belief = own.copy()
            np.add.at(belief, dst, voice * messages)
            out = (belief[src] - (voice * messages)[back])[:, :, None] + pots
            high = out.max(axis=1, keepdims=True)
            out = np.log(np.exp(out - high).sum(axis=1)) + high[:, 0]
            out -= np.log(np.exp(out - out.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) + out.max(axis=1, keepdims=True)
            step = (1 - damping) * 0.5 ** (rounds // patience)
            change, rounds = step * np.abs(out - messages).max(), rounds + 1
            messages = messages + step * (out - messages)
        belief = own.copy()
        np.add.at(belief, dst, voice * messages)
        belief = np.exp(belief - belief.max(axis=1, keepdims=True))
        return belief / belief.sum(axis=1, keepdims=True)


def _card(r, found: str) -> str:
    digits, gap = digits_of(found), r.choice([".", "/", "_", ":"])
    return gap.join(digits[i : i + 4] for i in range(0, len(digits), 4))


def _phone(r, found: str) -> str:
    digits = digits_of(found)
    first, area, a, b = digits[:-10], digits[-10:-7], digits[-7:-4], digits[-4:]
    forms = ["{a}-{b}", "{area}-{a}-{b}", "({area}) {a}-{b}", "({area}){a}-{b}", "{area}.{a}.{b}", "00{first}-{area}-{a}-{b}", "tel:{area}-{a}-{b}"]
    return r.choice(forms).format(first=first, area=area, a=a, b=b)


def _email(r, found: str) -> str:
    local, domain = found.split("@", 1)
    return r.choice([f"{local}@{domain.split('.')[0]}", f"{local}@[{domain}]", f"{local}@(at){domain}", f"{local}%@{domain.replace('.', ',')}"])


def _ip(r, found: str) -> str:
    return r.choice([found.replace(".", ","), found.replace(".", "-"), found.replace(".", "(.)"), found.replace(".", ":")])


#: Forms in which a training mention is written anew, by kind.
FORMS = (_email, _ip, _card, _phone)


def spans_to_learn(text: str) -> list[tuple[int, int, int]]:
    """Base spans and, where no base span is, assigned secrets."""
    base = base_spans(text)
    more = [(BASE, *m.span(1)) for m in SECRET.finditer(text) if DIGIT.search(m[1])]
    return base + [x for x in more if not any(a < x[2] and x[1] < b for _, a, b in base)]


def written_anew(text: str, spans: list[tuple[int, int, int]], r: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with each base mention in a form of FORMS, some of them twice,
    and the spans there."""
    out, labels, at, length = [], [], 0, 0

    def put(part: str) -> None:
        nonlocal length
        out.append(part)
        length += len(part)

    for kind, s, e in sorted(spans, key=lambda x: x[1]):
        if s < at:
            continue
        put(text[at:s])
        for again in range(1 + (r.random() < 0.5)):
            if again:
                put(" or ")
            part = text[s:e] if kind == BASE else FORMS[kind](r, text[s:e])
            labels.append((kind, length, length + len(part)))
            put(part)
        at = e
    put(text[at:])
    return "".join(out), labels


def lessons(text: str, seed: int) -> list[Nodes]:
    """What a training document gives: its nodes as they stand and with its
    mentions in other forms, some of those without features of their own."""
    r = random.Random(seed ^ zlib.crc32(text.encode()))
    spans = spans_to_learn(text)
    out = [nodes_of(text, spans)]
    if spans:
        out.append(nodes_of(*written_anew(text, spans, r)))
        blind = nodes_of(*written_anew(text, spans, r))
        hidden = [i for pair in blind.skip.tolist() for i in pair[1:] if r.random() < 0.5]
        blind.x[hidden] = 0
        out.append(blind)
    return out


def train(sample: list[Nodes], steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Pseudo-likelihood of the sample's labels. Emissions and transitions
    start and are drawn to nothing, skip potentials to agreement of weight
    one."""
    k, prior = len(KINDS) + 1, np.eye(len(KINDS) + 1)
    sample = [n for n in sample if len(n.spans)]
    at = np.cumsum([0, *(len(n.spans) for n in sample)])
    x = np.concatenate([n.x for n in sample] or [np.zeros((0, FEATURES))]).astype(np.float64)
    y = np.concatenate([n.labels for n in sample] or [np.zeros(0, np.int64)])
    chain = np.concatenate([n.chain + a for n, a in zip(sample, at, strict=False)] or [np.zeros((0, 2), np.int64)])
    skip = np.concatenate([n.skip + a for n, a in zip(sample, at, strict=False)] or [np.zeros((0, 2), np.int64)])
    field, one = Field(np.zeros((k, FEATURES)), np.zeros((k, k)), prior.copy()), np.eye(k)
    # rare labels weigh as much as frequent ones, up to the square root of their share
    rare = np.sqrt(len(y) / np.maximum(np.bincount(y, minlength=k), 1))[y][:, None] if len(y) else np.ones((0, 1))
    for _ in range(steps if len(y) else 0):
        logits = x @ field.emit.T
        np.add.at(logits, chain[:, 0], field.chain[:, y[chain[:, 1]]].T)
        np.add.at(logits, chain[:, 1], field.chain[y[chain[:, 0]]])
        np.add.at(logits, skip[:, 0], field.skip[y[skip[:, 1]]])
        np.add.at(logits, skip[:, 1], field.skip[y[skip[:, 0]]])
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        miss = rare * (one[y] - p / p.sum(axis=1, keepdims=True))
        scale = rate / len(y)
        field.emit += scale * (miss.T @ x) * 10 - rate * decay * field.emit
        field.chain += scale * (miss[chain[:, 0]].T @ one[y[chain[:, 1]]] + one[y[chain[:, 0]]].T @ miss[chain[:, 1]]) * 10 - rate * decay * field.chain
        s = miss[skip[:, 0]].T @ one[y[skip[:, 1]]] + miss[skip[:, 1]].T @ one[y[skip[:, 0]]]
        field.skip += scale * (s + s.T) * 5 - rate * decay * (field.skip - prior)
    return field


def _learnt(shared, seed: int, max_nodes: int):
    def run(batches):
        chosen = shared.value
        for batch in batches:
            for code, text in zip(batch.column("code").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = lessons(text, seed) if code in chosen else []
                if found and max(len(n.spans) for n in found) <= max_nodes:
                    yield pa.RecordBatch.from_arrays([pa.array([code], pa.int64()), pa.array([pickle.dumps(found)], pa.binary())], names=["code", "nodes"])

    return run


def fit(docs: DataFrame, max_docs: int = 1000, max_nodes: int = 2000, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Train on ``max_docs`` distinct texts with a digit or an at sign, the
    first in a seeded hash order. The texts are turned into nodes where they
    are read, and one of more than ``max_nodes`` is not learned from, so what
    comes to the driver is bounded. The patterns label the sample; no label
    column is read."""
    some = texts(docs, id_col, text_col).where(F.col("text").rlike("[0-9@]")).select(F.xxhash64("text").alias("code"), "text")
    chosen = frozenset(r["code"] for r in hash_sample(some.select("code"), ["code"], max_docs, seed))
    if not chosen:
        return train([])
    shared = docs.sparkSession.sparkContext.broadcast(chosen)
    made = some.where(F.col("code").isin(*chosen)).mapInArrow(tidied(_learnt(shared, seed, max_nodes)), "code long, nodes binary")
    found = made.dropDuplicates(["code"]).collect()
    return train([n for _, data in sorted((r["code"], bytes(r["nodes"])) for r in found) for n in pickle.loads(data)])


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field, sure: float = 0.9, alone: float = 0.97) -> list[tuple[int, int, int]]:
    """Spans that the field adds to the base ones. It has to be ``sure`` of a
    token that links join to a base span, and surer of one that stands
    ``alone``."""
    n = nodes_of(text, base)
    if not len(n.spans) or (n.labels > 0).all():
        return []
    marginals, out = field.marginals(n), []
    kinds, beside = marginals[:, 1:].argmax(axis=1), {(a, b) for a, b in n.chain.tolist()}
    least = np.full(len(kinds), alone)
    least[n.links[:, 1]] = sure
    last = None  # the last token that got a span, of which kind
    for i in np.flatnonzero((n.labels == 0) & (marginals[np.arange(len(kinds)), kinds + 1] >= least)).tolist():
        kind, (s, e) = int(kinds[i]), n.spans[i]
        token = text[s:e]
        lead = len(token) - len(token.lstrip(EDGE))
        core = token.strip(EDGE)
        if core and not any(a < s + lead + len(core) and s + lead < b for _, a, b in base):
            if last == (i - 1, kind) and (i - 1, i) in beside and kind in JOINED:
                out[-1] = (kind, out[-1][1], s + lead + len(core))
            else:
                out.append((kind, s + lead, s + lead + len(core)))
            last = (i, kind)
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


RESULT = pa.schema(
    [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:BASE]), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64()), ("n_spans", pa.int64())]
)


def _found(shared):
    def run(batches):
        field: Field = shared.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                base = base_spans(text)
                more = added_spans(text, base, field)
                counts = [sum(k == i for k, _, _ in base) for i in range(BASE)]
                rows.append((doc, *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more), len(base) + len(more)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(RESULT), RESULT.types, strict=True)], schema=RESULT)

    return run


def personal_data(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, counts of base matches by kind,
    base_sha256, spans (base and added, kind:start:end), n_added and n_spans.
    A secret's kind is ``secret``, listed after the others; only the field
    finds it.

    Null and empty texts have no span and the digest of the empty string.
    Repeated rows give repeated results, and an empty table none. Very long
    texts are read whole; the field's size is that of their tokens with a
    digit or an at sign.
    """
    field = field or fit(docs, id_col=id_col, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    return texts(docs, id_col, text_col).mapInArrow(
        tidied(_found(shared)), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"
    )
