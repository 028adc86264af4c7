"""Personal data: fixed patterns as a base, and a linear-chain conditional random field that adds what they miss.

The field labels white-space tokens as none, email, ip, card or phone, from the word shape of a token and the coarse
classes of its neighbours. It is trained here, by gradient ascent on the conditional likelihood, from the small table
``EXAMPLES``, and decoded by Viterbi over padded arrays of many token windows at a time.

By the field's structure a token without a digit, an @ or a bracketed "at" or "dot", whose neighbours have none
either, can only have the label none, in training and in decoding. So decoding windows round tokens with these is the
same as decoding whole texts.

All searches are linear in the text: runs are matched possessively, and only where a run starts.

Defined results: null text: empty; no spans. Added spans never overlap base ones. A null doc_id is carried along. Rows that
repeat are answered each. Empty table: no rows.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind's number, start, end

# ---- base patterns ----
_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """An address is the run of its characters before an @ and the domain after it; looked for from each @, so in linear time."""
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        low = at
        while low > end and text[low - 1] in _LOCAL:
            low -= 1
        m = _DOMAIN.match(text, at + 1) if low < at else None
        at += 1
        if m:
            end = at = m.end()
            yield low, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if "@" in text:
        out += [(0, a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdecimal, m[0])) <= 15]
    return out


# ---- the labelled table: {kind|text} marks a span ----
EXAMPLES = """
write to {email|anna.berg@mail.example.com} before noon
und.{email|34@mail7.example.com} for the rest of it
contact {email|j.doe (at) example.org} for a copy
contact {email|support [at] example.com} for a copy
my mail is {email|maria_lopez [at] mail [dot] example} thanks
reach me under {email|tom (at) host (dot) net} or later
ask {email|info[at]example.de} for it
ask {email|sales(at)shop.example} for it
send it to {email|k.weber{at}example.fr} today
the address {email|peter@localhost} is local
mail {email|lee [at] corp (dot) example [dot] com} please
call {phone|+49 30 1234567} after six
call {phone|555-010-4477} after six
phone {phone|(555) 010-9921} or come by
tel {phone|030 123 45 67} is the desk
tel. {phone|0171/2345678} is mine
fax {phone|555.010.8890} works too
mobile {phone|07700 900123} now
phone: {phone|0049 171 9876543} in the evening
call {phone|1-800-555-0199} toll free
reach us by phone {phone|555 010 7788} any day
ring {phone|(020) 7946 0958} for news
tel {phone|01 42 68 53 00} paris office
phone {phone|5550104477} at night
card {card|4111 1111 1111 1111} was used
card {card|4111-1111-1111-1111} was used
paid by card {card|3782 822463 10005} last week
card number {card|5500005555555559} on file
visa {card|4012 8888 8888 1882} expired
the card {card|6011-0009-9013-9425} is lost
a payment with {card|4179672074533673} that went through
credit card {card|378282246310005} noted
from {ip|191.60.21.84} the calls came
server {ip|10.0.0.17} did not answer
host {ip|192.168.1.1:8080} was down
address {ip|2001:db8:0:1:1:1:1:1} was logged
address {ip|fe80::1ff:fe23:4567:890a} was logged
ip {ip|2001:0db8:85a3::8a2e:0370:7334} seen
blocked {ip|172-16-254-1} again
host {ip|10-0-0-12} is new here
from {ip|192-168-7-20} came a call
server {ip|10[.]1[.]0[.]5} is back
login from {ip|203[.]0[.]113[.]9} failed
under the apache license version 2.0 of it
released under cc by 4.0 terms
the gnu general public license version 3.
in 1998 and 2004 the town had 12,500 people
on 2024-05-17 at 10:30 we met
on 17/05/2024 the 3rd part began
he paid $1,200.50 for 3 of them
about 45 % of 1200 rows and 0.75 of the rest
chapter 12 page 345 line 7
isbn 978-3-16-148410-0 of the book
key "2c2f090c991ec47d826f64d" was in the file
token sk_9f8e7d6c5b4a39281706 leaked
the value 3.14159 and 2.71828 and 1e10
version 1.2.3.4567 of build 20240517
room 101 floor 2 seat 14b
order 1002003 of 25 items
a score of 3-2 and then 21-14 at home
between 10 and 20 or 100 to 200
x1 y2 z3 and a4 paper
the 1990s and the 21st century
call me at 5 or at 10:45 today
phone the office before 2020 ends
card 12 of 52 in the deck
the host had 3 guests (at most)
it was (at the time) good and [dot] not
see [12] and (3) and {4} there
article 5 (1) of law 2016/679
weights 70 kg and 1.80 m tall
sum 12345 plus 67890 makes 80235
id 00012345678901234567 in the list
batch 2023-11-05T10:30:00Z done
price 12.99 or 1.299,00 euro
ratio 16:9 and time 23:59:59
the@sign alone and a @ between
he wrote @someone about it
word%%% 77%%% other### 12***
the&&& of 2&&& on### it
"""

_MARK = re.compile(r"\{(email|ip|card|phone)\|((?:[^{}]|\{at\})*)\}")
_TOKEN = re.compile(r"\S+")
_HINT = re.compile(r"[0-9@]|[\[({](?:at|dot)[\])}]", re.I)
_CUES = {"phone": 1, "tel": 1, "call": 1, "fax": 1, "mobile": 1, "ring": 1, "telefon": 1, "card": 2, "visa": 2, "credit": 2, "number": 2, "mail": 3, "email": 3, "contact": 3, "write": 3, "ip": 4, "host": 4, "server": 4, "address": 4}
_PLAIN_CLASSES, _CLASSES, _EDGE = 5, 16, 15


def coarse(token: str) -> int:
    """A token's class as its neighbours see it: 0 to 4 without any hint (4 kinds of cue words), 5 and up with one."""
    if not _HINT.search(token):
        return _CUES.get(token.strip(".,:;").lower(), 0)
    low, digits = token.lower(), sum(map(str.isdecimal, token))
    if "@" in token:
        return 5
    if re.fullmatch(r"[\[({]at[\])}]", low):
        return 6
    if re.fullmatch(r"[\[({]dot[\])}]", low):
        return 7
    if not digits:
        return 8
    core = token.strip(".,;:!?()*#$%&|")
    if core.isdecimal():
        return 9 if digits <= 2 else 10 if digits <= 4 else 11
    if re.fullmatch(r"[0-9.()/+\-]+", core):
        return 12
    return 13 if ":" in core else 14


def shape(token: str) -> list[str]:
    """A token's own features."""
    if not _HINT.search(token):
        return [f"plain{coarse(token)}"]
    digits = sum(map(str.isdecimal, token))
    core = token.strip(".,;!?*#$%&|\"'")
    form = re.sub(r"d+", "d", re.sub(r"x+", "x", re.sub(r"X+", "X", re.sub("[0-9]", "d", "".join("X" if c.isupper() else "x" if c.isalpha() else c for c in core)))))
    size = digits if digits < 7 else 8 if digits < 9 else 10 if digits < 11 else 12 if digits < 16 else 16 if digits < 20 else 20
    out = [f"form {form[:14]}", f"digits {size}", f"class {coarse(token)}"]
    out += [f"has {c}" for c in ".:/-()$%,@" if c in core]
    if re.search(r"[\[({]at[\])}]", core, re.I):
        out.append("joined at" if len(core) > 4 else "alone at")
    if core.count(".") == 3 and core.replace(".", "").isdecimal():
        out.append("four parts")
    if core.count(":") >= 2 and re.fullmatch(r"[0-9a-fA-F:]+", core):
        out.append("colons, hexadecimal")
    if core.startswith(("+", "00", "(")):
        out.append("phone start")
    if "[.]" in core:
        out.append("bracketed dot")
    return out


def labelled(line: str) -> tuple[list[str], list[int]]:
    """Tokens and labels (0 none, 1 to 4 the kinds) of a marked line."""
    text, spans, at = "", [], 0
    for m in _MARK.finditer(line):
        text += line[at : m.start()]
        spans.append((KINDS.index(m[1]) + 1, len(text), len(text) + len(m[2])))
        text, at = text + m[2], m.end()
    text += line[at:]
    tokens = list(_TOKEN.finditer(text))
    return [t[0] for t in tokens], [next((k for k, a, b in spans if t.start() < b and t.end() > a), 0) for t in tokens]


L, NEVER = len(KINDS) + 1, -1e6


class Field:
    """Weights of the field. A labelling's score: own features, classes of both neighbours, and label pairs, from none and to none at the ends."""

    def __init__(self, own: dict[str, np.ndarray], before: np.ndarray, after: np.ndarray, pairs: np.ndarray):
        self.own, self.before, self.after, self.pairs = own, before, after, pairs
        self.cache: dict[str, tuple[int, np.ndarray]] = {}

    def token(self, token: str) -> tuple[int, np.ndarray]:
        got = self.cache.get(token)
        if got is None:
            got = coarse(token), sum((self.own[f] for f in shape(token) if f in self.own), np.zeros(L))
            if len(token) <= 40:
                if len(self.cache) > 50_000:
                    self.cache.clear()
                self.cache[token] = got
        return got


def _scores(field: Field, windows: list[list[str]], edges: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Emissions [window, place, label], padded, and lengths."""
    sizes = np.array([len(w) for w in windows])
    out = np.zeros((len(windows), sizes.max(), L))
    for i, (tokens, (left, right)) in enumerate(zip(windows, edges, strict=True)):
        got = [field.token(t) for t in tokens]
        classes = np.array([left, *(c for c, _ in got), right])
        out[i, : len(tokens)] = np.array([e for _, e in got]) + field.before[classes[:-2]] + field.after[classes[2:]]
        out[i, : len(tokens)][_only_none(classes), 1:] = NEVER
    return out, sizes


def _only_none(classes: np.ndarray) -> np.ndarray:
    """Of tokens with these classes (those of both outer neighbours first and last): which stand among plain ones."""
    plain = (classes < _PLAIN_CLASSES) | (classes == _EDGE)
    return plain[:-2] & plain[1:-1] & plain[2:]


def viterbi(scores: np.ndarray, sizes: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The best labels of all windows at a time; places beyond a window's size get none."""
    n, steps, _ = scores.shape
    back = np.zeros((n, steps, L), np.int8)
    best = pairs[0] + scores[:, 0]
    for t in range(1, steps):
        ways = best[:, :, None] + pairs
        back[:, t] = ways.argmax(axis=1)
        best = np.where((t < sizes)[:, None], ways.max(axis=1) + scores[:, t], best)
    out = np.zeros((n, steps), np.int8)
    label, rows = (best + pairs[:, 0]).argmax(axis=1), np.arange(n)
    for t in range(steps - 1, -1, -1):
        inside = t < sizes
        out[inside, t] = label[inside]
        if t:
            label = np.where(inside, back[rows, t, label], label)
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


@functools.lru_cache(maxsize=2)
def train(table: str = EXAMPLES, epochs: int = 300, rate: float = 0.1, decay: float = 0.01) -> Field:
    """Maximises the penalised conditional log-likelihood of the table by Adam steps on exact gradients."""
    rows = [labelled(x) for x in table.strip().splitlines()]
    names = {f: i for i, f in enumerate(sorted({f for tokens, _ in rows for t in tokens for f in shape(t)}))}
    steps, count = max(len(t) for t, _ in rows), len(rows)
    own = np.zeros((count, steps, len(names)))
    prev, nxt, truth, mask = (np.zeros((count, steps), int) for _ in range(4))
    for i, (tokens, labels) in enumerate(rows):
        classes = [_EDGE, *map(coarse, tokens), _EDGE]
        for t, token in enumerate(tokens):
            own[i, t, [names[f] for f in shape(token)]] = 1
            prev[i, t], nxt[i, t], truth[i, t], mask[i, t] = classes[t], classes[t + 2], labels[t], 1
    barred = np.zeros((count, steps, L))
    for i, (tokens, _) in enumerate(rows):
        barred[i, : len(tokens)][_only_none(np.array([_EDGE, *map(coarse, tokens), _EDGE])), 1:] = NEVER
    hot = np.concatenate([own, np.eye(_CLASSES)[prev], np.eye(_CLASSES)[nxt]], axis=2) * mask[:, :, None]
    sizes = mask.sum(axis=1)
    target = np.eye(L)[truth] * mask[:, :, None]
    seen = np.zeros((L, L))
    for _, labels in rows:
        np.add.at(seen, ([0, *labels], [*labels, 0]), 1)
    w, pairs = np.zeros((hot.shape[2], L)), np.zeros((L, L))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(pairs), np.zeros_like(pairs)]
    at = np.arange(count)
    for epoch in range(1, epochs + 1):
        e = hot @ w + barred
        f = np.zeros((count, steps, L))
        f[:, 0] = pairs[0] + e[:, 0]
        for t in range(1, steps):
            f[:, t] = _lse(f[:, t - 1, :, None] + pairs, 1) + e[:, t]
        b = np.zeros((count, steps, L))
        for t in range(steps - 1, -1, -1):
            tail = pairs[:, 0] + np.zeros((count, L))
            inner = _lse((e[:, t + 1] + b[:, t + 1])[:, None, :] + pairs, 2) if t + 1 < steps else tail
            b[:, t] = np.where((t == sizes - 1)[:, None], tail, inner)
        z = _lse(f[at, sizes - 1] + pairs[:, 0], 1)
        p = np.exp(f + b - z[:, None, None]) * mask[:, :, None]
        expected = np.zeros((L, L))
        expected[0] += p[:, 0].sum(axis=0)
        expected[:, 0] += p[at, sizes - 1].sum(axis=0)
        for t in range(1, steps):
            joint = np.exp(f[:, t - 1, :, None] + pairs + (e[:, t] + b[:, t])[:, None, :] - z[:, None, None])
            expected += (joint * mask[:, t, None, None]).sum(axis=0)
        grads = np.einsum("ntf,ntl->fl", hot, target - p) - decay * w, seen - expected - decay * pairs
        for k, (param, g) in enumerate(zip((w, pairs), grads, strict=True)):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            param += rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    n = len(names)
    return Field({f: w[i] for f, i in names.items()}, w[n : n + _CLASSES], w[n + _CLASSES :], pairs)


# ---- spans of a batch ----
_TRIM_LEFT, _TRIM_RIGHT = "\"'<,;:!?*#$%&|", "\"'>,.;:!?*#$%&|"


def _plausible(kind: int, text: str) -> bool:
    """What a span of each kind has to have at least; the field only proposes."""
    digits = sum(map(str.isdecimal, text))
    if kind == 0:
        return bool(re.search(r"\w\s?(?:@|[\[({]at[\])}])\s?\w", text, re.I))
    if kind == 1:
        parts = re.split(r"\[\.\]|[.:-]", text)
        return len(parts) >= 4 and digits >= 4 and all(re.fullmatch("[0-9a-fA-F]{0,4}", p) for p in parts)
    if re.search("[A-Za-z]", text):
        return False
    if kind == 2:
        return 13 <= digits <= 19 and luhn("".join(filter(str.isdecimal, text)))
    return 7 <= digits <= 15 and not (digits > 12 and text.isdecimal())


def _windows(text: str, whole: bool = False) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Places of all tokens, and [low, high) token numbers of the windows to decode."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    if whole:
        return tokens, [(0, len(tokens))] if tokens else []
    spots, out, k = [m.start() for m in _HINT.finditer(text)], [], 0
    for i, (a, b) in enumerate(tokens):
        while k < len(spots) and spots[k] < a:
            k += 1
        if k < len(spots) and spots[k] < b:
            low, high = max(0, i - 2), min(len(tokens), i + 3)
            if out and low <= out[-1][1]:
                out[-1] = out[-1][0], high
            else:
                out.append((low, high))
    return tokens, out


def find(texts: list[str], field: Field, whole: bool = False) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, spans that the field adds) of each text."""
    out: list[tuple[list[Span], list[Span]]] = [([], []) for _ in texts]
    jobs, windows, edges = [], [], []
    for i, text in enumerate(texts):
        if not whole and not _HINT.search(text):
            continue
        out[i][0].extend(base_spans(text))
        tokens, lows = _windows(text, whole)
        for low, high in lows:
            jobs.append((i, tokens[low:high]))
            windows.append([text[a:b] for a, b in tokens[low:high]])
            edges.append(tuple(coarse(text[slice(*tokens[k])]) if 0 <= k < len(tokens) else _EDGE for k in (low - 1, high)))
    order = sorted(range(len(jobs)), key=lambda k: len(windows[k]))
    at = 0
    while at < len(order):  # windows of like length together, a bounded number of places at a time
        high = at + 1
        while high < len(order) and (high - at + 1) * len(windows[order[high]]) <= 50_000:
            high += 1
        some = order[at:high]
        scores, sizes = _scores(field, [windows[k] for k in some], [edges[k] for k in some])
        for k, row in zip(some, viterbi(scores, sizes, field.pairs), strict=True):
            if row.any():
                i, places = jobs[k]
                out[i][1].extend(_spans(texts[i], places, row))
        at = high
    for base, added in out:
        taken = sorted((a, b) for _, a, b in base)
        added[:] = sorted(s for s in set(added) if not any(a < s[2] and s[1] < b for a, b in taken))
    return out


def _spans(text: str, places: list[tuple[int, int]], labels: np.ndarray) -> Iterator[Span]:
    t = 0
    while t < len(places):
        high = t + 1
        if labels[t]:
            while high < len(places) and labels[high] == labels[t]:
                high += 1
            a, b = places[t][0], places[high - 1][1]
            while a < b and text[a] in _TRIM_LEFT:
                a += 1
            while a < b and text[b - 1] in _TRIM_RIGHT:
                b -= 1
            if a < b and _plausible(int(labels[t]) - 1, text[a:b]):
                yield int(labels[t]) - 1, a, b
        t = high


def said(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    field = train()
    for b in batches:
        for low in range(0, b.num_rows, 1000):
            part = b.slice(low, 1000)
            found = find([t or "" for t in part.column(1).to_pylist()], field)
            counts = [[sum(k == n for k, _, _ in base) for base, _ in found] for n in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(said(base).encode()).hexdigest() for base, _ in found]), pa.array([said(base + added) for base, added in found])],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (base and added) of every row of ``docs`` (doc_id, text)."""
    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_run, schema)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the first names the whole."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    field = train()
    for b in batches:
        names = b.schema.names
        for low in range(0, b.num_rows, 1000):
            part = b.slice(low, 1000)
            texts = part.column("text").to_pylist()
            found = find([t or "" for t in texts], field)
            new = [None if t is None else redact(t, base + added) if base or added else t for t, (base, added) in zip(texts, found, strict=True)]
            columns = {"text": pa.array(new, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in new], pa.int64())}
            yield pa.RecordBatch.from_arrays([columns.get(c, part.column(c)) for c in names], names)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` and ``n_chars`` to match."""
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.col("n_chars").cast("long"))
    return docs.mapInArrow(released(_redacted), docs.schema)
