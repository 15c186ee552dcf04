"""Personal data: exact patterns, and a linear-chain CRF over word shapes that adds what they do not cover.

The CRF is fitted on the small labelled table below by its conditional likelihood (forward-backward), and decoded by
Viterbi over whole batches of sentences in numpy.
"""

from __future__ import annotations

import functools
import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from vivarium.llm.common import map_columns, steps

KINDS = ("email", "ip", "card", "phone")

# --- exact patterns -------------------------------------------------------------------------------------------------

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match always begins where its digits do
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """From each @ as far left as a local part goes: a search from every word's letters would be slow on long words."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and (text[begin - 1] in "._%+-" or (text[begin - 1].isascii() and text[begin - 1].isalnum())):
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end()))
            end = m.end()
        at = text.find("@", max(end, at + 1))
    return out


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octets(text: str) -> bool:
    parts = [p.lstrip("0") for p in text.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _is_card(text: str) -> bool:
    d = digits_of(text)
    return 13 <= len(d) <= 19 and luhn(d)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost matches by kind, those that fail their condition dropped."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if _DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if _octets(m.group())]
        out["card"] = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and _is_card(m.group())]
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return out


# --- the labelled table ---------------------------------------------------------------------------------------------

#: Sentences with their personal data in [[kind text]]; all invented.
LABELLED = """
Write to [[email anna.berg@example.com]] before noon.
Contact: [[email j_doe99@mail.example.org]], or come by.
The address is <[[email sales@shop.example.net]]> for orders.
Mail ### [[email k.lund@example.com]]### and wait.
Ask [[email tom (at) example (dot) com]] for the key.
Send it to [[email mary.major [at] example [dot] org]] today.
Reach me under [[email info(at)example(dot)net]] please.
It is [[email bob[at]example.com]] or nothing.
The host [[ip 10.0.0.17]] went down again.
Log: [[ip 192.168.4.250]], port 8080.
From [[ip 8.8.4.4]] to [[ip 172.16.254.1]] it takes long.
Blocked [[ip 203.0.113.9]] after 17 tries.
Paid by card [[card 4111 1111 1111 1111]] yesterday.
Card [[card 5500-0000-0000-0004]] was refused.
The number [[card 340000000000009]] is on file.
Use [[card 4012.8888.8888.1881]] for tests.
Call [[phone +1 (555) 010-2345]] now.
Call [[phone +49 30 901820]] or write.
My number is [[phone +33 1 23 45 67 89]], ask for me.
Tel. [[phone (555) 010-7788]] all day.
Phone [[phone (030) 5550-1234]] after six.
Fax: [[phone (212) 555-0199]].
Tel: [[phone (415) 555-0132]], room 4.
You can call [[phone (743) 555-3824]] at night.
Dial [[phone 555-010-4477]] from here.
Ring [[phone 415-555-0137]] twice.
### [[phone +1 (743) 555-3824]]### was there.
Only the night knew of the house on the hill.
The cat sat, and the dog slept.
In 1998 there were 12 of them, in 2004 only 3.
Version 2.10.3 came out on 2021-05-17 at 10:45.
It costs $12.99 or 1,250.00 in all.
Order 4785380592391139 was sent on 03/04/2020.
The id is 20240117093011 and the batch 77.
Key 24be64439e3e49cf46b2d7c90f3602a3d0b907ff was lost.
See pages 12-17 and 203-219 (chapter 4).
He won 3-2 and then 21-19 in 2-1 sets.
Room 101 (first floor) and room 2b.
The file is a1b2c3d4-e5f6-7890-abcd-ef1234567890.
At 12:30:45.123 the run took 0.0153 s.
We met @ noon, @home, and at the gate.
Follow @annab and use #fun2020 there.
A score of 99.5 percent (up 3.2) is fine.
| one | two | 3 | four |
NOTHING!! OF!! THIS!! IS!! TRUE!!
Part number 555-12 and 7-0042-9 are out.
ISBN 978-3-16-148410-0 is a book.
The years (1914) to (1918) and 1939-1945.
Take 2 (two) or 3 (three) of 1000.
Sum: 1 + 2 = 3, and 4+5 = 9.
On 2020-01-02 and 2020-11-30 nothing came.
Section 1.2.3.4.5 has the details.
100000 200000 300000 and 12345678 are round.
"""

_MARK = re.compile(r"\[\[(\w+) (.+?)\]\](?!\])")


def labelled_table() -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Rows of (sentence, spans)."""
    rows = []
    for line in LABELLED.strip().split("\n"):
        text, spans, last = "", [], 0
        for m in _MARK.finditer(line):
            text += line[last : m.start()]
            spans.append((m[1], len(text), len(text) + len(m[2])))
            text += m[2]
            last = m.end()
        rows.append((text + line[last:], spans))
    return rows


# --- word shapes ----------------------------------------------------------------------------------------------------

LOWER, UPPER, DIGIT, AT, DOT, DASH, PLUS, OPEN, CLOSE, SPACE, OTHER = range(11)
#: How many values each part of a word's shape has: digits, letters, @, dots, dashes, plus in front, brackets,
#: first character, last character, a written "at" or "dot", other signs.
PARTS = (8, 3, 2, 4, 4, 2, 2, 4, 3, 3, 2)
SHAPES = int(np.prod(PARTS))
_STOP = frozenset(".!?")
_WRITTEN = {"at": 1, "dot": 2}


@functools.cache
def _classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isspace():
            out[i] = SPACE
        elif c.isalpha():
            out[i] = UPPER if c.isupper() else LOWER
    out[48:58] = DIGIT
    for c, k in (("@", AT), (".", DOT), ("-", DASH), ("+", PLUS), ("(", OPEN), ("[", OPEN), (")", CLOSE), ("]", CLOSE)):
        out[ord(c)] = k
    return out


def _bucket(x: np.ndarray, bounds: tuple[int, ...]) -> np.ndarray:
    return np.searchsorted(bounds, x, "right")


@dataclass
class Words:
    begin: np.ndarray
    end: np.ndarray
    shape: np.ndarray
    first_of_sentence: np.ndarray
    codes: np.ndarray


def words_of(texts: list[str]) -> Words:
    """Words of all texts, each text followed by a line break; sentences end at . ! ? or a line break."""
    joined = "".join([t + "\n" for t in texts])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[codes]
    inside = kind != SPACE
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def count(k: int) -> np.ndarray:
        where = np.flatnonzero(kind == k)
        return np.searchsorted(where, end) - np.searchsorted(where, begin)

    digits, lower, upper, signs = count(DIGIT), count(LOWER), count(UPPER), count(OTHER)
    first, last = kind[begin], kind[end - 1]
    brackets = count(OPEN) + count(CLOSE)
    written = np.zeros(len(begin), np.int64)
    for i in np.flatnonzero(brackets >= 2):
        word = joined[begin[i] : end[i]].lower()
        inner = re.search(r"[(\[](at|dot)[)\]]", word)
        written[i] = _WRITTEN[inner[1]] if inner else 0
    parts = (
        _bucket(digits, (1, 2, 3, 4, 5, 9, 16)),
        _bucket(lower + upper, (1, 4)),
        count(AT) > 0,
        np.minimum(count(DOT), 3),
        np.minimum(count(DASH), 3),
        first == PLUS,
        brackets > 0,
        np.select([first <= UPPER, first == DIGIT, (first == OPEN)], [0, 1, 2], 3),
        np.select([last <= UPPER, last == DIGIT], [0, 1], 2),
        written,
        signs > 0,
    )
    shape = np.zeros(len(begin), np.int64)
    for n, p in zip(PARTS, parts):
        shape = shape * n + p
    new = np.ones(len(begin), bool)
    if len(begin) > 1:
        stops = np.isin(codes[end - 1], [ord(c) for c in _STOP])
        breaks = np.flatnonzero(codes == 10)
        new[1:] = stops[:-1] | (np.searchsorted(breaks, begin[1:]) > np.searchsorted(breaks, begin[:-1]))
    return Words(begin, end, shape, new, codes)


# --- the model ------------------------------------------------------------------------------------------------------

LABELS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
N = len(LABELS)
FEATURES = sum(PARTS)


def _features(shape: np.ndarray) -> np.ndarray:
    """The active feature of each part, for each shape."""
    out = np.zeros((len(shape), len(PARTS)), np.int64)
    rest, offset = shape.copy(), FEATURES
    for j in range(len(PARTS) - 1, -1, -1):
        offset -= PARTS[j]
        out[:, j] = offset + rest % PARTS[j]
        rest //= PARTS[j]
    return out


@dataclass
class Crf:
    """Weights of a word's own, its predecessor's and its successor's shape; transitions between labels."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    steps: np.ndarray
    start: np.ndarray


def _allowed() -> np.ndarray:
    """A word inside a span follows its first word or another one inside; -inf elsewhere."""
    out = np.zeros((N, N))
    for j, name in enumerate(LABELS):
        if name[0] == "I":
            for i, other in enumerate(LABELS):
                if other[1:] != name[1:]:
                    out[i, j] = -1e9
    return out


def train(rows: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 400, rate: float = 0.1, decay: float = 0.02) -> Crf:
    """Fit by gradient steps (Adam) on the conditional log-likelihood of the labelled rows, with an L2 penalty."""
    rows = [r for r in rows if r[0].strip()]
    length, feats, gold = [], [], []
    for text, spans in rows:
        w = words_of([text])
        label = np.zeros(len(w.begin), np.int64)
        for kind, a, b in spans:
            hit = np.flatnonzero((w.begin < b) & (w.end > a))
            label[hit] = LABELS.index(f"I-{kind}")
            label[hit[0]] = LABELS.index(f"B-{kind}")
        length.append(len(label))
        feats.append(_features(w.shape))
        gold.append(label)
    t_max, s = max(length), len(rows)
    x = np.full((s, t_max + 2, len(PARTS)), FEATURES)  # FEATURES: no word here
    y = np.zeros((s, t_max), np.int64)
    real = np.zeros((s, t_max))
    for i, (f, g) in enumerate(zip(feats, gold)):
        x[i, 1 : len(g) + 1], y[i, : len(g)], real[i, : len(g)] = f, g, 1
    weights = {k: np.zeros((FEATURES + 1, N)) for k in ("own", "before", "after")} | {"steps": np.zeros((N, N)), "start": np.zeros(N)}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    places = {"own": x[:, 1:-1], "before": x[:, :-2], "after": x[:, 2:]}
    onehot = np.eye(N)[y] * real[:, :, None]
    pairs = np.einsum("sti,stj->ij", onehot[:, :-1], onehot[:, 1:])

    def lse(a: np.ndarray, axis: int) -> np.ndarray:
        m = a.max(axis=axis, keepdims=True)
        return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)

    for step in range(1, rounds + 1):
        emit = sum(weights[k][places[k]].sum(axis=2) for k in places)
        trans = weights["steps"] + _allowed()
        start = weights["start"] + _allowed()[0]
        alpha, beta = np.zeros((s, t_max, N)), np.zeros((s, t_max, N))
        alpha[:, 0] = start + emit[:, 0]
        for t in range(1, t_max):
            new = lse(alpha[:, t - 1, :, None] + trans, 1) + emit[:, t]
            alpha[:, t] = np.where(real[:, t, None] > 0, new, alpha[:, t - 1])
        z = lse(alpha[:, -1], 1)
        for t in range(t_max - 2, -1, -1):
            new = lse(trans[None] + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(real[:, t + 1, None] > 0, new, 0)
        marginal = np.exp(alpha + beta - z[:, None, None]) * real[:, :, None]
        both = np.exp(alpha[:, :-1, :, None] + trans + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
        slope = {"steps": pairs - both.sum(axis=(0, 1)), "start": (onehot[:, 0] - marginal[:, 0]).sum(axis=0)}
        off = onehot - marginal
        for k, p in places.items():
            slope[k] = np.zeros((FEATURES + 1, N))
            for j in range(len(PARTS)):
                np.add.at(slope[k], p[:, :, j].ravel(), off.reshape(-1, N))
        for k, w in weights.items():
            g = slope[k] - decay * w
            m, v = moment[k]
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.999 * v + 0.001 * g * g
            w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    every = _features(np.arange(SHAPES))
    own, before, after = (np.vstack([weights[k][every].sum(axis=1), weights[k][FEATURES] * len(PARTS)]).astype(np.float32) for k in ("own", "before", "after"))
    return Crf(own, before, after, (weights["steps"] + _allowed()).astype(np.float32), (weights["start"] + _allowed()[0]).astype(np.float32))


@functools.cache
def default_model() -> Crf:
    return train(labelled_table())


def viterbi(w: Words, model: Crf) -> np.ndarray:
    """The best label of each word; sentences of the batch step by step, longest first."""
    n = len(w.shape)
    best = np.zeros(n, np.int64)
    if not n:
        return best
    first = np.flatnonzero(w.first_of_sentence)
    size = np.diff(np.append(first, n))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    running = np.searchsorted(-size, -np.arange(size[0]), "left")  # sentences longer than t
    gone = np.full(n + 2, SHAPES)
    gone[1:-1] = w.shape
    left = np.where(w.first_of_sentence, SHAPES, gone[:-2])
    right = np.append(np.where(w.first_of_sentence[1:], SHAPES, w.shape[1:]), SHAPES)
    back = np.zeros((n, N), np.uint8)
    score = None
    final = np.zeros((len(first), N), np.float32)
    for t in range(int(size[0])):
        at = first[: running[t]] + t
        emit = model.own[w.shape[at]] + model.before[left[at]] + model.after[right[at]]
        if score is None:
            score = emit + model.start
        else:
            old = score[: len(at)]
            top = old[:, :1] + model.steps[0]
            came = np.zeros(top.shape, np.uint8)
            for j in range(1, N):
                other = old[:, j : j + 1] + model.steps[j]
                better = other > top
                came[better] = j
                np.maximum(top, other, out=top)
            back[at] = came
            score = top + emit
        done = running[t + 1] if t + 1 < len(running) else 0
        final[done : len(at)] = score[done:]
    label = final.argmax(axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        live = slice(0, running[t])
        at = first[live] + t
        best[at] = label[live]
        if t:
            label[live] = back[at, label[live]]
    return best


_TRIM = re.compile(r"[A-Za-z0-9+(\[].*[A-Za-z0-9)\]]", re.S)
_WRITTEN_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[(\[](?:at|AT)[)\]]) ?[A-Za-z0-9-]+(?: ?(?:\.|[(\[](?:dot|DOT)[)\]]) ?[A-Za-z0-9-]+)+")
_PHONE_LIKE = re.compile(r"[+(]?[0-9][ ().0-9/-]*[0-9]")


def _valid(kind: str, text: str) -> tuple[int, int] | None:
    """Where in a decoded span the kind's own condition holds."""
    if kind == "email":
        m = _WRITTEN_EMAIL.search(text)
    elif kind == "ip":
        m = _IP.search(text)
        m = m if m and _octets(m.group()) else None
    elif kind == "card":
        m = re.search(r"[0-9][0-9 .\-]*[0-9]", text)
        m = m if m and _is_card(m.group()) else None
    else:
        m = _PHONE_LIKE.search(text)
        m = m if m and 9 <= len(digits_of(m.group())) <= 15 else None
    return m.span() if m else None


def crf_spans(texts: list[str], model: Crf) -> list[list[tuple[str, int, int]]]:
    """Spans that the CRF finds in each text and that meet their kind's condition."""
    w = words_of(texts)
    label = viterbi(w, model)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    offset = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    named = np.flatnonzero(label)
    k = 0
    while k < len(named):
        i = j = int(named[k])
        kind = LABELS[label[i]][2:]
        k += 1
        while k < len(named) and named[k] == j + 1 and LABELS[label[named[k]]] == f"I-{kind}":
            j = int(named[k])
            k += 1
        doc = int(np.searchsorted(offset, w.begin[i], "right")) - 1
        a, b = int(w.begin[i] - offset[doc]), int(w.end[j] - offset[doc])
        good = _valid(kind, texts[doc][a:b])
        if good:
            out[doc].append((kind, a + good[0], a + good[1]))
    return out


def find(texts: list[str | None], model: Crf) -> list[tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]]:
    """For each text its base spans by kind, and all spans (base, then CRF spans that touch no other span) in order."""
    given = [t or "" for t in texts]
    out = []
    for text, added in zip(given, crf_spans(given, model)):
        base = base_spans(text)
        spans = [(k, a, b) for k in KINDS for a, b in base[k]]
        for kind, a, b in added:
            if all(b <= x or y <= a for _, x, y in spans):
                spans.append((kind, a, b))
        out.append((base, sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))))
    return out


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and base_sha256 (of kind:start:end in order) are of the exact patterns; spans lists those and the CRF's.
    Offsets are code points, ends exclusive. A null text is read as empty: counts 0, spans ''. Repeated rows get equal
    results; texts of any length are used whole; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or default_model())

    def run(ids: list, texts: list):
        out: list[list] = [ids, [], [], [], [], [], [], []]
        for base, spans in find(texts, sent.value):
            for column, kind in zip(out[1:5], KINDS):
                column.append(len(base[kind]))
            fixed = _written([(k, a, b) for k in KINDS for a, b in base[k]])
            out[5].append(hashlib.sha256(fixed.encode()).hexdigest())
            out[6].append(_written(spans))
            out[7].append(len(spans) - sum(map(len, base.values())))
        yield out

    ddl = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return map_columns(docs.select("doc_id", "text"), run, ddl, by=1)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span (the longest first where they overlap) replaced by its kind in brackets."""
    taken: list[tuple[str, int, int]] = []
    for s in sorted(spans, key=lambda s: (s[1] - s[2], s[1])):
        if all(s[2] <= x or y <= s[1] for _, x, y in taken):
            taken.append(s)
    for kind, a, b in sorted(taken, key=lambda s: -s[1]):
        text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
    return text


def mask_personal_data(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """docs, all columns, with personal data in text masked; n_chars follows where there is such a column. Null stays null.

    Empty texts stay empty, very long ones are masked whole, repeated rows and null ids stay as many as they are; other
    columns, whatever their names, stay as they are, and an empty table empty.
    """
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast(model or default_model())
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new: list = []
            for cut in steps([len(t or "") for t in texts]):
                new += [t and masked(t, spans) for t, (_, spans) in zip(texts[cut], find(texts[cut], sent.value))]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if size is not None:
                old = columns[size].to_pylist()
                columns[size] = pa.array([o if a == b else len(b) for o, a, b in zip(old, texts, new)], batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, StructType(docs.schema.fields))
