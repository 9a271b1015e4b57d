"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes.

The field is trained on a small labelled table that `labelled` makes, and decoded by Viterbi in
numpy batches. Its spans are added where they meet no span of a pattern.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from symgrid.llm.common import quoted, tidied

KINDS = ("email", "ip", "card", "phone")
LABELS = ("o", *KINDS, "secret")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9][0-9.]*")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            floor = found.end()
        at = text.find("@", found.end() if found else at + 1)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for run in DOTTED.finditer(text):
        if run.group().count(".") >= 3:
            for m in IP.finditer(text, run.start(), run.end()):
                if all(len(p) < 4 and int(p) <= 255 or int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split(".")):
                    yield m.span()


def luhn(digits: str) -> bool:
    own = [int(d) for d in reversed(digits)]
    return (sum(own[::2]) + sum(sum(divmod(2 * d, 10)) for d in own[1::2])) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                yield m.span()


PATTERNS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return [(kind, s, e) for kind, find in PATTERNS.items() for s, e in find(text)]


# Word shapes.

EDGE = ".,;:!?\"'()[]{}<>"
HINTS = frozenset("password passwd pwd secret token key api_key apikey".split())
RUN = re.compile(r"A+|a+|9+|(.)\1*", re.S)
#: Longer unbroken words are cut after these marks, so that each part has a shape of its own.
LONG, PART = 64, re.compile(r'[^=&",:;]*[=&",:;]+|[^=&",:;]+')
#: Words decoded together, at most (one line's words at least); shapes kept; words remembered.
CELLS, MOST_SHAPES, MEMO = 400_000, 100_000, 300_000


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges)


def _class(c: str) -> str:
    return "9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c


def shape(word: str) -> tuple:
    """What the field sees of a word: a small number of different values in any corpus."""
    if word.isalpha():
        low = word.lower()
        return ("word", "A" if word.isupper() else "a" if word.islower() else "Aa", low if low in HINTS else "")
    core = word.strip(EDGE)
    if core.isalpha():
        low = core.lower()
        return ("word", "A" if core.isupper() else "a", low if low in HINTS else "", word[0] if word[0] in "([" else "", "." if word[-1] in ".,;:!?" else word[-1] if word[-1] in ")]" else "")
    text = "".join(map(_class, word))
    runs = [m.group() for m in RUN.finditer(text)]
    digits = text.count("9")
    outline = "".join(r[0] + (str(_bucket(len(r), (1, 2, 3, 4, 5, 8, 11, 16, 20))) if r[0] == "9" else "") for r in runs) if len(runs) <= 12 else "many"
    swaps = sum(a in "Aa9" and b in "Aa9" and (a == "9") != (b == "9") for a, b in zip(text, text[1:], strict=False))
    name = re.split(r"[=:]", core, maxsplit=1)[0].lower()
    flags = tuple(c for c in "@=:/+(-_\"" if c in word) + (("[at]",) if re.search(r"[\[(]at[\])]", word) else ())
    if not digits and not set(flags) & {"@", "=", "[at]"}:
        return ("mixed", _bucket(len(runs), (2, 3, 5)))
    return ("code", outline if swaps < 3 else "", digits and _bucket(digits, (1, 2, 3, 4, 5, 7, 8, 10, 12, 13, 16, 20)), _bucket(swaps, (1, 2, 3, 5, 7)), _bucket(len(core), (2, 4, 8, 12, 16, 20, 32)), flags, word.count("."), name if name in HINTS else "", bool(re.fullmatch(r"[0-9a-f]+", core)), bool(re.fullmatch(r"[0-9A-Z]+", core)), word[-1] in ".,;:!?")


def features(s: tuple) -> list[str]:
    return [f"{s[0]}{i}={v!r}" for i, v in enumerate(s)] + [repr(s[:3])]


# The labelled table.

SYLLABLES = "an be co de el fi go hu in jo ka le mi no or pa qu re st ti un ve wi xa yo za thing ment tion".split()


def labelled(rows: int = 1_500, seed: int = 1) -> list[tuple[list[str], list[int]]]:
    """Invented sentences: their words, and each word's index in LABELS."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    pick = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))

    def word() -> str:
        w = r.choice(tuple(sorted(HINTS))) if r.random() < 0.01 else "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))
        w = r.choices([w, w.capitalize(), w.upper(), w + "-" + r.choice(SYLLABLES), w + "'s"], [70, 14, 10, 3, 3])[0]
        if r.random() < 0.08:
            w += r.choice("#$%&*|<>!-_~") * r.randint(1, 3)
        return r.choice(["", "", "", "", "", "", "", "", "(", '"']) + w + r.choices(["", ",", ".", "!!", ":", "?", ")", '"', "/" + r.choice(SYLLABLES)], [60, 9, 9, 4, 2, 2, 2, 2, 2])[0]

    def number() -> str:
        n = r.choice([digits(1), digits(2), digits(3), str(r.randint(1900, 2030)), f"{digits(1)}.{digits(2)}", f"{digits(2)},{digits(3)}", f"{r.randint(0, 23)}:{digits(2)}", f"{digits(2)}/{digits(2)}/{r.randint(1950, 2030)}", f"{r.randint(1950, 2030)}-{digits(2)}-{digits(2)}", f"{digits(2)}%", f"${digits(3)}", f"#{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(2)}", f"{r.choice(SYLLABLES).upper()}{digits(3)}", f"{digits(2)}{r.choice(SYLLABLES)}", f"{digits(1)}.", f"{digits(1)}.{digits(1)}.", digits(5), digits(6), digits(8), f"{digits(3)}-{digits(1)}-{digits(2)}", f"x={digits(2)}", f"{r.choice(SYLLABLES)}={r.choice(SYLLABLES)}", f"http://{r.choice(SYLLABLES)}.com/{r.choice(SYLLABLES)}"])
        return n + r.choice(["", "", "", ",", "."])

    def entity() -> tuple[str, list[str]]:
        a, b = "".join(r.choices(SYLLABLES, k=2)), "".join(r.choices(SYLLABLES, k=2))
        end = r.choice(["com", "org", "net", "de", "example.com"])
        alnum = "abcdefghijklmnopqrstuvwxyz0123456789"
        made = [
            ("email", [f"{a}.{digits(2)}@{b}{digits(1)}.{end}"]), ("email", [f"{a}@{b}.{end}"]), ("email", [a, "(at)", f"{b}.{end}"]), ("email", [f"{a}[at]{b}.{end}"]), ("email", [f"{a}.{b}(at){b}.{end}"]),
            ("ip", [".".join(str(r.randint(0, 255)) for _ in range(4))]), ("ip", ["[" + ".".join(str(r.randint(1, 255)) for _ in range(4)) + "]"]),
            ("card", [digits(16)]), ("card", [digits(4) for _ in range(4)]), ("card", ["-".join(digits(4) for _ in range(4))]),
            ("phone", [f"+{digits(1)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"]), ("phone", [f"({digits(3)})", f"{digits(3)}-{digits(4)}"]), ("phone", [f"{digits(3)}-{digits(3)}-{digits(4)}"]), ("phone", [f"+{digits(2)}", digits(3), digits(7)]), ("phone", [f"0{digits(3)}", digits(7)]),
            ("secret", ["AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)]), ("secret", [f"{r.choice(['password', 'secret', 'token', 'api_key', 'passwd'])}={pick('0123456789abcdef', r.randint(12, 24))}"]), ("secret", [r.choice(["api_key", "token", "secret"]), "=", '"' + pick("0123456789abcdef", 32) + '"']), ("secret", ["ghp_" + pick(alnum, 36)]), ("secret", ['"' + pick("0123456789abcdef", 32) + '"']),
        ]
        return r.choice(made)

    out = []
    for _ in range(rows):
        words, marks = [], []
        for _ in range(r.randint(4, 18)):
            kind = r.choices(["word", "number", "entity"], [80, 14, 6])[0]
            if kind == "entity":
                label, parts = entity()
                if r.random() < 0.3:
                    parts = [*parts[:-1], parts[-1] + r.choice(".,;")]
                words += parts
                marks += [LABELS.index(label)] * len(parts)
            else:
                words.append(word() if kind == "word" else number())
                marks.append(0)
        out.append((words, marks))
    return out


class Field:
    """Weights of the field, as one emission table for a word's own shape, its left and right."""

    def __init__(self, rows: list[tuple[list[str], list[int]]], rounds: int = 120, rate: float = 0.1, decay: float = 2e-3):
        y = len(LABELS)
        self.shapes: dict[tuple, int] = {}
        self.names: dict[str, int] = {}
        coded = [([self.shapes.setdefault(shape(w), len(self.shapes)) for w in words], marks) for words, marks in rows]
        for s in self.shapes:
            for f in features(s):
                self.names.setdefault(f, len(self.names))
        phi = self._phi(list(self.shapes))
        n, length = len(coded), max(len(w) for w, _ in coded)
        ids, gold = np.full((n, length), -1), np.zeros((n, length), int)
        for i, (w, m) in enumerate(coded):
            ids[i, : len(w)], gold[i, : len(m)] = w, m
        live = ids >= 0
        # Rows of phi for no word: all zero.
        phi0 = np.vstack([phi, np.zeros(phi.shape[1])])
        shift = [ids, np.hstack([np.full((n, 1), -1), ids[:, :-1]]), np.hstack([ids[:, 1:], np.full((n, 1), -1)])]
        self.weights = [np.zeros((phi.shape[1], y)) for _ in range(3)] + [np.zeros((y, y))]
        first, second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        eye = np.eye(y)
        for t in range(1, rounds + 1):
            tables = [phi0 @ w for w in self.weights[:3]]
            emit = sum(tab[s] for tab, s in zip(tables, shift, strict=True))
            mid, trans = self._marginals(emit, live, self.weights[3])
            delta = (mid - eye[gold]) * live[:, :, None]
            grads = []
            for s in shift:
                per = np.zeros((len(phi0), y))
                np.add.at(per, s.ravel(), delta.reshape(-1, y))
                grads.append(phi0.T @ per)
            both = live[:, 1:]
            seen = np.zeros((y, y))
            np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
            grads.append(trans - seen)
            for k, g in enumerate(grads):
                g = g / n + decay * self.weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.weights[k] -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        self.trans = self.weights[3]
        self.forget()

    def forget(self) -> None:
        """Starts the table of shapes anew; numbers given before are void."""
        self.shapes = {}
        self.tables = [np.zeros((1_024, len(LABELS))) for _ in range(3)]

    def _phi(self, shapes: list[tuple]) -> np.ndarray:
        out = np.zeros((len(shapes), len(self.names)))
        for i, s in enumerate(shapes):
            for f in features(s):
                if f in self.names:
                    out[i, self.names[f]] = 1
        return out

    @staticmethod
    def _marginals(emit: np.ndarray, live: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, length, y = emit.shape
        lse = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        alpha[:, 0] = emit[:, 0]
        for t in range(1, length):
            step = emit[:, t] + lse(alpha[:, t - 1][:, :, None] + trans, 1)
            alpha[:, t] = np.where(live[:, t][:, None], step, alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            step = lse(trans[None] + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(live[:, t + 1][:, None], step, 0)
        z = lse(alpha[:, -1], 1)
        mid = np.exp(alpha + beta - z[:, None, None])
        pair = alpha[:, :-1, :, None] + trans + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
        return mid, (np.exp(np.minimum(pair, 0)) * live[:, 1:, None, None]).sum(axis=(0, 1))

    def number(self, word: str) -> int:
        """The number of the word's shape; its emission rows are filled on first sight."""
        s = shape(word)
        at = self.shapes.get(s)
        if at is None:
            at = self.shapes[s] = len(self.shapes)
            if at == len(self.tables[0]):
                self.tables = [np.vstack([tab, np.zeros_like(tab)]) for tab in self.tables]
            row = self._phi([s])[0]
            for tab, w in zip(self.tables, self.weights[:3], strict=True):
                tab[at] = row @ w
        return at

    def margins(self) -> tuple[list[np.ndarray], float]:
        """By shape, the least lead of "o" over another label from a word itself, its left and its
        right neighbour; and the lead at which no run of other labels can win by its transitions."""
        n = len(self.shapes)
        lead = [(tab[:n, :1] - tab[:n, 1:]).min(axis=1) for tab in self.tables]
        t = self.trans - self.trans[0, 0]
        return lead, max(0.0, t[0, 1:].max()) + max(0.0, t[1:, 0].max()) + max(0.0, t[1:, 1:].max())

    def decode(self, rows: list[list[int]]) -> list[np.ndarray]:
        """Viterbi labels of sequences of shape numbers. Sequences of like length are decoded together,
        some CELLS numbers at once, so one long sequence does not widen the others' arrays."""
        order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
        out: list = [None] * len(rows)
        while order:
            many = max(1, CELLS // max(1, len(rows[order[0]])))
            for i, marks in zip(order[:many], self._together([rows[i] for i in order[:many]]), strict=True):
                out[i] = marks
            order = order[many:]
        return out

    def _together(self, rows: list[list[int]]) -> list[np.ndarray]:
        order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
        lengths = np.array([len(rows[i]) for i in order])
        n, top, y = len(rows), int(lengths[0]) if rows else 0, len(LABELS)
        ids = np.full((n, top + 2), -1)
        for k, i in enumerate(order):
            ids[k, 1 : 1 + len(rows[i])] = rows[i]
        # The last row stands for no word.
        tables = [np.vstack([tab[: len(self.shapes)], np.zeros(y)]) for tab in self.tables]
        back = np.zeros((top, n, y), np.int8)
        score = np.zeros((n, y))
        for t in range(top):
            live = int((lengths > t).sum())
            emit = tables[0][ids[:live, t + 1]] + tables[1][ids[:live, t]] + tables[2][ids[:live, t + 2]]
            if t:
                step = score[:live, :, None] + self.trans
                back[t, :live] = step.argmax(axis=1)
                emit = emit + step.max(axis=1)
            score[:live] = emit
        out: list = [None] * n
        state = score.argmax(axis=1)
        marks = np.zeros((n, top), np.int8)
        for t in range(top - 1, -1, -1):
            live = int((lengths > t).sum())
            marks[:live, t] = state[:live]
            state[:live] = back[t, np.arange(live), state[:live]]
        for k, i in enumerate(order):
            out[i] = marks[k, : lengths[k]]
        return out


@cache
def field() -> Field:
    return Field(labelled())


class Numbers(dict):
    """Word to shape number; long words are not remembered."""

    def __init__(self, own: Field):
        self.own = own

    def __missing__(self, word: str) -> int:
        found = self.own.number(word)
        if len(word) <= LONG:
            if len(self) > MEMO:
                self.clear()
            self[word] = found
        return found

    def trim(self) -> None:
        """Forgets shapes when there are too many; to be called where no numbers are held."""
        if len(self.own.shapes) > MOST_SHAPES:
            self.own.forget()
            self.clear()


def suspect(rows: list[np.ndarray], own: Field) -> list[bool]:
    """Which of the sequences may hold a label other than "o"; False is certain."""
    if not rows:
        return []
    (mid, left, right), least = own.margins()
    ids = np.concatenate(rows)
    lead = mid[ids]
    lead[1:] += np.minimum(left, 0)[ids[:-1]]
    lead[:-1] += np.minimum(right, 0)[ids[1:]]
    starts = np.cumsum([0] + [len(r) for r in rows[:-1]])
    return (np.minimum.reduceat(lead, starts) <= least).tolist()


SPACED = re.compile(r"\S+")


def words_of(text: str) -> list[str]:
    """The words of a text, long ones cut into their parts."""
    found = text.split()
    if found and max(map(len, found)) > LONG:
        found = [p for w in found for p in (PART.findall(w) if len(w) > LONG else (w,))]
    return found


def places_of(line: str) -> list[tuple[int, int]]:
    """Where words_of a line are."""
    out = []
    for m in SPACED.finditer(line):
        s, e = m.span()
        out += [(s, e)] if e - s <= LONG else [p.span() for p in PART.finditer(line, s, e)]
    return out


def added_spans(texts: list[str], own: Field, numbers: Numbers) -> list[list[tuple[str, int, int]]]:
    """The field's spans per text. Texts and lines in which "o" leads everywhere by more than any
    transition can give are not decoded; their labels are known."""
    found: list[list] = [[] for _ in texts]
    queue: list[tuple[int, int, str, np.ndarray]] = []
    code = lambda part: np.fromiter(map(numbers.__getitem__, part), np.int32)

    def flush() -> None:
        for (i, offset, line, _), marks in zip(queue, own.decode([q[3] for q in queue]), strict=True):
            if not marks.any():
                continue
            places = places_of(line)
            at = 0
            while at < len(marks):
                end = at + 1
                while end < len(marks) and marks[end] == marks[at]:
                    end += 1
                if marks[at]:
                    s, e = places[at][0], places[end - 1][1]
                    while s < e and line[s] in EDGE and line[s] not in "(":
                        s += 1
                    while e > s and line[e - 1] in EDGE and line[e - 1] not in ")":
                        e -= 1
                    if s < e:
                        found[i].append((LABELS[marks[at]], offset + s, offset + e))
                at = end
        queue.clear()

    def lines(i: int) -> None:
        offset, parts = 0, []
        for line in texts[i].split("\n"):
            words = words_of(line)
            if words:
                parts.append((i, offset, line, code(words)))
            offset += len(line) + 1
        queue.extend(part for part, bad in zip(parts, suspect([p[3] for p in parts], own), strict=True) if bad)

    batch: list[tuple[int, np.ndarray]] = []
    held = 0
    for i, text in enumerate(texts):
        words = words_of(text)
        if words:
            batch.append((i, code(words)))
            held += len(words)
        if held > 100_000 or i == len(texts) - 1:
            for (k, _), bad in zip(batch, suspect([b[1] for b in batch], own), strict=True):
                if bad:
                    lines(k)
            flush()
            batch, held = [], 0
            numbers.trim()
    return found


def all_spans(texts: list[str], own: Field, numbers: Numbers) -> Iterator[tuple[list, list]]:
    """For each text its base spans, and all spans by kind and start."""
    rank = {kind: i for i, kind in enumerate(LABELS[1:])}
    for text, extra in zip(texts, added_spans(texts, own, numbers), strict=True):
        base = base_spans(text)
        more = [x for x in extra if all(x[2] <= s or e <= x[1] for _, s, e in base)]
        yield base, sorted(base + more, key=lambda x: (rank[x[0]], x[1])) if more else base


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: key, n_email, n_ip, n_card, n_phone (of the patterns), base_sha256 (of
    the patterns' spans), spans (all of them, kind:start:end in code points, end exclusive).

    Null texts count as empty and have no spans; very long texts are read whole, in time and memory
    linear in their own length; of an unbroken word of more than LONG characters each part has a shape
    of its own; repeated rows get equal results, whatever their neighbours; an empty table gives an
    empty result; other columns are ignored.
    """

    shared = df.sparkSession.sparkContext.broadcast(field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        numbers = Numbers(own)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts, digests, spans = [], [], []
            for base, every in all_spans(texts, own, numbers):
                counts.append([sum(k == kind for k, _, _ in base) for kind in KINDS])
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(every))
            numbers_ = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(numbers_[:, i]) for i in range(4)), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["key", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(quoted(key).alias("key"), quoted(text).alias("text")).mapInArrow(tidied(run), f"key {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    return out.withColumnRenamed("key", key)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with every span of its text replaced by the kind in square brackets; of spans that meet, the
    first, and from one place the longest. Null stays null, a text without spans stays as it is, and
    equal texts give equal texts; an empty table stays empty."""
    at = df.columns.index(text)

    shared = df.sparkSession.sparkContext.broadcast(field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        numbers = Numbers(own)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            out = []
            for t, (_, every) in zip(texts, all_spans([t or "" for t in texts], own, numbers), strict=True):
                parts, end = [], 0
                for kind, s, e in sorted(every, key=lambda x: (x[1], -x[2])):
                    if s >= end:
                        parts += [t[end:s], f"[{kind}]"]
                    end = max(end, e)
                out.append("".join([*parts, t[end:]]) if parts else t)
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(tidied(run), df.schema)
