"""Language-model scores by a Katz back-off bigram model with Good-Turing discounts.

Counts. All words and all their bigrams are counted over all training texts. The FREQUENT most
frequent words have 16-bit numbers, and their weights are broadcast, which only makes them cheap; the
other words, called rare, are known by 64-bit hashes and weighed where their bigrams meet. A caller may
leave out bigrams seen fewer than `least` times (Katz, 1987, does so with those seen once) and bigrams
beyond the `vocabulary` most frequent words.

Bigrams within the `core` most frequent words (and a text's start and end), a fixed table, are
broadcast, which again is a matter of cost only.

Layout. Texts are read in blocks. A block keeps, per bigram, the list of its texts that hold it, and
sends each bigram once, with its uses in training, to a bucket by hash: one row of packed bytes per
block and bucket. So a bigram that every text holds costs a bucket one entry per block. A bigram of two
frequent words goes by both, one of a rare context by the context, any other by its rare word; so a
bucket has all uses of its rare words and all that follows them. A bucket adds up its bigrams over all
blocks and answers each block in the order in which the block asked. Scores are sums over a text's
tokens, and a token backs off from its bigram to its word: log P(w|v) if (v, w) was seen, else
log a(v) + log P(w). So a text's score is the sum of log a(v) + log P(w) over its tokens, plus a
difference for those tokens whose bigram was seen. For rare contexts a(v) needs the counts of the rare
words that follow; these come by a join of words to buckets.

A block numbers its texts in an order by hash, not in that of arrival, so a task that is run again after
a lost executor sends the same rows. There are as many packed rows as blocks times buckets: the
parameters block_tokens and bucket_bytes should grow with the executors' memory.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgrid.llm.common import durable, quoted
from symgrid.llm.simhash import LOWER

START, END = 65_534, 65_535
#: Words with broadcast weights; words that have bigrams (None: all).
FREQUENT, VOCABULARY, CORE = 65_534, None, 1_024
RARE, WIDE = np.uint64(1 << 63), np.uint64(1 << 16)
#: Tokens of a block; bytes of text per bucket; words remembered by a task.
BLOCK_TOKENS, BUCKET_BYTES, MEMO = 1_500_000, 16 << 20, 250_000
#: Counts up to this one are discounted.
K = 5


def split(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()


class Coded(dict):
    """Word to its id if it is frequent, or to its hash with the top bit set."""

    def __init__(self, known: dict[int, int]):
        self.known = known

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            # The frequent words stay; they come again.
            often = [(w, i) for w, i in self.items() if i < (1 << 63)]
            self.clear()
            self.update(often)
        h = xxhash.xxh64_intdigest(word) | (1 << 63)
        found = self[word] = self.known.get(h, h)
        return found

    def text(self, text: bytes | None) -> np.ndarray:
        words = split(text)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def identity(key: int | None, text: bytes | None) -> tuple[int, int]:
    """A row's 128-bit name in two signed halves, equal for equal rows only."""
    h = xxhash.xxh3_128_intdigest(struct.pack("<q?", key or 0, key is None) + (text or b""))
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def pack(*arrays: np.ndarray) -> bytes:
    """Integers of any size, compressed; ascending arrays cost the least."""
    parts = [struct.pack("<I", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a, np.uint64)
        width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        parts += [struct.pack("<QB", len(a), width), a.view(np.uint8).reshape(len(a), 8)[:, :width].T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = struct.unpack_from("<I", raw)[0], 4, []
    for _ in range(n):
        size, width = struct.unpack_from("<QB", raw, at)
        at += 9
        wide = np.zeros((size, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8, width * size, at).reshape(width, size).T
        out.append(wide.reshape(-1).view(np.uint64))
        at += width * size
    return out


def deltas(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=np.uint64(0))


def starts(*columns: np.ndarray) -> np.ndarray:
    """Whether each row of sorted columns differs from the one before it."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def word_counts(texts: DataFrame) -> DataFrame:
    """texts: column text (binary). Columns h, n: hash and count of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded, held, size = Coded({}), [], 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(coded.text(text))
                size += len(held[-1])
                if size > 2 * BLOCK_TOKENS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def core_pairs(texts: list[np.ndarray], core: int) -> tuple[np.ndarray, np.ndarray]:
    """The core's bigrams in these texts: their places in its flat table, and their texts' numbers."""
    size = np.array([len(t) for t in texts])
    last = np.cumsum(size + 2) - 1
    flat = np.empty(int(size.sum()) + 2 * len(texts), np.uint64)
    inner = np.ones(len(flat), bool)
    inner[last] = inner[last - size - 1] = False
    flat[inner] = np.concatenate(texts)
    flat[last - size - 1], flat[last] = core, core + 1
    fit = (flat < core) | ~inner
    both = np.flatnonzero(fit[:-1] & fit[1:])
    both = both[flat[both] != core + 1]
    place = flat[both].astype(np.int64) * (core + 2) + flat[both + 1].astype(np.int64)
    return place, np.searchsorted(last, both)


def spread(docs: DataFrame, known, buckets: int, core: int, whole: bool, block_tokens: int) -> DataFrame:
    """docs: key, text, train, in a defined order. Rows block, bucket, data, without the core's bigrams:
    two parts of a key (the first ascending) and its uses in training. The parts are both frequent words
    and 0; or a rare context and its successor; or a rare word and its frequent context plus WIDE. If
    not `whole`, rare words have no bigrams, and every successor of one is written 0. A row with bucket
    -1 holds the names of the block's texts (two halves), the bucket of each key in order of keys, the
    texts per key, and for each of these the text's number in the block and the uses; one with bucket
    -2 places in the core's table and their uses in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = Coded(known.value)
        task = TaskContext.get().partitionId()
        tokens: list[np.ndarray] = []
        names: list[tuple[int, int]] = []
        trains: list[bool] = []
        size, number = 0, 0

        def out() -> pa.RecordBatch:
            lengths = np.array([len(t) for t in tokens])
            flat = np.concatenate(tokens)
            edge = np.cumsum(lengths) - lengths
            # Contexts and successors with a start before and an end after every text.
            ctx = np.empty(len(flat) + len(tokens), np.uint64)
            nxt = np.empty(len(flat) + len(tokens), np.uint64)
            doc = np.repeat(np.arange(len(tokens), dtype=np.uint64), lengths + 1)
            learnt = np.array(trains)
            first = edge + np.arange(len(tokens))
            inner = np.ones(len(ctx), bool)
            inner[first] = False
            ctx[first], ctx[inner] = START, flat
            inner[:] = True
            inner[first + lengths] = False
            nxt[first + lengths], nxt[inner] = END, flat
            fit = ((ctx < core) | (ctx == START)) & ((nxt < core) | (nxt == END))
            mine = fit & np.repeat(learnt, lengths + 1)
            v, w = np.minimum(ctx[mine], core).astype(np.int64), np.minimum(nxt[mine], core + 1).astype(np.int64)
            table = np.bincount(v * (core + 2) + w, minlength=(core + 2) ** 2)
            used = np.flatnonzero(table)
            both = (ctx < RARE) & (nxt < RARE) & ~fit
            after = ctx >= RARE
            before = (nxt >= RARE) & ~after if whole else np.zeros(len(ctx), bool)
            keys = np.concatenate([(ctx[both] << np.uint64(16)) | nxt[both], ctx[after], nxt[before]])
            others = np.concatenate([np.zeros(int(both.sum()), np.uint64), nxt[after] if whole else np.zeros(int(after.sum()), np.uint64), ctx[before] + WIDE])
            docs_ = np.concatenate([doc[both], doc[after], doc[before]])
            order = np.lexsort((others, keys))
            keys, others, docs_ = keys[order], others[order], docs_[order]
            start = np.flatnonzero(starts(keys, others, docs_))
            uses = np.diff(np.append(start, len(keys)))
            keys, others, docs_ = keys[start], others[start], docs_[start]
            own = np.flatnonzero(starts(keys, others))
            many = np.diff(np.append(own, len(keys)))
            n = np.add.reduceat(uses * learnt[docs_.astype(np.int64)], own) if len(own) else own
            keys, others = keys[own], others[own]
            place = bucket_of(keys, buckets)
            halves = np.array(names, np.int64).view(np.uint64).reshape(-1, 2)
            rows = [(-1, pack(halves[:, 0], halves[:, 1], place, many, docs_, uses)), (-2, pack(deltas(used.astype(np.uint64)), table[used]))]
            order = np.argsort(place.astype(np.uint16) if buckets <= 65_536 else place, kind="stable")
            keys, others, n, place = keys[order], others[order], n[order], place[order]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(place)]]) if len(place) else np.zeros(1, int)
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                rows.append((int(place[s]), pack(deltas(keys[s:e]), others[s:e], n[s:e])))
            block = (task << 24) + number
            return pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "bucket", "data"])

        for batch in batches:
            for key, text, train in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens.append(coded.text(text))
                names.append(identity(key, text))
                trains.append(bool(train))
                size += len(tokens[-1]) + 1
                if size > block_tokens:
                    yield out()
                    tokens, names, trains, size, number = [], [], [], 0, number + 1
        if tokens:
            yield out()

    return docs.mapInArrow(run, "block long, bucket int, data binary")


def counted(group: pa.Table, least: int, whole: bool) -> pa.Table:
    """Of one bucket's rows: for each block, in its order, a row of kind 0 with its bigrams of frequent
    words and their counts, and one of kind 3 with the places of its others in the bucket's table of
    them. A row of kind 1 holds the bucket's seen bigrams of frequent words and their counts, its
    numbers of bigrams with counts 1 to K + 1, and the frequent contexts of its rare words, the
    bigrams' counts, the words' counts; one of kind 4 the table of all its other bigrams (two parts of
    a key, count). What a block keeps stays as it is, as kinds 2 (lists) and 6 (the core's bigrams)."""
    bucket = group.column("bucket").to_pylist()
    blocks, datas = group.column("block").to_pylist(), group.column("data").to_pylist()
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
    if bucket[0] < 0:
        return pa.table([pa.array(blocks, pa.int64()), pa.array(bucket, pa.int32()), pa.array([2 if b == -1 else 6 for b in bucket], pa.int32()), pa.array(datas, pa.binary())], schema=schema)
    parts = []
    for data in datas:
        d, other, n = unpack(data)
        parts.append((np.cumsum(d, dtype=np.uint64), other, n))
    keys, others, uses = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((others, keys))
    new = starts(keys[order], others[order])
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    keys, others = keys[order][new], others[order][new]
    count = np.bincount(which, uses.astype(float), len(keys)).astype(np.int64)
    # Keys ascend, so that those of rare words are the last ones, here and in a block's row.
    n = int(np.searchsorted(keys, RARE))
    out = []
    at = 0
    for block, (own, _, _) in zip(blocks, parts, strict=True):
        w = which[at : at + len(own)]
        at += len(own)
        plain = w[: int(np.searchsorted(own, RARE))]
        out.append((block, 0, pack(deltas(keys[plain]), count[plain])))
        if len(plain) < len(w):
            out.append((block, 3, pack((w[len(plain) :] - n).astype(np.uint64))))
    tally = np.bincount(np.minimum(count if whole else count[:n], K + 2), minlength=K + 3)[1 : K + 2]
    seen = np.flatnonzero(count[:n] >= least)
    keys, others, count, plain = keys[n:], others[n:], count[n:], (keys[seen], count[seen])
    _, _, used = owners(keys, others, count)
    led = (others >= WIDE) & (others < RARE) & (count >= least)
    out.append((-1, 1, pack(deltas(plain[0]), plain[1], tally, others[led] - WIDE, count[led], used[led])))
    out.append((-1, 4, pack(deltas(keys), others, count)))
    return pa.table([pa.array([r[0] for r in out], pa.int64()), pa.array(bucket[:1] * len(out), pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], schema=schema)


def owners(keys: np.ndarray, others: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket's table: which rare word each row has, whether as context, and that word's count."""
    own = np.cumsum(starts(keys)) - 1
    context = (others < WIDE) | (others >= RARE)
    used = np.bincount(own, count * context, int(own[-1]) + 1 if len(own) else 0).astype(np.int64)
    return own, context, used[own]


def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, data of kind 4 rows. Columns deal, h: the rare words that follow a rare word in a bucket."""
    for batch in batches:
        for bucket, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            others = unpack(data)[1]
            h = np.unique(others[others >= RARE])
            for at in range(0, len(h), 100_000):
                part = h[at : at + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), bucket, np.int32)), pa.array(part)], ["deal", "h"])


def weighed(model: Model, rows: pa.Table, found: pa.Table, least: int, whole: bool) -> pa.Table:
    """rows: of kinds 3 and 4 of a bucket; found: counts n of words h. Rows of kind 5, by block: one
    more than the context's count (0 for a frequent context), and what the bigram adds to the score but
    for the words' own weights."""
    data = list(zip(rows.column("block").to_pylist(), rows.column("kind").to_pylist(), rows.column("data").to_pylist(), strict=True))
    d, others, count = unpack(next(x for _, kind, x in data if kind == 4))
    keys, count = np.cumsum(d, dtype=np.uint64), count.astype(np.int64)
    own, context, used = owners(keys, others, count)
    value = np.zeros(len(keys))
    if whole:
        h, n = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
        order = np.argsort(h)
        h, n = np.append(h[order], ~np.uint64(0)), np.append(n[order], 0)
        rare = others >= RARE
        known = np.where(context, 0, used)
        at = np.searchsorted(h, others[rare])
        known[rare] = np.where(h[at] == others[rare], n[at], 0)
        frequent = context & ~rare
        word = model.log_word(known)
        word[frequent] = model.word[others[frequent].astype(np.int64)]
        seen = count >= least
        mine = seen & context
        size = int(own[-1]) + 1 if len(own) else 0
        disc = model.discounted(count, model.pair_ratio)
        mass, lower = np.bincount(own, disc * mine, size)[own], np.bincount(own, 10**word * mine, size)[own]
        full = (mass > 0) & (mass >= used * (1 - 1e-9))
        back = np.log10((1 - mass / np.maximum(used + full, 1)) / np.maximum(1 - lower, 1e-12))
        value[mine] = np.log10(disc[mine] / (used + full)[mine]) - word[mine]
        value[context & ~seen] = back[context & ~seen]
        led = np.flatnonzero(seen & ~context)
        v = (others[led] - WIDE).astype(np.int64)
        value[led] = np.log10(disc[led] / (model.uses[v] + model.short[v])) - model.back[v] - word[led]
    led_by = np.where(context, used + 1, 0)
    out = []
    for block, kind, x in data:
        if kind == 3:
            w = unpack(x)[0].astype(np.int64)
            out.append((block, pack(led_by[w], value[w].view(np.uint64))))
    bucket = rows.column("bucket")[0].as_py()
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
    return pa.table([pa.array([r[0] for r in out], pa.int64()), pa.array([bucket] * len(out), pa.int32()), pa.array([5] * len(out), pa.int32()), pa.array([r[1] for r in out], pa.binary())], schema=schema)


def discounts(n: list[int], least: int = 1) -> np.ndarray:
    """Katz's discount ratio for counts 0 to K (0 for counts below `least`), from the numbers n[r - 1]
    of kinds seen r times; where Good-Turing gives no ratio between 0 and 1, an absolute discount."""
    out = np.zeros(K + 1)
    fixed = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    a = (K + 1) * n[K] / n[0] if n[0] else 1.0
    for r in range(least, K + 1):
        good = ((r + 1) * n[r] / (r * n[r - 1]) - a) / (1 - a) if n[r - 1] and a < 1 else -1.0
        out[r] = good if 0 < good < 1 else (r - fixed) / r
    return out


class Model:
    """Unigram and back-off weights of the frequent words, and the statistics for all other words."""

    def __init__(self, counts: np.ndarray, n_train: int, total: int, kinds: int, ones: list[int], rest: float):
        """counts: of the frequent words by id. total, kinds: all training tokens, distinct ones. ones:
        numbers of tokens seen 1 to K + 1 times. rest: sum of discounted counts of all tokens."""
        self.total, self.kinds = total, kinds
        self.ratio = discounts(ones)
        self.unknown = max(1 - rest / total, 1 / (total + 1)) if total else 1.0
        self.scale = (1 - self.unknown) * total / rest if rest else 1.0
        self.count = np.zeros(65_536, np.int64)
        self.count[: len(counts)] = counts
        self.count[END] = n_train
        self.uses = self.count.copy()
        self.uses[START], self.uses[END] = n_train, 0
        self.word = self.log_word(self.count)
        self.back = np.zeros(65_536)
        self.pair_ratio = np.zeros(K + 1)
        self.short = np.zeros(65_536, bool)

    def discounted(self, c: np.ndarray, ratio: np.ndarray) -> np.ndarray:
        return np.where(c > K, 1.0, ratio[np.minimum(c, K)]) * c

    def log_word(self, c: np.ndarray) -> np.ndarray:
        known = np.maximum(self.discounted(c, self.ratio) * self.scale / max(self.total, 1), 1e-300)
        return np.log10(np.where(c > 0, known, self.unknown))

    def log_base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1.0) / (self.total + self.kinds + 1.0))

    def masses(self, keys: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts of seen bigrams, their discounted counts, their back-off probabilities."""
        v, w = (keys >> np.uint64(16)).astype(np.int64), (keys & np.uint64(0xFFFF)).astype(np.int64)
        own, mass = np.unique(v, return_inverse=True)
        add = lambda x: np.bincount(mass, x, len(own)).astype(float)
        return own, add(self.discounted(c, self.pair_ratio)), add(10 ** self.word[w])

    def led(self, v: np.ndarray, c: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of frequent contexts before rare words, which are used `used` times."""
        own, mass = np.unique(v.astype(np.int64), return_inverse=True)
        return own, np.bincount(mass, self.discounted(c, self.pair_ratio), len(own)).astype(float), np.bincount(mass, 10 ** self.log_word(used), len(own)).astype(float)

    def close(self, v: np.ndarray, mass: np.ndarray, lower: np.ndarray) -> None:
        """Back-off weights that make every context's distribution sum to one. A context whose seen
        bigrams would take all of it counts one use more."""
        full = mass >= self.uses[v] * (1 - 1e-9)
        self.short[v[full]] = True
        left = 1 - mass / np.maximum(self.uses[v] + full, 1)
        self.back[v] = np.log10(left / np.maximum(1 - lower, 1e-12))

    def gain(self, keys: np.ndarray, c: np.ndarray) -> np.ndarray:
        """What a seen bigram adds to log a(v) + log P(w)."""
        v, w = (keys >> np.uint64(16)).astype(np.int64), (keys & np.uint64(0xFFFF)).astype(np.int64)
        p = self.discounted(c, self.pair_ratio) / (self.uses[v] + self.short[v])
        return np.log10(p) - self.back[v] - self.word[w]


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def scores(df: DataFrame, key: str = "doc_id", text: str = "text", test: Column | None = None, core: int = CORE, vocabulary: int | None = None, least: int = 1, block_tokens: int | None = None, bucket_bytes: int | None = None) -> DataFrame:
    """One row per row of df: key (cast to long), held_out, n_tokens, n_known, train_tokens, base_score, score.

    `test` marks the rows that are scored but not learnt from. All words have bigrams, and bigrams seen
    once count too, unless a caller asks for less: bigrams seen fewer than `least` times are left to the
    back-off weight, and with `vocabulary` (FREQUENT at most) only that many words, the most frequent,
    have bigrams. block_tokens and bucket_bytes set a task's memory. Tokens are the words, lower-cased A-Z,
    and one end. Null texts count as empty (their end is a token); repeated rows are learnt as often
    as they occur and get equal scores; without training rows every token is unknown; an empty table
    gives an empty result; other columns are ignored. Only the frequent words' counts, the core's
    bigrams ((core + 2)^2 at most), a row of statistics per count up to K + 1 and one weight per
    frequent word reach the driver.
    """
    vocabulary = VOCABULARY if vocabulary is None else vocabulary
    whole = vocabulary is None
    if not whole and vocabulary > FREQUENT:
        raise ValueError(f"a vocabulary is {FREQUENT} words at most, or None for all")
    spark = df.sparkSession
    test = held_out(quoted(key)) if test is None else test
    docs = df.select(quoted(key).cast("long").alias("key"), quoted(text).cast("binary").alias("text"), (~test).alias("train"))
    sizes = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if("train").alias("n")).first()
    n_train = sizes["n"] or 0
    buckets = max(96, -(-(sizes["bytes"] or 0) // (bucket_bytes or BUCKET_BYTES)))

    words = durable(word_counts(docs.filter("train").select("text")))
    few = F.when(F.col("n") <= K + 1, F.col("n")).otherwise(0)
    tally = {r["r"]: r for r in words.groupBy(few.alias("r")).agg(F.count("*").alias("kinds"), F.sum("n").alias("tokens")).collect()}
    total = sum(r["tokens"] for r in tally.values()) + n_train
    kinds = sum(r["kinds"] for r in tally.values()) + (n_train > 0)
    ones = [(tally[r]["kinds"] if r in tally else 0) + (n_train == r) for r in range(1, K + 2)]
    ratio = np.append(discounts(ones), [1.0])
    rest = sum((tally[r]["tokens"] if r in tally else 0) * (ratio[r] if 0 < r <= K else 1.0) for r in range(K + 2)) + n_train * (ratio[n_train] if n_train <= K else 1.0)
    top = words.orderBy(F.desc("n"), "h").limit(FREQUENT if whole else vocabulary).toArrow()
    hashes, counts = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    known = spark.sparkContext.broadcast(dict(zip(hashes.tolist(), range(len(hashes)), strict=True)))
    model = Model(counts, n_train, total, kinds, ones, rest)

    ordered = docs.sortWithinPartitions(F.xxhash64("key", "text"), "key")
    rows = spread(ordered, known, buckets, core, whole, block_tokens or BLOCK_TOKENS)
    # What a block keeps is dealt by block, its bigrams by bucket.
    dealt = rows.withColumn("deal", F.when(F.col("bucket") < 0, -1 - F.col("block")).otherwise(F.col("bucket").cast("long")))
    store = durable(dealt.groupBy("deal").applyInArrow(lambda group: counted(group, least, whole), "block long, bucket int, kind int, data binary"))

    def core_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((core + 2) ** 2, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                place, n = unpack(data)
                total[np.cumsum(place, dtype=np.uint64).astype(np.int64)] += n.astype(np.int64)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(total[place])], ["place", "n"])

    table = store.filter("kind = 6").select("data").mapInArrow(core_sums, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    place, core_n = table.column("place").to_numpy().astype(np.int64), table.column("n").to_numpy()
    real = np.concatenate([np.arange(core), [START, END]]).astype(np.uint64)
    core_keys = (real[place // (core + 2)] << np.uint64(16)) | real[place % (core + 2)]

    def pair_tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = np.array([unpack(d)[2] for d in batch.column(0).to_pylist()], np.int64).reshape(-1, K + 1).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(K + 1, dtype=np.int32)), pa.array(t)], ["r", "n"])

    seen = store.filter("kind = 1").select("data")
    pairs = {r["r"]: r["n"] for r in seen.mapInArrow(pair_tally, "r int, n long").groupBy("r").agg(F.sum("n").alias("n")).collect()}
    model.pair_ratio = discounts([pairs.get(r, 0) + int((core_n == r + 1).sum()) for r in range(K + 1)], least=least)
    first = spark.sparkContext.broadcast(model)

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                d, c, _, led, led_c, used = unpack(data)
                for v, mass, lower in (first.value.masses(np.cumsum(d, dtype=np.uint64), c.astype(np.int64)), first.value.led(led, led_c.astype(np.int64), used.astype(np.int64))):
                    yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)), pa.array(mass), pa.array(lower)], ["v", "mass", "lower"])

    sums = seen.mapInArrow(weights, "v int, mass double, lower double").groupBy("v").agg(F.sum("mass").alias("mass"), F.sum("lower").alias("lower")).toArrow()
    seen_core = core_n >= least
    parts = [[sums.column(i).to_numpy() for i in range(3)], model.masses(core_keys[seen_core], core_n[seen_core])]
    v, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    model.close(v.astype(np.int64), *(np.bincount(at, np.concatenate([p[i] for p in parts]), len(v)) for i in (1, 2)))
    model.core_gain = np.zeros((core + 2) ** 2)
    model.core_gain[place[seen_core]] = model.gain(core_keys[seen_core], core_n[seen_core])
    full = spark.sparkContext.broadcast(model)

    def own_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded, m = Coded(known.value), full.value
        base = m.log_base(m.count)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(keys), 1_000):
                part = [coded.text(t) for t in texts[at : at + 1_000]]
                n = len(part)
                doc = np.repeat(np.arange(n), [len(t) for t in part])
                flat = np.concatenate(part)
                doc, ids = doc[flat < RARE], flat[flat < RARE].astype(np.int64)
                place, at_doc = core_pairs(part, core)
                add = lambda x: np.bincount(doc, x, n).astype(float)  # noqa: B023, E731
                known_ = np.bincount(doc, minlength=n) + int(m.count[END] > 0)
                score = add(m.word[ids] + m.back[ids]) + m.word[END] + m.back[START] + np.bincount(at_doc, m.core_gain[place], n)
                names = [identity(k, t) for k, t in zip(keys[at : at + 1_000], texts[at : at + 1_000], strict=True)]
                cols = [*np.array(names, np.int64).T.copy(), np.array([len(t) + 1 for t in part], np.int64), known_.astype(np.int64), add(base[ids]) + base[END], score]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), batch.column(0).slice(at, n), batch.column(2).slice(at, n)], ["name", "half", "n_tokens", "n_known", "base", "score", "key", "train"])

    def other_part(group: pa.Table) -> pa.Table:
        m = full.value
        # By bucket; within one, bigrams of frequent words come first, as in the block's order.
        answers = sorted(zip(group.column("bucket").to_pylist(), group.column("kind").to_pylist(), group.column("data").to_pylist(), strict=True), key=lambda r: r[:2])
        high, low, place, many, doc, uses = unpack(answers[0][2])
        gained, based, met = [], [], []
        for _, kind, data in answers[1:]:
            a, b = unpack(data)
            if kind == 0:
                k, c = np.cumsum(a, dtype=np.uint64), b.astype(np.int64)
                gained.append(np.zeros(len(k)))
                gained[-1][c >= least] = m.gain(k[c >= least], c[c >= least])
                based.append(np.zeros(len(k)))
                met.append(np.zeros(len(k), bool))
            else:
                context, c = a > 0, np.maximum(a.astype(np.int64) - 1, 0)
                gained.append(context * m.log_word(c) + b.view(np.float64))
                based.append(context * m.log_base(c))
                met.append(context & (c > 0))
        n = len(high)
        at, wide, doc = np.argsort(place, kind="stable"), many.astype(np.int64), doc.astype(np.int64)

        def total(parts: list[np.ndarray]) -> np.ndarray:
            value = np.zeros(len(place))
            value[at] = np.concatenate(parts) if parts else value
            return np.bincount(doc, np.repeat(value, wide) * uses, n).astype(float)

        cols = [high.view(np.int64), low.view(np.int64), np.zeros(n, np.int64), total(met).astype(np.int64), total(based), total(gained)]
        return pa.table([*map(pa.array, cols), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())], names=["name", "half", "n_tokens", "n_known", "base", "score", "key", "train"])

    schema = "name long, half long, n_tokens long, n_known long, base double, score double, key long, train boolean"
    mine = docs.select("key", "text", "train").mapInArrow(own_part, schema)
    asked = store.filter("kind = 4").select("bucket", "data").mapInArrow(needed, "deal int, h long").join(words, "h")
    rest_ = store.filter("kind in (3, 4)").groupBy("bucket").cogroup(asked.groupBy("deal")).applyInArrow(lambda rows, found: weighed(full.value, rows, found, least, whole), "block long, bucket int, kind int, data binary")
    theirs = store.filter("kind in (0, 2)").unionByName(rest_).groupBy("block").applyInArrow(other_part, schema)
    # Equal rows have one name: their sums are taken together and shared out again.
    both = mine.unionByName(theirs).groupBy("name", "half").agg(
        *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")], F.max("key").alias("key"), F.max("train").alias("train"), F.count("train").alias("rows")
    )
    each = both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return each.select(F.col("key").alias(key), (~F.col("train")).alias("held_out"), *[F.expr(f"{c} div rows").alias(c) for c in ("n_tokens", "n_known")], F.lit(total).cast("long").alias("train_tokens"), (F.col("base") / F.col("rows")).alias("base_score"), (F.col("score") / F.col("rows")).alias("score"))
