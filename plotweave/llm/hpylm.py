"""Language-model scoring with a hierarchical Pitman-Yor process.

The context of a token is the word before it in its text, or the start. Each context has a
restaurant of words; all of them share one parent, the restaurant of words without context, and
that one's parent is uniform over the known words and one more that stands for any unknown word.
The end of a text is a word too. Contexts, like words, grow with the corpus.

Seating is sampled by Gibbs sweeps: the customers of a dish get up and sit down again one after
another (for large counts in blocks of equal chances), given everybody else; tables of the
context restaurants are the customers of their parent. A token's probability is the average of
its predictive probabilities over SAMPLES seatings.

Counts cover all training documents. A scan task cuts its documents into shards; a shard keeps
its tokens as indices into its own list of words. Its (word, context) pairs go to buckets of a
word hash, where counts are added up and words are seated; pairs of frequent words, whose list is
short by definition, are dealt by both hashes. Buckets tell one another the tables of contexts,
and each shard gets what its words and pairs ask for and scores its documents. No table of all
words exists in one place.

A sweep seats all buckets at the same time, each given the seats of all others after the sweep
before. Between two sweeps the buckets' tables of each context meet at the context's home and
their sum goes back to those that asked; totals of the parent, and customers and tables of the
frequent words, are sums that all buckets are told. So the probabilities of all words after any
context add up to one. Contexts are told apart by 32 bits of hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.bytekit import CHUNK_BYTES, LOWER, NOT_SPACE, RollingHash, chunks, dropped, hash_bytes, tokens, utf8, written
from plotweave.llm.quality import remainder

SHARD_BYTES = 8 << 20
BUCKET_BYTES, LEAST_BUCKETS = 8 << 20, 64
#: Words with this share of all tokens are dealt by both hashes; there are 1 / FREQUENT of them at most.
FREQUENT = 1 / 1000
#: Discount and strength of the context restaurants and of their parent.
D2, S2, D1, S1 = 0.75, 2.0, 0.75, 1.0
BURN_IN, SAMPLES, SEED = 4, 2, 5
END = hash_bytes([b" "])[0]  # no word has a space
#: The context of a text's first token, as 32 bits.
START = np.uint32(hash_bytes([b"  "])[0] >> np.uint64(32))


def seated(count: np.ndarray, rest: np.ndarray, parent: np.ndarray, d: float, s: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its customers sit down again.

    rest: tables of other dishes in its restaurant; parent: the dish's probability there. The
    first 16 customers come one by one, later ones in blocks of a quarter of those seated.
    """
    tables = np.minimum(count, 1).astype(np.int64)
    k = 1
    live = np.flatnonzero(count > 1)
    while len(live):
        block = np.minimum(max(1, k // 4) if k >= 16 else 1, count[live] - k)
        t = tables[live]
        new = (s + d * (rest[live] + t)) * parent[live]
        old = np.maximum(k + (block - 1) / 2 - d * t, 1e-9)
        tables[live] = t + rng.binomial(block, new / (new + old))
        k += max(1, k // 4) if k >= 16 else 1
        live = live[count[live] > k]
    return tables


def in_bucket(value: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket of 64-bit hashes, or of the upper 32 bits of some: ranges of hashes in order."""
    high = value.astype(np.uint64) if value.dtype == np.uint32 else value >> np.uint64(32)
    return ((high >> np.uint64(8)) * np.uint64(n_buckets) >> np.uint64(24)).astype(np.int64)


_ZSTD = pa.Codec("zstd", 3)
#: Words of a shard that have a code of one byte; code 0 means a rarer one, listed apart.
_COMMON = 255


def squeezed(x: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(x).tobytes()
    return np.int64(len(raw)).tobytes() + _ZSTD.compress(raw, asbytes=True)


def unsqueezed(blob, kind) -> np.ndarray:
    size = int(np.frombuffer(blob, np.int64, 1)[0])
    return np.frombuffer(_ZSTD.decompress(memoryview(blob)[8:], size), kind) if size else np.zeros(0, kind)


def coded(index: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A sequence of indices below n as its most common ones, a byte for each element, and the three bytes of rare ones by place."""
    common = np.argsort(-np.bincount(index, minlength=n), kind="stable")[:_COMMON]
    code = np.zeros(n, np.uint8)
    code[common] = np.arange(1, len(common) + 1)
    codes = code[index]
    rare = index[codes == 0].astype(np.uint32)
    return common.astype(np.int32), codes, rare.view(np.uint8).reshape(-1, 4).T.copy()


def decoded(common: np.ndarray, codes: np.ndarray, rare: np.ndarray) -> np.ndarray:
    out = np.concatenate([[0], common]).astype(np.int64)[codes]
    out[codes == 0] = np.ascontiguousarray(rare.reshape(4, -1).T).view(np.uint32).ravel() if len(rare) else 0
    return out


_SHARD = "shard bigint, ids binary, n_tokens binary, common binary, codes binary, rare binary, words binary, n bigint, top array<struct<word:bigint,n:bigint>>"
_TOP = pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())]))


def _shards(share: float):
    """Rows of a shard: ids and flags, tokens of each text, their word indices, word hashes in order, training tokens, and its frequent words."""

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        held: list = []
        size = 0

        def flush():
            ids = pa.Table.from_batches([pa.record_batch([a, h], ["doc_id", "held_out"]) for a, h, *_ in held]).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ids.schema) as out:
                out.write_table(ids)
            n_tokens, value = (np.concatenate([x[k] for x in held]) for k in (2, 3))
            words, index = np.unique(value, return_inverse=True)
            train = np.repeat(~ids["held_out"].to_numpy(), n_tokens)
            counts = np.bincount(index, train, len(words)).astype(np.int64)
            often = np.flatnonzero(counts > share / 2 * train.sum())
            top = [{"word": int(w), "n": int(n)} for w, n in zip(words[often].view(np.int64), counts[often], strict=True)]
            blobs = [sink.getvalue().to_pybytes(), *map(squeezed, (n_tokens.astype(np.int32), *coded(index, len(words)), words))]
            return pa.record_batch([pa.array([part << 32 | made]), *(pa.array([b], pa.binary()) for b in blobs), pa.array([int(train.sum())]), pa.array([top], _TOP)], ["shard", "ids", "n_tokens", "common", "codes", "rare", "words", "n", "top"])

        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets, CHUNK_BYTES):
                low = LOWER[data[offsets[i] : offsets[j]]]
                at = offsets[i : j + 1] - offsets[i]
                start, end, upto = tokens(low, at, NOT_SPACE)
                n = np.diff(upto) + 1  # each text's words, then an end
                take = np.full(int(n.sum()), len(start), np.int64)
                word = np.ones(len(take), bool)
                word[np.cumsum(n) - 1] = False
                take[word] = np.arange(len(start))
                value = np.append(RollingHash(low)(start, end), END)[take]
                held.append((batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), n, value))
                size += int(at[-1])
                if size >= SHARD_BYTES:
                    yield flush()
                    held, size, made = [], 0, made + 1
        if held:
            yield flush()

    return run


def _column(batch, row: int, name: str, kind) -> np.ndarray:
    return unsqueezed(batch.column(batch.schema.get_field_index(name))[row].as_buffer(), kind)


def _ids(batch, row: int) -> pa.Table:
    return pa.ipc.open_stream(batch.column(batch.schema.get_field_index("ids"))[row].as_buffer()).read_all()


def _pairs(batch, row: int, n_words: int):
    """Tokens of each text, word of each token, distinct pairs (word * (n_words + 1) + context) and which one each token is; context n_words is the start."""
    n = _column(batch, row, "n_tokens", np.int32).astype(np.int64)
    index = decoded(*(_column(batch, row, c, k) for c, k in (("common", np.int32), ("codes", np.uint8), ("rare", np.uint8))))
    before = np.concatenate([[n_words], index[:-1]])
    before[np.cumsum(n)[:-1]] = n_words
    pairs, at = np.unique(index * (n_words + 1) + before, return_inverse=True)
    return n, index, pairs, at


def _dealt(words: np.ndarray, pairs: np.ndarray, frequent: np.ndarray, n_buckets: int):
    """Of a shard's pairs: words up to each bucket, context hashes, bucket, whether the word is frequent, and the order by bucket."""
    word, context = pairs // (len(words) + 1), pairs % (len(words) + 1)
    home = in_bucket(words, n_buckets)
    hashed = np.append((words >> np.uint64(32)).astype(np.uint32), START)[context]
    often = np.isin(words, frequent)[word]
    bucket = np.where(often, in_bucket(hashed ^ (words[word] >> np.uint64(32)).astype(np.uint32), n_buckets), home[word])
    order = np.lexsort((often, bucket))  # stable: pairs stay in the order of words
    return np.searchsorted(home, np.arange(n_buckets + 1)), word, hashed, bucket, often, order


_ASKED = "bucket int, shard bigint, words binary, n_pairs binary, contexts binary, counts binary, often binary, often_contexts binary, often_counts binary"


def _by_bucket(n_buckets: int, frequent: np.ndarray):
    """What a shard asks a bucket: its words there with their contexts, and pairs of frequent words (by their place in the list)."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                words = _column(batch, row, "words", np.uint64)
                n, _, pairs, at = _pairs(batch, row, len(words))
                train = np.repeat(~_ids(batch, row)["held_out"].to_numpy(), n)
                counts = np.bincount(at, train, len(pairs)).astype(np.int32)
                upto, word, hashed, bucket, often, order = _dealt(words, pairs, frequent, n_buckets)
                plain = order[~often[order]]
                rest = order[often[order]]
                cut, cut_rest = (np.searchsorted(bucket[x], np.arange(n_buckets + 1)) for x in (plain, rest))
                listed = np.searchsorted(frequent, words[word[rest]]).astype(np.uint16)
                each = np.bincount(word[plain], minlength=len(words)).astype(np.uint32)
                full = np.flatnonzero((upto[1:] > upto[:-1]) | (cut[1:] > cut[:-1]) | (cut_rest[1:] > cut_rest[:-1]))
                columns = [(words, upto), (each, upto), (hashed[plain], cut), (counts[plain], cut), (listed, cut_rest), (hashed[rest], cut_rest), (counts[rest], cut_rest)]
                blobs = [pa.array([squeezed(x[c[b] : c[b + 1]]) for b in full], pa.binary()) for x, c in columns]
                yield pa.record_batch([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), batch.column(0)[row].as_py(), np.int64)), *blobs], [f.split(" ")[0] for f in _ASKED.split(", ")])

    return run


#: Rows of a bucket: answers about a shard's pairs; words, counts, customers and tables of the parent and what shards ask (home);
#: tables of contexts, for the context's home; totals; its words and pairs; which of them a shard has; its seats; all tables of its contexts.
_PAIRS, _HOME, _TABLES, _SUMS, _SEATS, _LINKS, _OWN, _MET = range(8)
_TOLD = "kind int, bucket int, shard bigint, a binary, b binary, c binary, d binary, sums array<double>"


def planes(x: np.ndarray) -> np.ndarray:
    """32-bit numbers by the place of their bytes."""
    return np.ascontiguousarray(x, np.uint32).view(np.uint8).reshape(-1, 4).T.copy()


def unplanes(blob) -> np.ndarray:
    return np.ascontiguousarray(unsqueezed(blob, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of neighbours, modulo 2^32."""
    return planes(np.diff(x.astype(np.uint32), prepend=np.uint32(0)))


def unsteps(blob) -> np.ndarray:
    return np.cumsum(unplanes(blob), dtype=np.uint32)


def _told(rows: list[tuple]) -> pa.Table:
    """rows: kind, bucket, shard, up to four arrays, sums."""
    column = lambda k: pa.array([squeezed(r[3][k]) if len(r[3]) > k else b"" for r in rows], pa.binary())
    return pa.table({"kind": pa.array([r[0] for r in rows], pa.int32()), "bucket": pa.array([int(r[1]) for r in rows], pa.int32()), "shard": pa.array([r[2] for r in rows], pa.int64()), "a": column(0), "b": column(1), "c": column(2), "d": column(3), "sums": pa.array([list(r[4]) for r in rows], pa.list_(pa.float64()))})


def _cuts(value: np.ndarray, n_buckets: int):
    """Buckets of sorted hashes and their ranges."""
    cut = np.searchsorted(in_bucket(value, n_buckets), np.arange(n_buckets + 1))
    return [(b, slice(cut[b], cut[b + 1])) for b in np.flatnonzero(cut[1:] > cut[:-1])]


@dataclass
class Totals:
    """What all buckets are told after a sweep: known words, tables of all contexts, tables of the parent, and of each frequent word its tokens, customers and tables."""

    types: int
    customers: int
    tables: int
    total: np.ndarray
    c1: np.ndarray
    t1: np.ndarray

    def uniform(self) -> float:
        return 1.0 / (self.types + 1)


def totals(sums: np.ndarray, before: Totals | None, sweep: int) -> Totals:
    """From the buckets' sums, and the totals they seated with: frequent words (1 / FREQUENT at most) are seated in the parent here."""
    c1, total = (x.astype(np.int64) for x in np.split(sums[3:], 2))
    if before is None:
        t1 = np.minimum(c1, 1)
    else:
        t1 = seated(c1, before.tables - before.t1, np.full(len(c1), before.uniform()), D1, S1, np.random.default_rng((SEED, sweep)))
    return Totals(int(sums[0]) + int((total > 0).sum()), int(sums[1] + c1.sum()), int(sums[2] + t1.sum()), total, c1, t1)


class Bucket:
    """Words, pairs (word, context) in order with their counts, and contexts of a bucket."""

    def __init__(self, words: np.ndarray, word: np.ndarray, c2: np.ndarray, contexts: np.ndarray, context: np.ndarray, frequent: np.ndarray):
        self.words, self.word, self.c2, self.contexts, self.context = words, word, c2, contexts, context
        self.often = np.searchsorted(words, frequent)  # every bucket lists all frequent words
        self.plain = np.ones(len(words), bool)
        self.plain[self.often] = False
        self.total = np.bincount(word, c2, len(words)).astype(np.int64)

    @classmethod
    def read(cls, table: pa.Table, frequent: np.ndarray) -> Bucket:
        row = int(np.flatnonzero(table["kind"].to_numpy() == _SEATS)[0])
        blob = lambda name: table[name][row].as_buffer()
        words, numbers = unsqueezed(blob("a"), np.uint64), unplanes(blob("b")).astype(np.int64)
        word = np.repeat(np.arange(len(words)), numbers[: len(words)])
        return cls(words, word, numbers[len(words) :], unsteps(blob("c")), unplanes(blob("d")).astype(np.int64), frequent)

    def row(self, own: int) -> tuple:
        each = np.bincount(self.word, minlength=len(self.words))
        return (_SEATS, own, -1, (self.words, planes(np.concatenate([each, self.c2])), steps(self.contexts), planes(self.context)), ())

    def customers(self, t2: np.ndarray) -> np.ndarray:
        """Of each word in the parent; of frequent ones, those of this bucket."""
        return np.bincount(self.word, t2, len(self.words)).astype(np.int64)

    def tables(self, t2: np.ndarray) -> np.ndarray:
        """Of each context, those of this bucket."""
        return np.bincount(self.context, t2, len(self.contexts)).astype(np.int64)

    def swept(self, t2: np.ndarray, t1: np.ndarray, met: np.ndarray, told: Totals, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Tables of pairs, and of plain words in the parent, after all get up and sit down again; met: all tables of each context."""
        c1, t1 = self.customers(t2), t1.copy()
        c1[self.often], t1[self.often] = told.c1, told.t1
        uniform = np.full(len(self.words), told.uniform())
        parent = (np.maximum(c1 - D1 * t1, 0) + (S1 + D1 * told.tables) * uniform) / (S1 + told.customers)
        t2 = seated(self.c2, met[self.context] - t2, parent[self.word], D2, S2, rng)
        return t2, seated(self.customers(t2) * self.plain, told.tables - t1, uniform, D1, S1, rng)

    def posts(self, own: int, n_buckets: int, t2: list[np.ndarray], t1: list[np.ndarray]) -> list[tuple]:
        """Seats for the next sweep (the last ones first, then those of samples), tables for the contexts' homes, and sums of the last ones."""
        c1, here = self.customers(t2[0]), self.tables(t2[0])
        sums = [(self.total[self.plain] > 0).sum(), c1[self.plain].sum(), t1[0].sum(), *c1[self.often], *self.total[self.often]]
        rows: list[tuple] = [(_OWN, own, -1, (planes(np.concatenate(t2)), planes(np.concatenate(t1))), [float(x) for x in sums])]
        return rows + [(_TABLES, b, own, (steps(self.contexts[some]), planes(here[some])), ()) for b, some in _cuts(self.contexts, n_buckets)]


def _seats(table: pa.Table, bucket: Bucket) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of a bucket's row: tables of pairs and of plain words, the last ones first."""
    row = int(np.flatnonzero(table["kind"].to_numpy() == _OWN)[0])
    t2, t1 = (unplanes(table[name][row].as_buffer()).astype(np.int64).reshape(-1, n) if n else [np.zeros(0, np.int64)] * SAMPLES for name, n in (("a", len(bucket.c2)), ("b", len(bucket.words))))
    return list(t2), list(t1)


def _gather(n_buckets: int, frequent: np.ndarray):
    """A bucket's words and pairs, which of them each shard has, and the first seats: one table for each dish."""

    def run(table: pa.Table) -> pa.Table:
        own = table["bucket"][0].as_py()
        parts = {c: [unsqueezed(x, kind) for x in table[c].to_pylist()] for c, kind in (("words", np.uint64), ("n_pairs", np.uint32), ("contexts", np.uint32), ("counts", np.int32), ("often", np.uint16), ("often_contexts", np.uint32), ("often_counts", np.int32))}
        n_words = np.array([len(x) for x in parts["words"]], np.int64)
        n_plain, n_often = (np.array([len(x) for x in parts[c]], np.int64) for c in ("contexts", "often"))
        value, per_word, often = (np.concatenate(parts[c]) for c in ("words", "n_pairs", "often"))
        words, index = np.unique(np.concatenate([value, frequent]), return_inverse=True)
        index, of_frequent = index[: len(value)], index[len(value) :]
        context = np.concatenate([*parts["contexts"], *parts["often_contexts"]])
        count = np.concatenate([*parts["counts"], *parts["often_counts"]])
        word = np.concatenate([np.repeat(index, per_word), of_frequent[often]])
        pairs, at = np.unique(word << 32 | context.astype(np.int64), return_inverse=True)
        c2 = np.bincount(at, count, len(pairs)).astype(np.int64)
        contexts, context = np.unique((pairs & 0xFFFFFFFF).astype(np.uint32), return_inverse=True)
        bucket = Bucket(words, pairs >> 32, c2, contexts, context, frequent)
        of_word, of_plain, of_often = np.cumsum(n_words) - n_words, np.cumsum(n_plain) - n_plain, np.cumsum(n_often) - n_often + n_plain.sum()
        rows = [bucket.row(own)]
        for k, shard in enumerate(table["shard"].to_pylist()):
            mine = np.concatenate([at[of_plain[k] : of_plain[k] + n_plain[k]], at[of_often[k] : of_often[k] + n_often[k]]])
            rows.append((_LINKS, own, shard, (steps(mine), planes(index[of_word[k] : of_word[k] + n_words[k]])), ()))
        t2 = np.minimum(c2, 1)
        return _told(rows + bucket.posts(own, n_buckets, [t2], [np.minimum(bucket.customers(t2), 1) * bucket.plain]))

    return run


def _exchange(table: pa.Table) -> pa.Table:
    """At a home, each context's tables in all buckets are added up and told to those that have it; a bucket's own seats stay as they are."""
    kind, home = table["kind"].to_numpy(), table["bucket"][0].as_py()
    asked = np.flatnonzero(kind == _TABLES)
    out = [table.filter(pa.array(kind == _OWN))]
    if len(asked):
        contexts, here = ([read(table[c][int(k)].as_buffer()) for k in asked] for c, read in (("a", unsteps), ("b", unplanes)))
        every, at = np.unique(np.concatenate(contexts), return_inverse=True)
        met = np.bincount(at, np.concatenate(here), len(every)).astype(np.uint32)[at]
        upto = np.cumsum([0, *map(len, contexts)])
        senders = table["shard"].to_pylist()
        out.append(_told([(_MET, senders[int(k)], home, (planes(met[upto[i] : upto[i + 1]]),), ()) for i, k in enumerate(asked)]).cast(table.schema))
    return pa.concat_tables(out)


def _seat_words(n_buckets: int, frequent: np.ndarray, sweep: int, told: Totals):
    """One sweep of a bucket, given all tables of its contexts and the totals after the sweep before."""

    def run(static: pa.Table, inbox: pa.Table) -> pa.Table:
        own = static["bucket"][0].as_py()
        bucket = Bucket.read(static, frequent)
        t2, t1 = _seats(inbox, bucket)
        replies = np.flatnonzero(inbox["kind"].to_numpy() == _MET)
        replies = replies[np.argsort(inbox["shard"].to_numpy()[replies])]  # homes are ranges of contexts
        met = np.concatenate([np.zeros(0, np.uint32), *(unplanes(inbox["a"][int(k)].as_buffer()) for k in replies)]).astype(np.int64)
        last2, last1 = bucket.swept(t2[0], t1[0], met, told, np.random.default_rng((SEED, own, sweep)))
        samples = sweep - BURN_IN if sweep > BURN_IN else 0  # of those before
        return _told(bucket.posts(own, n_buckets, [last2, *t2[:samples]], [last1, *t1[:samples]]))

    return run


def _answer(n_buckets: int, frequent: np.ndarray, told: list[Totals]):
    """What a bucket tells shards and homes after the last sweep; told: the totals of the samples, the last one first."""

    def run(gathered: pa.Table, inbox: pa.Table) -> pa.Table:
        own = gathered["bucket"][0].as_py()
        bucket = Bucket.read(gathered, frequent)
        t2, t1 = _seats(inbox, bucket)
        known = np.array([bucket.total, *map(bucket.customers, t2), *t1])
        home = in_bucket(frequent, n_buckets) == own
        known[:, bucket.often] = np.array([told[0].total, *(x.c1 for x in told), *(x.t1 for x in told)]) * home
        met = [bucket.tables(x).astype(np.int64) for x in t2]
        rows: list[tuple] = [(_HOME, own, -1, (bucket.words, known.ravel()), ())]
        columns = np.array([bucket.c2, *t2])
        for k in np.flatnonzero(gathered["kind"].to_numpy() == _LINKS):
            shard = gathered["shard"][int(k)].as_py()
            rows.append((_PAIRS, own, shard, (columns[:, unsteps(gathered["a"][int(k)].as_buffer())].ravel(),), ()))
            rows.append((_HOME, own, shard, (unplanes(gathered["b"][int(k)].as_buffer()),), ()))
        for b, some in _cuts(bucket.contexts, n_buckets):
            rows.append((_TABLES, b, -1, (bucket.contexts[some], np.concatenate([x[some] for x in met])), ()))
        return _told(rows)

    return run


def _meet(n_buckets: int):
    """At its home, a word's tables as a context are added up."""

    def run(table: pa.Table) -> pa.Table:
        own = table["bucket"][0].as_py()
        kind, shard = table["kind"].to_numpy(), table["shard"].to_numpy()
        a, b = table["a"], table["b"]
        arrays = lambda which, x, t: [unsqueezed(x[int(k)].as_buffer(), t) for k in np.flatnonzero(which)]
        listed = (kind == _HOME) & (shard < 0)
        words = np.concatenate([np.zeros(0, np.uint64), *arrays(listed, a, np.uint64)])
        known = np.concatenate([np.zeros((1 + 2 * SAMPLES, 0), np.int64), *(x.reshape(1 + 2 * SAMPLES, -1) for x in arrays(listed, b, np.int64))], axis=1)
        mine = in_bucket(words, n_buckets) == own
        total = known[0]
        # Contexts: the words' upper 32 bits, and the start. Tables and customers of words with equal bits are one restaurant's.
        high = (words >> np.uint64(32)).astype(np.uint32)
        asked, context = np.unique(high, return_inverse=True)
        guests = np.bincount(context, total * mine, len(asked)).astype(np.int64)
        met = np.zeros((SAMPLES, len(asked)), np.int64)
        start = np.zeros(SAMPLES)
        for more, x in zip(arrays(kind == _TABLES, a, np.uint32), arrays(kind == _TABLES, b, np.int64), strict=True):
            x = x.reshape(SAMPLES, -1)
            start += x[:, more == START].sum(1)
            at = np.searchsorted(asked, more)
            there = (at < len(asked)) & (asked[np.minimum(at, max(0, len(asked) - 1))] == more) if len(asked) else np.zeros(len(more), bool)
            met[:, at[there]] += x[:, there]
        columns = np.concatenate([[total, guests[context]], known[1:], met[:, context]]) if len(words) else np.zeros((2 + 3 * SAMPLES, 0), np.int64)
        rows: list[tuple] = []
        for k in np.flatnonzero((kind == _HOME) & (shard >= 0)):
            rows.append((_HOME, own, int(shard[k]), (columns[:, unsqueezed(a[int(k)].as_buffer(), np.uint32)],), ()))
        ends = total[mine & (words == END)].sum()
        rows.append((_SUMS, own, -1, (), [total[mine].sum(), ends, *start]))
        return _told(rows)

    return run


def _score(all_tokens: int, all_types: int, ends: int, start: np.ndarray, c1: np.ndarray, t1: np.ndarray, n_buckets: int, frequent: np.ndarray, by_token: bool):
    def run(shards: pa.Table, answers: pa.Table) -> pa.Table:
        kind, bucket = answers["kind"].to_numpy(), answers["bucket"].to_numpy()
        got = {}
        for which in (_PAIRS, _HOME):
            rows = np.flatnonzero(kind == which)
            got[which] = [unsqueezed(answers["a"][int(k)].as_buffer(), np.int64) for k in rows[np.argsort(bucket[rows], kind="stable")]]
        out = []
        for batch in shards.to_batches():
            for row in range(batch.num_rows):
                words = _column(batch, row, "words", np.uint64)
                n, index, pairs, at = _pairs(batch, row, len(words))
                told = np.concatenate([x.reshape(2 + 3 * SAMPLES, -1) for x in got[_HOME]], axis=1)
                count, guests, rest = told[0], np.append(told[1], ends), told[2:].reshape(3, SAMPLES, -1)
                _, word, _, _, _, order = _dealt(words, pairs, frequent, n_buckets)
                seats = np.empty((1 + SAMPLES, len(pairs)), np.int64)
                seats[:, order] = np.concatenate([x.reshape(1 + SAMPLES, -1) for x in got[_PAIRS]], axis=1)
                context = pairs % (len(words) + 1)
                likely = np.zeros(len(pairs))
                for s in range(SAMPLES):
                    parent = (np.maximum(rest[0][s] - D1 * rest[1][s], 0) + (S1 + D1 * t1[s]) / (all_types + 1)) / (S1 + c1[s])
                    met = np.append(rest[2][s], start[s])[context]
                    likely += (np.maximum(seats[0] - D2 * seats[1 + s], 0) + (S2 + D2 * met) * parent[word]) / (S2 + guests[context]) / SAMPLES
                model = np.log10(likely)
                base = np.log10((count + 0.1) / (all_tokens + 0.1 * (all_types + 1)))
                doc = np.repeat(np.arange(len(n)), n)
                ids = _ids(batch, row)
                out.append(
                    pa.table(
                        {
                            "doc_id": ids["doc_id"],
                            "held_out": ids["held_out"],
                            "n_tokens": n,
                            "n_known": np.bincount(doc, (count > 0)[index], len(n)).astype(np.int64),
                            "train_tokens": np.full(len(n), all_tokens, np.int64),
                            "base_score": np.bincount(doc, base[index], len(n)),
                            "score": np.bincount(doc, model[at], len(n)),
                            **({"token_scores": pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)])), pa.array(model[at])).cast(pa.list_(pa.float64()))} if by_token else {}),
                        }
                    )
                )
        return pa.concat_tables(out)

    return run


def _sums(table: DataFrame, n: int) -> np.ndarray:
    """The buckets' sums, added up place by place."""
    found = table.select(F.posexplode("sums").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(n)
    for r in found:
        out[r["k"]] = r["x"]
    return out


def scored(docs: DataFrame, held_out: Column | None = None, by_token: bool = False, share: float = FREQUENT, least_buckets: int = LEAST_BUCKETS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of each row; by_token: also token_scores.

    Null and empty texts are one end token. Learns from the rows that are not held out (by
    default, the contract's); equal rows count as often as they occur. With nothing to learn
    from, every token has probability 1. Other columns are ignored.
    """
    flag = F.coalesce(remainder(10) == 0 if held_out is None else held_out, F.lit(False))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", flag.alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(least_buckets, -(-int(size) // BUCKET_BYTES))
    shards = written(rows.mapInArrow(_shards(share), _SHARD), "shards")
    n = shards.agg(F.sum("n")).first()[0] or 0
    top = shards.select(F.explode("top").alias("t")).groupBy("t.word").agg(F.sum("t.n").alias("n")).where(F.col("n") >= F.lit(share * n))
    frequent = np.sort(np.array([r["word"] for r in top.collect()], np.int64).view(np.uint64))  # 1 / FREQUENT words at most
    asked = shards.drop("n", "top").mapInArrow(_by_bucket(n_buckets, frequent), _ASKED)
    gathered = written(asked.groupBy("bucket").applyInArrow(_gather(n_buckets, frequent), _TOLD), "buckets")
    static = gathered.where(f"kind = {_SEATS}").groupBy("bucket")
    seats, told = gathered, [totals(_sums(gathered, 3 + 2 * len(frequent)), None, 0)]
    for sweep in range(BURN_IN + SAMPLES):
        inbox = seats.where(f"kind IN ({_OWN}, {_TABLES})").groupBy("bucket").applyInArrow(_exchange, _TOLD)
        after = written(static.cogroup(inbox.groupBy("bucket")).applyInArrow(_seat_words(n_buckets, frequent, sweep, told[0]), _TOLD), "seats")
        if sweep:
            dropped(seats)
        seats = after
        told.insert(0, totals(_sums(seats, 3 + 2 * len(frequent)), told[0], sweep))
    told = told[:SAMPLES]
    every = gathered.where(f"kind IN ({_SEATS}, {_LINKS})").groupBy("bucket").cogroup(seats.where(f"kind = {_OWN}").groupBy("bucket"))
    answered = written(every.applyInArrow(_answer(n_buckets, frequent, told), _TOLD), "answers")
    dropped(gathered, seats)
    met = written(answered.where(f"kind <> {_PAIRS}").groupBy("bucket").applyInArrow(_meet(n_buckets), _TOLD), "words")
    sums = _sums(met, 2 + SAMPLES)
    run = _score(int(sums[0]), told[0].types, int(sums[1]), sums[2:], np.array([x.customers for x in told]), np.array([x.tables for x in told]), n_buckets, frequent, by_token)
    answers = answered.where(f"kind = {_PAIRS}").unionByName(met.where(f"kind = {_HOME}")).select("shard", "kind", "bucket", "a")
    out = shards.drop("n", "top").groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double" + ", token_scores array<double>" * by_token)
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
