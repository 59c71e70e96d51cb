"""Language-model scoring by prediction by partial matching, with a word baseline.

Model.  A trie of byte contexts of up to ``ORDER`` bytes (lower-cased text, an end symbol,
padding before the start), trained on all training documents.  Escapes are estimated by
method C (an escape counts as often as a context has seen distinct symbols); symbols
that a longer context has seen are excluded from the shorter ones.  In a trained trie the
symbols of a context are among those of its suffix, so what exclusion leaves of a suffix
depends on the longer context alone and is stored with it; scoring is then exact without
walking symbol lists.  Below order 0 all symbols that were never seen are equally likely.

Asking and answering.  Texts are cut into chunks of about ``CHUNK_BYTES``.  One pass over
them asks: each distinct word and n-gram of a chunk becomes a row, with its count in the chunk's
training documents.  The rows' sums are the model.  Tries are built and asked
within groups of n-grams that end in the same two context bytes, dealt to shards of about ``SHARD_NODES``.  A group of
more n-grams than that is split by its third context byte, and again by the fourth and the fifth; the counts of the orders
that it is split below, at most 256 a context, then go to the shards of its parts.
Orders 0 and 1, at most 65,536 n-grams, travel to all of them.  The answers (a word's count, an n-gram's
log probability) are joined to the chunks that asked; a chunk's answers and then its texts, which travel packed, reach
a task in order and in small batches, and are scored piece by piece.  No model is held whole anywhere: a task needs the memory of a chunk or a
group, the driver that of the two lowest orders, and a frequent n-gram makes one row for each
chunk that holds it.

Defined cases: null text is empty (the end token alone); a null id is the id '' when rows
are held out; repeated rows count and are scored each; without training rows every count is 0;
a text longer than a chunk is a chunk of its own; extra columns play no part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, cut, discard, release

ORDER = 5
SYMBOLS, END = 256, 0xFF  # 0xFF is in no UTF-8 text
#: Bytes of text, and distinct words and n-grams, that close a chunk.
CHUNK_BYTES, HOLD = 48 << 20, 4_000_000
#: N-grams of a group in which tries are built.
SHARD_NODES = 250_000
SLICE = 1 << 20
#: Rows that are handed to Spark at a time.
ROWS = 1 << 16
MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(ident: str, parts: int = 10) -> F.Column:
    return F.crc32(F.coalesce(F.col(ident).cast("string"), F.lit(""))) % parts == 0


# --- n-grams ---------------------------------------------------------------------------


def stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Padded symbols of all texts, and the place of each text's end symbol."""
    pad = bytes([END]) * ORDER
    symbols = np.frombuffer(pad + pad.join([*texts, b""]), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + ORDER)
    return symbols, ends


def grams(symbols: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Keys (context bytes, oldest first, then the symbol) of the places in a slice."""
    key = np.zeros(stop - start, np.uint64)
    for back in range(ORDER, -1, -1):
        key = (key << np.uint64(8)) | symbols[start - back : stop - back]
    return key


def places(symbols: np.ndarray, ends: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Which places of a slice are predicted: a text's bytes and its end symbol, not padding."""
    mask = symbols[start:stop] != END
    mask[ends[np.searchsorted(ends, start) : np.searchsorted(ends, stop)] - start] = True
    return mask


def ask(df: DataFrame, ident: str, text: str, parts: int, chunk_bytes: int, hold: int) -> DataFrame:
    """Documents with their chunk (``n`` null), and what each chunk asks for (``n``: times in its training documents).

    A row with neither word nor gram counts the training documents of a chunk.
    """
    bounded_batches(df.sparkSession)
    names, kinds = ["chunk", "docs", "word", "gram", "n"], [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def made(rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(rows, t) for c, t in zip(names, kinds)], names=names)

    def asked(chunk: int, words: dict, tally: Tally, docs: int) -> Iterator[pa.RecordBatch]:
        tally.settle()
        keys, counts = tally.keys, tally.counts
        same = lambda n: pa.array(np.full(n, chunk))
        yield made(1, chunk=same(1), n=pa.array([docs]))
        named = iter(words.items())
        while own := list(islice(named, ROWS)):
            yield made(len(own), chunk=same(len(own)), word=pa.array([w for w, _ in own], pa.binary()), n=pa.array([n for _, n in own], pa.int64()))
        for at in range(0, len(keys), ROWS):
            own = slice(at, at + ROWS)
            yield made(len(keys[own]), chunk=same(len(keys[own])), gram=pa.array(keys[own].astype(np.int64)), n=pa.array(counts[own]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size, docs, words, tally = None, 0, 0, Counter(), Tally()
        for batch in batches:
            for rows in pieces(batch, min(chunk_bytes, 4 * SLICE)):
                texts, out = [(t or b"").lower() for t in rows.column(3).to_pylist()], rows.column(2).to_pylist()
                more_size = sum(map(len, texts))
                if size and size + more_size > chunk_bytes or len(words) + len(tally.keys) > hold:
                    yield from asked(chunk, words, tally, docs)
                    chunk, size, docs, words, tally = chunk + 1, 0, 0, Counter(), Tally()
                chunk, size = rows.column(0)[0].as_py() << 32 if chunk is None else chunk, size + more_size
                yield made(1, chunk=pa.array([chunk]), docs=pa.array([packed(rows.column(1), rows.column(2), pa.array(texts, pa.binary()))], pa.binary()))
                for held in (False, True):
                    part = [t for t, o in zip(texts, out) if o == held]
                    for t in part:
                        words.update(dict.fromkeys(t.split(), 0) if held else t.split())
                    docs += 0 if held else len(part)
                    symbols, ends = stream(part)
                    for at in range(ORDER, len(symbols), 4 * SLICE):
                        stop = min(at + 4 * SLICE, len(symbols))
                        more, n = np.unique(grams(symbols, at, stop)[places(symbols, ends, at, stop)], return_counts=True)
                        tally.take(more, n * (not held))
        if chunk is not None:
            yield from asked(chunk, words, tally, docs)
        del words, tally
        release(None)

    # few large chunks ask less often for the same; the table that is written from this keeps the chunks as they are numbered
    size = df.agg(F.sum(F.length(as_bytes(text)))).first()[0] or 0
    source = df.select(F.col(ident).alias("ident"), held_out(ident, parts).alias("held_out"), as_bytes(text))
    source = source.coalesce(max(math.ceil(size / chunk_bytes), df.sparkSession.sparkContext.defaultParallelism))
    return source.select(F.spark_partition_id().cast("bigint").alias("part"), "*").mapInArrow(run, "chunk bigint, docs binary, word binary, gram bigint, n bigint")


def packed(ident: pa.Array, held: pa.Array, texts: pa.Array) -> bytes:
    """Rows as one compressed piece."""
    batch, sink = pa.RecordBatch.from_arrays([ident, held, texts], names=["ident", "held_out", "text"]), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(piece: pa.Buffer | bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(piece).read_next_batch()


def pieces(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of at most about ``size`` bytes of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy().astype(np.int64))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def add(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each once, with the sum of its counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


# --- the trie ---------------------------------------------------------------------------


class Table:
    """From 64-bit keys to values, for whole arrays at a time.

    Keys lie in the order of their products with an odd number, beside the places where each run of leading bits starts.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, math.ceil(math.log2(max(1, len(keys)))))
        self.shift = np.uint64(64 - bits)
        spread = keys * MIX
        order = np.argsort(spread)
        self.keys, self.values = np.append(spread[order], ~np.uint64(0)), np.append(values[order], values.dtype.type(0))
        sizes = np.bincount((self.keys[:-1] >> self.shift).astype(np.int64), minlength=1 << bits)
        self.starts = np.concatenate(([0], np.cumsum(sizes)))[:-1].astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and whether each key is there."""
        spread = keys * MIX
        at = self.starts[(spread >> self.shift).astype(np.int64)]
        there = self.keys[at]
        found = there == spread
        open_ = np.flatnonzero(there < spread)
        while len(open_):
            at[open_] += 1
            there = self.keys[at[open_]]
            found[open_[there == spread[open_]]] = True
            open_ = open_[there < spread[open_]]
        found &= at < len(self.keys) - 1  # the last entry stands for no key
        return self.values[at], found


class Words:
    """Counts of a chunk's words by their 64-bit hashes, under a seed by which no two of them agree: ``words`` hold each once."""

    def __init__(self, words: list[pa.Array], counts: np.ndarray):
        self.seed = 0
        keys = self.hashed(words)
        while len(np.unique(keys)) < len(keys):
            self.seed += 1
            keys = self.hashed(words)
        self.table = Table(keys, counts)

    def hashed(self, words: list[pa.Array]) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *(digests(w.to_pylist(), self.seed) for w in words)])

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        """The counts of every text's words, all of which are in the table."""
        keys = [digests(t.split(), self.seed) for t in texts]
        found, known = self.table.find(np.concatenate([np.zeros(0, np.uint64), *keys]))
        assert known.all()
        return np.split(found, np.cumsum([len(k) for k in keys])[:-1])


def digests(words: list[bytes], seed: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(seed)), np.uint64, len(words))


class Tally:
    """Counts of keys, merged whenever as many have come as are held."""

    def __init__(self):
        self.keys, self.counts, self.more, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def take(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.more.append((keys, counts))
        self.n += len(keys)
        if self.n >= max(SLICE, len(self.keys)):
            self.settle()

    def settle(self) -> None:
        self.keys, self.counts = add(*(np.concatenate(x) for x in zip((self.keys, self.counts), *self.more)))
        self.more, self.n = [], 0


class Trie:
    """Counts by order, and what escapes and exclusion need; ``keys`` hold ORDER + 1 bytes.

    ``low``: keys of two bytes (one context byte, the symbol) over the whole corpus with
    their counts, if ``keys`` are a shard.  ``level``: the context bytes that a key's group has in
    common; for lower orders the sums of the whole corpus are in ``above``, by order.
    """

    def __init__(
        self,
        keys: np.ndarray,
        counts: np.ndarray,
        low: tuple[np.ndarray, np.ndarray] | None = None,
        level: np.ndarray | None = None,
        above: dict[int, tuple[np.ndarray, np.ndarray]] | None = None,
    ):
        eight = np.uint64(8)
        self.symbols: list[Table] = []
        self.contexts: list[Table] = []
        self.first: list[np.ndarray] = []  # log10 of the denominator, of the escape, unexcluded
        self.left: list[np.ndarray] = []  # the same for the suffix, without this node's symbols
        below: tuple | None = None  # of the order below: symbol keys, counts, context keys, totals, kinds
        for order in range(ORDER + 1):
            if order < 2 and low is not None:
                k, c = low
            elif above is not None and len(above.get(order, ((),))[0]):
                own = level <= order
                k, c = (np.concatenate(x) for x in zip((keys[own], counts[own]), above[order]))
            else:
                k, c = keys, counts
            k, c = add(k & np.uint64((1 << 8 * (order + 1)) - 1), c)
            c = c.astype(np.float64)
            ctx = k >> eight
            begin = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1]))) if len(k) else np.zeros(0, np.int64)
            nodes = ctx[begin]
            total = np.add.reduceat(c, begin) if len(begin) else c
            kinds = np.diff(np.append(begin, len(k))).astype(np.float64)
            with np.errstate(divide="ignore"):
                self.first.append(np.stack([np.log10(total + kinds), np.log10(kinds)], 1))
                if below is None:
                    self.left.append(np.zeros((len(nodes), 2)))
                else:
                    bk, bc, bnodes, btotal, bkinds = below
                    at = np.searchsorted(bk, k & np.uint64((1 << 8 * order) - 1))
                    seen = np.add.reduceat(bc[at], begin) if len(begin) else c
                    up = np.searchsorted(bnodes, nodes & np.uint64((1 << 8 * (order - 1)) - 1))
                    rest, more = btotal[up] - seen, bkinds[up] - kinds
                    # nothing is left of the suffix: the escape is certain and costs nothing
                    self.left.append(np.stack([np.where(more > 0, np.log10(rest + more), 0), np.where(more > 0, np.log10(more), 0)], 1))
            below = (k, c, nodes, total, kinds)
            value = np.log10(c)
            if order == ORDER:
                value = value - np.repeat(self.first[-1][:, 0], np.diff(np.append(begin, len(k))))
            self.symbols.append(Table(k, value.astype(np.float64)))
            self.contexts.append(Table(nodes, np.arange(len(nodes), dtype=np.int32)))
            if order == 0:
                self.unseen = -math.log10(max(1, SYMBOLS - len(k)))

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each key's symbol in its context."""
        out, known = self.symbols[ORDER].find(keys)
        left = np.flatnonzero(~known)
        out[left] = 0
        above = np.full(len(left), -1, np.int32)  # the node that was escaped from, one order up
        for order in range(ORDER, -1, -1):
            if not len(left):
                return out
            key = keys[left] & np.uint64((1 << 8 * (order + 1)) - 1)
            node, there = self.contexts[order].find(key >> np.uint64(8))
            value, known = self.symbols[order].find(key)
            if order < ORDER:
                cost = np.where((above >= 0)[:, None], _rows(self.left[order + 1], above), _rows(self.first[order], node))
            else:
                known[:] = False
                cost = _rows(self.first[order], node)
            out[left[known]] += value[known] - cost[known, 0]
            escaped = there & ~known
            out[left[escaped]] += cost[escaped, 1] - cost[escaped, 0]
            above = np.where(there, node, -1)[~known]
            left = left[~known]
        out[left] += self.unseen
        return out


def _rows(table: np.ndarray, index: np.ndarray) -> np.ndarray:
    return table[index] if len(table) else np.zeros((len(index), 2))


def context(key: F.Column, length: int) -> F.Column:
    """The last context bytes of an n-gram's key."""
    return F.shiftright(key, 8).bitwiseAND(F.lit((1 << 8 * length) - 1))


def shard_of(group: F.Column, level: F.Column, shards: int) -> F.Column:
    return F.when(level == 2, F.pmod(group * 40503, F.lit(shards))).otherwise(F.pmod(F.xxhash64(group, level), F.lit(shards))).cast("bigint")


# --- the operator -------------------------------------------------------------------------


def levels(grams_table: DataFrame, shard_nodes: int = SHARD_NODES) -> tuple[DataFrame, list[DataFrame]]:
    """Rows (gram, n, level, group) and, by context length from 2 on, the contexts whose groups were split.

    ``level`` is the least number of context bytes, from 2 to ``ORDER``, whose group has at most ``shard_nodes`` rows.
    """
    gram, split = F.col("gram"), []
    out = grams_table.select("gram", "n", F.lit(2).alias("level"))
    for length in range(2, ORDER):
        deep = out.where(F.col("level") == length)
        hot = cut(deep.groupBy(context(gram, length).alias("hot")).agg(F.count("*").alias("rows")).where(F.col("rows") > shard_nodes).select("hot"), "split")
        if hot.isEmpty():
            discard(hot)
            break
        split.append(hot)
        out = out.join(hot, (F.col("level") == length) & (context(gram, length) == F.col("hot")), "left")
        out = out.select("gram", "n", F.when(F.col("hot").isNotNull(), length + 1).otherwise(F.col("level")).alias("level"))
    group = context(gram, 2)
    for length in range(3, ORDER + 1):
        group = F.when(F.col("level") == length, context(gram, length)).otherwise(group)
    return out.withColumn("group", group), split


def scores(grams_table: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """(gram, value): log10 probability of every n-gram of a table (gram, n) under those with n > 0."""
    trained = grams_table.where("n > 0")
    shards = max(1, math.ceil(trained.count() / shard_nodes))
    low = trained.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("gram")).agg(F.sum("n").alias("n")).toArrow()  # 65,536 rows at most
    shared = grams_table.sparkSession.sparkContext.broadcast(tuple(low[c].to_numpy().astype(t) for c, t in (("gram", np.uint64), ("n", np.int64))))
    leveled, split = levels(grams_table, shard_nodes)
    dealt = leveled.select("gram", "n", "level", F.lit(0).alias("sum_of"), shard_of(F.col("group"), F.col("level"), shards).alias("shard"))
    for length, _ in enumerate(split, 2):
        below = leveled.where(F.col("level") > length)
        sums = below.where("n > 0").groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * (length + 1)) - 1)).alias("gram")).agg(F.sum("n").alias("n"))
        parts = below.select(context(F.col("gram"), length).alias("at"), shard_of(F.col("group"), F.col("level"), shards).alias("shard")).distinct()
        sums = sums.join(parts, context(F.col("gram"), length) == F.col("at"))
        dealt = dealt.unionByName(sums.select("gram", "n", F.lit(length).alias("level"), F.lit(length).alias("sum_of"), "shard"))

    def run(table: pa.Table) -> pa.Table:
        gram, n, level, sum_of = (table[c].to_numpy() for c in ("gram", "n", "level", "sum_of"))
        keys = gram.astype(np.uint64)
        above = {order: (keys[sum_of == order], n[sum_of == order]) for order in range(2, ORDER)}
        asked, trained = sum_of == 0, (sum_of == 0) & (n > 0)
        value = Trie(keys[trained], n[trained], shared.value, level[trained], above).score(keys[asked])
        release(None)
        return pa.table({"gram": gram[asked], "value": value.astype(np.float32)})

    return dealt.groupBy("shard").applyInArrow(run, "gram bigint, value float")


def score(
    df: DataFrame, ident: str = "doc_id", text: str = "text", parts: int = 10, chunk_bytes: int = CHUNK_BYTES, hold: int = HOLD, shard_nodes: int = SHARD_NODES
) -> DataFrame:
    """Per row: ident, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    table = cut(ask(df, ident, text, parts, chunk_bytes, hold), "asked")
    documents, asked = table.where("n is null").select("chunk", "docs"), table.where("n is not null")
    counts = cut(asked.groupBy("word", "gram").agg(F.sum("n").alias("n")), "counts")
    word_table, grams_table = counts.where("word is not null"), counts.where("gram is not null")
    head = counts.where("gram is null").agg(
        F.sum("n").alias("tokens"), F.count(F.when((F.col("n") > 0), 1)).alias("distinct"), F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("ends")
    ).first()
    tokens, ends = head.tokens or 0, head.ends or 0
    under = math.log10(tokens + 0.1 * (head.distinct + 1))
    of_words = asked.select("chunk", "word").join(word_table.select("word", F.col("n").cast("double").alias("value")), "word")
    of_grams = asked.select("chunk", "gram").join(cut(scores(grams_table, shard_nodes), "scores"), "gram")
    answers = of_words.select("chunk", "word", F.lit(None).cast("bigint").alias("gram"), "value").unionByName(of_grams.select("chunk", F.lit(None).cast("binary").alias("word"), "gram", F.col("value").cast("double").alias("value")))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    answers = answers.select("chunk", none("binary", "docs"), "word", "gram", "value")
    rows = answers.unionByName(documents.select("chunk", "docs", none("binary", "word"), none("bigint", "gram"), none("double", "value")))
    end_base = math.log10(ends + 0.1)

    def scored(piece: pa.Buffer, count: Words, model: Table) -> pa.RecordBatch:
        batch = unpacked(piece)
        texts = batch.column(2).to_pylist()
        n_tokens, n_known, base = [], [], []
        for c in count.of(texts):
            n_tokens.append(len(c) + 1)
            n_known.append(int((c > 0).sum()) + (ends > 0))
            base.append(float(np.log10(c + 0.1).sum()) + end_base - (len(c) + 1) * under)
        made = [pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(code_lengths(texts, model))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["ident", "held_out", "n_tokens", "n_known", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a chunk's answers come before its texts, in small batches; answers are kept as plain numbers, texts are let go piece by piece
        chunk, words, counts, keys, values, count, model = None, [], [], [], [], None, None
        for batch in batches:
            own, texts = batch.column(0).to_numpy(), pc.is_valid(batch.column(1)).to_numpy(zero_copy_only=False)
            edges = (np.flatnonzero((own[1:] != own[:-1]) | (texts[1:] != texts[:-1])) + 1).tolist()
            for start, stop in zip([0, *edges], [*edges, batch.num_rows]):
                part = batch.slice(start, stop - start)
                if own[start] != chunk:
                    chunk, words, counts, keys, values, count, model = own[start], [], [], [], [], None, None
                if not texts[start]:
                    is_word = pc.is_valid(part.column(2))
                    named, grams_ = part.filter(is_word), part.filter(pc.invert(is_word))
                    words.append(named.column(2))
                    counts.append(named.column(4).to_numpy().copy())
                    keys.append(grams_.column(3).to_numpy().astype(np.uint64))
                    values.append(grams_.column(4).to_numpy().astype(np.float32))
                    continue
                if model is None:
                    model = Table(np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.float32), *values]))
                    count = Words(words, np.concatenate([np.zeros(0), *counts]))
                    words, counts, keys, values = [], [], [], []
                for piece in part.column(1):
                    yield scored(piece.as_buffer(), count, model)
        del words, counts, keys, values, count, model
        release(None)

    bounded_batches(df.sparkSession)
    kind = df.schema[ident].dataType.simpleString()
    ordered = rows.repartition("chunk").sortWithinPartitions("chunk", F.col("docs").isNotNull())
    scored_rows = ordered.mapInArrow(run, f"ident {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored_rows.select(F.col("ident").alias(ident), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def code_lengths(texts: list[bytes], model: Table) -> np.ndarray:
    """log10 probability of each (lower-cased) text, whose n-grams are all in ``model``."""
    symbols, ends = stream(texts)
    out = np.zeros(len(texts))
    for at in range(ORDER, len(symbols), SLICE // 4):
        stop = min(at + SLICE // 4, len(symbols))
        where = np.flatnonzero(places(symbols, ends, at, stop))
        value, found = model.find(grams(symbols, at, stop)[where])
        assert found.all()
        out += np.bincount(np.searchsorted(ends, where + at), value, len(texts))
    return out
