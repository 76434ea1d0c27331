"""Language-model scores by a weighted backoff automaton over smoothed n-grams.

Tokens are lower-cased words and one end token a text. The vocabulary is every token of the training
texts, with exact counts, and the model has every n-gram of two to ``ORDER`` tokens that occurs twice or more in
them. Counts are discounted (absolute discounting, interpolated); in terms of the automaton:

* a *state* is a context that has arcs; state 0 is the empty context;
* an *arc* (state, token) has a log-probability and leads to the longest state that what has been read ends with;
* a *failure arc* of a state leads to its next shorter context and has the backoff weight that makes
  the state's probabilities sum to one.

A text's score is what one traversal from left to right adds up: the state is carried from token to token, a token
follows its arc or failure arcs down to a state that has one, and state 0 has every known token. Many texts are traversed side
by side, a token at a step; a long one is cut, and a cut's state is what the ``ORDER`` - 1 tokens before it lead to from state 0.

The model is as large as the corpus makes it. The *hot* automaton, of each size of n-gram all arcs that occur at least so often that ``ARCS`` are
enough for all sizes, goes to the executors, as do the ``HOT`` most frequent tokens. What it lacks comes by a join: an arc's log-probability
is its shorter context's, plus the state's backoff weight, plus a *gain*, so that a traversal of the whole automaton adds to that of the hot
one just the weights and gains of the contexts and arcs that are not hot, each of which is a key of the text's own n-grams. No
frequent key takes part in the join, and a bitmap of fixed size spares it most keys that the model doesn't have. These sizes change no score.
An n-gram's gain and its weight as a context have one key, and come as one sum: one that ends a text is no context of the model, as its end token is
followed by none. Keys are evenly spread, so that equal ranges of them are buckets, where sorted arrays of asked keys meet those of the model; a bucket
sends back a sum for each text. Buckets are as many as keep what a task holds of them at one size, whatever the corpus. A batch of texts is known by its partition and place there, as rows read again come in the same order.

N-grams that occur once are kept from the shuffle: tasks first send 32-bit fingerprints, four bytes an n-gram, and only n-grams whose fingerprint comes
twice are counted by their keys.

Null text: as empty; empty text: the end token alone. Null, negative and repeated ids: kept apart by id and text; repeated rows: a row each. Very
long texts: read in chunks, their hashed tokens in the memory of a task. Ties: an arc is hot or not by its count alone. Extra columns: ignored.
Empty table: no rows. No training texts: N and V are 0, every token is unknown and scores log10(1).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import _STEP, discard, fold_of, grouped, hashed_words, is_set, mixed, places, repeated, send, sent_within, signed, slices, sweep, written

FOLDS, HELD_OUT = 5, 1
ORDER = 3
HOT, ARCS = 1 << 21, 1 << 21
DISCOUNT = 0.75
#: The end token's hash.
END = mixed(np.array([0x5851F42D4C957F2D], np.uint64))[0]
#: Tokens whose n-grams a worker counts at once.
FLUSH_TOKENS = 1 << 20
#: Bits of the filters: 16 MB. They only spare work.
FILTER_BITS = 1 << 27
#: Tokens that are traversed in a row; rows of documents that are scored at once, 1,024 at most, as their numbers move in ten bits.
CUT, ROWS = 64, 1024
#: Training tokens to each bucket of keys, keys of the model that a task sorts at once, and keys to a batch of buckets' rows.
BUCKET_TOKENS, MODEL_KEYS, SENT_KEYS = 1 << 20, 1 << 19, 1 << 18
#: What tells the key of a token's backoff weight as a context, and of its own log-probability, from an n-gram's.
_WEIGHT, _TOKEN = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens in order, with the end tokens; number of tokens of each text)."""
    hashes, counts = hashed_words(texts)
    return np.insert(hashes, np.cumsum(counts), END), counts + 1


def gathered(batches, most: int = FLUSH_TOKENS):
    """The tokens of many texts at once: (hashes, number of tokens of each text)."""
    parts, total = [], 0
    for batch in slices(batches):
        parts.append(tokens_of(batch.column(0)))
        total += len(parts[-1][0])
        if total >= most:
            yield tuple(map(np.concatenate, zip(*parts, strict=True)))
            parts, total = [], 0
    if parts:
        yield tuple(map(np.concatenate, zip(*parts, strict=True)))


def unigrams(texts: DataFrame) -> DataFrame:
    """(h, c) of every token of the texts."""

    def run(batches):
        for hashes, _ in gathered(batches):
            h, _, n, _ = grouped(hashes)
            for low in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(signed(h[low : low + (1 << 16)])), pa.array(n[low : low + (1 << 16)])], ["h", "c"])

    return texts.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def gram_keys(contexts: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """Keys of n-grams by those of all their tokens but the last, and but the first."""
    return mixed(contexts * _STEP + suffixes)


def weight_keys(tokens: np.ndarray) -> np.ndarray:
    """Keys of the weights of contexts of one token; a longer one's is its n-gram's key."""
    return mixed(tokens ^ _WEIGHT)


def token_keys(tokens: np.ndarray) -> np.ndarray:
    return mixed(tokens ^ _TOKEN)


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, byte by byte: the first bytes of all, which are mostly 0, lie together for compression."""
    steps = keys.copy()
    steps[1:] -= keys[:-1]
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel())


def bucket_begins(tokens: int) -> np.ndarray:
    """The first key of each bucket, all equally wide: as many as keep a bucket's share of so many training tokens at ``BUCKET_TOKENS``."""
    buckets = min(1 << 16, max(16, -(-tokens // BUCKET_TOKENS)))
    return np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)


def ten_bits(numbers: np.ndarray) -> bytes:
    """Numbers below 1,024: the low bytes of all, then the two bits above of four in a byte."""
    high = np.zeros(-(-len(numbers) // 4) * 4, np.uint8)
    high[: len(numbers)] = numbers >> 8
    high = high.reshape(-1, 4)
    return (numbers & 255).astype(np.uint8).tobytes() + (high[:, 0] | high[:, 1] << 2 | high[:, 2] << 4 | high[:, 3] << 6).tobytes()


def of_ten_bits(data, n: int) -> np.ndarray:
    packed = np.frombuffer(data, np.uint8)
    high = (packed[n:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
    return packed[:n] | high.ravel()[:n].astype(np.uint16) << 8


def windows(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, suffix, key) of all n-grams of ``size`` tokens, and the places of those within texts."""
    owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    key = hashes
    for _ in range(size - 1):
        context, suffix = key[:-1], key[1:]
        key = gram_keys(context, suffix)
    return context, suffix, key, np.flatnonzero(owner[: len(key)] == owner[size - 1 :])


def ngrams(texts: DataFrame, size: int, tokens: int) -> DataFrame:
    """(context, suffix, c) of every n-gram of ``size`` tokens with a count of two or more, dealt by suffix."""
    def keys_of(batches):
        for hashes, counts in gathered(batches):
            _, _, key, inside = windows(hashes, counts, size)
            yield key[inside]

    sent = send(texts.sparkSession, repeated(texts.select("text"), keys_of, tokens, FILTER_BITS))
    sweep(texts.sparkSession)

    def run(batches):
        wanted = sent.value
        for hashes, counts in gathered(batches):
            context, suffix, key, inside = windows(hashes, counts, size)
            keep = inside[is_set(wanted, places(key[inside], FILTER_BITS))]
            context, suffix = context[keep], suffix[keep]
            _, at, n, _ = grouped(key[keep])
            for low in range(0, len(at), 1 << 16):
                some = at[low : low + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(signed(context[some])), pa.array(signed(suffix[some])), pa.array(n[low : low + (1 << 16)])], ["context", "suffix", "c"])

    return texts.select("text").mapInArrow(run, "context long, suffix long, c long").repartition("suffix").groupBy("context", "suffix").agg(F.sum("c").alias("c")).where("c > 1")


def level(texts: DataFrame, shorter: DataFrame, size: int, tokens: int, least: int, most: int, last: bool) -> tuple[DataFrame | None, DataFrame, tuple, tuple, int]:
    """N-grams of ``size`` tokens: (key, c, p) of all for the next level; (key, v) of the arcs and states that aren't hot; the hot arcs (key, context,
    suffix, lift) and states (context, weight) as arrays; and the count from which on they are hot.

    v is an arc's gain or a state's weight; lift an arc's log-probability less its suffix's.
    ``shorter``: (key, c, p) of the n-grams one token shorter. It has every n-gram's context and suffix, as
    these occur as often at least; so what is hot here, from ``least`` on, has a hot context and suffix. At most ``most`` arcs are hot.
    """

    def keyed(batches):
        for batch in batches:
            context, suffix = (batch.column(k).to_numpy().view(np.uint64) for k in ("context", "suffix"))
            keys = [pa.array(signed(k)) for k in (gram_keys(context, suffix), weight_keys(context) if size == 2 else context)]
            yield pa.RecordBatch.from_arrays([*keys, *batch.columns], ["key", "weight_key", *batch.schema.names])

    with sent_within():
        low = ngrams(texts, size, tokens).join(shorter.select(F.col("key").alias("suffix"), F.col("p").alias("low")), "suffix").select("context", "suffix", "c", "low")
        grams = written(low)
    hot = max(least, hot_count(grams, most))
    # n-grams move once, by context; a context's first one carries its state
    dealt = grams.repartition("context")
    sums = dealt.groupBy("context").agg(F.max("c").alias("top"), F.sum("c").alias("arcs_c"), F.count("*").alias("arcs"), F.sum("low").alias("arcs_low"), F.min("suffix").alias("first"))
    # every context is followed by a token; of its continuations that are no arcs each occurs once
    states = sums.join(shorter.select(F.col("key").alias("context"), F.col("c").alias("total")), "context")
    states = states.withColumn("mass", DISCOUNT * (F.col("arcs") + F.col("total") - F.col("arcs_c")) / F.col("total"))
    here = (F.col("arcs_c") - DISCOUNT * F.col("arcs")) / F.col("total") + F.col("mass") * F.col("arcs_low")
    weight = F.log10(F.greatest(1 - here, F.lit(1e-12)) / F.greatest(1 - F.col("arcs_low"), F.lit(1e-12)))
    states = states.select("context", "top", "first", "total", "mass", weight.alias("backoff"))
    joined = dealt.join(states, "context").select("context", "suffix", "c", "low", "top", "first", "total", "mass", "backoff")
    joined = joined.mapInArrow(keyed, "key long, weight_key long, context long, suffix long, c long, low double, top long, first long, total long, mass double, backoff double")
    p = (F.col("c") - DISCOUNT) / F.col("total") + F.col("mass") * F.col("low")
    lift = F.log10(p) - F.log10("low")
    is_hot, is_first, hot_state = F.col("c") >= hot, F.col("first") == F.col("suffix"), F.col("top") >= hot
    # only the hot ones need context, suffix and lift, and the others v; counts and p are for the next level
    columns = {"v": F.when(~is_hot, lift - F.col("backoff")), "lift": F.when(is_hot, lift), "suffix": F.when(is_hot, F.col("suffix")), "context": F.when(is_hot | (is_first & hot_state), F.col("context"))}
    columns |= {"weight": F.when(is_first, F.col("backoff")), "weight_key": F.when(is_first & ~hot_state, F.col("weight_key"))}
    arcs = written(joined.select("key", *(() if last else ("c", p.alias("p"))), *(c.alias(n) for n, c in columns.items())))
    discard(grams)
    table = arcs.where("lift is not null").select("key", "context", "suffix", "lift").toArrow()
    hot_arcs = (*(table.column(c).to_numpy().view(np.uint64) for c in ("key", "context", "suffix")), table.column("lift").to_numpy())
    table = arcs.where("weight is not null and weight_key is null").select("context", "weight").toArrow()
    hot_states = (table.column("context").to_numpy().view(np.uint64), table.column("weight").to_numpy())
    cold = arcs.where("v is not null").select("key", "v").union(arcs.where("weight_key is not null").select("weight_key", "weight"))
    if last:
        return None, cold, hot_arcs, hot_states, hot
    cold, longer = written(cold), written(arcs.select("key", "c", "p"))
    discard(arcs)
    return longer, cold, hot_arcs, hot_states, hot


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each wanted key is in a sorted array, and where."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


def key_bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap with two places of each key set, by its low and its high half; ``bits`` is a power of two up to 2^32.

    Tasks send places as 16 bits in ranges of 65,536, each sent once by a task's batch, and a range comes back as its bits.
    """
    width = min(16, bits.bit_length() - 1)

    def places_of(parts):
        key = np.concatenate(parts)
        place = np.concatenate([key, key >> np.uint64(32)]) & np.uint64(bits - 1)
        place = np.unique(place.astype(np.uint32))
        ranges, first = np.unique(place >> np.uint32(width), return_index=True)
        there = (place & np.uint32((1 << width) - 1)).astype(np.uint16)
        sent = [x.tobytes() for x in np.split(there, first[1:])]
        return pa.RecordBatch.from_arrays([pa.array(ranges.astype(np.int32)), pa.array(sent, pa.binary())], ["range", "places"])

    def send_places(batches):
        parts, total = [], 0
        for batch in batches:
            parts.append(batch.column(0).to_numpy().view(np.uint64))
            total += batch.num_rows
            if total >= MODEL_KEYS:
                yield places_of(parts)
                parts, total = [], 0
        if total:
            yield places_of(parts)

    def meet(table: pa.Table) -> pa.Table:
        found = np.zeros(1 << width, bool)
        for here in table.column("places"):
            found[np.frombuffer(here.as_buffer(), np.uint16)] = True
        return pa.table({"range": table.column("range").slice(0, 1), "bits": pa.array([np.packbits(found, bitorder="little").tobytes()], pa.binary())})

    table = keys.mapInArrow(send_places, "range int, places binary").groupBy("range").applyInArrow(meet, "range int, bits binary").toArrow()
    out = np.zeros(bits // 64, np.int64)
    by_range = out.view(np.uint8).reshape(bits >> width, -1)
    for place, there in zip(table.column("range").to_pylist(), table.column("bits"), strict=True):
        by_range[place] = np.frombuffer(there.as_buffer(), np.uint8)
    return out


class Keys:
    """Sorted, evenly spread 64-bit keys, found by where those begin that share their first bits."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.begin = keys, None

    def __getstate__(self):
        """Differences of keys byte by byte, without the first bytes that are 0 in all."""
        planes = np.frombuffer(packed(self.keys), np.uint8).reshape(8, -1)
        width = max((k + 1 for k in range(8) if planes[k].any()), default=0)
        return len(self.keys), planes[:width].tobytes()

    def __setstate__(self, state):
        n, data = state
        planes = np.zeros((8, n), np.uint8)
        planes.reshape(-1)[: len(data)] = np.frombuffer(data, np.uint8)
        self.keys, self.begin = unpacked(planes), None

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted key, -1 for those that aren't there."""
        if self.begin is None:  # by whoever looks: it isn't sent
            bits = max(1, len(self.keys).bit_length() - 1)
            self.shift = np.uint64(64 - bits)
            self.begin = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
            self.begin = np.append(self.begin, np.int32(len(self.keys)))
        bucket = (wanted >> self.shift).astype(np.int64)
        at, stop, out = self.begin[bucket], self.begin[bucket + 1], np.full(len(wanted), -1, np.int32)
        left = np.flatnonzero(at < stop)
        at, stop, wanted = at[left], stop[left], wanted[left]
        while len(left):
            there = self.keys[at]
            same = there == wanted
            out[left[same]] = at[same]
            more = np.flatnonzero((there < wanted) & (at + 1 < stop))
            left, at, stop, wanted = left[more], at[more] + 1, stop[more], wanted[more]
        return out


class Automaton:
    """States, arcs and failure arcs as arrays.

    ``arcs``: for each size from 2 on, (key, context, suffix, lift), the lift being an arc's log-probability less its suffix's;
    ``weights``: (context, backoff weight) likewise. An n-gram's context and suffix must be there too, or be tokens. An arc's ``log`` is what it
    adds to its token's own log-probability.
    """

    def __init__(self, arcs: list[tuple], weights: list[tuple]):
        self.order = 1 + len(arcs)
        # states by the size of their context; their numbers go on from size to size
        by_size, self.backoff, low = [], [np.zeros(1)], 1
        for context, weight in weights:
            order = np.argsort(context)
            by_size.append((context[order], low))
            self.backoff.append(weight[order])
            low += len(order)
        self.backoff = np.concatenate(self.backoff)
        self.size = np.repeat(np.arange(len(by_size) + 1, dtype=np.int8), [1, *(len(c) for c, _ in by_size)])
        self.fail = np.zeros(low, np.int32)
        self.tokens = Keys(by_size[0][0] if by_size else np.zeros(0, np.uint64))
        self.keys, self.log, self.next = [], [], []

        def state(contexts: np.ndarray, size: int) -> np.ndarray:
            """The numbers of the states of these contexts; 0 for those that are none."""
            if size > len(by_size):
                return np.zeros(len(contexts), np.int32)
            known, first = by_size[size - 1]
            here, at = found(known, contexts)
            return np.where(here, first + at, 0).astype(np.int32)

        for n, (key, _, suffix, lift) in enumerate(arcs, 1):
            order = np.argsort(key)
            key, suffix, lift = key[order], suffix[order], lift[order]
            # to the state of the whole n-gram, or else to where its suffix leads
            to = state(key, n + 1)
            below = found(self.keys[-1].keys, suffix)[1] if n > 1 else None
            shorter = state(suffix, 1) if n == 1 else self.next[-1][below]
            self.log.append(lift if n == 1 else lift + self.log[-1][below])
            self.keys.append(Keys(key))
            self.next.append(np.where(to > 0, to, shorter))
            # a state's failure arc leads to where its context's suffix leads
            if n < len(by_size):
                contexts, first = by_size[n]
                at = found(key, contexts)[1]
                self.fail[first : first + len(contexts)] = shorter[at] if len(key) else 0

    def along(self, hashes: np.ndarray, owner: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of each size, for each token: the arc of the n-gram that ends there, from size 2 on, -1 for none; and the state of the context that ends there, from size 1 on, 0 for none."""
        arcs, states, key = [], [self.tokens.find(hashes) + 1], hashes
        for n in range(1, self.order):
            key = gram_keys(key[:-1], key[1:])
            inside = np.flatnonzero((states[-1][n - 1 : -1] > 0) & (owner[: len(key)] == owner[n:])) if len(key) else np.zeros(0, np.int64)
            arc = np.full(len(hashes), -1, np.int32)
            arc[inside + n] = self.keys[n - 1].find(key[inside])
            arcs.append(arc)
            if n < self.order - 1:
                at = np.flatnonzero(arc >= 0)
                to = self.next[n - 1][arc[at]]
                state = np.zeros(len(hashes), np.int32)
                state[at] = np.where(self.size[to] == n + 1, to, 0)
                states.append(state)
        return arcs, states

    def traverse(self, counts: np.ndarray, unigram: np.ndarray, arcs: list[np.ndarray], first: np.ndarray, cut: int = CUT) -> np.ndarray:
        """What each token adds to the score, by the arcs and first states that :meth:`along` has. ``unigram``: what it adds at state 0, 0 for a token that is not at hand."""
        total, out = len(unigram), unigram.copy()
        if self.order == 1 or not total:
            return out
        ends = np.cumsum(counts)
        pieces = -(-counts // cut)
        text = np.repeat(np.arange(len(counts)), pieces)
        start = (ends - counts)[text] + (np.arange(len(text)) - (np.cumsum(pieces) - pieces)[text]) * cut
        stop = np.minimum(start + cut, ends[text])
        begin = np.maximum(start - (self.order - 1), (ends - counts)[text])  # the tokens before a cut only lead to its state
        state, at = np.zeros(len(text), np.int32), begin
        while len(at):
            counted, then = at >= start, first[at]
            going = np.flatnonzero(state > 0)
            here = state[going]
            while len(going):
                size, p = self.size[here], at[going]
                arc = np.full(len(going), -1, np.int32)
                for n in range(1, self.order):
                    of = np.flatnonzero(size == n)
                    arc[of] = arcs[n - 1][p[of]]
                    took = of[arc[of] >= 0]
                    then[going[took]] = self.next[n - 1][arc[took]]
                    add = took[counted[going[took]]]
                    out[p[add]] += self.log[n - 1][arc[add]]
                back = np.flatnonzero(arc < 0)
                add = back[counted[going[back]]]
                out[p[add]] += self.backoff[here[add]]
                here, going = self.fail[here[back]], going[back]
                going, here = going[here > 0], here[here > 0]
            at = at + 1
            on = at < stop
            state, at, start, stop = then[on], at[on], start[on], stop[on]
        return out


def hot_count(counts: DataFrame, most: int) -> int:
    """The lowest count c from which on all rows together are ``most`` at most, to a sixteenth of a doubling."""
    bins = counts.groupBy(F.floor(F.log2(F.col("c").cast("double")) * 16).alias("f")).agg(F.min("c").alias("low"), F.count("*").alias("n")).collect()
    lowest, total = 1 << 62, 0
    for _, low, n in sorted(bins, reverse=True):
        total += n
        if total > most:
            break
        lowest = low
    return lowest


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, hot_tokens: int = HOT, most_arcs: int = ARCS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold_of(F.col(id_col), FOLDS) == HELD_OUT).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    texts = docs.where("not held_out")
    counts = written(unigrams(texts))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    scale = n + 0.5 * (v + 1)
    often = hot_count(counts, hot_tokens)
    top = counts.where(F.col("c") >= often).select("h", "c").toArrow()
    hot_h, hot_c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
    by = np.argsort(hot_h)
    tokens = counts.select(F.col("h").alias("key"), "c", ((F.col("c") + 0.5) / F.lit(scale)).alias("p"))
    cold = tokens.where("false").select("key", F.col("p").alias("v"))
    hot_arcs, hot_states, shorter, least = [], [], tokens, 2
    for size in range(2, order + 1):
        longer, more, arcs, states, least = level(texts, shorter, size, n, least, most_arcs // (order - 1), size == order)
        if size > 2:
            discard(shorter)
        hot_arcs.append(arcs)
        hot_states.append(states)
        cold, shorter = cold.union(more), longer
    sent = docs.sparkSession.sparkContext.broadcast((Keys(hot_h[by]), hot_c[by].astype(np.min_scalar_type(hot_c.max(initial=0))), Automaton(hot_arcs, hot_states), key_bitmap(cold.select("key"), FILTER_BITS)))
    sweep(docs.sparkSession)
    begins = bucket_begins(n)
    schema = "bucket int, batch long, keys binary, owners binary, freqs binary, logs binary, docs binary"

    def rows_of(buckets: list[int], batch: int | None, **columns) -> pa.RecordBatch:
        n = len(buckets)
        values = [pa.array(buckets, pa.int32()), pa.array([batch] * n, pa.int64())]
        values += [pa.array(columns.get(c, [None] * n), pa.binary()) for c in ("keys", "owners", "freqs", "logs", "docs")]
        return pa.RecordBatch.from_arrays(values, ["bucket", "batch", "keys", "owners", "freqs", "logs", "docs"])

    def dealt(batch: int | None, keys: np.ndarray, **columns):
        """A row of each bucket's part of sorted keys and of what belongs to them, the rows of many buckets together."""
        cuts = np.append(np.searchsorted(keys, begins), len(keys))
        some = np.flatnonzero(np.diff(cuts))
        for part in np.split(some, np.flatnonzero(np.diff(cuts[some] // SENT_KEYS)) + 1) if len(some) else ():
            spans = [slice(cuts[b], cuts[b + 1]) for b in part.tolist()]
            yield rows_of(part.tolist(), batch, keys=[packed(keys[x]) for x in spans], **{name: [(ten_bits(values[x]) if name == "owners" else values[x].tobytes()) for x in spans] for name, values in columns.items()})

    def model_rows(batches, of_tokens: bool):
        def rows(parts):
            key, v = (np.concatenate(x) for x in zip(*parts, strict=True))
            key = token_keys(key) if of_tokens else key
            by = np.argsort(key)
            return dealt(None, key[by], logs=v[by])

        parts, total = [], 0
        for batch in batches:
            parts.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
            total += batch.num_rows
            if total >= MODEL_KEYS:
                yield from rows(parts)
                parts, total = [], 0
        if parts:
            yield from rows(parts)

    def asks(batch: int, own: np.ndarray, key: np.ndarray):
        """Rows of what the texts of a batch ask for: n-grams, or tokens if its number is inverted."""
        by = np.argsort(key)
        key = key[by]
        # keys by their numbers, and the texts that ask for each in order
        pair = np.zeros(len(key), np.int64)
        pair[1:] = np.cumsum(key[1:] != key[:-1])
        distinct = key[np.flatnonzero(np.diff(pair, prepend=-1))]
        pair = np.sort((pair << 16) | own[by])
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        freq = np.diff(np.append(first, len(pair))).astype(np.uint32)
        return dealt(batch, distinct[pair[first] >> 16], owners=(pair[first] & 0xFFFF).astype(np.uint16), freqs=freq)

    def run(batches):
        known_h, known_c, automaton, bits = sent.value
        logs = np.log10((known_c.astype(np.float64) + 0.5) / scale)
        mask = np.uint64(FILTER_BITS - 1)

        def maybe(keys: np.ndarray) -> np.ndarray:
            """Numbers of the keys that the model may have."""
            some = np.flatnonzero(is_set(bits, (keys & mask).astype(np.int64)))
            return some[is_set(bits, ((keys[some] >> np.uint64(32)) & mask).astype(np.int64))]

        partition = TaskContext.get().partitionId()
        for number, batch in enumerate(slices(batches, ROWS)):
            size, number = batch.num_rows, (partition << 32) + number
            h, lengths = tokens_of(batch.column(2))
            owner = np.repeat(np.arange(size, dtype=np.uint16), lengths)
            at = known_h.find(h)
            known = at >= 0
            unigram = np.zeros(len(h))
            unigram[known] = logs[at[known]]
            base = np.bincount(owner, unigram, size)
            arcs, states = automaton.along(h, owner)
            path = np.bincount(owner, automaton.traverse(lengths, unigram, arcs, states[0]), size)
            asked = [(owner[:0], h[:0])]
            key, there = h, np.ones(len(h), bool)  # n-grams that begin at each token, and whether the model may have them
            for n in range(1, order):
                if len(key) < 2:
                    break
                if n == 1:
                    begin = np.flatnonzero((states[0][:-1] == 0) & (owner[:-1] == owner[1:]))
                    wanted = weight_keys(key[begin])
                    some = maybe(wanted)
                    asked.append((owner[begin[some]], wanted[some]))
                # an n-gram's context and suffix are the model's if it is; it is cold as an arc or as a context
                key = gram_keys(key[:-1], key[1:])
                is_cold = arcs[n - 1][n:] < 0 if n == order - 1 else states[n][n:] == 0
                begin = np.flatnonzero((owner[: len(key)] == owner[n:]) & there[:-1] & there[1:] & is_cold)
                some = begin[maybe(key[begin])]
                asked.append((owner[some], key[some]))
                there = arcs[n - 1][n:] >= 0
                there[some] = True
            yield from asks(number, *(np.concatenate(x) for x in zip(*asked, strict=True)))
            yield from asks(~number, owner[~known], token_keys(h[~known]))
            # what is known of the texts so far goes through some bucket
            n_known = np.bincount(owner[known], minlength=size)
            so_far = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (lengths, n_known, base, path))], names)
            yield rows_of([number % len(begins)], number, docs=[so_far.serialize().to_pybytes()])

    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    unknown = float(np.log10(0.5 / scale))
    answers = pa.schema([("batch", pa.int64()), *((c, pa.binary()) for c in ("docs", "owners", "logs", "token_owners", "token_logs", "token_hits"))])

    def meet(table: pa.Table) -> pa.Table:
        column = {c: table.column(c) for c in ("batch", "keys", "owners", "freqs", "logs", "docs")}
        rows = {"model": [], "asks": [], "docs": []}
        for i, batch in enumerate(column["batch"].to_pylist()):
            rows["model" if batch is None else "docs" if column["docs"][i].is_valid else "asks"].append(i)

        def array(name: str, i: int, kind) -> np.ndarray:
            return np.frombuffer(column[name][i].as_buffer(), kind)

        keys = np.concatenate([unpacked(column["keys"][i].as_buffer()) for i in rows["model"]] or [np.zeros(0, np.uint64)])
        v = np.concatenate([array("logs", i, np.float64) for i in rows["model"]] or [np.zeros(0)])
        keys, _, _, of = grouped(keys)
        v = np.bincount(of, v, len(keys))
        out = [{"batch": column["batch"][i].as_py(), "docs": column["docs"][i].as_py()} for i in rows["docs"]]
        for i in rows["asks"]:
            freq = array("freqs", i, np.uint32)
            own = of_ten_bits(column["owners"][i].as_buffer(), len(freq))
            hit, at = found(keys, unpacked(column["keys"][i].as_buffer()))
            batch = column["batch"][i].as_py()
            log = np.full(len(own), unknown if batch < 0 else 0.0)
            log[hit] = v[at[hit]]
            total = np.bincount(own, log * freq)
            some = np.flatnonzero(total)
            if batch < 0:
                hits = np.bincount(own, hit * freq).astype(np.int64)
                out.append({"batch": ~batch, "token_owners": ten_bits(some), "token_logs": total[some].tobytes(), "token_hits": hits[some].tobytes()})
            else:
                out.append({"batch": batch, "owners": ten_bits(some), "logs": total[some].tobytes()})
        return pa.Table.from_pylist(out, answers)

    def whole(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        docs_of = next(pa.ipc.read_record_batch(r["docs"], so_far_schema) for r in rows if r["docs"] is not None)
        known, base, score = (docs_of.column(c).to_numpy().copy() for c in ("n_known", "base_score", "score"))
        for r in rows:
            if r["logs"]:
                log = np.frombuffer(r["logs"])
                score[of_ten_bits(r["owners"], len(log))] += log
            if r["token_logs"]:
                log = np.frombuffer(r["token_logs"])
                of = of_ten_bits(r["token_owners"], len(log))
                score[of] += log
                base[of] += log
                known[of] += np.frombuffer(r["token_hits"], np.int64)
        return pa.table([docs_of.column(0), docs_of.column(1), docs_of.column(2), pa.array(known), pa.array(np.full(len(known), n)), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    so_far_schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    rows = docs.mapInArrow(run, schema)
    rows = rows.union(tokens.where(F.col("c") < often).select("key", F.log10("p").alias("v")).mapInArrow(lambda batches: model_rows(batches, True), schema))
    rows = rows.union(cold.mapInArrow(lambda batches: model_rows(batches, False), schema))
    met = rows.groupBy("bucket").applyInArrow(meet, "batch long, docs binary, owners binary, logs binary, token_owners binary, token_logs binary, token_hits binary")
    return met.groupBy("batch").applyInArrow(whole, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
