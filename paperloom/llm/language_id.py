"""Language of words and texts by a linear-chain conditional random field.

Labels are words' languages. Features of a word (a run of non-blanks, lower-cased, its letters only): the word itself (lexicon), its first and last 1 to 4 letters
(affixes) and its n-grams of 2 and 3 letters, its borders included; each kind weighs as a unit vector. Features are hashed to 2^``BITS`` weights a language.
Transitions between adjacent words' languages are learned, so that a word that could be of several languages follows its neighbours, and text that switches is cut where it does.
Marginals come from forward-backward over all words of a text. A text's language is the one with the greatest sum of marginals over words that have a letter, its score the mean of them.

Training: sequences of ``WINDOW`` words from ``WINDOWS`` places of about ``SAMPLE`` distinct texts of each of the ``LANGUAGES`` most frequent languages (a share by hash of the text), half of them spliced from two languages;
AdaGrad on the likelihood of the labels, by forward-backward, on the driver. These bounds hold for training alone.

Inference is one narrow pass over whole texts. Emissions depend on a word alone and are kept by the word's hash. Texts are cut into blocks of ``BLOCK`` words, and the chain's steps are taken in all blocks of a batch at once: first each block's product of
transition matrices, then the vectors at blocks' borders (a scan over blocks), then the marginals inside. A long text is many blocks: it costs no more than many short ones.

The input of a prediction is the text only. Null text, or none with a letter: ``und``, score 0. Nothing learned (an empty table, no language): ``und`` too. Ties: the language that sorts first. Repeated rows: a row each;
copies of a text teach once for each language. Null id: the fold of the empty text. Extra columns: ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Runs, fold_of, mixed, slices, word_chunks

BITS = 18
AFFIXES, NGRAMS = (1, 2, 3, 4), (2, 3)
SAMPLE, LANGUAGES, WINDOWS, WINDOW, WORD = 400, 64, 3, 24, 64
EPOCHS, BATCH = 6, 64
BLOCK = 64
#: Words whose chains are run at once.
WORDS = 1 << 17
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of all words' features, their values, how many each word has); a word without a letter has none."""
    bare = ["".join(c for c in w.lower() if c.isalpha()) if not w.isalpha() else w.lower() for w in words]
    length = np.fromiter(map(len, bare), np.int64, len(bare))
    text = np.frombuffer("".join(f"\x02{w}\x03" if w else "" for w in bare).encode("utf-32-le"), np.uint32).astype(np.uint64)
    spans = np.where(length > 0, length + 2, 0)
    begin = np.cumsum(spans) - spans
    owner = np.repeat(np.arange(len(bare)), spans)
    place = np.arange(len(text)) - begin[owner]  # 0 is the border before a word
    left = spans[owner] - place  # characters from here to the word's end, the border after it included
    many = length[owner]
    mix = mixed((text + np.uint64(1)) * _STEP)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def put(kind: int, h: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        number = mixed(h + np.uint64((kind + 1) * int(_STEP) % (1 << 64))) & np.uint64((1 << BITS) - 1)
        out.append((owner[at], number.astype(np.int64), value))

    h = np.zeros(len(text), np.uint64)
    for n in range(1, max(*AFFIXES, *NGRAMS) + 1):
        h = h[: len(text) - n + 1] * np.uint64(0xD1342543DE82EF95) + mix[n - 1 :] if len(text) >= n else h[:0]
        starts = np.arange(len(h))
        whole = left[: len(h)] >= n
        if n in NGRAMS:
            at = starts[whole]
            put(n, h[at], at, 1 / np.sqrt(many[at] + 3 - n))
        if n in AFFIXES:
            inside = (many[: len(h)] >= n) & whole
            at = starts[inside & (place[: len(h)] == 1)]
            put(10 + n, h[at], at, np.full(len(at), 0.5))
            at = starts[inside & (left[: len(h)] == n + 1)]
            put(20 + n, h[at], at, np.full(len(at), 0.5))
    if len(text):
        powers = np.cumprod(np.full(int(spans.max()), _STEP | np.uint64(1), np.uint64))
        firsts = begin[length > 0]
        put(30, np.add.reduceat(mix * powers[place], firsts), firsts, np.ones(len(firsts)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(len(words), np.int64)
    by, number, value = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(by, kind="stable")
    return number[order], value[order].astype(np.float32), np.bincount(by, minlength=len(words))


class Field:
    """Languages, weights by (feature, language), log transitions by (from, to)."""

    def __init__(self, languages: list[str], weights: np.ndarray, transitions: np.ndarray):
        self.languages, self.weights, self.transitions = languages, weights, transitions

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log potentials of each word's languages."""
        return summed(self.weights, *features(words))


def summed(weights: np.ndarray, number: np.ndarray, value: np.ndarray, count: np.ndarray) -> np.ndarray:
    out = np.zeros((len(count), weights.shape[1]), np.float32)
    some = count > 0
    if some.any():
        out[some] = np.add.reduceat(weights[number] * value[:, None], (np.cumsum(count) - count)[some])
    return out


def forward_backward(scores: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginals, expected transitions) of sequences of equal length: scores are (sequence, word, language).

    Before the first word any language is equally likely, and a transition leads from it to the first word's.
    """
    m, n, k = scores.shape
    e, step = np.exp(scores - scores.max(2, keepdims=True)), np.exp(transitions)
    ahead, back = np.empty((m, n + 1, k)), np.ones((m, n + 1, k))
    ahead[:, 0] = 1 / k
    for t in range(n):
        x = (ahead[:, t] @ step) * e[:, t]
        ahead[:, t + 1] = x / x.sum(1, keepdims=True)
    for t in range(n, 0, -1):
        x = (back[:, t] * e[:, t - 1]) @ step.T
        back[:, t - 1] = x / x.sum(1, keepdims=True)
    marginals = ahead[:, 1:] * back[:, 1:]
    marginals /= marginals.sum(2, keepdims=True)
    pairs = np.zeros((k, k))
    for t in range(n):
        x = ahead[:, t, :, None] * step * (e[:, t] * back[:, t + 1])[:, None, :]
        pairs += (x / x.sum((1, 2), keepdims=True)).sum(0)
    return marginals, pairs


def train(windows: list[tuple[list[str], int]], languages: list[str], seed: int = 5, epochs: int = EPOCHS, rate: float = 0.3, l2: float = 1e-4) -> Field:
    """windows: (words, language's number). Half of the sequences are spliced from two windows of any languages."""
    k = len(languages)
    weights, transitions = np.zeros((1 << BITS, k), np.float32), np.zeros((k, k))
    if k < 2 or not windows:
        return Field(languages, weights, transitions)
    vocabulary: dict[str, int] = {}
    ids = np.array([[vocabulary.setdefault(w, len(vocabulary)) for w in words] for words, _ in windows])
    labels = np.repeat(np.array([label for _, label in windows])[:, None], ids.shape[1], 1)
    number, value, count = features(list(vocabulary))
    begin = np.cumsum(count) - count
    rng = np.random.default_rng(seed)
    gw, gt = np.full(weights.shape, 1e-2, np.float32), np.full((k, k), 1e-2)
    for _ in range(epochs):
        # the second half of the mixed sequences comes from a window of any other
        mixed_ids, mixed_labels = ids.copy(), labels.copy()
        other, cut = rng.permutation(len(ids)), rng.integers(4, max(5, ids.shape[1] - 3), len(ids))
        splice = (rng.random(len(ids)) < 0.5)[:, None] & (np.arange(ids.shape[1]) >= cut[:, None])
        mixed_ids[splice], mixed_labels[splice] = ids[other][splice], labels[other][splice]
        order = rng.permutation(len(ids))
        for low in range(0, len(order), BATCH):
            part = order[low : low + BATCH]
            words, at = np.unique(mixed_ids[part], return_inverse=True)
            lengths = count[words]
            flat = np.repeat(begin[words] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
            num, val = number[flat], value[flat]
            e = summed(weights, num, val, lengths)[at].reshape(len(part), -1, k)
            marginals, pairs = forward_backward(e.astype(np.float64), transitions)
            truth = mixed_labels[part]
            np.subtract.at(marginals, (np.arange(len(part))[:, None], np.arange(truth.shape[1]), truth), 1)
            np.subtract.at(pairs, (truth[:, :-1], truth[:, 1:]), 1)
            first = np.bincount(truth[:, 0], minlength=k)
            pairs -= np.outer(np.full(k, 1 / k), first)
            by_word = np.zeros((len(words), k), np.float32)
            np.add.at(by_word, at.reshape(-1), marginals.reshape(-1, k))
            slope = np.repeat(by_word, lengths, 0) * val[:, None] / len(part)
            used, inverse = np.unique(num, return_inverse=True)
            g = np.zeros((len(used), k), np.float32)
            np.add.at(g, inverse, slope)
            g += l2 * weights[used]
            gw[used] += g * g
            weights[used] -= rate * g / np.sqrt(gw[used])
            p = pairs / len(part) + l2 * transitions
            gt += p * p
            transitions -= rate * p / np.sqrt(gt)
    return Field(languages, weights, transitions)


def spread(words: list[str]) -> list[list[str]]:
    """Windows of equal length at even distances over a text's words; a short text is repeated to fill one."""
    words = [w[:WORD] for w in words if any(map(str.isalpha, w))]
    if not words:
        return []
    if len(words) < WINDOW:
        return [(words * (WINDOW // len(words) + 1))[:WINDOW]]
    n = min(WINDOWS, len(words) // WINDOW)
    step = (len(words) - WINDOW) // max(1, n - 1) if n > 1 else 0
    return [words[i * step : i * step + WINDOW] for i in range(n)]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, folds: int = FOLDS, held_out: int = HELD_OUT) -> Field:
    """Learns from texts and languages of rows outside the fold ``held_out``."""
    known = docs.where((fold_of(F.col(id_col), folds) != held_out) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct("h").alias("n")).orderBy(F.desc("rows"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r.lang for r in sizes)
    share = F.lit(0)
    for r in sizes:
        share = F.when(F.col("lang") == r.lang, F.lit(min(1 << 20, (sample << 20) // max(1, r.n)))).otherwise(share)
    # equal texts are one; of each language about `sample` are left, whatever the table's size
    picked = known.where(F.pmod(F.col("h"), F.lit(1 << 20)) < share).groupBy("lang", "h").agg(F.min("text").alias("text"))

    def run(batches):
        for batch in slices(batches, 64):
            langs, words = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = spread(text.split())
                langs += [lang] * len(found)
                words += found
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.list_(pa.string()))], ["lang", "words"])

    table = picked.select("lang", "text").mapInArrow(run, "lang string, words array<string>").toArrow()
    place = {lang: i for i, lang in enumerate(languages)}
    windows = sorted(zip(table.column("words").to_pylist(), map(place.__getitem__, table.column("lang").to_pylist()), strict=True))
    return train(windows, languages)


def chains(e: np.ndarray, counts: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Marginals of each word's languages; e: log potentials of the words of all texts end to end, counts: words of each text."""
    k = e.shape[1]
    step = np.exp(transitions)
    blocks = -(-counts // BLOCK)
    text_of = np.repeat(np.arange(len(counts)), blocks)
    first = np.cumsum(blocks) - blocks  # each text's first block
    number = np.arange(len(text_of)) - first[text_of]
    size = np.minimum(counts[text_of] - number * BLOCK, BLOCK)
    word = (np.cumsum(counts) - counts)[text_of] + number * BLOCK
    at = word[:, None] + np.arange(BLOCK)
    there = np.arange(BLOCK) < size[:, None]
    p = np.exp(e - e.max(1, keepdims=True)).astype(np.float64) if len(e) else np.zeros((0, k))
    p = np.where(there[:, :, None], p[np.minimum(at, max(len(e) - 1, 0))], 1.0)

    # each block's product, by (block, language before it, language of its last word)
    through = np.broadcast_to(np.eye(k), (len(p), k, k)).copy()
    for t in range(BLOCK):
        live = there[:, t]
        x = (through[live] @ step) * p[live, t][:, None, :]
        through[live] = x / x.max((1, 2), keepdims=True)
    # vectors before and after each block: a scan over the blocks of all texts side by side
    ahead, back = np.full((len(p), k), 1 / k), np.ones((len(p), k))
    for b in range(1, int(blocks.max(initial=0))):
        mine = first[blocks > b] + b
        x = np.einsum("bi,bij->bj", ahead[mine - 1], through[mine - 1])
        ahead[mine] = x / x.sum(1, keepdims=True)
    for b in range(int(blocks.max(initial=0)) - 2, -1, -1):
        mine = first[blocks > b + 1] + b
        x = np.einsum("bj,bij->bi", back[mine + 1], through[mine + 1])
        back[mine] = x / x.sum(1, keepdims=True)
    # inside the blocks
    out = np.empty_like(p)
    for t in range(BLOCK):
        x = (ahead @ step) * p[:, t]
        ahead = np.where(there[:, t, None], x / x.sum(1, keepdims=True), ahead)
        out[:, t] = ahead
    for t in range(BLOCK - 1, -1, -1):
        out[:, t] *= back
        x = (back * p[:, t]) @ step.T
        back = np.where(there[:, t, None], x / x.sum(1, keepdims=True), back)
    out = out[there]
    return out / out.sum(1, keepdims=True)


class Labeller:
    """Marginals of all words of texts, in groups of texts of about ``WORDS`` words."""

    def __init__(self, model: Field):
        self.model, self.k = model, len(model.languages)
        # the languages' potentials, then whether the word has a letter
        self.known = Runs(self._made, np.float32, numbers=1 << 22)

    def _made(self, words: list[bytes]) -> list[np.ndarray]:
        texts = [w.decode(errors="replace") for w in words]
        e = self.model.emissions(texts)
        letters = np.fromiter((any(map(str.isalpha, w)) for w in texts), np.float32, len(texts))
        return list(np.concatenate([e, letters[:, None]], 1))

    def run(self, texts: pa.Array):
        """(rows, marginals by word, has a letter by word, words by row) of groups of consecutive rows."""
        width, held, counts, row = self.k + 1, [], [], 0

        def group():
            found = np.concatenate(held) if held else np.zeros((0, width), np.float32)
            n = np.array(counts, np.int64)
            return range(row, row + len(counts)), chains(found[:, :-1], n, self.model.transitions), found[:, -1] > 0, n

        for words in word_chunks(texts):
            values, _ = self.known.numbers(self.known.places(words))
            while row + len(counts) <= words.first_row + words.rows - 1:
                counts.append(0)
            for r, n in zip(*np.unique(words.owner, return_counts=True), strict=True):
                counts[r - row] += int(n)
            held.append(values.reshape(-1, width))
            if words.ends and sum(map(len, held)) >= WORDS:
                yield group()
                row, held, counts = row + len(counts), [], []
        if counts:
            yield group()


def predict(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        labeller = Labeller(sent.value)
        names, k = labeller.model.languages, labeller.k
        for batch in slices(batches):
            lang, score = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            for rows, marginals, letters, counts in labeller.run(batch.column(2)) if k else ():
                owner = np.repeat(np.arange(len(counts)), counts)[letters]
                sums = np.stack([np.bincount(owner, marginals[letters, j], len(counts)) for j in range(k)], 1)
                for r, x in zip(rows, sums, strict=True):
                    if total := x.sum():
                        best = int(x.argmax())
                        lang[r], score[r] = names[best], min(1.0, float(x[best] / total))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold_of(F.col(id_col), folds) == held_out).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def label_words(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, first_word, n_words, lang, score): the runs of words of one language, numbered from 0; code-switched texts have several."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        labeller = Labeller(sent.value)
        names = labeller.model.languages
        for batch in slices(batches):
            ids, out = batch.column(0).to_pylist(), []
            for rows, marginals, _, counts in labeller.run(batch.column(1)) if names else ():
                best = marginals.argmax(1)
                ends = np.cumsum(counts)
                for r, low, high in zip(rows, ends - counts, ends, strict=True):
                    cuts = [int(low), *(np.flatnonzero(np.diff(best[low:high])) + 1 + low).tolist(), int(high)]
                    out += [(ids[r], a - int(low), b - a, names[best[a]], float(marginals[a:b, best[a]].mean())) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()), strict=True)], ["doc_id", "first_word", "n_words", "lang", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, first_word long, n_words long, lang string, score double")
