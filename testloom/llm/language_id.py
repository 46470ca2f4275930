"""Language ID by prediction by partial matching over bytes.

For every language a variable-order byte context tree is counted on a bounded
sample of labelled texts. Its statistics are frozen: a byte that the longest known
context has seen costs its share there; any other costs an escape and is coded by the
next shorter context, down to the 256 equally likely bytes (escape method C, no
exclusion). These are the lengths an arithmetic coder would need. A text gets the
language whose tree codes it in the fewest bits.

The trees of all languages share their nodes: strings of up to ORDER + 1 bytes that any
language has. A node has a code length for each language, escapes included, so a known
string costs one look-up; only the others walk down to shorter contexts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from testloom.llm.common import BLOCK_BYTES, blocks

#: Bytes before the predicted one; the tables below are laid out for three.
ORDER = 3
#: Labelled texts a language learns from, bytes of them, and bytes of one text: the bound of the sample.
SAMPLE_TEXTS = 1000
SAMPLE_BYTES = 2_000_000
TEXT_BYTES = 20_000
#: Rows that a task gives back at once.
SENT_ROWS = 1000
UNKNOWN = "und"


class Tree:
    """Counts of one language: strings of k + 1 bytes, and what their first k bytes were followed by."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.size = size
        code = np.zeros(len(symbols) - ORDER, np.int64)
        self.levels = []
        for k in range(ORDER + 1):
            code = code + symbols[ORDER - k : len(symbols) - k].astype(np.int64) * size**k
            strings, counts = np.unique(code, return_counts=True)
            contexts, first, distinct = np.unique(strings // size, return_index=True, return_counts=True)
            self.levels.append((strings, counts, contexts, np.add.reduceat(counts, first) if len(first) else counts, distinct))

    def bits(self, k: int, codes: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code length of the last byte of strings of k + 1 bytes, and the escape's share of it
        (0 where the string is known or its context isn't); below: code lengths at order k - 1."""
        strings, counts, contexts, times, distinct = self.levels[k]
        at, known = looked_up(contexts, codes // self.size)
        total = np.where(known, times[at] + distinct[at], 1)
        escape = np.where(known, np.log2(total / np.where(known, distinct[at], 1)), 0.0)
        at, seen = looked_up(strings, codes)
        return np.where(seen, np.log2(total / np.where(seen, counts[at], 1)), escape + below), escape


def looked_up(sorted_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return at, sorted_[at] == values


class Model:
    """Frozen statistics of all languages.

    Bytes that no sample has are one symbol: they have no node, so a context that holds
    one is unknown, and each of them costs the same.
    """

    def __init__(self, texts: dict[str, list[bytes]]):
        self.languages = sorted(texts)
        joined = {k: np.frombuffer(b"".join(b"\n" * ORDER + t for t in v), np.uint8) for k, v in texts.items()}
        seen = np.flatnonzero(sum((np.bincount(v, minlength=256) for v in joined.values()), np.zeros(256, np.int64)))
        self.symbol_of = np.zeros(256, np.int64)
        self.symbol_of[seen] = np.arange(1, len(seen) + 1)
        n = self.n_symbols = len(seen) + 1
        trees = [Tree(self.symbol_of[joined[k]], n) for k in self.languages]
        if not trees:
            return
        nodes = [np.unique(np.concatenate([t.levels[k][0] for t in trees])) for k in range(ORDER + 1)]
        every = (np.arange(n), np.arange(n * n), nodes[2], nodes[3])
        self.bits, self.escapes = [], []  # by order: a row for each node, a column for each language
        for k, codes in enumerate(every):
            below = np.full((len(codes), len(trees)), 8.0) if k == 0 else self._below(k, codes, nodes)
            both = [t.bits(k, codes, below[:, i]) for i, t in enumerate(trees)]
            self.bits.append(np.column_stack([b for b, _ in both]).astype(np.float32))
        contexts = (np.arange(n * n), nodes[2])
        for k, codes in zip((2, 3), contexts, strict=True):
            # what a string costs above its shorter one if its context is known and it isn't: symbol 0 is never known
            self.escapes.append(np.column_stack([t.bits(k, codes * n, np.zeros(len(codes)))[1] for t in trees]).astype(np.float32))
        #: number of a string of three bytes among the nodes, -1 if it has none
        self.three = np.full(n**3, -1, np.int32)
        self.three[nodes[2]] = np.arange(len(nodes[2]), dtype=np.int32)
        # strings of four bytes: for each node of three a bit a symbol, and the nodes before each word of bits
        words = -(-n // 64)
        row, symbol = self.three[nodes[3] // n].astype(np.int64), nodes[3] % n
        self.follows = np.zeros(len(nodes[2]) * words, np.uint64)
        np.bitwise_or.at(self.follows, row * words + symbol // 64, np.uint64(1) << (symbol % 64).astype(np.uint64))
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.follows), dtype=np.int64)[:-1])).astype(np.int32)
        self.n_words = words

    def _below(self, k: int, codes: np.ndarray, nodes: list[np.ndarray]) -> np.ndarray:
        shorter = codes % self.n_symbols**k
        return self.bits[k - 1][shorter if k < ORDER else np.searchsorted(nodes[2], shorter)].astype(np.float64)

    def _each(self, symbols: np.ndarray) -> np.ndarray:
        """Bits of each symbol from the fourth on under each language."""
        n = self.n_symbols
        two = symbols[:-1] * n + symbols[1:]
        three = self.three[two[:-1] * n + symbols[2:]]
        last, context = symbols[ORDER:], three[:-1].astype(np.int64)
        place = np.maximum(context, 0) * self.n_words + last // 64
        word, bit = self.follows[place], np.uint64(1) << (last % 64).astype(np.uint64)
        known = (word & bit != 0) & (context >= 0)
        node = self.before[place] + np.bitwise_count(word & (bit - np.uint64(1)))
        out = self.bits[3][np.where(known, node, 0)]
        rest = np.flatnonzero(~known)
        if len(rest):
            at, above = three[1:][rest], context[rest]
            lower = np.where((at >= 0)[:, None], self.bits[2][np.maximum(at, 0)], self.bits[1][two[2:][rest]] + self.escapes[0][two[1:-1][rest]])
            out[rest] = lower + np.where((above >= 0)[:, None], self.escapes[1][np.maximum(above, 0)], np.float32(0))
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language; texts of at least one byte."""
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + ORDER)
        symbols = self.symbol_of[np.frombuffer(b"".join(b"\n" * ORDER + t for t in texts), np.uint8)]
        starts = np.concatenate(([0], ends[:-1]))
        edges = np.column_stack((starts, ends - ORDER)).ravel()[:-1]  # the bits of a text, and those between texts
        return np.add.reduceat(self._each(symbols), edges, axis=0, dtype=np.float64)[::2]


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on at most SAMPLE_TEXTS different texts and SAMPLE_BYTES bytes a language.

    Takes rows with text and language; of a text its first TEXT_BYTES bytes. The sample is
    drawn by a hash of the text at the rate that the number of different texts asks for,
    and what the draw gives beyond the bounds is cut by the same hash. So it depends neither
    on ids nor on the partitioning, copies count once, and every language is learned: the
    rate is 1 or lets a hundred texts through on average. Empty table: nothing is learned.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.substring(F.encode(text_col, "UTF-8"), 1, TEXT_BYTES).alias("raw"), F.xxhash64(F.lit("language sample"), F.col(text_col)).alias("h"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.avg(F.octet_length("raw")).alias("mean"))
    # one row a language, of which the model holds far more
    rates = sizes.select("lang", F.least(F.lit(1.0), SAMPLE_TEXTS / F.greatest("n", F.lit(1)), SAMPLE_BYTES / F.greatest(F.col("n") * F.col("mean"), F.lit(1.0))).alias("rate"))
    share = F.pmod("h", F.lit(1 << 30)) / (1 << 30)
    drawn = rows.join(F.broadcast(rates), "lang").where(share < F.col("rate")).groupBy("lang", "h").agg(F.min("raw").alias("raw"))
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h")
    upto = F.sum(F.octet_length("raw")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = drawn.select("lang", "raw", F.row_number().over(order).alias("place"), upto.alias("upto")).where(f"place <= {SAMPLE_TEXTS} and upto <= {SAMPLE_BYTES}")
    texts: dict[str, list[bytes]] = {}
    for row in sorted(kept.collect(), key=lambda r: (r.lang, r.place)):
        texts.setdefault(row.lang, []).append(bytes(row.raw))
    return Model(texts)


def predict(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """documents plus lang_pred, score and bits_per_byte; given columns of these names are replaced.

    lang_pred is `und` with score 0 and bits_per_byte null where the text is null or has no
    letter, or where nothing was learned. score is the chance of the language under equal
    priors, 2**-bits normalised over the languages; bits_per_byte is the code length of the
    text under it. Whole texts count; a long one is coded in pieces that keep their
    contexts. The model's size is bounded by the sample: at most SAMPLE_BYTES nodes a
    language, with a number for each language, so it is broadcast. The text is sent to the
    tasks' Python once, as the given column if it is one.
    """
    names = ("lang_pred", "score", "bits_per_byte")
    given = [c for c in documents.columns if c not in names]
    shared = documents.sparkSession.sparkContext.broadcast(model)
    once = text_col in given and documents.schema[text_col].dataType.simpleString() == "string"
    at_text = given.index(text_col) if once else len(given)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            raw, told = batch.column(at_text).cast(pa.binary()), batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            bits = np.zeros((batch.num_rows, len(model.languages)))
            rows = ((i, raw[i].as_py()) for i in np.flatnonzero(told).tolist())
            pieces = ((i, x[max(0, at - ORDER) : at + BLOCK_BYTES], at > 0) for i, x in rows for at in range(0, len(x), BLOCK_BYTES))
            later = []

            def first_pieces():
                for i, x, follows in pieces:
                    if follows:
                        later.append(i)
                        bits[i] += model.code_lengths([x])[0] - model.code_lengths([x[:ORDER]])[0]
                    else:
                        yield i, x

            for block in blocks(first_pieces()) if model.languages else ():
                bits[[i for i, _ in block]] += model.code_lengths([x for _, x in block])
            if model.languages:
                best = bits.argmin(1)
                chance = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
            else:
                told = np.zeros(batch.num_rows, bool)
            langs = [model.languages[best[i]] if told[i] else UNKNOWN for i in range(batch.num_rows)]
            scores = [float(chance[i]) if told[i] else 0.0 for i in range(batch.num_rows)]
            rates = [float(bits[i, best[i]]) / len(raw[i].as_buffer()) if told[i] else None for i in range(batch.num_rows)]
            out = pa.RecordBatch.from_arrays([*batch.columns[: len(given)], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], [*given, *names])
            yield from (out.slice(k, SENT_ROWS) for k in range(0, out.num_rows, SENT_ROWS))

    text = F.col(text_col).cast("string")
    rows = documents.select(*given, *([] if once else [text.alias("_text")]), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("_told"))
    schema = documents.select(*given).schema.add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    return rows.mapInArrow(score, schema)
