"""Token counts by a linear longest-match automaton.

The vocabulary becomes a trie whose nodes carry a failure link and the number of
tokens that following it pops. Greedy longest-match-first then costs one step a
byte and yields only the count: no piece is ever built.

A text is cut before every white-space byte ([\\x20\\x09-\\x0D]); a blank (0x20)
stays in front of the word that follows it, other white space stands alone. Each
such span is cut greedily on its own. Null and empty texts have no tokens. A byte
that no vocabulary entry covers counts as one token.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SPANS = re.compile(rb"\x20?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]")
#: Distinct spans whose counts a task keeps; beyond it the memory starts anew.
MEMO_SPANS = 200_000


def read_vocabulary(path: str) -> list[bytes]:
    """Entries of a `base64 rank` file."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """Trie in dictionaries: goto[node * 256 + byte], fail[node], popped[node].

    Every single byte is an entry, so each string has a cut and each node but the
    root a link.
    """

    def __init__(self, vocabulary: Iterable[bytes]):
        goto: dict[int, int] = {}
        final, parents, byte_in = [False], [0], [0]
        for entry in (*vocabulary, *(bytes([b]) for b in range(256))):
            node = 0
            for b in entry:
                nxt = goto.get(node << 8 | b)
                if nxt is None:
                    nxt = goto[node << 8 | b] = len(final)
                    final.append(False)
                    parents.append(node)
                    byte_in.append(b)
                node = nxt
            final[node] = bool(entry)
        fail, popped = [0] * len(final), [0] * len(final)
        children: list[list[int]] = [[] for _ in final]
        for node in range(1, len(final)):
            children[parents[node]].append(node)
        level = children[0]
        while level:  # breadth first: links lead to shorter strings
            below: list[int] = []
            for node in level:
                below += children[node]
                if final[node]:
                    fail[node], popped[node] = 0, 1
                    continue
                at, count, b = fail[parents[node]], popped[parents[node]], byte_in[node]
                while (at << 8 | b) not in goto:
                    count += popped[at]
                    at = fail[at]
                fail[node], popped[node] = goto[at << 8 | b], count
            level = below
        self.goto, self.fail, self.popped = goto, fail, popped

    def count(self, span: bytes) -> int:
        """Tokens of the greedy cut of one span."""
        goto, fail, popped = self.goto.get, self.fail, self.popped
        node = count = 0
        for b in span:
            while (nxt := goto(node << 8 | b)) is None:
                count += popped[node]
                node = fail[node]
            node = nxt
        while node:
            count += popped[node]
            node = fail[node]
        return count


class SpanCounts(dict):
    """Token count of every distinct span seen by a task, in bounded memory."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, span: bytes) -> int:
        if len(self) >= MEMO_SPANS:
            self.clear()
        n = self.automaton.count(span)
        if len(span) <= 64:
            self[span] = n
        return n


def token_counts(documents: DataFrame, vocabulary_path: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_spans, n_tokens.

    Null or empty text: zeros. Repeated rows and null ids give a row each. Extra
    columns are ignored. The vocabulary is read once on the driver and broadcast;
    its size does not depend on the data.
    """
    spark = documents.sparkSession
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = SpanCounts(Automaton(vocabulary.value))
        of, spans = counts.__getitem__, SPANS.findall
        for batch in batches:
            sizes, n_spans, n_tokens = [], [], []
            for text in batch.column(1):
                found = spans(raw := text.as_py() or b"")
                sizes.append(len(raw))
                n_spans.append(len(found))
                n_tokens.append(sum(map(of, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(n_tokens, pa.int64())], ["id", "n_bytes", "n_spans", "n_tokens"])

    texts = documents.select(F.col(id_col).alias("id"), F.encode(text_col, "UTF-8").alias("raw"))
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(count, f"id {kind}, n_bytes long, n_spans long, n_tokens long").withColumnRenamed("id", id_col)
