"""Token counts by heap-and-linked-list byte-pair merging (operator 7).

A text is normalised and cut into pieces as the vocabulary file says.  Each piece starts as a
doubly linked list of byte symbols; a heap holds the adjacent pairs that the merge table knows,
and the pair of lowest rank (leftmost on ties) is merged again and again.  The number of tokens is
the number of initial symbols minus the number of merges; no identifiers are made.

Counts of pieces are remembered in a table of bounded size in each worker, as words recur.
"""

from __future__ import annotations

import heapq
import json
import os
import unicodedata
from collections.abc import Callable

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

#: Pieces remembered in a worker; the table is emptied beyond that, which changes no count.
REMEMBERED = 300_000
#: Pieces longer than this aren't remembered.
LONGEST_REMEMBERED = 64


def _byte_symbols() -> list[str]:
    """The printable stand-ins that byte-level vocabularies write for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    table = {b: chr(b) for b in shown}
    return [table.get(b) or chr(next(rest)) for b in range(256)]


class PieceCounter(dict):
    """piece -> number of tokens, filled on demand."""

    def __init__(self, spec: dict):
        super().__init__()
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        number = {token: i for i, token in enumerate(model["vocab"])}
        self.merges = {
            (number[a], number[b]): (rank, number[a + b])
            for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        }
        symbols = _byte_symbols()
        self.inner = [number[s] for s in symbols]
        self.last = [number[s + suffix] for s in symbols]

    def __missing__(self, piece: str) -> int:
        n = self.count(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n

    def count(self, raw: bytes) -> int:
        n = len(raw)
        symbol = [self.inner[b] for b in raw]
        symbol[-1] = self.last[raw[-1]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges, heap = self.merges, []
        for i in range(n - 1):
            found = merges.get((symbol[i], symbol[i + 1]))
            if found:
                heap.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        heapq.heapify(heap)
        merged = 0
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i] if symbol[i] == left else n
            if j >= n or symbol[j] != right:
                continue  # one of the two has been merged since
            merged += 1
            symbol[i], symbol[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                found = merges.get((new, symbol[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, new, symbol[k], found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((symbol[h], new))
                if found:
                    heapq.heappush(heap, (found[0], h, symbol[h], new, found[1]))
        return n - merged


def make_counter(spec_text: str) -> Callable[[str], int]:
    """The function text -> number of tokens for a vocabulary file of the kind 'BPE with word ends'."""
    spec = json.loads(spec_text)
    counts = PieceCounter(spec)
    special = [t["content"] for t in spec.get("added_tokens", []) if not t.get("normalized")]
    cut_special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
    mark = os.path.commonprefix(special)  # '' if they have none; then every text is cut
    split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    # White space of the file's pattern language: not U+001C to U+001F, which Python's \s has.
    pieces = regex.compile(split["pattern"]["Regex"].replace("\\s", "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000")).findall

    def plain(text: str) -> int:
        if not text.isascii():
            # The file lower-cases each character by itself: no final sigma.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return sum(map(counts.__getitem__, pieces(text.lower())))

    def count(text: str) -> int:
        if cut_special is None or mark not in text:
            return plain(text)
        parts = cut_special.split(text)
        return len(parts) - 1 + sum(plain(p) for p in parts if p)

    return count


def count_tokens(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Bytes and tokens of each text.

    ``vocabulary`` is the path of the vocabulary file on the driver; its content goes to the tasks
    with the function (under 2 MB, whatever the input).  Returns ``id_col``, n_bytes, n_tokens and
    over_limit (n_tokens > ``limit``), one row per input row.

    Null and empty texts have 0 bytes and 0 tokens.  Texts are counted whole, however long.
    Repeated rows give repeated results, a null id stays null, an empty table gives none, and
    columns other than the two named are not read.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec_text = f.read()
    held = df.sparkSession.sparkContext.broadcast(spec_text)
    added = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def make():
        count = make_counter(held.value)

        def each(text):
            n = count(text) if text else 0
            return (len(text.encode("utf-8", "surrogatepass")) if text else 0, n, n > limit)

        return each

    return map_texts(df, [id_col], text_col, added, make)
