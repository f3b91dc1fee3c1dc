"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

The tokenizer is a sentencepiece BPE model with byte fallback.  No piece of such a model has a
word mark inside or before the end of another character run, and characters that are in no piece
stand alone as bytes, so no merge crosses a space or an unknown character: a text splits there into
segments that are tokenized independently.  ``PrefixCounter`` checks this on the model it is given.

Within a segment the table ``last[j]`` holds the last token of the encoding of the first j
characters.  The encoding of the first j characters is that of the first i plus one token t, for the
only t that ends at j and *agrees* with last[i]: the pair must itself encode as (last[i], t).  So the
count of each prefix is one more than that of a shorter one, and the last entry is the count of the
whole segment.  Prefix counts of a text are those of its segment plus the total before it; how many
tokens a cut text has, and where to cut for a budget, are look-ups and never a second encoding.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MARK = "▁"
#: bytes of segments, and pairs, that a Python worker keeps; a full table is dropped and begun again
CACHE_BYTES = 128 << 20
CACHE = 500_000
#: what an entry of a table takes beside its characters
ENTRY = 120
LIMIT = 4096


class _Counts(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make
        self.size = 0

    def __missing__(self, segment: str) -> int:
        n = self.make(segment)
        size = ENTRY + 4 * len(segment)
        if self.size + size > CACHE_BYTES:
            self.clear()
            self.size = 0
        if size <= CACHE_BYTES:
            self[segment] = n
            self.size += size
        return n


class PrefixCounter:
    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        sp = self.model
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in normal}
        pieces = self.score
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece of the model has a word mark after another character; segments would not be independent")
        if sp.encode(" a") == sp.encode("a") or len(sp.encode("a  b")) < len(sp.encode("a b")):
            raise ValueError("the model drops white space; only models that keep it are supported")
        #: what a piece can end with; a search for the last token goes back no further
        self.endings = {p[i:] for p in pieces for i in range(len(p))}
        self.agrees: dict[tuple[str, str], bool] = {}
        self.counts = _Counts(self._total)

    def _merged(self, text: str) -> list[str]:
        """Plain BPE: the best-scored neighbouring pair first, the leftmost of equals."""
        symbols = list(text)
        while True:
            best = None
            for i in range(len(symbols) - 1):
                s = self.score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best[0]):
                    best = (s, i)
            if best is None:
                return symbols
            i = best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]

    def _agree(self, left: str, right: str) -> bool:
        """Whether left and then right is the encoding of the two together; left may be empty."""
        known = self.agrees.get((left, right))
        if known is None:
            if len(self.agrees) >= CACHE:
                self.agrees.clear()
            known = self.agrees[left, right] = self._merged(left + right) == ([left, right] if left else [right])
        return known

    def prefixes(self, segment: str) -> list[int]:
        """Tokens of each prefix of a segment; entry 0 is the empty prefix."""
        counts, last = [0], [""]
        pieces, endings, known = self.score, self.endings, self.agrees.get
        for j in range(1, len(segment) + 1):
            i = j - 1
            t = segment[i]
            if t not in endings:  # in no piece: bytes
                counts.append(counts[i] + len(t.encode("utf-8", "replace")))
                last.append("")
                continue
            while True:
                if t in pieces or i == j - 1:
                    before = last[i]
                    ok = known((before, t))
                    if ok or ok is None and self._agree(before, t):
                        break
                i -= 1
                t = segment[i:j]
                if i < 0 or t not in endings:
                    raise ValueError(f"no token ends at {j} of {segment!r}")
            counts.append(counts[i] + (1 if t in pieces else len(t.encode("utf-8", "replace"))))
            last.append(t)
        return counts

    def _total(self, segment: str) -> int:
        return self.prefixes(segment)[-1]

    def segments(self, text: str) -> list[str]:
        """Segments of a text as the model sees it: a word mark first, spaces as marks; none if empty."""
        if not text:
            return []
        s = MARK + text.replace(" ", MARK)
        out = []
        for k, line in enumerate(s.split("\n")):
            if k:
                out.append("\n")
            if MARK * 2 in line:
                out += re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", line)
            else:
                head, *words = line.split(MARK)
                if head:
                    out.append(head)
                out += [MARK + w for w in words]
        return out

    def count(self, text: str) -> int:
        return sum(map(self.counts.__getitem__, self.segments(text)))

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of text[:k] for every k from 0 to len(text), without encoding any of them."""
        out, before, first = [0], 0, True
        for segment in self.segments(text):
            table = self.prefixes(segment)
            # the model's own leading mark is no character of the text
            out += [before + n for n in table[2 if first else 1 :]]
            first, before = False, before + table[-1]
        return out

    def cut(self, text: str, budget: int) -> int:
        """The most code points that stay within the budget of tokens, whatever comes between."""
        counts = self.prefix_counts(text)
        return max(k for k, n in enumerate(counts) if n <= budget)


@lru_cache(maxsize=4)
def counter(model_file: str) -> PrefixCounter:
    return PrefixCounter(model_file)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def count_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model", limit: int = LIMIT
) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    model is a name that ``public_tokenizers`` knows or a path that every executor can open.  Null
    texts count as empty: 0 bytes and 0 tokens.  Repeated rows each get a row; other columns of docs
    are not read.  No begin, end or special tokens are counted, and special strings in a text are
    ordinary characters.
    """

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(counter(model if "/" in model else model_path(model)).count)

    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        small_batches(docs).select(F.col(id_col), text.alias("_text"))
        .select(F.col(id_col), F.octet_length("_text").cast("long").alias("n_bytes"), tokens("_text").alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
    )


def token_budgets(docs: DataFrame, budgets: list[int], id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """id, n_tokens and cuts: for each budget the most code points of the text that fit in it.

    Null texts are empty, so that every cut is 0.
    """

    @F.pandas_udf("struct<n_tokens: long, cuts: array<long>>")
    def cuts(texts: pd.Series) -> pd.DataFrame:
        c = counter(model if "/" in model else model_path(model))
        rows = []
        for text in texts:
            counts = c.prefix_counts(text)
            rows.append((counts[-1], [max(k for k, n in enumerate(counts) if n <= b) for b in budgets]))
        return pd.DataFrame(rows, columns=["n_tokens", "cuts"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return small_batches(docs).select(F.col(id_col), cuts(text).alias("_c")).select(id_col, "_c.n_tokens", "_c.cuts")
