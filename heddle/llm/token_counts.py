"""Token counts by prefix dynamic programming.

A byte-pair encoding is settled locally: a sequence of pieces is the encoding of
its text exactly if every two neighbours are the encoding of their own text.  So
the last piece of each prefix follows from the last pieces of shorter prefixes,
and ``count[i] = count[i - len(last[i])] + 1`` holds the exact count for every
prefix.  The vocabulary has no piece with a space mark after another character,
so encodings never reach over the start of a word: the table of a text is the
running sum over its words plus the table of one word, and the tables of words
are shared between texts.

Defined results: a null or empty text has 0 tokens; rows with a null id, repeated
rows and extra columns pass through one row for one row; an empty table gives an
empty result; texts of any length are taken whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.arrow import slices, texts_of

MARK = "▁"
#: Words with the space marks before them, line feeds, and marks with nothing behind.
_PARTS = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
#: Words whose totals a process holds, and prefixes of HEAD characters whose tables it holds.
MEMO_WORDS, MEMO_HEADS, HEAD = 700_000, 150_000, 6


class PieceBpe:
    """Prefix counts for a sentencepiece BPE model with byte fallback."""

    def __init__(self, model_file: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.score: dict[str, float] = {}
        for i in range(library.get_piece_size()):
            if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i)):
                self.score[library.id_to_piece(i)] = library.get_score(i)
        self.longest = max(map(len, self.score))
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece reaches over the start of a word; words can't be counted apart")
        #: Pieces that are the encoding of their own text; no other can be a last piece.
        self.standing = {p for p in self.score if self._merged(p) == [p]}
        self._fit: dict[tuple[str, str], bool] = {}
        self._heads: dict[str, tuple[list[str | None], list[int]]] = {}

    def _merged(self, s: str) -> list[str]:
        """Pieces of a short text: the best-scored neighbours merge first, then the leftmost."""
        parts = list(s)
        while True:
            joins = [(-self.score[j], k) for k, j in enumerate(map(str.__add__, parts, parts[1:])) if j in self.score]
            if not joins:
                return parts
            k = min(joins)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _fits(self, left: str, right: str) -> bool:
        if len(self._fit) > 500_000:
            self._fit.clear()
        known = self._fit[left, right] = self._merged(left + right) == [left, right]
        return known

    def _extend(self, part: str, last: list[str | None], count: list[int]) -> None:
        """Carry the table of a prefix on to the whole part."""
        score, standing, fit, longest = self.score, self.standing, self._fit, self.longest
        for end in range(len(count), len(part) + 1):
            char = part[end - 1]
            if char not in score:  # bytes; these never merge
                last.append(None)
                count.append(count[-1] + len(char.encode("utf-8", "surrogatepass")))
                continue
            for start in range(end - longest if end > longest else 0, end):
                piece = part[start:end]
                if piece in standing:
                    before = last[start]
                    if before is not None:
                        fits = fit.get((before, piece))
                        if not (self._fits(before, piece) if fits is None else fits):
                            continue
                    last.append(piece)
                    count.append(count[start] + 1)
                    break
            else:
                raise AssertionError(f"no last piece for {part[:end]!r}")

    def table(self, part: str) -> list[int]:
        """Counts for the prefixes of a part of 0, 1, ... characters; words with one beginning share its table."""
        if len(part) <= HEAD:
            last, count = [None], [0]
        else:
            head = self._heads.get(part[:HEAD])
            if head is None:
                if len(self._heads) > MEMO_HEADS:
                    self._heads.clear()
                head = self._heads[part[:HEAD]] = ([None], [0])
                self._extend(part[:HEAD], *head)
            last, count = head[0].copy(), head[1].copy()
        self._extend(part, last, count)
        return count


class TokenCounter:
    """Whole-text answers from the tables of words."""

    def __init__(self, model_file: str):
        self.bpe = PieceBpe(model_file)
        bpe = self.bpe

        class Totals(dict):
            def __missing__(self, part: str) -> int:
                total = self[part] = bpe.table(part)[-1]
                return total

        self.totals = Totals()

    @staticmethod
    def parts(text: str) -> list[str]:
        """Parts of the text as the model sees it: a mark in front, marks for spaces."""
        return _PARTS.findall(MARK + text.replace(" ", MARK)) if text else []

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        if len(self.totals) > MEMO_WORDS:
            self.totals.clear()
        return sum(map(self.totals.__getitem__, self.parts(text)))

    def prefix_counts(self, text: str) -> list[int]:
        """The exact count for every prefix of 0, 1, ... characters of the text."""
        out, base = [], 0
        for part in self.parts(text):
            table = self.bpe.table(part)
            out += [base + n for n in table[1:]]
            base += table[-1]
        # the first of these is the mark in front, which an empty prefix hasn't
        return [0, *out[1:]]

    def longest_prefix(self, text: str, budget: int) -> int:
        """Characters of the longest prefix with at most ``budget`` tokens."""
        parts, before, base = self.parts(text), [], 0
        for part in parts:
            before.append(base)
            base += self.totals[part]
        if base <= budget:
            return len(text)
        end = sum(map(len, parts))
        for part, base in zip(reversed(parts), reversed(before), strict=True):
            end -= len(part)
            if base < budget:
                table = self.bpe.table(part)
                for k in range(len(part), 0, -1):
                    if base + table[k] <= budget and end + k > 1:
                        return end + k - 1
        return 0


_counters: dict[str, TokenCounter] = {}


def counter(model_file: str) -> TokenCounter:
    """One for each process and model."""
    if model_file not in _counters:
        _counters[model_file] = TokenCounter(model_file)
    return _counters[model_file]


def count_tokens(df: DataFrame, model_file: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, n_bytes, n_tokens, over_limit and budget_chars for each row.

    ``budget_chars`` is the length in characters of the longest prefix with at
    most ``budget`` tokens, read off the prefix tables.  No shuffle.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_file)
        for whole in batches:
            for batch in slices(whole):
                texts = texts_of(batch)
                n = [own.count(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        batch.column("n_bytes"),
                        pa.array(n, pa.int64()),
                        pa.array([k > budget for k in n], pa.bool_()),
                        pa.array([len(t) if k <= budget else own.longest_prefix(t, budget) for t, k in zip(texts, n, strict=True)], pa.int64()),
                    ],
                    ["id", "n_bytes", "n_tokens", "over_limit", "budget_chars"],
                )

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, budget_chars long").withColumnRenamed("id", id_col)
