"""Chat formatting by token-level assembly.

Each turn's role and text are encoded apart, and reserved ids are spliced in
between them, so nothing that a text says can become a control token:

    <s> [ROLE] role [TEXT] text </s>

Control strings occurring in content are escaped by a backslash after their first
character, backslashes by another one, and the tokenizer's own space mark is
spelled ``\\_``; this also keeps the formatted text, in which the reserved ids are
written out, readable back.  A turn's segments have (length, under loss) each; the loss
mask over ids follows from the prefix sums of the lengths.

Turns of a conversation are processed in the order of turns (ties: by ids), in a stream
that holds one batch and the sums of the conversation at hand, however long it is.

Defined results: null text or role counts as empty; a null turn comes first; rows of a null
conv_id form one conversation; repeated rows are turns of their own; extra columns are
ignored; texts are taken whole; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.arrow import slices

BOS, EOS, ROLE, TEXT = "<s>", "</s>", "[ROLE]", "[TEXT]"
#: Strings that mean something to this template or to its usual relatives.
CONTROLS = [BOS, EOS, ROLE, TEXT, "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
SPACE_MARK = "▁"
_ESCAPE = re.compile("|".join(map(re.escape, ["\\", SPACE_MARK, *CONTROLS])))
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    def mark(m: re.Match[str]) -> str:
        s = m[0]
        return "\\\\" if s == "\\" else "\\_" if s == SPACE_MARK else f"{s[0]}\\{s[1:]}"

    return _ESCAPE.sub(mark, text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: SPACE_MARK if m[1] == "_" else m[1], text)


class Template:
    """Assembles turns into ids and reads them back."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = self.library.get_piece_size()
        #: Ids of the control strings: two of the model's own, two behind its vocabulary.
        self.ids = {BOS: self.library.bos_id(), EOS: self.library.eos_id(), ROLE: size, TEXT: size + 1}
        self.names = {i: s for s, i in self.ids.items()}

    def encode(self, segment: str) -> list[int]:
        return self.library.encode(escape(segment), num_threads=1)

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)

    def assemble(self, role: str, text: str) -> tuple[list[int], list[int], list[int]]:
        """Ids of a turn, and the loss spans: their starts and ends."""
        body = self.encode(text)
        segments = [([self.ids[BOS], self.ids[ROLE]], 0), (self.encode(role), 0), ([self.ids[TEXT]], 0), (body, int(role == "assistant")), ([self.ids[EOS]], 0)]
        ends = list(accumulate(len(s) for s, _ in segments))
        loss = [k for k, (s, under) in enumerate(segments) if under and s]
        return [i for s, _ in segments for i in s], [ends[k] - len(segments[k][0]) for k in loss], [ends[k] for k in loss]

    def read(self, ids: list[int], starts: list[int], ends: list[int]) -> tuple[str, str, str, str]:
        """Role, text, text under loss and formatted text of a turn, from its ids and spans alone."""
        shape = [k for k, i in enumerate(ids) if i in self.names]
        if [ids[k] for k in shape] != [self.ids[s] for s in (BOS, ROLE, TEXT, EOS)]:
            raise ValueError("not a turn of this template")
        role, text = (self.decode(ids[a + 1 : b]) for a, b in (shape[1:3], shape[2:4]))
        loss = "".join(unescape(text if [a - 1, b] == shape[2:4] else self.decode(ids[a:b])) for a, b in zip(starts, ends, strict=True))
        return unescape(role), unescape(text), loss, f"{BOS}{ROLE}{role}{TEXT}{text}{EOS}"


_templates: dict[str, Template] = {}


def template(model_file: str) -> Template:
    """One for each process and model."""
    if model_file not in _templates:
        _templates[model_file] = Template(model_file)
    return _templates[model_file]


def format_turns(df: DataFrame, model_file: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversation and turn with ids and loss_from, loss_to (spans of ids) for each row.  No shuffle."""
    conv, turn = (df.schema[c].dataType.simpleString() for c in (conv_col, turn_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = template(model_file)
        for whole in batches:
            for batch in slices(whole):
                made = [own.assemble(r or "", t or "") for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("turn"), *(pa.array([m[k] for m in made], pa.list_(pa.int32())) for k in range(3))], ["conv", "turn", "ids", "loss_from", "loss_to"])

    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"conv {conv}, turn {turn}, ids array<int>, loss_from array<int>, loss_to array<int>").withColumnsRenamed({"conv": conv_col, "turn": turn_col})


def digests(turns: DataFrame, model_file: str, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """One row for each conversation with digests of what is read back from its turns' ids and masks."""
    conv = turns.schema[conv_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now = template(model_file), None
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        conv_kind = None

        def give(done: list[list]) -> pa.RecordBatch:
            rows = [[key, n, turn.hexdigest(), loss, text.hexdigest(), chars] for key, n, turn, loss, text, chars in done]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), [conv_kind, *kinds], strict=True)], names)

        for whole in batches:
            for batch in slices(whole):
                done = []
                conv_kind = batch.column("conv").type
                for key, ids, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv", "ids", "loss_from", "loss_to")), strict=True):
                    if now is None or now[0] != key:
                        if now is not None:
                            done.append(now)
                        now = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    role, text, loss, formatted = own.read(ids, a, b)
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    now[3] += len(loss)
                    now[4].update(loss.encode("utf-8", "surrogatepass"))
                    now[5] += len(formatted)
                if done:
                    yield give(done)
        if now is not None:
            yield give([now])

    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), "ids", "loss_from", "loss_to")
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "turn", "ids")
    return dealt.mapInArrow(run, f"conv {conv}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("conv", conv_col)
