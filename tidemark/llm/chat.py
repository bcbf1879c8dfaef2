"""Chat formatting (2): token-budgeted windows of whole turns.

Turns are rendered and tokenized once; prefix sums of their token counts then
choose each window by bisection: as many whole turns as the budget holds beside
the system turns, which every window repeats, and a limited history of the
turns before, which is repeated for context.  Every turn is new in one window
only, and only the new turns of the assistant are targets: what is repeated is
masked, so no target is learned twice.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, ready
from .near_dedup import _runs

#: A byte-level BPE: ranks of tokens (.tiktoken) or a tokenizer file (.json). Every executor must have it.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE vocabularies of this kind cut texts to pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokens of an Arrow batch, about.
TOKENS = 1 << 20
#: Tokens of a window; most turns that are repeated as history, and their most tokens as a share of what the system turns leave.
BUDGET, HISTORY, HISTORY_SHARE = 2048, 4, 0.25
SCHEMA = "conv_id long, window int, first_turn long, last_turn long, history_turns int, n_tokens int, n_targets int, over_budget boolean, text string, input_ids array<int>, loss_mask array<int>"
_tokenizers: dict = {}


def tokenizer(path: str) -> tuple[Callable[[list[str]], list[list[int]]], Callable[[list[int]], str]]:
    """(encode texts, decode ids); the names of special tokens in a text are ordinary text."""
    if path not in _tokenizers:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            own = (lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]), lambda ids: t.decode(ids, skip_special_tokens=False)
        else:
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            t = tiktoken.Encoding(path, pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
            own = (lambda texts: [t.encode_ordinary(x) for x in texts]), t.decode
        _tokenizers[path] = own
    return _tokenizers[path]


def render(role: str, text: str) -> tuple[str, str]:
    """(head, body) of a turn; an assistant's body, with the end mark, is what is learned."""
    return f"<|im_start|>{role}\n", f"{text}<|im_end|>\n"


class Span(NamedTuple):
    """A window: history from..new..end, as indices of turns after the system's."""

    history: int
    new: int
    end: int
    over: bool


def spans(counts: list[int], room: int, history: int = HISTORY, share: float = HISTORY_SHARE) -> Iterator[Span]:
    """Windows over turns with so many tokens each; a turn that is over the room has a window of its own."""
    sums = [0, *accumulate(counts)]
    i = 0
    while i < len(counts):
        h = i
        while h > 0 and i - h < history and sums[i] - sums[h - 1] <= share * room and sums[i + 1] - sums[h - 1] <= room:
            h -= 1
        end = bisect_right(sums, sums[h] + room) - 1
        if end <= i:
            yield Span(i, i, i + 1, True)
            i += 1
        else:
            yield Span(h, i, end, False)
            i = end


def windows(turns: list[tuple[int, str, str]], path: str = TOKENIZER, budget: int = BUDGET, history: int = HISTORY) -> Iterator[tuple]:
    """Rows of SCHEMA, without conv_id, of one conversation's (turn, role, text), in order."""
    parts = [render(role, text) for _, role, text in turns]
    encode, _ = tokenizer(path)
    ids = encode([x for p in parts for x in p])
    tokens = [ids[2 * k] + ids[2 * k + 1] for k in range(len(turns))]
    lead = 0
    while lead < len(turns) and turns[lead][1] == "system":
        lead += 1
    system = [t for k in range(lead) for t in tokens[k]]
    # A conversation of system turns only is one window.
    chosen = list(spans([len(t) for t in tokens[lead:]], max(0, budget - len(system)), history)) or [Span(0, 0, 0, len(system) > budget)]
    for number, s in enumerate(chosen):
        out, mask = list(system), [0] * len(system)
        for k in range(lead + s.history, lead + s.end):
            learned = k >= lead + s.new and turns[k][1] == "assistant"
            out += tokens[k]
            mask += [0] * len(ids[2 * k]) + [int(learned)] * len(ids[2 * k + 1])
        shown = [*range(lead), *range(lead + s.history, lead + s.end)]
        first = turns[min(lead + s.new, len(turns) - 1)][0]
        last = turns[max(lead + s.end - 1, 0)][0]
        yield number, first, last, s.new - s.history, len(out), sum(mask), s.over, "".join(x for k in shown for x in parts[k]), out, mask


def chat_windows(conversations: DataFrame, path: str = TOKENIZER, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Training windows of all conversations, with token ids and loss mask.

    Turns go by number, ties by role and text; turns that repeat stay.  Rows
    without conv_id or turn are left out; a missing role is user, a missing text
    empty.  Only system turns at the start are repeated; later ones are turns
    like others.  A turn longer than the room is kept whole in a window of its
    own, marked over_budget, as is any window whose system turns are over it.
    An empty table has no windows; other columns aren't looked at, whatever their names.
    """
    spark = ready(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("conv_id IS NOT NULL AND turn IS NOT NULL")
    keys = ["conv_id", "turn", "role", "text"]
    rows = rows.repartition(partitions(spark), "conv_id").sortWithinPartitions(*keys)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    def build(batches):
        held, size = [], 0
        for t in _runs(batches, ["conv_id"]):
            conv = t["conv_id"][0].as_py()
            turns = list(zip(t["turn"].to_pylist(), t["role"].to_pylist(), t["text"].to_pylist()))
            for w in windows(turns, path, budget, history):
                held.append((conv, *w))
                size += w[4]
                if size >= TOKENS:
                    yield batch(held)
                    held, size = [], 0
        if held:
            yield batch(held)

    return rows.mapInArrow(build, SCHEMA)
