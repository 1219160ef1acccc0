"""Chat formatting on token level: segments encoded apart, reserved ids spliced, masks from prefix sums.

A turn becomes ``START role \\n text END \\n``.  START and END are reserved ids that no encoding of a text
can produce; in the readable form they are control strings, and control strings inside a text are escaped.
Each turn is a row of its own with its place in the conversation, so a conversation of any length is
spread over tasks.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tableprep.llm.common import annotate
from tableprep.operators.ordered import RANGE, running, with_ranges
from tableprep.session import written

START_TEXT, END_TEXT = "<|im_start|>", "<|im_end|>"
# A backslash goes between "<" and "|"; texts that have backslashes there already get one more.
OPENING, ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")

TURN = "ids array<int>, mask_start int, mask_stop int"
BACK = "role string, text string, loss_text string, formatted string"
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def escape(text: str) -> str:
    return OPENING.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role ends at the first line break, so its own are written out."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unfold(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], line)


def unescape_role(role: str) -> str:
    return unfold(unescape(role))


class Template:
    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.start = max(merges.values()) + 1
        self.end = self.start + 1

    def format(self, role: str, text: str) -> tuple[list[int], int, int]:
        """Ids of one turn, and the range of those that stand for its text."""
        encode = self.encoding.encode_ordinary
        header, content = encode(escape_role(role) + "\n"), encode(escape(text))
        ids = [self.start, *header, *content, self.end, *encode("\n")]
        return ids, 1 + len(header), 1 + len(header) + len(content)

    def plain(self, ids: list[int]) -> str:
        return self.encoding.decode_bytes(ids).decode("utf-8", "replace")

    def read(self, ids: list[int], mask: tuple[int, int] | None) -> tuple[str, str, str | None, str]:
        """Role, text, text under the mask, and the readable form, from the ids of one turn."""
        end = ids.index(self.end)
        role, _, text = self.plain(ids[1:end]).partition("\n")
        loss = None if mask is None else unescape(self.plain(ids[mask[0] : mask[1]]))
        readable = START_TEXT + role + "\n" + text + END_TEXT + self.plain(ids[end + 1 :])
        return unescape_role(role), unescape(text), loss, readable


@lru_cache(maxsize=2)
def template(ranks: str, pattern: str) -> Template:
    return Template(ranks, pattern)


def format_turns(conversations: DataFrame, ranks: str, pattern: str, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn: ``conv_id, turn, ids, ids_start, loss_start, loss_stop``.

    ``ids_start`` is the number of ids of the conversation before the turn (a prefix sum), the loss range
    counts from the start of the conversation and is null for turns of roles not in ``learned``.  Turns
    are ordered by (turn, role, text), nulls first, so ties and repeated rows have a defined order; null
    roles and texts are empty; a null conv_id is a conversation of its own.  Other columns are dropped.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    header = F.concat(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\n"), text)
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.sha2(text, 256).alias("digest"), header.alias("segment"),
    )

    def compute(segments):
        made = []
        for segment in segments:
            name, _, content = segment.decode("utf-8", "replace").partition("\n")
            made.append(template(ranks, pattern).format(unfold(name), content))
        return [list(column) for column in zip(*made)]

    order = ["turn", "role", "digest"]
    # ranges come from the plain turns, so that texts are encoded once
    ranged = with_ranges(turns, ["conv_id", *order])
    made = annotate(ranged, "segment", TURN, compute).drop("segment")
    made = written(made, "turns") if RANGE in made.columns else made
    stop = {"ids_stop": F.size("ids").cast("long")}
    placed = running(made, ["conv_id"], order, sums=stop, rows_per_range=None).withColumn("ids_start", F.col("ids_stop") - F.size("ids"))
    masked = F.col("role").isin(*learned)
    return placed.select(
        "conv_id", "turn", "role", "digest", "ids", "ids_start",
        F.when(masked, F.col("ids_start") + F.col("mask_start")).alias("loss_start"),
        F.when(masked, F.col("ids_start") + F.col("mask_stop")).alias("loss_stop"),
    )


def read_turns(turns: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """The turns of ``format_turns`` decoded: ``conv_id, turn, role, text, loss_text, formatted``."""
    keep = turns.select("conv_id", "turn", "digest", "ids", "ids_start", "loss_start", "loss_stop")
    back = StructType([*keep.schema, *StructType.fromDDL(BACK)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read, at = [], dict(zip(batch.schema.names, batch.columns))
            columns = (at[c].to_pylist() for c in ("ids", "ids_start", "loss_start", "loss_stop"))
            for ids, before, start, stop in zip(*columns):
                mask = None if start is None else (start - before, stop - before)
                read.append(template(ranks, pattern).read(ids, mask))
            made = [pa.array(list(c), type=pa.string()) for c in (zip(*read) if read else [[]] * 4)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *made], names=[*batch.schema.names, "role", "text", "loss_text", "formatted"]
            )

    return keep.mapInArrow(run, back).drop("ids", "ids_start", "loss_start", "loss_stop")


def conversation_digests(read: DataFrame) -> DataFrame:
    """Per conversation: turns, digests of all turns and of the text under the loss mask, characters.

    A digest over a whole conversation has to see its turns in order.  They pass as a sorted stream (sorted
    on disk where needed), so a task holds one batch and two hash states, never a conversation.
    """
    rows = read.select(
        "conv_id", "turn", "role", "digest", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("said"),
        "loss_text", F.length("formatted").alias("chars"),
    ).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state, done = None, []

        def close():
            conv, n, turns, loss_chars, loss, chars = state
            done.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def flush():
            columns = [pa.array(list(c), type=t) for c, t in zip(zip(*done) if done else [[]] * 6, types)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            at = dict(zip(batch.schema.names, batch.columns))
            for conv, said, loss, chars in zip(*(at[c].to_pylist() for c in ("conv_id", "said", "loss_text", "chars"))):
                if state is None or state[0] != conv:
                    if state is not None:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += 1
                state[2].update(said.encode())
                state[5] += chars
                if loss is not None:
                    state[3] += len(loss)
                    state[4].update(loss.encode())
            yield flush()
        if state is not None:
            close()
            yield flush()

    return rows.mapInArrow(run, DIGESTS)
