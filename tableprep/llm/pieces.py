"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the vocabulary has a space marker behind another character, so merges never cross the start
of a marked word.  A text is therefore cut at its markers, every distinct chunk is segmented once per
task's table, and ids (and decoded surfaces) are joined back by the chunks' positions.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tableprep.llm.common import annotate

MARK = "▁"
TABLE_CHUNKS = 200_000  # a task's table starts anew beyond so many chunks
TABLE_CHARACTERS = 16 << 20  # or so many characters of chunks
CHUNKS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

OUTPUTS = "ids array<int>, decoded string"


class ChunkTable:
    """Distinct chunks with their ids and decoded surfaces; a chunk's own first marker is implied."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        crossing = [p for p in map(self.model.id_to_piece, range(self.model.get_piece_size())) if not self.fits(p)]
        if crossing:
            raise ValueError(f"pieces cross space markers, so words are not independent: {crossing[:3]}")
        if self.model.normalize("Åﬁ ①  x") != f"{MARK}Åﬁ{MARK}①{MARK}{MARK}x":
            raise ValueError("the model normalises texts; chunks need one that only marks spaces")
        self.lone = self.model.piece_to_id(MARK)
        if self.lone == self.model.unk_id():
            raise ValueError("the vocabulary has no lone space marker")
        self.clear()

    @staticmethod
    def fits(piece: str) -> bool:
        return bool(re.fullmatch(f"{MARK}*[^{MARK}]*", piece))

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.surfaces: list[str] = []
        self.characters = 0
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.ends = np.zeros(1 << 14, dtype=np.int64)

    def add(self, chunks: list[str]) -> None:
        # a lone marker is the empty chunk, which the library would not encode at all
        encoded = [ids if chunk else [self.lone] for chunk, ids in zip(chunks, self.model.encode(chunks, num_threads=1))]
        for chunk, surface in zip(chunks, self.model.decode(encoded, num_threads=1)):
            self.slots[chunk] = len(self.surfaces)
            self.surfaces.append(surface)
            self.characters += len(chunk)
        used, n = len(self.surfaces) - len(chunks), len(self.surfaces)
        if n > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(max(n, len(self.ends)), dtype=np.int64)])
        before = self.ends[used - 1] if used else 0
        self.ends[used:n] = before + np.cumsum([len(ids) for ids in encoded])
        if self.ends[n - 1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(int(self.ends[n - 1]), len(self.flat)), dtype=np.int32)])
        self.flat[before : self.ends[n - 1]] = np.fromiter((i for ids in encoded for i in ids), dtype=np.int32)

    @staticmethod
    def cut(text: str) -> list[str]:
        """The chunks of a text without their first marker."""
        if not text:
            return []
        if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [chunk[1:] for chunk in CHUNKS.findall(MARK + text.replace(" ", MARK))]

    def encode(self, texts: list[bytes | None]) -> tuple[pa.Array, list[str]]:
        cut = [self.cut((t or b"").decode("utf-8", "replace")) for t in texts]
        if len(self.slots) > TABLE_CHUNKS or self.characters > TABLE_CHARACTERS:
            self.clear()
        known = self.slots.keys()
        new = dict.fromkeys(c for chunks in cut for c in chunks if c not in known)
        if new:
            self.add(list(new))
        slots = np.fromiter((self.slots[c] for chunks in cut for c in chunks), dtype=np.int64)
        ends = self.ends[slots]
        starts = np.where(slots > 0, self.ends[slots - 1], 0)
        counts = ends - starts
        positions = np.cumsum(counts)
        total = int(positions[-1]) if len(positions) else 0
        ids = self.flat[np.arange(total) + np.repeat(starts - (positions - counts), counts)]
        words = np.cumsum([len(chunks) for chunks in cut])
        offsets = np.concatenate([[0], np.concatenate([[0], positions])[words]]).astype(np.int32)
        surfaces, at = self.surfaces, self.slots
        decoded = [" ".join([surfaces[at[c]] for c in chunks]) for chunks in cut]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), decoded


@lru_cache(maxsize=2)
def chunk_table(model: str) -> ChunkTable:
    return ChunkTable(model)


def encode_pieces(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``ids`` (no begin or end ids) and the ``decoded`` text.

    ``model`` is a path every executor has.  A null or empty text has no ids and decodes to the empty
    text; repeated rows are encoded one by one; a very long text without spaces is one chunk.  Columns
    of ``docs`` named like a result column are replaced.
    """

    def compute(texts):
        return chunk_table(model).encode(texts)

    return annotate(docs, text, OUTPUTS, compute)
