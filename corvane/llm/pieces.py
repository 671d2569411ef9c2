"""SentencePiece encoding and decoding with a distinct-chunk table.

A piece of the vocabulary never holds a whitespace marker after another character, and merges are local,
so a text can be cut before each run of markers and each chunk segmented by itself. ``cuts_at_markers``
checks that of a model; other models are refused. The texts of an Arrow slice become one list of chunks; its
distinct chunks are looked up in the table, those it lacks are segmented, once, and the entries (ids as decimal text, and the
decoded text where it isn't the chunk's own) join back by position. A worker process keeps its table for all its tasks. A table that would grow beyond ``table_chunks`` begins
anew with the slice's own chunks, so memory stays bounded; a table of the whole corpus would grow with it and need a shuffle of every word.
"""

from __future__ import annotations

import hashlib
import itertools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import extend

MARK = "▁"
_RUNS = re.compile(f"{MARK}+[^{MARK}]*")
_processors: dict[str, object] = {}


def processor(model: bytes):
    """The model's processor, loaded once in each Python worker."""
    import sentencepiece

    key = hashlib.sha256(model).hexdigest()
    if key not in _processors:
        _processors[key] = sentencepiece.SentencePieceProcessor(model_proto=model)
    return _processors[key]


def cuts_at_markers(sp) -> bool:
    """Whether no piece crosses from a character to a marker, and markers are put in front and kept."""
    whole = all(MARK not in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.vocab_size()))
    return whole and sp.encode("a", out_type=str)[0].startswith(MARK) and sp.decode(sp.encode("  a  b ")) == "  a  b "


class Chunks:
    """The table of distinct chunks: the ids of each as decimal text, and the decoded text of those that don't decode to themselves."""

    def __init__(self, model: bytes, table_chunks: int):
        self.sp, self.most = processor(model), table_chunks
        self.ids: dict[str, str] = {}
        self.changed: dict[str, str] = {}
        self.segmented = 0

    def add(self, chunks: set[str]) -> None:
        """Segment the chunks that the table lacks. A chunk begins with at least one marker, which the library adds."""
        new = [c for c in chunks if c not in self.ids]
        if len(self.ids) + len(new) > self.most:
            self.ids.clear(), self.changed.clear()
            new = list(chunks)
        self.segmented += len(new)
        if MARK in chunks and MARK not in self.ids:  # the library adds no marker to an empty text
            new.remove(MARK)
            self.ids[MARK] = str(self.sp.piece_to_id(MARK))
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            for chunk, ids in zip(part, self.sp.encode([c[1:] for c in part], num_threads=1), strict=True):
                self.ids[chunk] = " ".join(map(str, ids))
                if (text := " " + self.sp.decode(ids)) != chunk.replace(MARK, " "):
                    self.changed[chunk] = text

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """For each text, its ids as decimal text without the end id, and its decoded text."""
        chunks = [_RUNS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self.add(set(itertools.chain.from_iterable(chunks)))
        out = []
        for text, part in zip(texts, chunks, strict=True):
            if self.changed.keys().isdisjoint(part):
                decoded = text.replace(MARK, " ")
            else:
                decoded = "".join([self.changed.get(c) or c.replace(MARK, " ") for c in part])[1:]
            out.append((" ".join(map(self.ids.__getitem__, part)), decoded))
        return out


_tables: dict[tuple[str, int], Chunks] = {}


def table_of(model: bytes, table_chunks: int) -> Chunks:
    """The process's table for a model."""
    key = hashlib.sha256(model).hexdigest(), table_chunks
    if key not in _tables:
        _tables[key] = Chunks(model, table_chunks)
    return _tables[key]


def encode_documents(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, keep: tuple[str, ...] = (), table_chunks: int = 150_000
) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256 and the columns of ``keep``.

    Ids end with the model's end id. A null text counts as empty and has that id only. With
    ``with_ids`` the result also has ids (array<int>) and decoded (the decoded text). Repeated rows and
    null ids pass through; an empty table gives an empty result. Other columns are not read but for those of ``keep``, which may have
    any name that the result's own columns don't have. The model's file is read on the driver and its bytes (half a megabyte for the
    32k vocabulary) go to the tasks with the function.
    """
    with open(model_path, "rb") as file:
        model = file.read()
    if not cuts_at_markers(processor(model)):
        raise ValueError("pieces of this model can cross whitespace markers")
    end = str(processor(model).eos_id())
    rows = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("_text"), *[docs[c].alias(f"_keep_{k}") for k, c in enumerate(keep)])

    def start():
        table = table_of(model, table_chunks)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

        def make(batch):
            both = table.encode(batch["_text"].to_pylist())
            ids = [f"{a} {end}" if a else end for a, _ in both]
            out = [[x.count(" ") + 1 for x in ids], [sha(x) for x in ids], [sha(b) for _, b in both]]
            return out + ([[[int(i) for i in x.split(" ")] for x in ids], [b for _, b in both]] if with_ids else [])

        return make

    new = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    found = extend(rows, new, start, slice_bytes=2 << 20)  # a slice of chunks takes some thirty times its bytes
    return found.select(F.col("_id").alias(id_col), *[x.split()[0] for x in new.split(", ")], *[F.col(f"_keep_{k}").alias(c) for k, c in enumerate(keep)])
