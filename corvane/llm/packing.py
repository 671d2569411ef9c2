"""Best-fit packing of tokenised documents into sequences, improved by a swap-based local search.

1. Documents are tokenised once; a document longer than a sequence is cut, its first piece taking what is over. A piece that is full is a sequence.
2. The others are dealt into groups of about ``group`` pieces. A group is packed best-fit, longest first. Then underfull bins trade: a bin
   gives pieces to fuller ones, one for nothing, one for one, two for one or one for two, wherever that raises the sum of squared
   fills, which drains the emptiest bins until they are gone. Trades go on until none is left; squared fill is a growing, bounded integer.
3. Bins still underfull are dealt into new groups and trade again, as whole bins, until one group holds them all, a round empties
   none, or no packing could have fewer bins.

Groups are dealt by a hash of a row's place in the written table of pieces, so a repeated or frequent id is no hot key, and a
lost executor's tasks give the same bins again. Only a row of numbers a piece is shuffled, never ids or texts.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, extend

#: Runs of white space from here on are left to the tokenizers library, as the other one's pattern recurses on them.
_LONG_RUN = re.compile(r"\s{1000}")
_FAR = 1 << 20


class ByteBpe:
    """Ids exactly as ``tokenizers`` gives them for a byte-level BPE file, computed by tiktoken where that is provably the same.

    Tiktoken merges the neighbours whose union has the lowest rank, tokenizers the pair that comes first in the list of merges. They
    differ only if some token can be reached from a pair that isn't its merge. That can't be if ids rise with the merges and the merges
    turn each token's own bytes into that one token: were p + q = t merged without a rule, t's bytes alone would come to p, q in the same steps
    and end there. ``provable`` checks this. Texts with a special token's string and with very long white space go to tokenizers.
    """

    def __init__(self, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(model.decode())
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte-level alphabet: these stand for themselves
        alphabet = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        self.vocabulary = self.slow.get_vocab(with_added_tokens=False)
        ranks = {bytes(alphabet[c] for c in word): i for word, i in self.vocabulary.items()}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def provable(self) -> bool:
        import json

        model = json.loads(self.slow.to_str())
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        ids = [self.vocabulary[a + b] for a, b in merges]
        plain = model["normalizer"] is None and model["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        rising = all(a < b for a, b in zip(ids, ids[1:]))
        return plain and rising and all(len(self.slow.model.tokenize(word)) == 1 for word in self.vocabulary)

    def encode(self, text: str, fast: bool = True) -> list[int]:
        if not fast or any(s in text for s in self.special) or _LONG_RUN.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_encoders: dict[str, ByteBpe] = {}


def encoder(model: bytes) -> ByteBpe:
    """The process's encoder of a model."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _encoders:
        _encoders[key] = ByteBpe(model)
    return _encoders[key]


def cut(length: int, most: int) -> list[int]:
    """Lengths of a document's pieces: what is over first, then full ones."""
    return ([length % most] if length % most else []) + [most] * (length // most)


class Bins:
    """Bins of one group: pieces by number, and units (subsets of a bin that could be taken out) as arrays to search in.

    A unit is (size, room of its bin, bin). Unit 0 of every bin is the empty one, so a plain move is an exchange for nothing. Units of
    a bin that has changed are dead (their room is far below zero); arrays are rebuilt when half is dead.
    """

    def __init__(self, lengths: list[int], most: int, bins: list[list[int]]):
        self.lengths, self.most, self.bins = lengths, most, bins
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.trades = 0

    @classmethod
    def best_fit(cls, lengths: list[int], most: int) -> Bins:
        """Longest first, each into the fullest bin that takes it. Rooms that occur are the bits of one integer."""
        by_room: dict[int, list[int]] = {}
        rooms, bins = 0, []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fits = rooms >> lengths[i]
            if fits:
                room = lengths[i] + (fits & -fits).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
                bins[b].append(i)
            else:
                room, b = most, len(bins)
                bins.append([i])
            room -= lengths[i]
            by_room.setdefault(room, []).append(b)
            rooms |= 1 << room
        return cls(lengths, most, bins)

    def least(self) -> int:
        return -(-sum(self.fill) // self.most)

    def count(self) -> int:
        return sum(map(bool, self.bins))

    def _index(self, kind: int) -> None:
        """Units of ``kind`` pieces (1 with the empty one, or 2) of all underfull bins."""
        rows = [(size, self.most - self.fill[b], b) for b in self.open_ for size in self._sizes(b, kind)]
        self.units[kind] = np.array(rows, np.int64).reshape(-1, 3).T.copy()
        self.dead[kind] = 0

    def _sizes(self, b: int, kind: int) -> set[int]:
        sizes = [self.lengths[i] for i in self.bins[b]]
        if kind == 1:
            return {0, *sizes}
        seen = set(sizes)
        twice = {s for s in seen if sizes.count(s) > 1}
        return {x + y for x, y in combinations(sorted(seen), 2)} | {2 * s for s in twice}

    def _best(self, size: int, source: int, kind: int):
        """(slack, bin, size taken back): the exchange of ``size`` from ``source`` that leaves the least room, among those that raise squared fill."""
        taken, room, b = self.units[kind]
        given = size - taken
        slack = room - given
        ok = (given > 0) & (slack >= 0) & (b != source) & (self.most - room + given > self.fill[source])
        if not ok.any():
            return None
        at = int(np.where(ok, slack, _FAR).argmin())
        return int(slack[at]), int(b[at]), int(taken[at])

    def _take(self, b: int, size: int, kind: int) -> list[int]:
        """Pieces of bin ``b`` that are a unit of this size."""
        if size == 0:
            return []
        own = self.bins[b]
        if kind == 1:
            return [next(i for i in own if self.lengths[i] == size)]
        return list(next(p for p in combinations(own, 2) if self.lengths[p[0]] + self.lengths[p[1]] == size))

    def _update(self, *changed: int) -> None:
        for kind in (1, 2):
            units = self.units[kind]
            gone = np.isin(units[2], changed) & (units[1] >= 0)
            units[1][gone] = -_FAR
            self.dead[kind] += int(gone.sum())
            rows = [(size, self.most - self.fill[b], b) for b in changed if b in self.open_ for size in self._sizes(b, kind)]
            self.units[kind] = np.concatenate([units, np.array(rows, np.int64).reshape(-1, 3).T], 1)
            if self.dead[kind] * 2 > self.units[kind].shape[1] > 256:
                self._index(kind)

    def _trade(self, source: int) -> bool:
        """The best exchange for one of the source's pieces or pairs; False if none raises squared fill."""
        for given_kind, taken_kinds in ((1, (1, 2)), (2, (1,))):
            found = None
            for size in sorted(self._sizes(source, given_kind) - {0}, reverse=True):
                for kind in taken_kinds:
                    best = self._best(size, source, kind)
                    if best and (found is None or best[0] < found[0][0]):
                        found = best, size, kind
                if found and found[0][0] == 0:
                    break
            if found:
                (_, target, back), size, kind = found
                out, into = self._take(source, size, given_kind), self._take(target, back, kind)
                self.bins[source] = [i for i in self.bins[source] if i not in out] + into
                self.bins[target] = [i for i in self.bins[target] if i not in into] + out
                for b in (source, target):
                    self.fill[b] = sum(self.lengths[i] for i in self.bins[b])
                    if self.fill[b] in (0, self.most):
                        self.open_.discard(b)
                self._update(source, target)
                self.trades += 1
                return True
        return False

    def improve(self) -> Bins:
        """Trade until no exchange raises squared fill, or there are as few bins as their tokens need. Emptiest bins give first."""
        self.open_ = {b for b, f in enumerate(self.fill) if 0 < f < self.most}
        self.units, self.dead = {}, {}
        for kind in (1, 2):
            self._index(kind)
        least, moving = self.least(), True
        while moving and self.count() > least:
            moving = False
            for b in sorted(self.open_, key=lambda b: (self.fill[b], b)):
                while b in self.open_ and self._trade(b):
                    moving = True
        return self

    def places(self) -> tuple[list[int], list[int], list[int]]:
        """For each piece: its bin's smallest piece, its offset there, and the bin's fill."""
        name, offset, fill = ([0] * len(self.lengths) for _ in range(3))
        for b, own in enumerate(self.bins):
            at = 0
            for i in sorted(own):
                name[i], offset[i], fill[i] = min(own), at, self.fill[b]
                at += self.lengths[i]
        return name, offset, fill


def pieces_of(docs: DataFrame, path: str, id_col: str, text_col: str, most: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: _id, piece, start, length, crc, and ids where they are to be kept."""
    with open(path, "rb") as file:
        model = file.read()
    fast = encoder(model).provable()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a file of bounded size, two megabytes here
    rows = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("_text"))

    def start():
        table = encoder(shared.value)

        def make(batch):
            out = []
            for text in batch["_text"].to_pylist():
                ids = np.array([*table.encode(text, fast), end_id], "<u4")
                at, made = 0, []
                for k, size in enumerate(cut(len(ids), most)):
                    part = ids[at : at + size]
                    made.append({"piece": k, "start": at, "length": size, "crc": zlib.crc32(part.tobytes())} | ({"ids": part.tolist()} if keep_ids else {}))
                    at += size
                out.append(made)
            return [out]

        return make

    found = extend(rows, f"p array<struct<piece: int, start: long, length: long, crc: long{', ids: array<int>' if keep_ids else ''}>>", start, slice_bytes=1 << 20)
    return found.select("_id", F.explode("p").alias("p")).select("_id", "p.*")


def _packed(most: int, whole_bins: bool):
    """A function of one group's rows that sets bin, offset and fill; with ``whole_bins``, it begins with the bins that the rows have."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table["_r"].to_numpy(), kind="stable")))
        rows, lengths = table["_r"].to_numpy(), table["length"].to_pylist()
        if whole_bins:
            members: dict[int, list[int]] = {}
            for i, b in enumerate(table["_bin"].to_pylist()):
                members.setdefault(b, []).append(i)
            bins = Bins(lengths, most, list(members.values()))
        else:
            bins = Bins.best_fit(lengths, most)
        name, offset, fill = bins.improve().places()
        for column, values in (("_bin", rows[name]), ("_offset", offset), ("_fill", fill)):
            table = table.set_column(table.schema.get_field_index(column), column, pa.array(values, pa.int64()))
        return table

    return run


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most: int = 1024, end_id: int = 2, group: int = 8192, rounds: int = 4, keep_ids: bool = False
) -> DataFrame:
    """One row for each piece of each row of ``docs``: id, piece, start, length, ids_crc32, sequence_id, offset; with ``keep_ids`` also ids.

    A null text counts as empty; it has the end id only and is one piece of length 1. Repeated rows and null ids are documents of their
    own. Only documents longer than ``most`` are cut. An empty table gives an empty result. Columns other than the two named are not
    read, so they may have any name. A sequence_id is the place of the sequence's first piece among all pieces, so ids are unique
    but not gapless. ``rounds`` bounds how often underfull bins are dealt anew; it changes how few sequences there are, never which pieces.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    made = pieces_of(docs, path, id_col, text_col, most, end_id, keep_ids).withColumn("_r", F.monotonically_increasing_id())
    made = scratch.table("pieces", made)  # with the numbers, so that they are the same at each read
    closed = made.filter(F.col("length") == most).withColumns({"_bin": F.col("_r"), "_offset": F.lit(0).cast("long"), "_fill": F.lit(most).cast("long")})
    state = made.filter(F.col("length") < most).withColumns({n: F.lit(0).cast("long") for n in ("_bin", "_offset", "_fill")})
    parts, tokens, bins = [closed], None, None
    for turn in range(rounds):
        n = state.count()
        groups = -(-n // group)
        if not n:
            break
        key = F.pmod(F.xxhash64(F.col("_bin") if turn else F.col("_r"), F.lit(turn)), F.lit(groups))
        state = scratch.table(f"round-{turn}", state.groupBy(key.alias("_g")).applyInArrow(_packed(most, turn > 0), state.schema))
        open_ = state.filter(F.col("_fill") < most)
        seen = open_.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"), F.coalesce(F.sum((F.col("_offset") == 0).cast("int")), F.lit(0)).alias("bins")).first()
        settled = groups == 1 or seen.bins <= -(-seen.tokens // most) or (seen.tokens, seen.bins) == (tokens, bins)
        tokens, bins = seen.tokens, seen.bins
        if settled or turn == rounds - 1:
            parts.append(state)
            break
        parts.append(state.filter(F.col("_fill") == most))
        state = open_
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    columns = [F.col("_id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("_bin").alias("sequence_id"), F.col("_offset").alias("offset")]
    return out.select(*columns, *["ids"] * keep_ids)
