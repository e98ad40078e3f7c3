"""SentencePiece encoding with seeded merge-dropout, and lossless decoding."""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache, partial
from heapq import heapify, heappop, heappush
from itertools import chain, count, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from hindcast.llm.blocks import blocks, mixed, raw_texts

CACHE = 400_000
# Splits of a unit with up to so many dropped merges are remembered.
KEPT_DROPS = 2
# Units up to this length are merged by scanning a list of ranks, longer ones by an agenda.
SHORT_UNIT = 48
DRAWS = 1024
SPACE = "▁"
_FULL = 1 << 64
_NONE = float("inf")


class PieceModel:
    """A SentencePiece BPE vocabulary with byte fallback and no normalisation."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds, norm = proto.ModelProto.SentencePiece, model.normalizer_spec
        plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or norm.precompiled_charsmap or not plain:
            raise ValueError(f"not a BPE model that leaves text as it is: {path}")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.order = {p: -model.pieces[i].score for p, i in self.ids.items()}
        self.of_byte = [i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE]
        if len(self.of_byte) != 256:
            raise ValueError(f"no byte fallback: {path}")
        self.bytes_of = [p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        for byte, i in enumerate(self.of_byte):
            self.bytes_of[i] = bytes([byte])
        if any(SPACE in p.lstrip(SPACE) or "\n" in p[:-1] or "\n" in p[1:] for p in self.ids):
            raise ValueError(f"pieces cross word starts or line ends: {path}")
        # No piece goes on after a space sign that follows something else, nor across a line
        # end, nor from a letter or digit to one of `marks`. Such places cut a text into units
        # that are merged one by one, and that come back more often than words with their marks.
        crossed = {b for p in self.ids for a, b in pairwise(p) if a.isalnum()}
        marks = re.escape("".join(sorted(set(string.punctuation) - crossed)))
        plain = f"[^{SPACE}\n{marks}]"
        marked = rf"|(?<![^\W_])[{marks}]" if marks else ""
        self.units = re.compile(f"{SPACE}*[^{SPACE}\n](?:{plain}{marked})*|{SPACE}+|\n").findall

    def encode_unit(self, unit: str, dropout: int = 0, key: bytes = b"", drops: Sequence[int] = (), gap_after: Callable[[], int] | None = None) -> tuple[int, list[int]]:
        """Candidates and ids of one unit: merge by score, then from the left, without dropped merges.

        Candidates wait in an agenda. One that comes up while both its symbols still stand is
        counted, and skipped if its number is in ``drops`` or the hash of (key, unit, place,
        piece) is below ``dropout``. With ``gap_after``, the number of candidates from one dropped
        to the next, further ones are dropped from number ``drops[-1]`` on, which are added to ``drops``.
        """
        order = self.order
        symbols = list(unit)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            piece = symbols[i] + symbols[i + 1]
            rank = order.get(piece)
            if rank is not None:
                agenda.append((rank, i, i + 1, piece))
        heapify(agenda)
        salt = key + unit.encode() if dropout else b""
        met = 0
        while agenda:
            _, left, right, piece = heappop(agenda)
            if after[left] != right or symbols[left] is None or symbols[left] + (symbols[right] or "") != piece:
                continue
            met += 1
            if met - 1 in drops:
                if gap_after and met - 1 == drops[-1]:
                    drops.append(met + gap_after())
                continue
            if dropout and xxhash.xxh3_64_intdigest(b"%d %b %b" % (left, piece.encode(), salt)) < dropout:
                continue
            symbols[left], symbols[right] = piece, None
            follow = after[left] = after[right]
            if follow < n:
                before[follow] = left
                grown = piece + symbols[follow]
                if grown in order:
                    heappush(agenda, (order[grown], left, follow, grown))
            lead = before[left]
            if lead >= 0:
                grown = symbols[lead] + piece
                if grown in order:
                    heappush(agenda, (order[grown], lead, left, grown))
        return met, self._ids_or_bytes(symbol for symbol in symbols if symbol is not None)

    def encode_short(self, unit: str, drops: list[int], gap_after: Callable[[], int]) -> tuple[int, list[int]]:
        """`encode_unit` of a short unit, the same candidates in the same order.

        The next candidate is the first of the lowest ranks; a dropped one has no rank until a neighbour grows.
        ``drops`` holds rising numbers, one at least.
        """
        rank_of = self.order.get
        symbols = list(unit)
        ranks = [rank_of(a + b, _NONE) for a, b in pairwise(unit)]
        met, at, drop = 0, 0, drops[0]
        while ranks:
            rank = min(ranks)
            if rank == _NONE:
                break
            i = ranks.index(rank)
            met += 1
            if met > drop:
                ranks[i] = _NONE
                at += 1
                if at == len(drops):
                    drops.append(met + gap_after())
                drop = drops[at]
                continue
            piece = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(piece + symbols[i + 1], _NONE)
            if i:
                ranks[i - 1] = rank_of(symbols[i - 1] + piece, _NONE)
        ids = self.ids
        try:
            return met, [ids[symbol] for symbol in symbols]
        except KeyError:
            return met, self._ids_or_bytes(symbols)

    def _ids_or_bytes(self, symbols: Iterable[str]) -> list[int]:
        out = []
        for symbol in symbols:
            i = self.ids.get(symbol)
            if i is None:
                out.extend(self.of_byte[b] for b in symbol.encode())
            else:
                out.append(i)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text whose encoding, under any dropout, is ``ids``."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode()[1:]


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


class _Units(dict):
    """Ids of the units met so far; forgets all of them when there are many."""

    def __init__(self, model: PieceModel, dropout: int, key: bytes):
        self.model, self.dropout, self.key = model, dropout, key

    def __missing__(self, unit: str) -> list[int]:
        if len(self) >= CACHE:
            self.clear()
        value = self[unit] = self.model.encode_unit(unit, self.dropout, self.key)[1]
        return value


class _Drops:
    """How many candidates pass before the next one dropped, again and again, from keyed hashes.

    A hash below the k-th threshold, (1 - rate) ** k of all hashes, lets k candidates pass.
    """

    def __init__(self, dropout: float):
        self.most = min(max(64, int(45 / dropout)), 65_536)
        part, shares = float(_FULL), []
        for _ in range(self.most):
            part *= 1 - dropout
            shares.append(min(int(part), _FULL - 1))
        self.thresholds = np.array(shares[::-1], np.uint64)

    def stream(self, key: int) -> Iterator[int]:
        passed, start = 0, np.uint64(key)
        for turn in count():
            places = np.arange(turn * DRAWS, (turn + 1) * DRAWS, dtype=np.uint64)
            hashes = mixed(mixed(mixed(start + mixed(places + np.uint64(1)))))
            for gap in (self.most - np.searchsorted(self.thresholds, hashes, "right")).tolist():
                passed += gap
                if gap < self.most:
                    yield passed
                    passed = 0


class _Splits(dict):
    """Splits of the units met so far, by the unit or by (unit, numbers of the candidates dropped): candidates and ids.

    Keys and splits are flat tuples, which the garbage collector need not follow. Forgets all of them when there are many.
    """

    def __init__(self, model: PieceModel, dropout: float):
        self.model, self.drops = model, _Drops(dropout)

    def keep(self, at: str | tuple, split: tuple[int, tuple[int, ...]]) -> None:
        if len(self) >= CACHE:
            self.clear()
        self[at] = split

    def draw(self, key: int) -> Callable[[list[str]], Iterator[Sequence[int]]]:
        """Encodes the units of one text, part by part. Each candidate of each is dropped or not by itself."""
        known_as, model = self.get, self.model
        gap_after = self.drops.stream(key).__next__
        gap = gap_after()

        def encode(units: list[str]) -> Iterator[Sequence[int]]:
            nonlocal gap
            for unit in units:
                split = known_as(unit)
                if split is not None and gap >= split[0]:
                    gap -= split[0]
                    yield split[1]
                    continue
                at, drops = unit, []
                while split is not None and gap < split[0]:
                    drops.append(gap)
                    gap += 1 + gap_after()
                    at = (unit, *drops)
                    split = known_as(at)
                if split is None:
                    # One run tells this place's split, whatever else is dropped in it.
                    known = len(drops)
                    drops.append(gap)
                    if len(unit) <= SHORT_UNIT:
                        n, ids = model.encode_short(unit, drops, gap_after)
                    else:
                        n, ids = model.encode_unit(unit, drops=drops, gap_after=gap_after)
                    gap = drops[-1]
                    if len(drops) == known + 1 <= KEPT_DROPS + 1:
                        self.keep(at, (n, tuple(ids)))
                else:
                    n, ids = split
                gap -= n
                yield ids

        return encode


class Encoder:
    """Encodes texts with one model, dropout rate and seed.

    Every candidate merge of every place of a text is dropped by itself, by a draw keyed by the
    seed, the name of the text, the text and the place. With ``variants``, a text falls under one
    of so many keys instead, by hash of its name, and under one key a unit (a word with the
    spaces before it) always splits alike.
    """

    def __init__(self, model: PieceModel, dropout: float = 0.0, seed: int = 0, variants: int | None = None):
        if not 0 <= dropout <= 1:
            raise ValueError("dropout is a rate from 0 to 1")
        self.model, self.seed = model, seed
        limit = min(int(dropout * _FULL), _FULL)
        self.splits = _Splits(model, dropout) if limit and variants is None else None
        self.known = [_Units(model, limit, b"%d %d " % (seed, v)) for v in range(variants if limit and variants else 1)]

    def encode(self, text: str, name: str = "") -> list[int]:
        if not text:
            return []
        if self.splits is None:
            at = xxhash.xxh3_64_intdigest(name, self.seed & (_FULL - 1)) % len(self.known)
            of_units = partial(map, self.known[at].__getitem__)
        else:
            of_units = self.splits.draw(xxhash.xxh3_64_intdigest(f"{self.seed} {len(name)} {name} {text}"))
        # A space sign in the text itself is written as bytes, else it would come back as a space.
        first, *rest = (part.replace(" ", SPACE) for part in text.split(SPACE))
        ids = list(chain.from_iterable(of_units(self.model.units(SPACE + first))))
        for part in rest:
            ids.extend(self.model.of_byte[b] for b in SPACE.encode())
            ids.extend(chain.from_iterable(of_units(self.model.units(part))))
        return ids


def encode_pieces(
    docs: DataFrame,
    path: str,
    dropout: float = 0.1,
    seed: int = 0,
    variants: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Piece ids of every text under the SentencePiece BPE model at ``path``.

    Returns ``doc_id, n_pieces, ids, lossless``, one row for each input row; ``lossless``
    says that decoding ``ids`` gives the text again. Merges are dropped anew at every place of every
    text, unless ``variants`` are asked for (:class:`Encoder`). The same seed gives the same ids in every
    run, on any partitioning. Null texts have null ``ids``, no pieces and null ``lossless``;
    empty texts have no pieces. Rows with the same id and text are encoded alike; other columns
    are not read. The model must be at ``path`` on every executor.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        encoder = Encoder(model, dropout, seed, variants)
        for batch in blocks(batches):
            texts = [x.decode() for x in raw_texts(batch)]
            names = batch.column("doc_id").to_pylist()
            null = batch.column("text").is_null().to_numpy(zero_copy_only=False)
            ids = [encoder.encode(text, str(name)) for text, name in zip(texts, names, strict=True)]
            same = [model.decode(i) == t for i, t in zip(ids, texts, strict=True)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())))
            ends = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, flat, mask=pa.array(null))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), lists, pa.array(same, mask=null)],
                ["doc_id", "n_pieces", "ids", "lossless"],
            )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, n_pieces long, ids array<int>, lossless boolean")


def decode_pieces(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts from ``ids``: ``doc_id, text``. Null ids give a null text; no ids an empty one."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            texts = [None if i is None else model.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].alias("ids"))
    return rows.mapInArrow(decode, "doc_id long, text string")
