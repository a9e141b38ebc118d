"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs whose joined text is a piece, ordered by the piece's
score (the best first, the leftmost among equals).  The best pair is merged, its new neighbours enter
the agenda, and pairs whose symbols have changed since are passed over.  What is left in the end are
the pieces; a symbol that is none becomes its UTF-8 bytes where the model has byte pieces, else unknown.

A text is cut where no piece can reach across: before a blank mark that follows another character, if
no piece of the vocabulary holds such a pair.  Each part has an agenda of its own and its ids are
remembered.  The agendas of all new short parts of an Arrow batch advance together, one merge each a
round; longer parts keep theirs in a heap.

New parts are also encoded by the sentencepiece library, in one call a batch (whole texts where the
model's normalisation does more than mark blanks); ``agreed`` tells whether all parts of the text have
the library's ids.  Ids always come from the agenda.

Normalisation and decoding are the library's.  Models that are not of the merge type, or that hold
user-defined pieces, are refused.

Defined results: a null text is the empty one, which has no ids and decodes to the empty text; no text
is cut off, however long; rows that repeat a doc_id are encoded each; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from catamatch.llm.common import map_slices, texts

MARK = "▁"
#: Longest part whose agenda advances together with others and is remembered, and how many are.
SHORT, REMEMBERED = 40, 400_000
_MERGE_TYPE, _NORMAL, _USER_DEFINED = 2, 1, 4
_NO_RANK = np.int64(1) << 40


class Agenda:
    """Merges of one vocabulary: texts to ids."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.library = SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto.FromString(self.library.serialized_model_proto())
        if model.trainer_spec.model_type != _MERGE_TYPE:
            raise ValueError("the model is not of the merge type")
        if any(p.type == _USER_DEFINED for p in model.pieces):
            raise ValueError("the model has user-defined pieces")
        scores = {p.piece: p.score for p in model.pieces if p.type == _NORMAL}
        places = {s: i for i, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {p: places[s] for p, s in scores.items()}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces)}
        self.unknown = self.library.unk_id()
        self.bytes = [self.ids[f"<0x{b:02X}>"] for b in range(256)] if model.trainer_spec.byte_fallback else None
        across = not self.bytes or any(MARK in p.lstrip(MARK) for p in self.ranks)
        self.parts = re.compile(r"(?s).+" if across else f"{MARK}*[^{MARK}]+|{MARK}+")
        how = model.normalizer_spec
        self.plain = (not across and how.add_dummy_prefix and how.escape_whitespaces and not how.remove_extra_whitespaces
                      and not how.precompiled_charsmap and not model.trainer_spec.treat_whitespace_as_suffix)
        self._pairs()
        self.known: dict[str, tuple[bytes, bool]] = {}

    def _pairs(self) -> None:
        """Symbols are pieces and the other characters of pieces; each joinable pair has its rank and result."""
        symbols = {p: self.ids[p] for p in self.ranks}
        for c in sorted({c for p in self.ranks for c in p} - symbols.keys()):
            symbols[c] = len(self.ids) + len(symbols)
        self.width = len(self.ids) + len(symbols) + 1
        self.of_char = np.full(0x110000, self.width - 1, np.int64)
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        joins = sorted((symbols[p[:i]] * self.width + symbols[p[i:]], r, self.ids[p]) for p, r in self.ranks.items()
                       for i in range(1, len(p)) if p[:i] in symbols and p[i:] in symbols)
        self.keys, self.key_ranks, self.results = (np.array(x, np.int64) for x in zip(*joins))

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.key_ranks[at], _NO_RANK), self.results[at]

    def together(self, parts: list[str]) -> list[bytes]:
        """Ids of many short parts: in each round every part merges the best pair of its agenda."""
        out: list[bytes] = [b""] * len(parts)
        which, sizes = np.arange(len(parts)), np.array([len(p) for p in parts], np.int64)
        symbols = self.of_char[np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")]
        last = np.cumsum(sizes) - 1
        ranks, results = self._look(symbols, np.roll(symbols, -1))
        ranks[last] = _NO_RANK
        while len(which):
            starts = last - sizes + 1
            best = np.minimum.reduceat(ranks << np.int64(20) | (np.arange(len(symbols)) - np.repeat(starts, sizes)), starts)
            open_ = best >> np.int64(20) < _NO_RANK
            self._finish(parts, which[~open_], sizes[~open_], symbols[np.repeat(~open_, sizes)], out)
            at = starts[open_] + (best[open_] & 0xFFFFF)
            symbols[at] = results[at]
            keep = np.repeat(open_, sizes)
            keep[at + 1] = False
            gone = np.cumsum(~keep)
            at = at - gone[at]
            symbols, ranks, results = symbols[keep], ranks[keep], results[keep]
            which, sizes = which[open_], sizes[open_] - 1
            last = np.cumsum(sizes) - 1
            first = np.zeros(len(symbols), bool)
            first[last - sizes + 1] = True
            # the merged symbol has new pairs with both neighbours
            ends = np.zeros(len(symbols), bool)
            ends[last] = True
            for i in (at[~ends[at]], at[~first[at]] - 1):
                ranks[i], results[i] = self._look(symbols[i], symbols[i + 1])
            ranks[last] = _NO_RANK
        return out

    def _finish(self, parts: list[str], which: np.ndarray, sizes: np.ndarray, symbols: np.ndarray, out: list[bytes]) -> None:
        """Files the ids of parts without any pair left."""
        ends = np.cumsum(sizes)
        odd = np.maximum.reduceat(symbols, ends - sizes) >= len(self.ids) if len(which) else sizes
        raw = symbols.astype("<i4").tobytes()
        for i, lo, hi, other in zip(which.tolist(), (4 * (ends - sizes)).tolist(), (4 * ends).tolist(), odd.tolist()):
            out[i] = self.alone(parts[i]) if other else raw[lo:hi]  # other: some character is no piece

    def merged(self, part: str) -> list[str]:
        """The symbols that are left of a part when no pair can be merged any more."""
        symbols, ranks = list(part), self.ranks
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(ranks[p], i, p) for i, p in enumerate(map(str.__add__, symbols, symbols[1:])) if p in ranks]
        heapq.heapify(agenda)
        while agenda:
            _, left, pair = heapq.heappop(agenda)
            right = after[left]
            if right >= n or not symbols[left] or symbols[left] + symbols[right] != pair:
                continue  # one of them has been merged since
            symbols[left], symbols[right] = pair, ""
            follows = after[left] = after[right]
            if follows < n:
                before[follows] = left
                if (joined := pair + symbols[follows]) in ranks:
                    heapq.heappush(agenda, (ranks[joined], left, joined))
            if before[left] >= 0 and (joined := symbols[before[left]] + pair) in ranks:
                heapq.heappush(agenda, (ranks[joined], before[left], joined))
        return [s for s in symbols if s]

    def alone(self, part: str) -> bytes:
        """Ids of one part by a heap."""
        out, unknown_before = [], False
        for symbol in self.merged(part):
            found = self.ids.get(symbol, self.unknown)
            if found != self.unknown:
                out.append(found)
            elif self.bytes:
                out += [self.bytes[b] for b in symbol.encode()]
            elif not unknown_before:  # unknown symbols in a row are one piece
                out.append(found)
            unknown_before = found == self.unknown
        return np.array(out, "<i4").tobytes()

    def _learn(self, parts: list[str]) -> dict[str, tuple[bytes, bool]]:
        """Ids of parts, with the library's verdict where it can be asked about parts."""
        short = [p for p in parts if len(p) <= SHORT]
        found = dict(zip(short, self.together(short)))
        found.update((p, self.alone(p)) for p in parts if len(p) > SHORT)
        if not self.plain:
            return {p: (i, True) for p, i in found.items()}
        theirs = self.library.encode([p[1:].replace(MARK, " ") for p in found], num_threads=1)
        flat = np.fromiter(chain.from_iterable(theirs), "<i4").tobytes()
        ends = np.cumsum([4 * len(t) for t in theirs], dtype=np.int64).tolist()
        # a mark by itself ends a text that ends in a blank; the library can't be asked about it alone
        return {p: (i, p == MARK or i == flat[lo:hi]) for (p, i), lo, hi in zip(found.items(), [0, *ends], ends)}

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of every text and whether the library has the same."""
        if self.plain:
            cut = [self.parts.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        else:
            cut = [self.parts.findall(self.library.normalize(t)) for t in texts]
        known = self.known
        new = self._learn(list({p for parts in cut for p in parts if p not in known}))
        if len(known) + len(new) > REMEMBERED:
            new = {p: known[p] if p in known else new[p] for parts in cut for p in parts}
            known.clear()
        known.update(new)
        ids, agreed = [], []
        for parts in cut:
            found = [known[p] for p in parts]
            ids.append(np.frombuffer(b"".join([f[0] for f in found]), "<i4"))
            agreed.append(all([f[1] for f in found]))
        for p in new:
            if len(p) > SHORT:
                del known[p]
        if not self.plain:
            theirs = self.library.encode(texts, num_threads=1)
            agreed = [np.array_equal(a, np.array(b, np.int32)) for a, b in zip(ids, theirs)]
        return ids, agreed


@lru_cache(maxsize=2)
def agenda(path: str) -> Agenda:
    """One vocabulary a worker process."""
    return Agenda(path)


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (array<int>) and agreed of every row; ``model`` is a file that all executors have."""
    def run(cols):
        ids, agreed = agenda(model).encode([t.decode() for t in cols["text"]])
        return {"doc_id": cols["doc_id"], "ids": ids, "agreed": agreed}

    return map_slices(texts(docs), run, "doc_id bigint, ids array<int>, agreed boolean")


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """doc_id, ids and agreed with ``text``, the library's decoding of the ids."""
    def run(cols):
        return {**cols, "text": agenda(model).library.decode([i.tolist() for i in cols["ids"]], num_threads=1)}

    return map_slices(rows.select("doc_id", "ids", "agreed"), run, "doc_id bigint, ids array<int>, agreed boolean, text string")
