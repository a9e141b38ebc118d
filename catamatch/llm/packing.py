"""Best-fit packing of token pieces by a configuration linear program.

Documents become pieces of at most ``LENGTH`` tokens.  Only the histogram of piece lengths, at
most ``LENGTH`` numbers whatever the corpus, goes to the driver.  There the covering program over
configurations (multisets of lengths that fit a sequence) is solved by multiplicative weights:
each round prices one configuration by a knapsack dynamic program over the current weights and
lowers the weights of the lengths it covers.  The solution is rounded down, and what is left is
packed by repeated best-fit patterns, each of which uses up at least one length.

The plan says which ranks of a length go to which sequences and offsets.  Ranks within a length
come from a running count dealt to parts, so a length with any share of the pieces is spread.

Defined results: a null or empty text is the end token alone; each row is packed, so rows that
repeat a doc_id are packed each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from catamatch.llm.common import map_slices, numbered, pieces_of, texts
from catamatch.operators.stage import written

LENGTH, END = 2048, 0
ROUNDS, RATE, LEAN, SLACK = 300, 0.5, 1.1, 0.001
CHUNK = 4096
KEPT_WORDS, KEPT_CHARS = 60_000, 64


#: The pattern by which this vocabulary splits text, written out for Latin-1.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
#: Outside of these characters, white space, letters and normal forms need the library's own rules.
_OTHER = re.compile(r"[^\t-\r -~\xa1-\xff]|<\|")


class Encoder(dict):
    """Ids of text parts as little-endian uint32 bytes; short parts are remembered.

    A Latin-1 text is lower-cased and split as the vocabulary says, and each distinct part goes
    through the merges once.  A text with any other character, or with a special token's string,
    goes through the whole tokenizer, chunk by chunk: its rules never look across a blank.
    A memory of ``KEPT_WORDS`` parts is set aside when it is full and asked before the merges, until the next
    one is full: parts in use return from it.  That of chunks is emptied.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.merges = self.tokenizer.model
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.forms = {c: as_bytes(chr(c))[0][0] for c in range(0x80, 0x100)}
        self.before: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        ids = self.before.get(part)
        if ids is None:
            form = part if part.isascii() else part.translate(self.forms)
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.merges.tokenize(form)])
        if len(part) <= KEPT_CHARS:
            if len(self) >= KEPT_WORDS:
                self.before = dict(self)
                self.clear()
            self[part] = ids
        return ids

    def chunk(self, chunk: str) -> bytes:
        ids = self.chunks.get(chunk)
        if ids is None:
            ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
            if len(chunk) <= KEPT_CHARS:
                if len(self.chunks) >= KEPT_WORDS:
                    self.chunks.clear()
                self.chunks[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if _OTHER.search(text):
            return b"".join(map(self.chunk, text.replace("\n", " ").split(" ")))
        return b"".join(map(self.__getitem__, _PARTS.findall(text.lower())))


@cache
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def token_pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian uint32): documents cut only above ``length``."""
    def run(cols):
        encode = encoder(vocabulary).ids
        out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids": []}
        tail = np.array([end], "<u4").tobytes()
        for doc, text in zip(cols["doc_id"], cols["text"]):
            ids = encode(text.decode()) + tail
            for i, at in enumerate(range(0, len(ids), 4 * length)):
                part = ids[at:at + 4 * length]
                for k, v in zip(out, (doc, i, at // 4, len(part) // 4, part)):
                    out[k].append(v)
        return out

    return map_slices(texts(docs), run, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


def price(values: np.ndarray, room: int) -> np.ndarray:
    """Knapsack: the counts per length 1..room of the best-valued multiset that fits ``room``.

    values[l] is the value of one piece of length l; lengths of no value are not used, and of
    equally good choices the longest piece is taken.
    """
    lengths = np.flatnonzero(values[:room + 1] > 0)[::-1]
    best, last = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    worth, skip = values[lengths], np.searchsorted(-lengths, -np.arange(room + 1))
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if skip[c] < len(lengths):
            sums = best[c - lengths[skip[c]:]] + worth[skip[c]:]
            i = int(sums.argmax())
            if sums[i] > best[c]:
                best[c], last[c] = sums[i], lengths[skip[c] + i]
    counts, c = np.zeros(room + 1, np.int64), room
    while c > 0:
        if last[c]:
            counts[last[c]] += 1
            c -= last[c]
        else:
            c -= 1
    return counts


def weigh(demand: np.ndarray, room: int, rounds: int, rate: float) -> list[tuple[np.ndarray, float]]:
    """Fractional configurations by multiplicative weights on the covering constraints.

    A length's weight starts at its share of the tokens, a little more for long pieces, which are
    the hard ones to place, and falls with the share of its pieces that is covered.
    """
    need = demand.astype(float)
    present = demand > 0
    size = np.arange(room + 1) / room
    weight = np.where(present, need * size ** LEAN, 0.0)
    covered, out = np.zeros(room + 1), {}
    for _ in range(rounds):
        values = np.divide(weight, need, out=np.zeros(room + 1), where=present & (covered < 1 - 1e-9))
        if not values.any():
            break
        config = np.minimum(price(values, room), demand)
        used = config > 0
        step = float((need[used] * (1 - covered[used]) / config[used]).min())
        gain = step * config[used] / need[used]
        covered[used] += gain
        weight[used] *= np.exp(-rate * gain)
        key = config.tobytes()
        out[key] = out.get(key, 0.0) + step
    return [(np.frombuffer(k, np.int64), x) for k, x in out.items()]


def fill(left: np.ndarray, room: int) -> np.ndarray:
    """Best-fit pattern: the longest piece left and the multiset of others that fills most of the rest."""
    config = np.zeros(room + 1, np.int64)
    longest = int(np.flatnonzero(left)[-1])
    config[longest] = 1
    free = room - longest
    reach, steps = 1, []  # bit i: the sum i can be made
    for length in np.flatnonzero(left[:free + 1])[::-1].tolist():
        n = min(int(left[length] - config[length]), free // length)
        take = 1
        while n > 0 and not reach >> free & 1:
            take = min(take, n)
            steps.append((length, take, reach))
            reach = (reach | reach << length * take) & (1 << free + 1) - 1
            n -= take
            take *= 2
    total = reach.bit_length() - 1
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            config[length] += take
            total -= length * take
    return config


def plan(histogram: dict[int, int], room: int = LENGTH, rounds: int = ROUNDS, rate: float = RATE) -> list[tuple[np.ndarray, int]]:
    """Whole configurations with multiplicities that hold exactly the pieces of the histogram.

    Rounding takes the whole part of each configuration's amount; a configuration that leaves more
    than ``SLACK`` of a sequence free is not worth repeating and is left to the patterns.
    """
    left = np.zeros(room + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    sizes, out = np.arange(room + 1), []
    if left[room]:
        out.append((np.eye(1, room + 1, room, dtype=np.int64)[0], int(left[room])))
        left[room] = 0
    for config, x in weigh(left, room, rounds, rate):
        used = config > 0
        times = min(int(x + 1e-9), int((left[used] // config[used]).min()))
        if times and config @ sizes >= (1 - SLACK) * room:
            out.append((config, times))
            left -= times * config
    while left.any():
        config = fill(left, room)
        used = config > 0
        times = int((left[used] // config[used]).min())
        out.append((config, times))
        left -= times * config
    return out


def places(configs: list[tuple[np.ndarray, int]]) -> pd.DataFrame:
    """For each length and first rank: sequence, pieces a sequence, offset of the first one."""
    rows, taken, base = [], {}, 0
    for config, times in configs:
        offset = 0
        for length in np.flatnonzero(config)[::-1].tolist():
            n = int(config[length])
            rows.append((length, taken.get(length, 0), base, n, offset))
            taken[length] = taken.get(length, 0) + n * times
            offset += n * length
        base += times
    return pd.DataFrame(rows, columns=["length", "first", "base", "each", "offset"]).sort_values(["length", "first"])


def pack(pieces: DataFrame, length: int = LENGTH, rounds: int = ROUNDS, chunk: int = CHUNK) -> DataFrame:
    """Adds sequence_id and offset to pieces with doc_id, piece and length; sequences are gapless."""
    pieces = written(pieces)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = places(plan(histogram, length, rounds))
    # at most (rounds + 2 * length) configurations of few lengths: bounded, whatever the corpus
    span = 1 << 44
    keys = (table["length"] * span + table["first"]).to_numpy(np.int64)
    first, base, each, offset = (table[c].to_numpy(np.int64) for c in ("first", "base", "each", "offset"))

    @pandas_udf("sequence_id bigint, offset bigint")
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, size.to_numpy() * span + rank.to_numpy(), "right") - 1
        r = rank.to_numpy() - first[at]
        return pd.DataFrame({"sequence_id": base[at] + r // each[at],
                             "offset": offset[at] + r % each[at] * size.to_numpy()})

    ranked = numbered(pieces, ["length"], ["doc_id", "piece"], F.lit(1).cast("bigint"), "__rank",
                      pieces_of(sum(histogram.values()), chunk))
    return ranked.withColumn("__at", place("length", "__rank")).select(
        *pieces.columns, F.col("__at.sequence_id").alias("sequence_id"), F.col("__at.offset").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids as one binary; a group holds at most ``LENGTH`` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.transform(parts, lambda p: F.hex(p["ids"])).alias("p")).select(
        "sequence_id", F.unhex(F.array_join("p", "")).alias("ids"))
