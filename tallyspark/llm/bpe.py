"""Byte-level BPE as a streaming transducer with bounded lookahead, and its incremental decoder."""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the split pattern of this family of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pieces kept in a worker's memo before it starts anew.
MEMO = 400_000
#: Ids decoded at a time.
STEP = 16_384


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Tokenizer:
    """One vocabulary.  encode() and decode() are streams; neither holds more than a bounded window."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in byte_letters().items()}
        raw = lambda s: bytes(to_byte[c] for c in s)
        vocab = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        pieces = []
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (m.split(" ") if isinstance(m, str) else m))
            self.rank[vocab[a], vocab[b]] = rank
            self.made.append(vocab[a + b])
            pieces.append((a, b))
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {v: k for k, v in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.lookahead = sufficient_lookahead(pieces)
        self.cut = regex.compile(SPLIT)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.memo: dict[str, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """The tokens of a short piece: the pair of the lowest rank first, leftmost among equals."""
        ids, rank, made, none = [self.single[b] for b in data], self.rank.get, self.made, len(self.made)
        ranks = [rank(pair, none) for pair in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            ids[i] = made[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), none)
        return ids

    def stream(self, data: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one piece that arrives in parts.

        What lies more than the lookahead before the end of the window can no
        longer change; it is emitted, and the window goes on from that token
        boundary, which no merge crosses.
        """
        window = b""
        for part in data:
            for at in range(0, len(part), 4 * self.lookahead):
                window += part[at : at + 4 * self.lookahead]
                end = 0
                for i in self.merge(window) if len(window) > 2 * self.lookahead else ():
                    if end + len(self.bytes_of[i]) > len(window) - self.lookahead:
                        break
                    end += len(self.bytes_of[i])
                    yield i
                window = window[end:]
        yield from self.merge(window)

    def piece(self, s: str) -> list[int]:
        ids = self.merge(s.encode("utf-8", "surrogatepass"))
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[s] = ids
        return ids

    def parts(self, text: str) -> Iterator[tuple[int, int, int | None]]:
        """Where the text between special tokens begins and ends, and each special token with its id."""
        at = 0
        for m in self.specials.finditer(text) if self.specials else ():
            yield at, m.start(), None
            yield m.start(), m.end(), self.special[m[0]]
            at = m.end()
        yield at, len(text), None

    def encode(self, text: str) -> Iterator[list[int]]:
        """Tokens as soon as they are stable.

        A short piece is stable where the next begins, and is remembered; what
        is longer goes through stream() in parts.  Nothing that grows with the
        text is held.
        """
        known, short = self.memo.get, self.lookahead // 4
        for begin, end, special in self.parts(text):
            if special is not None:
                yield [special]
                continue
            for m in self.cut.finditer(text, begin, end):
                s = m[0]
                if (ids := known(s)) is not None:
                    yield ids
                elif len(s) <= short:
                    yield self.piece(s)
                else:
                    yield from self._long(s)

    def _long(self, s: str) -> Iterator[list[int]]:
        some: list[int] = []
        for i in self.stream(s[k : k + 4096].encode("utf-8", "surrogatepass") for k in range(0, len(s), 4096)):
            some.append(i)
            if len(some) == STEP:
                yield some
                some = []
        yield some

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as its bytes become whole characters; bytes that are no UTF-8 give U+FFFD."""
        state, ids = codecs.getincrementaldecoder("utf-8")("replace"), iter(ids)
        while data := b"".join(map(self.bytes_of.__getitem__, islice(ids, STEP))):
            yield state.decode(data)
        yield state.decode(b"", True)

    def digests(self, text: str, keep: list[int] | None = None) -> tuple[int, str, str]:
        """How many tokens, the digest of their ids and that of the text decoded from them; keep takes the ids.

        Encoder and decoder run in step, STEP ids at a time.
        """
        n, ids_sha, text_sha = 0, hashlib.sha256(), hashlib.sha256()

        def passed() -> Iterator[int]:
            some: list[int] = []
            for ids in self.encode(text):
                some += ids
                if len(some) >= STEP:
                    yield from told(some)
                    some = []
            yield from told(some)

        def told(some: list[int]) -> list[int]:
            nonlocal n
            if some:
                ids_sha.update(("," * bool(n) + str(some)[1:-1].replace(" ", "")).encode())
                n += len(some)
                if keep is not None:
                    keep.extend(some)
            return some

        for part in self.decode(passed()):
            text_sha.update(part.encode("utf-8", "surrogatepass"))
        return n, ids_sha.hexdigest(), text_sha.hexdigest()


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """How many bytes after a token can still change it, at most.

    The merge (a, b) waits for b, and b's last part may be taken away by a
    merge of lower rank with what follows; that merge in turn may be undone by
    a still lower one.  Ranks fall along such a chain, so one pass in the order
    of the ranks finds the longest reach of each merge from the point between
    its two parts.
    """
    made: dict[bytes, int] = {}
    reach_from: dict[bytes, int] = {}
    most = 1
    for a, b in merges:
        reach = max(len(b), len(b) + reach_from.get(b, 0))
        inner = b
        while inner in made:  # b's own last merges, and theirs
            head, tail, far = made[inner]
            reach = max(reach, len(b) - len(tail) + far)
            inner = tail
        made[a + b] = (a, b, reach)
        reach_from[a] = max(reach_from.get(a, 0), reach)
        most = max(most, reach)
    return most + max((len(a) + len(b) for a, b in merges), default=1)


@cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256 [, ids]) of every whole text.

    Encodes as the vocabulary's own library does without added special tokens:
    a special token's string in a text becomes its id.  A null text counts as
    empty: no tokens, and both digests are those of the empty string.  Each text
    runs through encoder and decoder in bounded memory besides the text itself;
    keep_ids adds the ids as a list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            rows: list[list] = [[], [], [], []]
            for text in b.column(1):
                ids: list[int] | None = [] if keep_ids else None
                for column, x in zip(rows, (*t.digests(text.as_py() or "", ids), ids), strict=True):
                    column.append(x)
            columns = [b.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
            yield pa.record_batch([*columns, *([pa.array(rows[3], pa.list_(pa.int32()))] if keep_ids else [])], names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, schema)
