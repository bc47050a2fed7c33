"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding by a byte-to-text state machine.

Encoding by a merge list is the same as choosing tokens from left to right such that each two neighbours are what the merges make of their joint
bytes. The transducer takes the longest token at the frontier that agrees with the one before it, tries shorter ones otherwise, and steps back where none
agrees. So its tokens are always the encoding of the bytes up to the frontier, and those that no later byte can change are emitted.

The *sufficient lookahead* is how far from the end of some bytes their encoding can depend on what follows. Take two texts that begin with the same bytes and run the merges in
the order of their ranks (each token is made by one merge, whose rank is above those of its parts, so this is the encoding). Let f be the last place before
the leftmost difference where both have a boundary, and t a token that begins at f in one of them. At first, t ends beyond or at the end of the common
bytes, so f lies at most length(t) before it. Later, f moves left only if a token s that ends at f is merged with such a t, in one of the two texts only; then the tokens at the new f
are s in one and st in the other, and f has moved by length(s). Otherwise t may grow to the right and f stays. Ranks go up all the time. So with D[t] = length(t) at the start, and for each merge
(a, b) to m in the order of ranks, D[a] and D[m] raised to D[b] + length(a) and D[m] to D[a], no difference ever lies further than the largest D from the end of the common bytes.

Texts are cut by the tokenizer's pre-token rule as they stream, ``CHUNK`` characters at a time; a pre-token that is still open after ``_OPEN`` characters is handed to the transducer piece by piece.
Ids of short pre-tokens that were met before are kept (at most ``KEPT``).

Null text counts as empty and gives no ids. Lone surrogates cannot occur in a Spark string. Repeated rows give repeated results; extra columns are left out; an empty table gives an empty
result.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, sliced
from .tokens import _BYTE_CUT, _OTHER, BYTE_BPE, byte_letters, vocabulary_path

#: Pre-tokens (of up to ``SHORT`` characters) and pairs of tokens that are kept.
KEPT, PAIRS, SHORT = 1_000_000, 400_000, 32


class Merges:
    """A byte-level vocabulary and its merge list."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        model = spec["model"]
        self.id_of = {raw(k): v for k, v in model["vocab"].items() if all(c in letters for c in k)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for text in self.special:
            self.id_of.pop(text.encode(), None)
        self.bytes_of = {v: k for k, v in self.id_of.items()} | {v: k.encode() for k, v in self.special.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(pairs):
            key = self.id_of[raw(a)], self.id_of[raw(b)]
            self.rank[key], self.made[key] = r, self.id_of[raw(a) + raw(b)]
        self.longest = max(map(len, self.id_of))
        self.lookahead = self._sufficient_lookahead()
        self._agree: dict[int, bool] = {}
        self._own: dict[int, bool] = {}
        self._shorter: dict[int, int] = {}

    def _sufficient_lookahead(self) -> int:
        """The largest D of the module's argument, in bytes."""
        if len(set(self.made.values())) < len(self.made):
            raise ValueError("a token is made by two merges, so ranks do not order the merges")
        far = {t: len(raw) for t, raw in self.bytes_of.items()}
        for (a, b), made in self.made.items():  # in the order of ranks
            moved = far[b] + len(self.bytes_of[a])
            far[made] = max(far[made], far[a], moved)
            far[a] = max(far[a], moved)
        return max(far.values(), default=0)

    def by_merges(self, raw: bytes) -> list[int]:
        """The plain definition: apply the merge of least rank (leftmost first) until none applies."""
        seq = [self.id_of[raw[i : i + 1]] for i in range(len(raw))]
        while len(seq) > 1:
            r, i = min((self.rank.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(seq, seq[1:], strict=False)))
            if r == 1 << 30:
                break
            seq[i : i + 2] = [self.made[seq[i], seq[i + 1]]]
        return seq

    def agree(self, a: int, b: int) -> bool:
        """Whether the merges make exactly a, b of their joint bytes."""
        key = a << 20 | b
        got = self._agree.get(key)
        if got is None:
            if len(self._agree) > PAIRS:
                self._agree.clear()
            got = self._agree[key] = self.by_merges(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return got

    def whole(self, a: int) -> bool:
        """Whether a token's own bytes are encoded as that token."""
        got = self._own.get(a)
        if got is None:
            got = self._own[a] = self.by_merges(self.bytes_of[a]) == [a]
        return got

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        got = self._shorter.get(token)
        if got is None:
            raw = self.bytes_of[token]
            got = self._shorter[token] = next((self.id_of[raw[:k]] for k in range(len(raw) - 1, 0, -1) if raw[:k] in self.id_of), -1)
        return got


class Transducer:
    """One pre-token's bytes in, stable ids out."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.reset()

    def reset(self) -> None:
        self.held = b""  # bytes from the first token that is not emitted
        self.at = 0  # the frontier in them
        self.tokens: list[int] = []
        self.dead: set[int] = set()  # places from which no encoding goes on
        self.before = -1  # the last emitted token
        self.next = -1

    def _find(self) -> int:
        held, at, id_of = self.held, self.at, self.m.id_of
        for k in range(min(self.m.longest, len(held) - at), 0, -1):
            got = id_of.get(held[at : at + k])
            if got is not None:
                return got
        return -1

    def _run(self, need: int) -> None:
        """Go on while ``need`` bytes lie ahead (the longest token, or 1 at the end)."""
        m = self.m
        while len(self.held) - self.at >= need or self.next >= 0:
            token = self.next if self.next >= 0 else self._find()
            last = self.tokens[-1] if self.tokens else self.before
            while token >= 0:
                end = self.at + len(m.bytes_of[token])
                if end not in self.dead and (m.agree(last, token) if last >= 0 else m.whole(token)):
                    break
                token = m.shorter(token)
            if token >= 0:
                self.tokens.append(token)
                self.at, self.next = end, -1
                continue
            if not self.tokens:
                raise AssertionError("a step back passed the sufficient lookahead")
            self.dead.add(self.at)
            last = self.tokens.pop()
            self.at -= len(m.bytes_of[last])
            self.next = m.shorter(last)
            if self.next < 0:  # nothing shorter here either: the place itself is dead
                self.next = last  # its end is dead now, so the search falls through to the step back

    def feed(self, raw: bytes) -> list[int]:
        self.held += raw
        self._run(self.m.longest)
        out, gone = [], 0
        while self.tokens and gone + len(self.m.bytes_of[self.tokens[0]]) <= self.at - self.m.lookahead:
            self.before = self.tokens.pop(0)
            gone += len(self.m.bytes_of[self.before])
            out.append(self.before)
        if gone:
            self.held, self.at = self.held[gone:], self.at - gone
            self.dead = {d - gone for d in self.dead if d > gone}
        return out

    def finish(self) -> list[int]:
        self._run(1)
        out = self.tokens
        self.reset()
        return out


#: Characters of a text that the query hands over at a time, and those of an open pre-token after which it is handed to the transducer in part.
CHUNK, _OPEN = 1 << 16, 4096
#: A character of each class of pre-tokens, as a witness of one that goes on: letters, digits, white space, others.
_WITNESSES = "a1\n!"


class Encoder:
    """Text in pieces of any size in, ids out; special tokens' texts count as them."""

    def __init__(self, merges: Merges, splitter=None):
        self.t = Transducer(merges)
        self.m, self.splitter = merges, splitter
        self.kept: dict[str, bytes] = {}
        #: What must follow a piece to settle it: the longest contraction, or a special token's beginning.
        self.room = max(map(len, merges.special), default=1) + 4

    def word(self, piece: str) -> bytes:
        got = self.kept.get(piece)
        if got is None:
            ids = self.t.feed(piece.encode()) + self.t.finish() if len(piece) <= _OPEN else self._long(piece)
            got = np.array(ids, "<u2").tobytes()
            if len(piece) > SHORT:
                return got
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[piece] = got
        return got

    def _long(self, piece: str) -> list[int]:
        ids: list[int] = []
        for i in range(0, len(piece), _OPEN):
            ids += self.t.feed(piece[i : i + _OPEN].encode())
        return ids + self.t.finish()

    def pieces(self, text: str) -> list[str]:
        if not _OTHER.search(text):
            return _BYTE_CUT.findall(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def _joined(self, pieces: list[str]) -> bytes:
        parts = list(map(self.kept.get, pieces))
        if None in parts:
            parts = [self.word(p) if ids is None else ids for p, ids in zip(pieces, parts, strict=True)]
        return b"".join(parts)

    def ids(self, text: str) -> bytes:
        """Ids of a whole text as 16-bit little-endian bytes."""
        return b"".join(self.packed([text]))

    def _goes_on(self, witness: str, text: str) -> int:
        """Characters at the beginning of ``text`` that belong to an open pre-token of the witness's class."""
        pieces = self.pieces(witness + text)
        return len(pieces[0]) - 1 if pieces else 0

    def stream(self, chunks: Iterable[str]) -> Iterator[list[int]]:
        """Ids as they become stable."""
        for part in self.packed(chunks):
            yield np.frombuffer(part, "<u2").tolist()

    def packed(self, chunks: Iterable[str]) -> Iterator[bytes]:
        """The same as 16-bit little-endian bytes.

        Held are at most a chunk, ``_OPEN`` characters and, in the transducer, the sufficient lookahead.
        """
        held, witness = "", ""  # witness: the class of a pre-token that is partly handed over
        for chunk, last in _with_last(chunks):
            held += chunk
            while True:
                found = [(at, s) for s in self.m.special if (at := held.find(s)) >= 0]
                at, special = min(found) if found else (len(held), "")
                head, settled = held[:at], bool(special) or last
                taken, witness, out = self._some(head, settled, witness)
                if out:
                    yield out
                if not special:
                    held = held[taken:]
                    break
                yield self.m.special[special].to_bytes(2, "little")
                held = held[at + len(special) :]

    def _some(self, text: str, settled: bool, witness: str) -> tuple[int, str, bytes]:
        """(characters taken, witness, ids) of the beginning of a text; all of it if nothing that follows can change its pre-tokens."""
        out, taken = b"", 0
        edge = len(text) if settled else len(text) - self.room
        if witness:
            n = self._goes_on(witness, text) if text else 0
            if n >= len(text) and not settled:  # still open
                n = max(0, edge)
                return n, witness, np.array(self.t.feed(text[:n].encode()), "<u2").tobytes()
            if n > edge:
                return 0, witness, b""
            out = np.array(self.t.feed(text[:n].encode()) + self.t.finish(), "<u2").tobytes()
            taken, witness = n, ""
        pieces = self.pieces(text[taken:]) if taken else self.pieces(text)
        if settled:
            return len(text), "", out + self._joined(pieces)
        done, k = taken, 0
        while k + 1 < len(pieces) and done + len(pieces[k]) <= edge:
            done += len(pieces[k])
            k += 1
        out += self._joined(pieces[:k])
        if k + 1 == len(pieces) and len(pieces[k]) > _OPEN + self.room:  # the open one
            part = pieces[k][: -self.room]
            end = part[-1]
            witness = next(w for w in _WITNESSES if len(self.pieces(w + end + "\n" * (w == "\n"))[0]) > 1)
            return done + len(part), witness, out + np.array(self.t.feed(part.encode()), "<u2").tobytes()
        return done, "", out


def _with_last(chunks: Iterable[str]) -> Iterator[tuple[str, bool]]:
    it = iter(chunks)
    now = next(it, "")
    for then in it:
        yield now, False
        now = then
    yield now, True


class TextMachine:
    """Bytes in, text out: an unfinished character is held, and each wrong sequence gives U+FFFD."""

    def __init__(self):
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, raw: bytes) -> str:
        return self.machine.decode(raw)

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def decode(merges: Merges, ids: Iterable[int], step: int = 4096) -> str:
    of, machine, out, part = merges.bytes_of, TextMachine(), [], []
    for i in ids:
        part.append(of[i])
        if len(part) == step:
            out.append(machine.feed(b"".join(part)))
            part.clear()
    return "".join([*out, machine.feed(b"".join(part)), machine.finish()])


@lru_cache(maxsize=2)
def encoder(name: str = BYTE_BPE) -> Encoder:
    """One for each Python worker and vocabulary."""
    from tokenizers import pre_tokenizers

    return Encoder(Merges(vocabulary_path(name)), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True))


def encode_and_decode(docs: DataFrame, vocabulary: str = BYTE_BPE) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in sliced(batches, "text"):
            rows = [np.frombuffer(coder.ids(t), "<u2").astype(np.int32) for t in batch.column(1).to_pylist()]
            off = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))
            yield pa.record_batch([batch.column(0), ids, pa.array([decode(coder.m, r.tolist()) for r in rows], pa.string())], names=["doc_id", "ids", "decoded"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary: str = BYTE_BPE) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, without moving ids and texts back; each text passes through the transducer and the decoder in parts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        bytes_of = coder.m.bytes_of.__getitem__
        for batch in sliced(batches, "text"):
            n, ids_sha, text_sha = [], [], []
            for t in batch.column(1).to_pylist():
                count, of_ids, of_text, machine = 0, hashlib.sha256(), hashlib.sha256(), TextMachine()
                for part in coder.packed(t[i : i + CHUNK] for i in range(0, len(t) or 1, CHUNK)):
                    ids = np.frombuffer(part, "<u2")
                    count += len(ids)
                    of_ids.update(ids.astype("<u4").tobytes())
                    of_text.update(machine.feed(b"".join(map(bytes_of, ids.tolist()))).encode())
                of_text.update(machine.finish().encode())
                n.append(count)
                ids_sha.append(of_ids.hexdigest())
                text_sha.append(of_text.hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
