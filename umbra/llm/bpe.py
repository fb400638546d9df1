"""Byte-pair encoding as a streaming transducer, and decoding as a state machine.

The transducer keeps, for each recent byte position, the last token of the
encoding of the bytes so far. That token is unique: the longest known suffix whose
pair with the token before it stays unmerged when both are encoded together. A
token is emitted as soon as every position from which a later token can start
agrees on it, or at the latest when the merge list's sufficient lookahead
(:meth:`Vocabulary.lookahead`) has passed, so the memory depends on the merge list
alone. Texts go through in chunks, and a long piece as it comes.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from umbra.llm.batches import slices

#: The pre-tokenizer's pattern, a fixed value of the vocabulary's format.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The four kinds of characters that pieces run on in.
RUNS = tuple(map(regex.compile, (r"\p{L}+", r"\p{N}+", r"\s+", r"[^\s\p{L}\p{N}]+")))
#: Characters of a text that are taken at once, and of a piece that is fed as it comes.
CHUNK, LONG = 1 << 16, 1 << 10


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary: token bytes, merges by rank, and strings that are single tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        of = _byte_chars()
        self.ids = {bytes(of[c] for c in t): i for t, i in found["model"]["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in found.get("added_tokens", [])}
        self.bytes = [b""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for b, i in self.ids.items():
            self.bytes[i] = b
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        pairs = (m if isinstance(m, list) else m.split(" ") for m in found["model"]["merges"])
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            u, v = (self.ids[bytes(of[c] for c in x)] for x in (a, b))
            made = self.ids[self.bytes[u] + self.bytes[v]]
            self.merges.setdefault((u, v), (rank, made))
            self.parts.setdefault(made, (u, v))
        self.rank = {made: self.merges[p][0] for made, p in self.parts.items()}
        self.longest = max(map(len, self.ids))
        self._pairs: dict[int, bool] = {}
        #: Finds all tokens that end at each byte, longest first; bytes stand as characters below 256.
        self.endings = ahocorasick.Automaton()
        for b, i in self.ids.items():
            self.endings.add_word(b.decode("latin-1"), (i, len(b) - 1))
        self.lengths = [len(b) for b in self.bytes]
        self.endings.make_automaton()
        self.reach = self.lookahead()
        self.splits = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")

    def lookahead(self) -> int:
        """Bytes after a token that can change it: enough for every text.

        What follows reaches back only through merges of rising rank, neighbours of
        which share a token, and each of them moves it by one token's length at most.
        So the longest such chain times the longest token is enough.
        """
        deepest: dict[int, int] = {}
        for (u, v), (_, made) in sorted(self.merges.items(), key=lambda x: x[1][0]):
            depth = 1 + max(deepest.get(t, 0) for t in (u, v, made))
            for t in (u, v, made):
                deepest[t] = max(deepest.get(t, 0), depth)
        return max(deepest.values(), default=1) * self.longest

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether encoding both tokens' bytes together gives these two tokens.

        Both are unmerged step by step at their common border, latest merge first;
        a merge across the border that comes earlier would have joined them.
        """
        a, b, limit, ok = left, right, len(self.merges) + 1, True
        while True:
            across = self.merges.get((a, b))
            if across is not None and across[0] < limit:
                ok = False
                break
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                break
            # undo the later of the two; one merge goes from left to right, so across comes before the right one
            if ra > rb:
                limit, a = ra, self.parts[a][1]
            else:
                limit, b = rb + 1, self.parts[b][0]
        if len(self._pairs) > 400_000:
            self._pairs.clear()
        self._pairs[left << 32 | right] = ok
        return ok


class Encoder:
    """Streaming transducer over the bytes of one piece: feed bytes, take the stable tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.tail = bytearray()  # the bytes since the last emitted token
        self.last: list[int] = [-1]  # the last token at each position of tail; at 0 the emitted one

    def feed(self, data: bytes) -> list[int]:
        """Take bytes; give the tokens that no later byte can change."""
        step = 3 * self.v.longest
        if len(data) <= step:
            self._advance(data)
            return self._emit() if len(self.tail) >= step else []
        return [t for at in range(0, len(data), step) for t in self.feed(data[at : at + step])]

    def _advance(self, data: bytes) -> None:
        v, last, known = self.v, self.last, self.v._pairs
        old = len(self.tail)
        self.tail += data
        lead = max(0, old - v.longest + 1)
        found = old
        for end, (token, back) in v.endings.iter(self.tail[lead:].decode("latin-1")):
            end += lead
            if end < found:
                continue  # before the new bytes, or its last token is known
            before = last[end - back]
            if before >= 0:
                apart = known.get(before << 32 | token)
                if not (v.stays_apart(before, token) if apart is None else apart):
                    continue
            last.append(token)
            found = end + 1
        if found < len(self.tail):
            raise ValueError("the vocabulary lacks a byte")

    def _path(self, end: int) -> list[int]:
        cuts, last, lengths = [end], self.last, self.v.lengths
        while end > 0:
            end -= lengths[last[end]]
            cuts.append(end)
        cuts.reverse()
        return cuts

    def _emit(self) -> list[int]:
        """Emit up to the last cut that the paths of all live positions share."""
        end = len(self.tail)
        shared = set(self._path(end))
        for at in range(max(1, end - self.v.longest + 1), end):
            shared.intersection_update(self._path(at))
        cut = max(shared)
        if end - cut > self.v.reach:
            # no text changes what lies further back than the lookahead
            cut = max(c for c in self._path(end) if c <= end - self.v.reach)
        if not cut:
            return []
        return self._take(cut)

    def _take(self, cut: int) -> list[int]:
        cuts = self._path(cut)
        out = [self.last[c] for c in cuts]
        del out[0]
        self.last = [self.last[cut], *self.last[cut + 1 :]]
        del self.tail[:cut]
        return out

    def finish(self) -> list[int]:
        """The tokens of what is left; the transducer starts anew."""
        out = self._take(len(self.tail)) if self.tail else []
        self.last = [-1]
        return out


class PieceCache(dict):
    """Pieces already encoded, at most two generations of ``limit`` short pieces.

    The transducer's state after a piece's first bytes is kept too, for pieces that begin alike.
    """

    def __init__(self, vocabulary: Vocabulary, limit: int = 150_000, head: int = 6):
        super().__init__()
        self.v, self.limit, self.old = vocabulary, limit, {}
        self.encoder, self.head, self.heads = Encoder(vocabulary), head, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.old.get(piece)
        if found is None:
            encoder, data = self.encoder, piece.encode()
            if len(data) > 128:
                return (*encoder.feed(data), *encoder.finish())
            if len(data) > self.head:
                start = data[: self.head]
                state = self.heads.get(start)
                if state is None:
                    encoder.feed(start)
                    if len(self.heads) >= self.limit:
                        self.heads.clear()
                    self.heads[start] = tuple(encoder.last)
                else:
                    encoder.tail, encoder.last = bytearray(start), list(state)
                encoder.feed(data[self.head :])
            else:
                encoder.feed(data)
            found = tuple(encoder.finish())
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found


def encode(vocabulary: Vocabulary, cache: PieceCache, text: str) -> list[int]:
    """The ids of a whole text; strings of single tokens stand for themselves."""
    out: list[int] = []
    at = 0
    for m in [*vocabulary.splits.finditer(text), None]:
        part = text[at : m.start() if m else len(text)]
        out.extend(chain.from_iterable(map(cache.__getitem__, PIECES.findall(part))))
        if m:
            out.append(vocabulary.special[m[0]])
            at = m.end()
    return out


def encode_chunks(vocabulary: Vocabulary, chunks: Iterable[str], cache: PieceCache | None = None) -> Iterator[list[int]]:
    """Encode a text that comes in chunks: lists of ids, as soon as they are stable.

    Kept are a chunk, the beginning of a single-token string, and the end of the text
    that may still become other pieces: its last two pieces, which are short or, once
    one is longer than ``LONG``, a run of one kind of characters that goes to the
    transducer as it comes. So memory depends on the chunks' size, not on the text's.
    """
    cache = PieceCache(vocabulary) if cache is None else cache
    encoder = Encoder(vocabulary)
    longest = max(map(len, vocabulary.special), default=0)
    pending, carry, run = "", "", None

    def split(text: str, last: bool) -> Iterator[tuple[str, int | None]]:
        """Split at single-token strings; the end that may still become one is held back."""
        nonlocal pending
        at = 0
        for m in vocabulary.splits.finditer(text):
            yield text[at : m.start()], vocabulary.special[m[0]]
            at = m.end()
        held = 0
        if not last:
            held = next((n for n in range(min(longest - 1, len(text) - at), 0, -1) if any(s.startswith(text[len(text) - n :]) for s in vocabulary.special)), 0)
        pending = text[len(text) - held :] if held else ""
        yield text[at : len(text) - held], None

    def cut(text: str, ends: bool) -> list[int]:
        """Ids of what is settled of ``carry`` and ``text``; ``carry`` and ``run`` keep the rest."""
        nonlocal carry, run
        out: list[int] = []
        text, carry = carry + text, ""
        if run:
            m = run.match(text)
            stop = m.end() if m else 0
            if stop == len(text) and not ends:
                # the last blank before a word belongs to the word
                carry = text[-1:]
                return encoder.feed(text[:-1].encode())
            stop -= run is RUNS[2] and stop < len(text)
            out += encoder.feed(text[:stop].encode())
            out += encoder.finish()
            text, run = text[stop:], None
        found = PIECES.findall(text)
        rest = [] if ends else found[-2:]
        out.extend(chain.from_iterable(map(cache.__getitem__, found[: len(found) - len(rest)])))
        if rest and len(rest[-1]) > LONG:
            # so long a run has settled what stands before it
            out.extend(chain.from_iterable(map(cache.__getitem__, rest[:-1])))
            run = next(r for r in RUNS if r.match(rest[-1][-1]))
            out += encoder.feed(rest[-1][:-1].encode())
            carry = rest[-1][-1]
        else:
            carry = "".join(rest)
        return out

    for chunk in chain(chunks, [None]):
        for text, special in list(split(pending + (chunk or ""), chunk is None)):
            if ids := cut(text, special is not None or chunk is None):
                yield ids
            if special is not None:
                yield [special]


def encode_text(vocabulary: Vocabulary, cache: PieceCache, text: str) -> Iterator[list[int]]:
    """Lists of ids of a text, chunk by chunk where it is long."""
    if len(text) <= CHUNK:
        yield encode(vocabulary, cache, text)
    else:
        yield from encode_chunks(vocabulary, (text[at : at + CHUNK] for at in range(0, len(text), CHUNK)), cache)


class Decoder:
    """Incremental byte-to-text state machine: ids in, the text that is complete out."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.v.bytes.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(maxsize=2)
def _loaded(path: str) -> tuple[Vocabulary, PieceCache, list[str]]:
    v = Vocabulary(path)
    return v, PieceCache(v), [str(i) for i in range(len(v.bytes))]


def encode_documents(documents: DataFrame, vocabulary: str, column: str = "text", with_ids: bool = True) -> DataFrame:
    """Add n_tokens, ids_sha256, decoded_sha256 (and ids, decoded with ``with_ids``) to each row.

    ``vocabulary`` is the path of a byte-level BPE file in tokenizer-JSON form, which
    every executor can read. A null text counts as empty: no tokens and the digests of
    the empty string. Other columns pass through unless they clash with the new ones,
    which replace them. Repeated rows stay; an empty table gives no rows. The plan is
    one scan without a shuffle; of a long text only a chunk's tokens are held at once,
    unless ``with_ids`` asks for them.
    """
    new = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
    kinds = dict(zip(["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"], ["bigint", "string", "string", "array<int>", "string"], strict=True))
    arrow = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    keep = [c for c in documents.columns if c not in new]
    schema = ", ".join([*(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} {kinds[c]}" for c in new)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, cache, names = _loaded(vocabulary)
        for batch in (piece for whole in batches for piece in slices(whole, whole.schema.get_field_index(column))):
            out: dict[str, list] = {c: [] for c in new}
            for x in batch.column(batch.schema.get_field_index(column)):
                machine, total, of_ids, of_text = Decoder(v), 0, sha256(), sha256()
                every: list[int] = []
                said: list[str] = []
                for ids in encode_text(v, cache, x.as_py() or ""):
                    of_ids.update((("," if total else "") + ",".join(map(names.__getitem__, ids))).encode() if ids else b"")
                    total += len(ids)
                    text = machine.feed(ids)
                    of_text.update(text.encode())
                    if with_ids:
                        every += ids
                        said.append(text)
                text = machine.finish()
                of_text.update(text.encode())
                out["n_tokens"].append(total)
                out["ids_sha256"].append(of_ids.hexdigest())
                out["decoded_sha256"].append(of_text.hexdigest())
                if with_ids:
                    out["ids"].append(every)
                    out["decoded"].append("".join(said) + text)
            held = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*held, *(pa.array(out[c], arrow[kinds[c]]) for c in new)], names=[*keep, *new])

    return documents.mapInArrow(run, schema)
