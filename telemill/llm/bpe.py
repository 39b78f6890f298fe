"""Byte-level BPE encoding and decoding by transducers.

Encoding. A token sequence is the BPE encoding of its bytes exactly if every token is, and every two neighbours are
together, the encoding of their own bytes. So the nondeterministic transducer goes from a token to any that begins where
it ends and fits behind it. It is determinised by looking ahead as far as one token reaches: a state is the token before
a place and the longest token that begins there, from which all shorter ones follow; it gives the longest of them that
fits. Where none does, or only one to a place from which no way leads on, the step before is taken back and the next
shorter token that fits is taken. What fits leads to a place in one way only, so no place is left twice.
States are made when needed for the second time and kept (up to a bound, then begun afresh): words never seen before run
through states that other words have made.

Decoding. Token bytes run through a UTF-8 state machine (states: bytes still missing and what the next may be), one
transition per token, made when first needed; complete characters leave at once, a cut one waits for its rest, and
malformed bytes become U+FFFD as in Python's own decoder.

Edge cases: null and empty texts give no tokens; a word that is itself a token is that token; repeated rows each get
their result; texts have any length; other columns of the input are kept unless the result
has their name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from telemill.llm.pretokens import Memo, Recent, spaced

STATES, FITS = 800_000, 1_000_000
#: Bytes that are looked up at once where the longest token is looked for.
AHEAD = 4
#: Texts between spaces whose tokens are kept, and words within such of several words.
PIECES, WORDS = 600_000, 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """The transducer from bytes of one word to tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        self.halves = Memo(lambda t: self._merged(t, 2), len(ranks) + 256)
        self.fits: dict[int, bool] = {}
        self.steps = self._trie()
        #: Of each token its number of bytes, and the longest other token that it begins with (-1: none).
        self.length = {i: len(t) for i, t in self.tokens.items()}
        self.shorter = {i: next((ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ranks), -1) for i, t in self.tokens.items()}
        self.ahead = Memo(self._begun, STATES)
        #: The token that a state gives (-1: none), by token before + 1 (0: none) << 32 | longest token ahead. The first
        #: is that before any token ahead.
        self.states: dict[int, int] = {-1: -1}
        #: States that were needed once.
        self.once: set[int] = set()

    def _trie(self) -> dict[int, tuple[int, int]]:
        """What follows a beginning of tokens (0: none) on a byte, by number << 8 | byte: the longer beginning's number, or
        -1 where no token goes on from there, and the token it is, or -1."""
        inner = {t[:i] for t in self.ranks for i in range(1, len(t))}
        number = {b"": 0} | {t: i for i, t in enumerate(sorted(inner), 1)}
        return {number[t[:-1]] << 8 | t[-1]: (number.get(t, -1), self.ranks.get(t, -1)) for t in inner | self.ranks.keys()}

    def _begun(self, data: bytes) -> tuple[int, int]:
        """The number of these bytes as a beginning of tokens (-1: none begins with them), and the longest token that they
        begin with."""
        node, longest = 0, -1
        for byte in data:
            node, token = self.steps.get(node << 8 | byte, (-1, -1))
            if token >= 0:
                longest = token
            if node < 0:
                break
        return node, longest

    def _merged(self, piece: bytes, least_parts: int = 1) -> list[bytes]:
        """The encoding of a few bytes by the merges themselves: lowest rank first, leftmost of equals."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > least_parts:
            at, least = -1, None
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (least is None or r < least):
                    at, least = i, r
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, pair: tuple[bytes, bytes]) -> bool:
        """Whether two neighbours are the encoding of their bytes: taking both apart, youngest merge first, no merge
        across their border may have come before the merges that made what stands there."""
        left, right = pair
        if not left:
            return self._merged(right) == [right]
        if len(self.halves[left]) > 2 or len(self.halves[right]) > 2 or not self._whole(right):
            return False
        rank, made = self.ranks, None  # made: the rank of the merge that has just been undone, and whether it was on the left
        while True:
            across = rank.get(left + right)
            if across is not None and (made is None or (across < made[0] if made[1] else across <= made[0])):
                return False
            a, b = rank[left] if len(left) > 1 else -1, rank[right] if len(right) > 1 else -1
            if a < 0 and b < 0:
                return True
            if a > b:
                made, left = (a, True), self.halves[left][-1]
            else:
                made, right = (b, False), self.halves[right][0]

    def _whole(self, token: bytes) -> bool:
        return self._fit(-1, self.ranks[token])

    def _fit(self, left: int, right: int) -> bool:
        """_fits() by ids (left -1: none), kept."""
        key = left + 1 << 32 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= FITS:
                self.fits.clear()
            known = self.fits[key] = self._fits((self.tokens[left] if left >= 0 else b"", self.tokens[right]))
        return known

    def _next(self, left: int, token: int) -> int:
        """The longest token that fits behind `left`, of this one and those that it begins with (-1: none)."""
        while token >= 0 and not self._fit(left, token):
            token = self.shorter[token]
        return token

    def _made(self, left: int, longest: int) -> int:
        """What a state that isn't kept gives; kept if it was needed before."""
        key, token = left + 1 << 32 | longest, self._next(left, longest)
        if key in self.once:
            if len(self.states) >= STATES:
                self.states.clear()
            self.states[key] = token
            self.once.discard(key)
        else:
            if len(self.once) >= STATES:
                self.once.clear()
            self.once.add(key)
        return token

    def word(self, data: bytes) -> tuple[int, ...]:
        """The token ids of one pre-token."""
        if (whole := self.ranks.get(data)) is not None:
            return (whole,)
        steps, length, ahead, states = self.steps, self.length, self.ahead, self.states
        at, left, n = 0, -1, len(data)
        out: list[int] = []
        closed: set[int] | None = None  # places from which no way leads to the end
        while at < n:
            node, longest = ahead[data[at : at + AHEAD]]
            if node >= 0:
                for i in range(at + AHEAD, n):
                    step = steps.get(node << 8 | data[i])
                    if step is None:
                        break
                    node, token = step
                    if token >= 0:
                        longest = token
                    if node < 0:
                        break
            token = states.get(left + 1 << 32 | longest)
            if token is None:
                token = self._made(left, longest)
            if token < 0 or closed:
                closed = closed or set()
                while token < 0 or at + length[token] in closed:
                    if token < 0:  # back to the place before
                        closed.add(at)
                        token = out.pop()
                        at -= length[token]
                        left = out[-1] if out else -1
                    token = self._next(left, self.shorter[token])
            out.append(token)
            left = token
            at += length[token]
        return tuple(out)


def _utf8_step(state: tuple[int, int, int], byte: int) -> tuple[int, int, int] | None:
    """state: bytes missing, least and most that the next may be. None: malformed here."""
    missing, low, high = state
    if missing:
        return (missing - 1, 0x80, 0xBF) if low <= byte <= high else None
    if byte < 0x80:
        return state
    if 0xC2 <= byte <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= byte <= 0xEF:
        return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
    if 0xF0 <= byte <= 0xF4:
        return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
    return None


class Decoder:
    """Token ids to text, one transition per token."""

    IDLE = (0, 0x80, 0xBF)

    def __init__(self, ranks: dict[bytes, int]):
        self.pieces = {i: t for t, i in ranks.items()}
        self.states = [self.IDLE]
        self.moves: list[dict[int, int]] = [Memo(lambda i: self._move(0, i), 1 << 60)]
        #: Tokens of complete characters.
        self.whole = {i for i in self.pieces if self.moves[0][i] == 0}

    def _move(self, at: int, token: int) -> int:
        state = self.states[at]
        for byte in self.pieces[token]:
            state = _utf8_step((0, 0x80, 0xBF) if not state[0] else state, byte)
            if state is None:
                return -1
        state = state if state[0] else self.IDLE
        if state not in self.states:
            self.states.append(state)
            self.moves.append(Memo(lambda i, at=len(self.states) - 1: self._move(at, i), 1 << 60))
        return self.states.index(state)

    def text(self, ids: list[int]) -> str:
        """The whole text of these ids."""
        at, moves = 0, self.moves
        idle = moves[0]
        for i in () if self.whole.issuperset(ids) else ids:
            at = idle[i] if at == 0 else moves[at][i]
            if at < 0:  # malformed
                return "".join(self.stream(ids))
        if at:  # the last character is cut
            return "".join(self.stream(ids))
        return str(b"".join(map(self.pieces.__getitem__, ids)), "utf-8")

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The text as it becomes complete, holding back the bytes of one character at most. A sequence that can't go on
        is one U+FFFD, and the byte that doesn't fit begins anew."""
        held, state, done = bytearray(), self.IDLE, []
        for i in ids:
            for byte in self.pieces[i]:
                after = _utf8_step(state, byte)
                if after is None:
                    if state[0]:  # what was begun is cut here
                        done.append("\ufffd")
                        held.clear()
                        after = _utf8_step(self.IDLE, byte)
                    if after is None:
                        done.append("\ufffd")
                        state = self.IDLE
                        continue
                held.append(byte)
                if after[0]:
                    state = after
                else:
                    done.append(held.decode("utf-8"))
                    held.clear()
                    state = self.IDLE
            if done:
                yield "".join(done)
                done = []
        if held:
            yield "\ufffd"


class Codec:
    """Whole texts to ids and back, words' ids kept."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.encoder, self.decoder, self.pattern = Encoder(ranks), Decoder(ranks), regex.compile(pattern)
        self.words = Memo(self._word, WORDS)
        self.pieces = Recent(self._piece, PIECES // 2)

    def _word(self, word: str) -> tuple[int, ...]:
        alone = self.pieces.get(word)
        return self.encoder.word(word.encode()) if alone is None else alone[0]

    def _piece(self, piece: str) -> tuple[tuple[int, ...], str]:
        found = self.pattern.findall(piece)
        ids = self.encoder.word(found[0].encode()) if len(found) == 1 else tuple(chain.from_iterable([self.words[x] for x in found]))
        return ids, ",".join(map(str, ids))

    def encode(self, text: str) -> tuple[list[int], str]:
        """The ids, and their decimal forms joined by commas."""
        if not text:
            return [], ""
        pieces = spaced(text) or self.pattern.findall(text)
        found = list(map(self.pieces.__getitem__, pieces))
        ids, said = zip(*found, strict=True)
        return list(chain.from_iterable(ids)), ",".join(filter(None, said))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def coded(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of each row of docs; with ids, also the ids and the decoded text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            rows: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            more: dict[str, list] = {"ids": [], "decoded": []}
            for x in b.column(1):
                found, said = own.encode(x.as_py() or "")
                back = own.decoder.text(found)
                rows["n_tokens"].append(len(found))
                rows["ids_sha256"].append(hashlib.sha256(said.encode()).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
                if ids:
                    more["ids"].append(found)
                    more["decoded"].append(back)
            types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, types.get(k, pa.string())) for k, v in (rows | (more if ids else {})).items()]], [key, *rows, *(more if ids else {})])

    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * ids
    return docs.select(key, text).mapInArrow(run, schema)
