"""Exact SentencePiece BPE by backtracking, and its decoding.

Greedy merging gives the one tokenisation whose neighbouring tokens are all compatible:
two tokens are compatible if merging their joined text again gives just these two. So a
text can be encoded from left to right with the longest pieces that an Aho-Corasick
automaton finds, stepping back to shorter ones where neighbours are incompatible. A bit
per position remembers where no continuation exists, which keeps the search linear.

No piece holds a blank after another character, so merges never cross the start of a blank
run. Texts are cut there and the chunks' codes are kept in a bounded cache.
"""

from __future__ import annotations

import functools
import re
import struct

import ahocorasick
from pyspark.sql import DataFrame

from marketpulse.llm.common import hex_digest, id_like, map_rows, texts

BLANK = "▁"
_BLANK_BYTES = BLANK.encode("utf-8")
CHUNK = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_NEVER = float("inf")


def model_pieces(path: str) -> list[tuple[str, float, int]]:
    """(text, score, type) of all pieces of a model file that this encoder can serve."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    normal, trained = model.normalizer_spec, model.trainer_spec
    if (
        trained.model_type != pb.TrainerSpec.BPE
        or not trained.byte_fallback
        or trained.treat_whitespace_as_suffix
        or normal.precompiled_charsmap
        or normal.remove_extra_whitespaces
        or not normal.add_dummy_prefix
        or not normal.escape_whitespaces
    ):
        raise ValueError("only BPE models with byte fallback and no text rewriting are served")
    return [(p.piece, p.score, p.type) for p in model.pieces]


class PieceCodec:
    """Encoder and decoder of one model.

    ``cache`` bounds the chunks and pairs of a generation. Those of the last generation are
    remembered too, and move on when they are met again.
    """

    def __init__(self, pieces: list[tuple[str, float, int]], cache: int = 200_000):
        self.text = [p[0] for p in pieces]
        self.kind = [p[2] for p in pieces]
        self.cache = cache
        usable = [i for i, p in enumerate(pieces) if p[2] == NORMAL]
        if any(p[2] in (USER_DEFINED, UNUSED) for p in pieces):
            raise ValueError("user-defined and unused pieces are not served")
        self.id_of = {self.text[i]: i for i in usable}
        order = sorted(usable, key=lambda i: -pieces[i][1])
        #: Place in merge order; pieces of equal score are merged from left to right.
        self.rank: dict[str, int] = {}
        last, place = None, -1
        for i in order:
            if pieces[i][1] != last:
                last, place = pieces[i][1], place + 1
            self.rank[self.text[i]] = place
        self.single = {c for c in self.id_of if len(c) == 1}
        if any(c not in self.single for t in self.id_of for c in t):
            raise ValueError("a piece has a character that is no piece itself")
        if any(BLANK in t.lstrip(BLANK) for t in self.id_of):
            raise ValueError("a piece holds a blank after another character")
        self.byte_id = {int(self.text[i][3:5], 16): i for i, k in enumerate(self.kind) if k == BYTE}
        self._piece_bytes = [
            bytes([int(t[3:5], 16)]) if k == BYTE
            else " ⁇ ".encode() if k == UNKNOWN
            else b"" if k == CONTROL
            else t.encode("utf-8")
            for t, k in zip(self.text, self.kind, strict=True)
        ]
        self.begin, self.end = self.text.index("<s>"), self.text.index("</s>")
        self.automaton = ahocorasick.Automaton()
        for t in self.id_of:
            self.automaton.add_word(t, len(t))
        self.automaton.make_automaton()
        self._merges: dict[str, list[tuple[float, str, str]]] = {}
        self._pairs: dict[tuple[str, str], bool] = {}
        self._chunks: dict[str, tuple[bytes, bytes]] = {}
        self._old_chunks: dict[str, tuple[bytes, bytes]] = {}

    def merges(self, token: str) -> list[tuple[float, str, str]]:
        """How a token's text merges: (rank, first symbol, last symbol) after each step.

        The first entry is the state before any merge. The list ends with the token itself
        if its text merges into one symbol, which is the case for every token of an encoding.
        """
        if (known := self._merges.get(token)) is None:
            parts, known = list(token), [(-1.0, token[0], token[-1])]
            while len(parts) > 1:
                ranks = [self.rank.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
                best = min(ranks)
                if best == _NEVER:
                    break
                at = ranks.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                known.append((best, parts[0], parts[-1]))
            if len(parts) > 1:
                known = []
            self._merges[token] = known
        return known

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the joined text of two tokens gives the two tokens again.

        An empty left token stands for the start of a chunk.
        """
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= self.cache:
                self._pairs.clear()
            known = self._pairs[left, right] = self._remerge(left, right)
        return known

    def _remerge(self, left: str, right: str) -> bool:
        if not left:
            return bool(self.merges(right))
        a, b = self.merges(left), self.merges(right)
        if not a or not b:
            return False
        rank, i, j = self.rank, 0, 0
        while True:
            next_a = a[i + 1][0] if i + 1 < len(a) else _NEVER
            next_b = b[j + 1][0] if j + 1 < len(b) else _NEVER
            across = rank.get(a[i][2] + b[j][1], _NEVER)
            # At equal rank the leftmost pair merges first.
            if across < next_a and across <= next_b:
                return False
            if next_a == _NEVER and next_b == _NEVER:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def tokens(self, chunk: str) -> list[str]:
        """Pieces of a chunk of known characters, by backtracking."""
        if chunk in self.id_of and self.merges(chunk):
            return [chunk]
        n = len(chunk)
        longest = [1] * n
        for end, size in self.automaton.iter(chunk):
            start = end + 1 - size
            if size > longest[start]:
                longest[start] = size
        failed = bytearray(n + 1)  # one flag per position without a continuation
        out: list[str] = []
        id_of, pairs = self.id_of, self._pairs
        at, size, last = 0, longest[0], ""
        while True:
            while size:
                token = chunk[at : at + size]
                if token in id_of and not failed[at + size]:
                    fits = pairs.get((last, token))
                    if fits is None:
                        fits = self.compatible(last, token)
                    if fits:
                        break
                size -= 1
            if size:
                out.append(token)
                at += size
                if at == n:
                    return out
                last, size = token, longest[at]
            else:
                failed[at] = 1
                size = len(out.pop())
                at -= size
                size -= 1
                last = out[-1] if out else ""

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of a chunk; a character without a piece becomes the pieces of its bytes."""
        single, ids, at = self.single, [], 0
        if single.issuperset(chunk):
            return [self.id_of[t] for t in self.tokens(chunk)]
        while at < len(chunk):
            end = at
            while end < len(chunk) and chunk[end] in single:
                end += 1
            if end > at:
                ids += [self.id_of[t] for t in self.tokens(chunk[at:end])]
            if end < len(chunk):
                ids += [self.byte_id[b] for b in chunk[end].encode("utf-8")]
            at = end + 1
        return ids

    def packed(self, text: str) -> tuple[int, bytes, bytes]:
        """(ids, ids as little-endian unsigned 32-bit integers, decoded UTF-8)."""
        begin, end = struct.pack("<I", self.begin), struct.pack("<I", self.end)
        if not text:
            return 2, begin + end, b""
        codes, decoded, chunks = [begin], [], self._chunks
        for chunk in CHUNK.findall(BLANK + text.replace(" ", BLANK)):
            known = chunks.get(chunk)
            if known is None:
                known = self._chunk(chunk)
                chunks = self._chunks
            codes.append(known[0])
            decoded.append(known[1])
        codes.append(end)
        packed = b"".join(codes)
        # The first chunk begins with the blank that encoding puts there.
        return len(packed) // 4, packed, b"".join(decoded)[1:]

    def _chunk(self, chunk: str) -> tuple[bytes, bytes]:
        """Packed ids of a chunk and what these decode to, blanks as spaces."""
        known = self._old_chunks.get(chunk)
        if known is None:
            ids = self.chunk_ids(chunk)
            data = b"".join(map(self._piece_bytes.__getitem__, ids))
            known = struct.pack(f"<{len(ids)}I", *ids), data.replace(_BLANK_BYTES, b" ")
        if len(chunk) <= 64:
            if len(self._chunks) >= self.cache:
                self._old_chunks, self._chunks = self._chunks, {}
            self._chunks[chunk] = known
        return known

    def encode(self, text: str) -> list[int]:
        n, packed, _ = self.packed(text)
        return list(struct.unpack(f"<{n}I", packed))

    def decode(self, ids) -> str:
        """Text of any id sequence: control pieces give nothing, a wrong byte U+FFFD.

        Blanks become spaces, but for the one that encoding puts before the first piece.
        """
        data = b"".join(map(self._piece_bytes.__getitem__, ids))
        first = next((i for i in ids if self.kind[i] != CONTROL), None)
        if first is not None and self.text[first].startswith(BLANK):
            data = data[len(_BLANK_BYTES) :]
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError:
            text = "".join(_valid_parts(data))
        return text.replace(BLANK, " ")


def _valid_parts(data: bytes):
    """Characters of ``data``; each byte that starts no valid character is U+FFFD."""
    at = 0
    while at < len(data):
        for size in range(1, 5):
            try:
                yield data[at : at + size].decode("utf-8")
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            yield "\ufffd"
            at += 1


@functools.lru_cache(maxsize=1)
def _codec(model_path: str, cache: int, pieces: _Pieces) -> PieceCodec:
    """One codec per Python worker, which outlives its tasks."""
    return PieceCodec(pieces.shared.value, cache)


class _Pieces:
    """A model's pieces as broadcast; equal to any other of the same digest."""

    def __init__(self, shared, digest: str):
        self.shared, self.digest = shared, digest

    def __eq__(self, other):
        return isinstance(other, _Pieces) and self.digest == other.digest

    def __hash__(self):
        return hash(self.digest)


def piece_codes(
    df: DataFrame,
    model_path: str,
    with_ids: bool = False,
    with_text: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    cache: int = 400_000,
    keep: bool = True,
) -> DataFrame:
    """Ids of every row's text with begin and end, and the text decoded from them.

    Every row gives one row: ``n_tokens``, digests of ids and decoded text, with ``with_ids``
    also ``ids`` (little-endian unsigned 32-bit integers) and with ``with_text`` ``decoded``.
    A null or empty text has the begin and end ids alone. ``model_path`` must exist on the
    driver; its pieces are broadcast (their number is that of the vocabulary). A Python worker
    keeps the codec and its caches for the tasks to come; without ``keep`` they end with a task.
    """
    found = model_pieces(model_path)
    shared = df.sparkSession.sparkContext.broadcast(found)
    pieces = _Pieces(shared, hex_digest(repr(found)))

    def make():
        codec = _codec(model_path, cache, pieces) if keep else PieceCodec(shared.value, cache)

        def row(doc_id, text):
            n, packed, decoded = codec.packed(text)
            out = doc_id, n, hex_digest(packed), hex_digest(decoded)
            out += (packed,) if with_ids else ()
            return (*out, decoded.decode("utf-8")) if with_text else out

        return row

    source = texts(df, id_col, text_col)
    more = (", ids binary" if with_ids else "") + (", decoded string" if with_text else "")
    return map_rows(
        source,
        make,
        f"doc_id {id_like(source)}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}",
    )
