"""Token ids as files: Huffman-coded blocks in ascending document order.

A token file set is a folder with ``code`` (code lengths by id) and ``blocks``. A block holds
whole documents: their ids as one bit string under the canonical code, a bit-offset
checkpoint every 256 ids, and a directory of its documents. Blocks are independent; inside
one, decoding can begin at any checkpoint.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marketpulse.llm.common import id_like, map_batches, shared_folder, stored, texts
from marketpulse.llm.huffman import Code, code_lengths

_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A last character that the tokenizer takes for a letter or digit, whatever it does before.
#: It composes and lowers case first: beyond ASCII these are Latin letters whose lower case is
#: one letter too. Others may end in a mark, which makes one token with a sign after it.
_LETTER_LAST = (
    "[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u01ef\u01f1-\u024f]\\z"
)
#: Words longer than this are encoded anew each time.
_KEPT_CHARS = 64
#: Text and words of one step; bounds what a step holds beside the text itself.
_STEP_BYTES, _STEP_WORDS = 8 << 20, 1 << 18


def _parts(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Words without the signs at their end, and these; ASCII words in lower case.

    A sign after a letter or digit begins a token of its own, and the tokenizer lowers case
    itself, so the parts have the ids of the word. Words that could hold a special token
    stay whole.
    """
    core = pc.utf8_rtrim(words, _SIGNS)
    cut = pc.and_(
        pc.match_substring_regex(core, _LETTER_LAST),
        pc.invert(pc.match_substring(words, "<|")),
    )
    signs = pc.struct_field(pc.extract_regex(words, f"(?P<tail>[{re.escape(_SIGNS)}]*)\\z"), [0])
    tail = pc.if_else(cut, signs, pa.scalar("", words.type))
    core = pc.if_else(cut, core, words)
    core = pc.if_else(pc.and_(cut, pc.string_is_ascii(core)), pc.ascii_lower(core), core)
    return core, tail


class WordTokenizer:
    """A tokenizer that drops blanks and never joins across them, with words remembered.

    Ids of texts are those of their words in turn, so each distinct word is encoded once
    while it is remembered. A generation takes the words of a step until it holds ``cache``
    bytes; words of the last generation move on when they are met again.
    """

    def __init__(self, path: str, cache: int = 40 << 20):
        from tokenizers import Tokenizer

        # A task has one core, and memory of more threads would stay with the worker.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        probe = self._ids(["A1, b\nc", "a1", ",", "b", "c"])
        if probe[0] != [i for ids in probe[1:] for i in ids]:
            raise ValueError("this tokenizer does not work word by word")
        self.cache, self.held = cache, 0
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        mark = self._ids(["\0"])[0]
        self.mark = mark[0] if len(mark) == 1 else None

    def _ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Encode words in lines of many.

        Each word of letters ends with the one token of it that the vocabulary marks as a
        word's end. Other words are parted by a character that none of them holds; what
        neither can part is encoded word by word.
        """
        out = {}
        letters = [w for w in words if w.isalpha()] if self.last.any() else []
        plain = [w for w in words if "\0" not in w and not w.isalpha()] if self.mark is not None else []
        for group, gap in ((letters, " "), (plain, " \0 ")):
            lines = [group[i : i + 500] for i in range(0, len(group), 500)]
            coded = (
                ids
                for i in range(0, len(lines), 32)  # the library's own results are large
                for ids in self._ids([gap.join(x) for x in lines[i : i + 32]])
            )
            for line, found in zip(lines, coded, strict=True):
                if gap == " ":
                    ids = np.array(found, "<u4")
                    ends = np.flatnonzero(self.last[ids]) + 1
                    starts = np.concatenate([[0], ends])
                else:
                    ids = np.array([*found, self.mark], "<u4")
                    ends = np.flatnonzero(ids == self.mark)
                    starts = np.concatenate([[0], ends + 1])
                if len(ends) == len(line):
                    data = ids.tobytes()
                    for w, a, b in zip(line, (4 * starts).tolist(), (4 * ends).tolist()):
                        out[w] = data[a:b]
        rest = [w for w in words if w not in out]
        for w, ids in zip(rest, self._ids(rest), strict=True):
            out[w] = np.array(ids, "<u4").tobytes()
        return out

    def of_words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, as little-endian unsigned 32-bit integers."""
        old, out = self.old, list(map(self.known.get, words))
        missing = [k for k, ids in enumerate(out) if ids is None]
        fresh = self._learn([words[k] for k in missing if words[k] not in old])
        kept = {}
        for k in missing:
            word = words[k]
            ids = out[k] = fresh[word] if word in fresh else old[word]
            if len(word) <= _KEPT_CHARS:
                kept[word] = ids
        self.known |= kept
        self.held += 200 * len(kept) + sum(map(len, kept)) + sum(map(len, kept.values()))
        if self.held > self.cache:
            self.old, self.known, self.held = self.known, {}, 0
        return out

    def packed(self, found: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a string array. Words are told apart for all texts at once."""
        split = pc.split_pattern(pc.replace_substring(found, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        core, tail = _parts(coded.dictionary)
        both = pa.concat_arrays([core, tail]).dictionary_encode()
        ids = self.of_words(both.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        part_of = both.indices.to_numpy().reshape(2, -1)
        word, parts = coded.indices.to_numpy(), []
        for at in range(0, len(word), _STEP_WORDS):
            own = part_of[:, word[at : at + _STEP_WORDS]].T.ravel()
            n = sizes[own]
            shift = np.repeat(starts[own] - (np.cumsum(n) - n), n)
            parts.append(flat[shift + np.arange(len(shift))])
        whole = np.concatenate(parts) if parts else flat
        of_word = sizes[part_of].sum(axis=0)
        upto = np.concatenate([[0], np.cumsum(of_word[word])])
        bounds = upto[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield whole[a:b]


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per Python worker, which outlives its tasks."""
    return WordTokenizer(path)


def tokenized(
    df: DataFrame, tokenizer_path: str, end_id: int, id_col="doc_id", text_col="text"
) -> DataFrame:
    """(doc_id, n_tokens, ids): compressed ids of every row's text, with the end id."""

    source = texts(df, id_col, text_col)
    schema = T._parse_datatype_string(f"doc_id {id_like(source)}, n_tokens long, ids binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        pack = zstandard.ZstdCompressor(level=1)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for part in _steps(batch):
                sizes, packed = [], []
                for ids in tokenizer.packed(part.column(1)):
                    full = np.concatenate([ids, end])
                    sizes.append(len(full))
                    packed.append(pack.compress(_planes(full.tobytes())))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())],
                    schema=arrow,
                )

    return source.mapInArrow(run, schema)


def _steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded amount of text, or one row."""
    size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + _STEP_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def _planes(ids: bytes) -> bytes:
    """Byte planes, lowest first; high planes are mostly zero and cost next to nothing."""
    return np.frombuffer(ids, np.uint8).reshape(-1, 4).T.tobytes()


def _ids(packed: bytes, unpack) -> np.ndarray:
    planes = np.frombuffer(unpack.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents; as long as the vocabulary."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        total = np.zeros(0, np.int64)
        for batch in batches:
            for packed in batch["ids"]:
                found = np.bincount(_ids(packed, unpack))
                if len(found) > len(total):
                    total, found = found, total
                total[: len(found)] += found
        seen = np.flatnonzero(total)
        yield {"id": seen.tolist(), "n": total[seen].tolist()}

    rows = map_batches(tokens.select("ids"), run, "id long, n long").groupBy("id").sum("n").collect()
    out = np.zeros(max((r[0] for r in rows), default=0) + 1, np.int64)
    for i, n in rows:
        out[i] = n
    return out


def write_token_files(
    df: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_ids: int = 1 << 19,
    file_ids: int = 1 << 24,
) -> None:
    """Tokenize every row's text and write the ids in ascending id order.

    Rows of equal id follow each other in the order of a hash of their ids; a missing id
    comes first. A null or empty text has the end id alone. A block takes documents until it
    has ``block_ids`` ids; ``file_ids`` is the aim for one file.
    """
    spark = df.sparkSession
    tokens = stored(tokenized(df, tokenizer_path, end_id, id_col, text_col), "tokens")
    counts = id_counts(tokens)
    lengths = code_lengths(counts)
    spark.createDataFrame(
        [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id long, length int"
    ).coalesce(1).write.parquet(f"{folder}/code")
    shared = spark.sparkContext.broadcast(lengths)
    parts = max(1, int(-(-counts.sum() // file_ids)))
    keys = tokens.withColumn("tie", F.xxhash64("ids"))
    ordered = keys.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def blocks(batches):
        code, unpack = Code(shared.value), zstandard.ZstdDecompressor()
        part, before, held, docs = TaskContext.get().partitionId(), 0, 0, []

        def block():
            ids = np.concatenate([d[1] for d in docs])
            bits, checkpoints = code.encode(ids)
            return {
                "part": [part],
                "before": [before],
                "n_ids": [len(ids)],
                "bits": [bits],
                "checkpoints": [checkpoints.astype("<u8").tobytes()],
                "doc_ids": [[d[0] for d in docs]],
                "sizes": [[len(d[1]) for d in docs]],
            }

        for batch in batches:
            for doc_id, packed in zip(batch["doc_id"], batch["ids"], strict=True):
                docs.append((doc_id, _ids(packed, unpack)))
                held += len(docs[-1][1])
                if held >= block_ids:
                    yield block()
                    before, held, docs = before + held, 0, []
        if docs:
            yield block()

    map_batches(
        ordered.select("doc_id", "ids"),
        blocks,
        "part int, before long, n_ids long, bits binary, checkpoints binary, "
        f"doc_ids array<{id_like(tokens)}>, sizes array<long>",
    ).write.parquet(f"{folder}/blocks")


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the files.

    ``start`` counts the ids of all documents before it. With ``with_ids`` the ids come too,
    as little-endian unsigned 32-bit integers.
    """
    rows = spark.read.parquet(f"{folder}/code").collect()
    lengths = np.zeros(max((r.id for r in rows), default=0) + 1, np.uint8)
    for r in rows:
        lengths[r.id] = r.length
    shared = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.parquet(f"{folder}/blocks")
    # One row per file, of which there are few.
    ends = {r[0]: r[1] for r in blocks.groupBy("part").agg(F.sum("n_ids")).collect()}
    base, at = {}, 0
    for part in sorted(ends):
        base[part] = at
        at += ends[part]

    def run(batches):
        code = Code(shared.value)
        for batch in batches:
            for part, before, n, bits, points, doc_ids, sizes in zip(
                *(batch[c] for c in columns), strict=True
            ):
                ids = code.decode(bits, np.frombuffer(points, "<u8"), n).astype("<u4")
                ends = np.cumsum(sizes)
                own = [ids[e - s : e].tobytes() for e, s in zip(ends, sizes, strict=True)]
                out = {
                    "doc_id": doc_ids,
                    "start": (base[part] + before + ends - sizes).tolist(),
                    "n_tokens": sizes,
                    "ids_crc32": [zlib.crc32(x) for x in own],
                }
                yield out | ({"ids": own} if with_ids else {})

    columns = ("part", "before", "n_ids", "bits", "checkpoints", "doc_ids", "sizes")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return map_batches(
        blocks.select(*columns),
        run,
        f"doc_id {kind}, start long, n_tokens long, ids_crc32 long"
        + (", ids binary" if with_ids else ""),
    )


def token_files(df: DataFrame, tokenizer_path: str, end_id: int, **options) -> DataFrame:
    """Write ``df`` to a new shared folder and read it back."""
    folder = shared_folder(df.sparkSession, "token-files")
    write_token_files(df, folder, tokenizer_path, end_id, **options)
    return read_token_files(df.sparkSession, folder)
