"""SentencePiece coding, chat templates, Huffman-coded token files."""

from __future__ import annotations

import hashlib
import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from marketpulse.llm import chat, huffman, sentencepieces, templates, token_files
from marketpulse.llm.registry import QUERIES

from .conftest import SMALL

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def codec():
    return sentencepieces.PieceCodec(sentencepieces.model_pieces(MODEL), cache=100)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_equal_the_library(codec, library):
    rng = random.Random(1)
    letters = "abcdeéß  ▁▁中文😀\n\t\x00<0x0A></s>12'"
    parts = ["th", "ing", "tion", " ", "   ", "er", "return", "    ", "self", ".", "--", "==", "x"]
    for i in range(3000):
        source = parts if i % 2 else letters
        text = "".join(rng.choice(source) for _ in range(rng.randint(0, 30)))
        want = library.encode(text, add_bos=True, add_eos=True)
        assert codec.encode(text) == want, repr(text)
        assert codec.packed(text)[2].decode() == library.decode(want)
        ids = [rng.randrange(600 if rng.random() < 0.5 else 32000) for _ in range(8)]
        assert codec.decode(ids) == library.decode(ids)


def test_long_text_without_blanks(codec, library):
    text = "abcabcab中" * 3000
    assert codec.encode(text) == library.encode(text, add_bos=True, add_eos=True)


def test_compatible_tokens(codec):
    assert codec.compatible("▁the", "re") == (codec.tokens("▁there") == ["▁the", "re"])
    assert codec.tokens("▁unbelievably")


def test_piece_query(spark, small, library):
    got = {r.doc_id: r for r in QUERIES["op5_sentencepiece"](spark, SMALL).collect()}
    for doc_id, text in small:
        ids = library.encode(text, add_bos=True, add_eos=True)
        r = got[doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_of_odd_rows(odd, none):
    rows = sentencepieces.piece_codes(odd, MODEL, with_text=True).collect()
    assert len(rows) == 9
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {2}
    assert sentencepieces.piece_codes(none, MODEL).count() == 0


def _render(source, **names):
    filters = {"up": str.upper}
    return list(templates.compile_template(source, filters)(names))


def test_template_language():
    source = "{% for m in list %}{% if m.a == 'x' and not b %}X{% elif b %}B{% else %}-{% endif %}{% endfor %}"
    items = [{"a": "x"}, {"a": "y"}]
    assert "".join(t for t, _ in _render(source, list=items, b="")) == "X-"
    assert "".join(t for t, _ in _render(source, list=items, b="1")) == "BB"
    assert _render("a{{ 'b' | up + \"\\n\" }}c") == [("aB\nc", False)]
    assert _render("a{% generation %}{{ x }}{% endgeneration %}", x="b") == [("a", False), ("b", True)]


def test_template_constants_are_folded():
    tree = templates.fold(templates.parse("{% if 'a' == 'b' %}no{% else %}y{{ 'es' }}{% endif %}!", {}), {})
    assert tree == ("block", [("print", ("const", "yes!"))])


@pytest.mark.parametrize("source", [
    "{{ x.__class__() }}", "{{ x | eval }}", "{% import os %}", "{% for x in y %}", "{% endif %}",
    "{{ 'a }}", "{{ }}",
])
def test_template_refuses(source):
    with pytest.raises(templates.TemplateError):
        templates.compile_template(source)


def test_template_reaches_no_attributes():
    assert _render("{{ x.upper }}{{ x.__class__ }}", x="text") == []


def test_escapes_are_reversible():
    rng = random.Random(9)
    bits = ["\\", "<", "s>", "</s>", "[", "INST]", "[/INST]", "<s>", "a", "/"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text
        assert not any(c in safe for c in chat.CONTROLS)


def test_conversations_read_back(spark):
    turns = [
        (1, 1, "assistant", "two"), (1, 0, "user", "one </s> \\"), (1, 2, None, None),
        (2, 0, "assistant", "</s>[INST] ok [/INST]"), (2, 0, "assistant", "</s>[INST] ok [/INST]"),
        (None, None, "user", "x"), (None, 3, "assistant", "y"),
    ]
    frame = spark.createDataFrame(
        [(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, part string"
    )
    formatted = chat.format_conversations(frame)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\none </s> \\\nassistant\ntwo\n\n\n")
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (3, 3, sha("two"))
    assert got[2].loss_sha256 == sha("</s>[INST] ok [/INST]" * 2)
    assert got[None].turns_sha256 == sha("user\nx\nassistant\ny\n")
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0


def test_huffman_is_optimal_and_canonical():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 40, 3000):
        counts = rng.integers(0, 1000, n)
        counts[0] = 5
        lengths = huffman.code_lengths(counts, 16)
        assert ((lengths > 0) == (counts > 0)).all() and lengths.max() <= 16
        free = huffman.code_lengths(counts, 40)
        heap = [int(c) for c in counts[counts > 0]]
        heapq.heapify(heap)
        best = heap[0] if len(heap) == 1 else 0
        while len(heap) > 1:
            joined = heapq.heappop(heap) + heapq.heappop(heap)
            best += joined
            heapq.heappush(heap, joined)
        assert (counts * free).sum() == best <= (counts * lengths).sum()
        code = huffman.Code(lengths)
        for size in (1, 255, 256, 257, 3000):
            ids = rng.choice(n, size, p=counts / counts.sum())
            bits, points = code.encode(ids)
            assert (code.decode(bits, points, size) == ids).all()


def test_huffman_keeps_to_its_limit():
    counts = 2 ** np.arange(30)
    lengths = huffman.code_lengths(counts, 6)
    assert lengths.max() == 6 and (0.5 ** lengths.astype(float)).sum() == 1


def test_token_files_equal_the_library(spark, small):
    tokenizer = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r for r in QUERIES["op8_token_files"](spark, SMALL).collect()}
    start = 0
    for doc_id, text in small:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        r = got[doc_id]
        assert (r.start, r.n_tokens) == (start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def _odd_words(rng):
    """Words of letters that the tokenizer composes, lowers or splits, with signs around."""
    letters = (
        "abzAZéÉßñçİıŉǰŸĀªº²½×αΩΣςжЖकषि\u094dाதமி가각日あ\u3099ﬁ①Ⅷ％，．１Ａ"
        "\u0338\u0301\u0307\u0308\u200d\u00ad\t\r\0\x85\u3000😀01"
    )
    signs = "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"
    fixed = ["Vadi", "İ.", "<|endoftext|>", "a<|endoftext|>.", "don't", "I'll.", "½.", "i\u0307."]
    if rng.random() < 0.2:
        return rng.choice(fixed)
    parts = (rng.choices(signs, k=rng.choice([0, 0, 1])), rng.choices(letters, k=rng.randint(0, 5)))
    return "".join([*parts[0], *parts[1], *rng.choices(signs, k=rng.choice([0, 1, 1, 3]))])


def test_words_of_all_scripts_equal_the_library():
    rng, library = random.Random(8), Tokenizer.from_file(WORDS)
    found = [
        rng.choice([" ", "\n", "  "]).join(_odd_words(rng) for _ in range(rng.randint(1, 9)))
        for _ in range(5000)
    ]
    want = library.encode_batch(found, add_special_tokens=False)
    words = token_files.WordTokenizer(WORDS, cache=100_000)  # several generations
    for at in range(0, len(found), 250):
        got = words.packed(pa.array(found[at : at + 250]))
        for text, ids, w in zip(found[at:], got, want[at:]):
            assert ids.tolist() == w.ids, repr(text)
    assert words.old


def test_token_steps_are_bounded(monkeypatch):
    """Texts are cut into steps by size; a text larger than a step is one of its own."""
    monkeypatch.setattr(token_files, "_STEP_BYTES", 100)
    monkeypatch.setattr(token_files, "_STEP_WORDS", 3)
    found = ["a b c d e f g h", "x" * 300, "", "one two", "y " * 70]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(found)], names=["i", "t"])
    steps = list(token_files._steps(batch))
    assert [x for s in steps for x in s.column(1).to_pylist()] == found and len(steps) > 2
    words, library = token_files.WordTokenizer(WORDS), Tokenizer.from_file(WORDS)
    got = [ids.tolist() for s in steps for ids in words.packed(s.column(1))]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in found]


def test_token_files_in_blocks_and_parts(spark, small, tmp_path):
    frame = spark.createDataFrame(small, "doc_id long, text string").repartition(5)
    token_files.write_token_files(frame, str(tmp_path), WORDS, 2, block_ids=500, file_ids=20_000)
    rows = token_files.read_token_files(spark, str(tmp_path), with_ids=True).collect()
    rows.sort(key=lambda r: r.doc_id)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]
    blocks = spark.read.parquet(f"{tmp_path}/blocks")
    assert blocks.count() > 20 and blocks.select("part").distinct().count() > 1


def test_token_files_of_odd_rows(odd, none):
    rows = token_files.token_files(odd, WORDS, 2).collect()
    assert len(rows) == 9 and {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {1}
    assert sorted(r.start for r in rows)[0] == 0
    assert token_files.token_files(none, WORDS, 2).count() == 0
