"""Compression bands, decontamination and secret scans."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import zstandard

from marketpulse.llm import automata, decontaminate, quality_rules, secrets
from marketpulse.llm.registry import QUERIES

from .conftest import SMALL


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def plain_counts(text):
    words = _words(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {
        j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1
        for j in range(i, i + 3)
    }
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if _words(line):
            dup += line in seen
            seen.add(line)
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit),
    )


def test_rules_match_plain_counts(spark, small):
    got = {r.doc_id: r for r in QUERIES["op2_compression_bands"](spark, SMALL).collect()}
    assert len(got) == len(small)
    for doc_id, text in small:
        r, want = got[doc_id], plain_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_word_counts_of_odd_texts():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab \n\t\x0b\x1c\x85 é#|") for _ in range(rng.randint(0, 60)))
        assert quality_rules.word_counts(text) == plain_counts(text), repr(text)


def test_bands_reject_repetition_and_noise(docs):
    rng = random.Random(1)
    prose = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9))) for _ in range(400))
    noise = " ".join("".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(12)) for _ in range(60))
    frame = docs(prose, prose + " same words" * 2000, noise, "again and again " * 200)
    got = {r.doc_id: r.kept for r in quality_rules.compression_bands(frame).collect()}
    assert got[0] and not got[1] and not got[3]
    ratio = len(noise.encode()) / len(zstandard.ZstdCompressor(3).compress(noise.encode()))
    assert not quality_rules.Bands(limits=((1e9, ratio + 0.1, 9.0),)).inside(2000, ratio)


def test_rules_on_odd_rows(odd, none):
    rows = quality_rules.compression_bands(odd).collect()
    assert len(rows) == 9
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in rows if r.doc_id in (2, 3, 5))
    assert quality_rules.compression_bands(none).count() == 0


def brute_hits(text, items, width=10):
    def split(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    words, hit, found = split(text), set(), set()
    for item_id, item in items:
        own = split(item)
        for i in range(max(1, len(own) - width + 1) if own else 0):
            window = own[i : i + width]
            for j in range(len(words) - len(window) + 1):
                if words[j : j + len(window)] == window:
                    hit.update(range(j, j + len(window)))
                    found.add(str(item_id))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit)


def test_contamination_against_brute_force(spark, docs):
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "Ä", "x1"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, "a b"), (2, ""), (None, "a"), (3, None), (10, text(6)), (4, "c"), (5, text(9))]
    found = [text(rng.randint(0, 40)).replace(" ", rng.choice([" ", "-", "\n"])) for _ in range(40)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    usable = [i for i in items if i[0] is not None]
    for size in (1 << 20, 8):  # one automaton, and many
        rows = decontaminate.contamination(docs(*found), benchmark, 4, block_bytes=size).collect()
        for r in rows:
            assert tuple(r)[1:6] == brute_hits(found[r.doc_id], usable, 4)


def test_offsets_lead_back_to_the_text(spark, docs):
    benchmark = spark.createDataFrame([(1, "Ünder the  big tree")], "item_id long, text string")
    text = "é-é. Ünder THE\nbig tree, ok"
    row = decontaminate.contamination(docs(text), benchmark).collect()[0]
    a, b = map(int, row.hit_spans.split(":"))
    assert text[a:b] == "Ünder THE\nbig tree"


def test_contamination_of_odd_rows(spark, odd, none):
    benchmark = spark.createDataFrame([(7, "ipsum dolor lorem")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(odd, benchmark).collect()}
    assert got[4].contaminated and got[4].n_words == 90_000
    assert not got[2].contaminated
    kept = decontaminate.drop_contaminated(odd, benchmark)
    assert kept.count() == 8 and kept.columns == odd.columns
    assert decontaminate.contamination(none, benchmark).count() == 0
    assert not decontaminate.contamination(odd, benchmark.limit(0)).filter("contaminated").count()


def plain_spans(text):
    kinds = (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)),
        ("access", re.compile("AKIA[A-Z0-9]+")),
        ("hex", re.compile("[0-9a-f]+")),
    )
    least = {"assign": 6, "access": 20, "hex": 24}
    out = [
        (m.start(), i, m.end(), kind)
        for i, (kind, p) in enumerate(kinds) for m in p.finditer(text)
        if len(m[2] if kind == "assign" else m[0]) >= least[kind]
    ]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_base_spans_against_plain_patterns(spark, small):
    rng = random.Random(2)
    bits = ["token", "secret", ":", "=", ' "', "abc", "AKIA", "Z9" * 9, "0a" * 13, " ", "ſecret", "API_KEY", "é"]
    for _ in range(2000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert secrets.joined([s[:3] for s in secrets.base_spans(text)]) == plain_spans(text)
    got = {r.doc_id: r for r in QUERIES["op1_secrets"](spark, SMALL).collect()}
    for doc_id, text in small:
        want = plain_spans(text)
        assert got[doc_id].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(got[doc_id].spans.split(","))


def test_formats_are_learned(docs):
    rng = random.Random(4)
    key = lambda: "sk-" + "".join(rng.choice("0123456789abcdefXYZ") for _ in range(29))
    labelled = [f"password = {key()} and internationalization-of-things here" for _ in range(80)]
    hidden = key()
    frame = docs(*labelled, f"see {hidden} or wellknown-ordinary-word2", "nothing")
    rows = {r.doc_id: r for r in secrets.find_secrets(frame).collect()}
    assert rows[80].spans == f"format:4:{4 + len(hidden)}"
    assert hidden not in rows[80].redacted and rows[81].spans == ""


def _key(rng, n):
    return "".join(rng.choice("0123456789abcdefXYZ") for _ in range(n))


def test_formats_of_any_length_are_learned(docs):
    rng = random.Random(8)
    prose = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 14))) for _ in range(400)]
    for size in (12, 300):
        labelled = [f"token={_key(rng, size)} {' '.join(rng.choices(prose, k=9))}" for _ in range(60)]
        hidden = _key(rng, size)
        frame = docs(*labelled, f"see {hidden} there", " ".join(prose))
        rows = {r.doc_id: r for r in secrets.find_secrets(frame).collect()}
        assert rows[60].spans == f"format:4:{4 + size}"
        assert rows[61].spans == ""
        assert all("format" not in r.spans for r in rows.values() if r.doc_id != 60)


def test_credentials_without_digits_are_found_and_words_are_not(docs):
    rng = random.Random(9)
    letters = lambda: "".join(rng.choice("GHJKLMNPQRSTVWXZ") for _ in range(14))
    prose = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(14, 20))) for _ in range(200)]
    hidden = letters()
    frame = docs(*[f"secret: {letters()} {w}" for w in prose], f"{hidden} {prose[0]}")
    rows = {r.doc_id: r for r in secrets.find_secrets(frame).collect()}
    assert rows[200].spans == "format:0:14"
    assert all("format" not in rows[i].spans for i in range(200))


def test_labelled_words_make_no_format(docs):
    rng = random.Random(10)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(6, 12))) for _ in range(900)]
    lines = [f"token {w} secret: {v} {x}" for w, v, x in zip(words, words[300:], words[600:])]
    rows = secrets.find_secrets(docs(*lines)).collect()
    found = sum(r.spans.count("format") for r in rows)
    assert found <= 2 * len(lines) // 50, found


def _plain_score(automaton, text):
    """Mean log probability per character, one dictionary look-up at a time."""
    at, total = 0, 0.0
    for c in [*text, ""]:
        edges = automaton.edges[at] if at >= 0 else {}
        s = automata.symbol(c) if c else automata.END
        p, at = edges.get(s, (automaton.unseen, -1))
        total += p - (math.log(automata.SPREAD.get(s, 1)) if c else 0)
    return total / (len(text) + 1)


def test_format_spans_match_a_plain_scan(docs):
    rng = random.Random(11)
    prose = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 14))) for _ in range(9000)]
    texts = []
    for i in range(240):
        bits = rng.choices(prose, k=rng.randint(0, 60))
        if i % 8 == 0:
            bits.insert(rng.randint(0, len(bits)), _key(rng, rng.randint(9, 15)))
        if i % 2:
            bits.append(f"passwd = '{_key(rng, rng.randint(9, 15))}'")
        texts.append(rng.choice([" ", "\n", ", "]).join(bits))
    frame = docs(*texts)
    formats = secrets.learn_formats(frame)
    assert formats.kinds and formats.shortest == 9
    got = {r.doc_id: r.spans for r in secrets.scan(frame, formats).collect()}
    seen = 0
    for i, text in enumerate(texts):
        want = [x for x in plain_spans(text).split(",") if x]
        taken = [tuple(map(int, x.split(":")[1:])) for x in want]
        for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", text):
            a, b = m.span()
            if b - a < 9 or any(x < b and a < y for x, y in taken):
                continue
            usual = _plain_score(formats.ordinary, m[0])
            if any(
                _plain_score(x, m[0]) - usual >= formats.least[k] for k, x in formats.kinds.items()
            ):
                want.append(f"format:{a}:{b}")
                seen += 1
        want.sort(key=lambda x: (int(x.split(":")[1]), secrets.KINDS.index(x.split(":")[0])))
        assert got[i] == ",".join(want)
    assert seen > 20


def test_a_full_automaton_merges_into_the_nearest_state():
    rng = random.Random(12)
    examples = ["".join(rng.choices("a9Z-", k=6)) for _ in range(60)]
    small = automata.infer(examples, alpha=0.9, max_states=4)
    assert len(small.edges) == 4
    assert small.log_likelihood("a9Z-a9") > small.log_likelihood("++++++")


def test_automaton_prefers_its_language():
    rng = random.Random(6)
    word = lambda: "ab" * rng.randint(3, 6) + str(rng.randint(100, 999))
    a = automata.infer([word() for _ in range(300)])
    assert len(a.edges) < 20
    assert a.log_likelihood("ababab123") > a.log_likelihood("zz-zz-zz") + 1
    assert automata.infer([]).log_likelihood("x") < 0


def test_secrets_of_odd_rows(odd, none):
    assert secrets.find_secrets(odd).count() == 9
    assert secrets.find_secrets(none).count() == 0
    formats = secrets.formats_of({}, secrets.Settings())
    kept = secrets.redact(odd, formats)
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, odd.collect()))


def test_one_bad_chunk_in_a_long_clean_text(docs):
    rng = random.Random(5)
    letters = "etaoinshrdlu"
    words = ["".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(3000)]
    prose = " ".join(rng.choices(words, k=20_000))
    size = quality_rules.Bands().chunk_bytes
    noise = "".join(chr(rng.randint(33, 126)) for _ in range(size))
    again = ("the same line once again\n" * size)[:size]
    parts = [prose[i : i + size] for i in range(0, 8 * size, size)]
    found = ["".join(parts)] + ["".join([*parts[:3], x, *parts[4:]]) for x in (noise, again)]
    rows = quality_rules.compression_bands(docs(*found)).collect()
    got = {r.doc_id: (r.n_chunks, r.bad_chunks, r.base_failed, r.kept) for r in rows}
    assert got == {0: (8, 0, False, True), 1: (8, 1, False, False), 2: (8, 1, False, False)}
