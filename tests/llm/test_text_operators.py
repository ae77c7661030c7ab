"""Operators on single texts: quality rules, codec, token counts, secrets."""

import hashlib
import random
import re

import pytest

from pyspark.sql import functions as F

from loomcart.llm import piece_codec, quality_rules, queries, secret_scan, token_counts

SCHEMA = "doc_id long, text string, score string, t int, words string, id string"
ODD = [None, "", " ", "\n\n", "a", "é ß 😀 ﬁ", "\x00\x01x", "▁a ▁", "x" * 5000, "ab " * 3000,
       "  two  spaces  ", "\t\n mixed \r\n", "<|endoftext|> tail", "they're we'll I'd  it's"]


def frame(spark, texts, ids=None):
    """Rows with extra columns whose names clash with inner ones."""
    rows = [(None if ids is None and i == 3 else (ids[i] if ids else i), t, "x", 1, "y", "z")
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_rules(text):
    t = text or ""
    w = WORD.findall(t)
    wins = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    cov = set()
    for i, x in enumerate(wins):
        if wins.count(x) > 1:
            cov.update(range(i, i + 8))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)),
            len(cov), len(w) < 20 or 100 * len(cov) > 30 * len(w))


def test_quality_rules_match_brute_force(spark):
    rng = random.Random(1)
    texts = ODD[:8] + ["w" * 3000] + [
        "".join(rng.choice(["a ", "b ", "c. ", "\n", "| ", "d* "]) for _ in range(rng.randint(0, 120)))
        for _ in range(60)]
    texts += [texts[-1]]
    got = quality_rules.judge(frame(spark, texts, list(range(len(texts))))).orderBy("doc_id").collect()
    assert len(got) == len(texts)
    for r, t in zip(got, texts):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                r.base_failed) == brute_rules(t), repr(t)
        assert not (r.base_failed and r.kept)


def test_quality_rules_lines(spark):
    clean = " ".join(f"word{i} follows here." for i in range(30))
    nav = "Home | Shop | About | Contact | News | Help | Login | Cart | More | End"
    noisy = clean + "\n" + nav + "\nLicensed under the MIT License."
    r = quality_rules.judge(frame(spark, [noisy, "\n".join([nav + f" {i}" for i in range(5)])], [1, 2]),
                            with_text=True).orderBy("doc_id").collect()
    assert r[0].kept and r[0].clean_text == clean and r[0].n_failed_lines == 2
    assert not r[1].kept and r[1].lost_chars == r[1].word_chars


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert quality_rules.judge(none).count() == 0
    assert secret_scan.digests(secret_scan.scan(none)).count() == 0
    assert piece_codec.encode_documents(none, queries.vocabulary("piece_bpe_32k.model")).count() == 0
    assert token_counts.count_documents(none, queries.vocabulary("byte_bpe_50k.json")).count() == 0


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    path = queries.vocabulary("piece_bpe_32k.model")
    return piece_codec.PieceCodec(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_codec_equals_library(library):
    own, sp = library
    rng = random.Random(2)
    letters = "ab  \n\tthe▁é😀ßaaa<s></s>0x41   "
    texts = [t or "" for t in ODD] + [" " * k for k in range(70)] + ["a" + " " * k + "b" for k in range(70)]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    ids, b = own.encode(texts)
    for t, x, y in zip(texts, b[:-1], b[1:]):
        assert ids[x:y].tolist() == sp.encode(t, add_eos=True), repr(t)
    assert [x.decode() for x in own.decode_bytes(ids, b)] == [sp.decode(ids[x:y].tolist()) for x, y in zip(b[:-1], b[1:])]
    odd = [[rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(0, 6), 259])
            for _ in range(rng.randint(0, 8))] for _ in range(1500)]
    assert own.decode(odd) == [sp.decode(x) for x in odd]


def test_codec_of_long_words(library):
    """Words without a space, from a heap: the same pieces, in seconds."""
    import time

    codec, lib = library
    rng = random.Random(12)
    texts = ["the" * 20_000, "ab" * 3000 + " " + "x" * 5000, "".join(rng.choice("aeiourstln") for _ in range(200_000)),
             "".join(rng.choice("thehonéи漢😀") for _ in range(9000)) + " tail", "a" * 1001 + " " + "a" * 1000]
    t0 = time.perf_counter()
    got = [codec.encode([t])[0] for t in texts]
    assert time.perf_counter() - t0 < 30
    for ids, t in zip(got, texts):
        assert list(ids) == lib.encode(t, add_eos=True)
    small = piece_codec.PieceCodec(queries.vocabulary("piece_bpe_32k.model"), long_word=3)
    for t in texts[3:] + [t or "" for t in ODD]:
        assert list(small.encode([t])[0]) == lib.encode(t, add_eos=True)


def test_codec_small_table_gives_the_same(library):
    own, sp = library
    small = piece_codec.PieceCodec(queries.vocabulary("piece_bpe_32k.model"), table_words=3)
    for t in ("one two three four five six", "six seven eight one", "nine one two"):
        assert small.encode([t])[0].tolist() == sp.encode(t, add_eos=True)


def test_codec_documents(spark, library):
    _, sp = library
    got = piece_codec.encode_documents(
        frame(spark, ODD, list(range(len(ODD)))), queries.vocabulary("piece_bpe_32k.model"), slice_bytes=50,
        outputs=("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256", "round_trip")
    ).orderBy("doc_id").collect()
    for r, t in zip(got, ODD):
        want = sp.encode(t or "", add_eos=True)
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(want).encode()).hexdigest()
        assert r.decoded == sp.decode(want) and r.round_trip


def test_token_counts_every_prefix():
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    own, lib = token_counts.TokenCounter(path), Tokenizer.from_file(path)

    def want(t):
        return len(lib.encode(t, add_special_tokens=False).ids)

    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "'", "'re", "'ll", "é", "😀", "12", "the", "ing", "##",
             " <|endoftext|>", "<|end", "\t", "　", "!!"]
    texts = [t or "" for t in ODD[:8]] + ODD[-2:]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    for t in texts:
        if len(t) < 200:
            counts = own.prefix_counts(t)
            assert counts.tolist() == [want(t[:i]) for i in range(len(t) + 1)], repr(t)
            for budget in (0, 1, 3):
                fits = [i for i in range(len(t) + 1) if want(t[:i]) <= budget]
                assert own.cut(t, budget) == fits[-1]


def test_token_counts_documents(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = token_counts.count_documents(frame(spark, ODD, list(range(len(ODD)))), path, budgets=(5,),
                                       with_prefixes=True, slice_bytes=50).orderBy("doc_id").collect()
    for r, t in zip(got, ODD):
        assert r.n_tokens == len(lib.encode(t or "", add_special_tokens=False).ids)
        assert r.n_bytes == len((t or "").encode()) and r.prefix_tokens[-1] == r.n_tokens
        assert r.prefix_tokens[r.chars_5] <= 5


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)


def brute_spans(t):
    s = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 6]
    s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    return sorted(s + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24])


def secret_texts():
    rng = random.Random(4)
    parts = ["password", "TOKEN", "api_key", "apikey", "=", ":", " ", '"', "'", "abc123", "AKIA", "AKIA" + "Q7" * 9,
             "deadbeef" * 4, "é", "\x01", "\x02", ".", "-", "word "]
    return [t or "" for t in ODD] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(300)]


def test_secret_base_spans(spark):
    texts = secret_texts()
    got = secret_scan.digests(secret_scan.scan(frame(spark, texts, list(range(len(texts)))))).orderBy("doc_id").collect()
    names = secret_scan.KINDS
    for r, t in zip(got, texts):
        s = brute_spans(t)
        x = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in s)
        assert r.base_sha256 == hashlib.sha256(x.encode()).hexdigest(), repr(t)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in s) for j in range(3))
        assert set(filter(None, x.split(","))) <= set(filter(None, r.spans.split(",")))


def test_secret_markov_adds_random_strings(spark):
    rng = random.Random(5)

    def rand(n):
        return "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(n))

    words = ["customer_order_reference", "internationalization", "configuration_parameter",
             "responsibilities", "notwithstanding_clause", "representation_layer"]
    texts = [f"the {rng.choice(words)} and {rng.choice(words)} password={rand(24)} end" for _ in range(150)]
    planted = rand(32)
    texts += [f"some {words[0]} then {planted} closes", f"only {words[3]} here"]
    got = secret_scan.digests(secret_scan.scan(frame(spark, texts, list(range(len(texts)))))).orderBy("doc_id").collect()
    at = texts[150].index(planted)
    assert got[150].spans == f"markov:{at}:{at + 32}"
    assert got[151].spans == ""
    assert sum("markov" in r.spans for r in got[:150]) == 0


def test_secret_redaction(spark):
    from pyspark.sql import functions as F

    texts = ["a password=abcdef123 b " + "0123456789abcdef" * 2, "token = \"" + "ab12" * 8 + "\"", "clean", None]
    out = secret_scan.scan(frame(spark, texts, [1, 2, 3, 4]), keep=("text",)).orderBy("doc_id").select(
        secret_scan.redacted(F.col("text")).alias("x")).collect()
    assert [r.x for r in out] == ["a [SECRET] b [SECRET]", '[SECRET]"', "clean", None]


def cut_runs(t, spans):
    """Runs of 12 and more characters less the base spans."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{12,}", t):
        free = [i for i in range(m.start(), m.end()) if not any(a <= i < b for a, _, b in spans)]
        while free:
            n = next((k for k in range(1, len(free)) if free[k] != free[0] + k), len(free))
            out.append((free[0], free[0] + n, t[free[0]:free[0] + n], n == m.end() - m.start()))
            free = free[n:]
    return out


def test_secret_runs_are_cut_at_base_spans(spark):
    texts = secret_texts() + ["x" * 20 + "deadbeef" * 4 + "_" * 20 + "AKIA" + "Q7" * 9 + "abcdef0123456789" * 3 + "z" * 13]
    got = secret_scan._outside(secret_scan.base_spans(frame(spark, texts, list(range(len(texts)))))).orderBy("id")
    for r, t in zip(got.collect(), texts):
        assert [tuple(x) for x in r.runs] == cut_runs(t.replace("\x01", "\x02"), brute_spans(t)), repr(t)


def test_secret_rest_of_a_key_is_found(spark):
    """A key that holds a hex stretch is masked around it too."""
    rng = random.Random(6)
    letters = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"
    words = ["customer_order_reference", "internationalization", "responsibilities"]
    texts = [f"the {rng.choice(words)} password={''.join(rng.choice(letters) for _ in range(24))}" for _ in range(150)]
    rest = "ZqW8rT5yUiOpLkJhGfDsAzXcVbNm12"
    texts += ["see " + "aB3xQ9" + "0123456789abcdef01234567" + rest + " end"]
    out = secret_scan.scan(frame(spark, texts, list(range(len(texts)))), keep=("text",)).orderBy("doc_id").select(
        secret_scan.redacted(F.col("text")).alias("x"), secret_scan.spans_text("spans").alias("s")).collect()[-1]
    assert out.s == "hex:9:34,markov:34:64" and out.x == "see aB3xQ[SECRET][SECRET] end"


def test_redaction_matches_python(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(200):
        t = "".join(rng.choice("aé😀﻿\x00 z") for _ in range(rng.randint(0, 30)))
        spans = []
        for _ in range(rng.randint(0, 5)):
            a, b = sorted((rng.randint(0, len(t)), rng.randint(0, len(t))))
            if a < b:
                spans.append((a, 0, b))
        rows.append((t, sorted(spans)))
    frame_ = spark.createDataFrame(rows, "text string, spans array<struct<s:int,k:int,e:int>>")
    for r in frame_.select("*", secret_scan.redacted(F.col("text")).alias("x")).collect():
        out, at = "", 0
        for s, _, e in r.spans:
            if s >= at:
                out += r.text[at:s] + "[SECRET]"
            at = max(at, e)
        assert r.x == out + r.text[at:]


def test_secret_scan_of_one_long_text(spark):
    """A megabyte of hex keys, and one of a single unbroken run, in seconds."""
    import time

    rng = random.Random(1)
    keys = ["%032x" % rng.getrandbits(128) for _ in range(30_000)]
    for text in (" ".join(keys), "_".join(keys)):
        t0 = time.perf_counter()
        out = secret_scan.scan(frame(spark, [text], [1]), keep=("text",)).select(
            F.size("spans").alias("n"), secret_scan.redacted(F.col("text")).alias("x")).first()
        assert time.perf_counter() - t0 < 30
        assert out.n >= 30_000 and not re.search("[0-9a-f]", out.x)
