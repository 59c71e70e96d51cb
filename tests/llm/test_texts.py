import gc
import hashlib
import random
import re
import sys
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattis.llm import bpe, chat, decontaminate, secrets
from lattis.llm.queries import tokenizer_path

# --- decontamination -------------------------------------------------------------------------


def windows(items, size):
    out = []
    for key, w in items:
        if w:
            out += [(key, w)] if len(w) < size else [(key, w[i : i + size]) for i in range(len(w) - size + 1)]
    return out


def brute(doc, found):
    hit, keys = [0] * len(doc), set()
    for key, w in found:
        for i in range(len(doc) - len(w) + 1):
            if doc[i : i + len(w)] == w:
                keys.add(key)
                hit[i : i + len(w)] = [1] * len(w)
    return sum(hit), keys


def test_automaton_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        size, kinds = rng.choice([2, 3, 10]), rng.choice([2, 3, 6])
        make = lambda n: [b"w%d" % rng.randint(0, kinds) for _ in range(n)]
        items = [(str(i), make(rng.randint(0, 14))) for i in range(rng.randint(0, 6))]
        docs = [make(rng.randint(0, 30)) for _ in range(6)]
        got = [(sum(b - a for a, b in s), k) for s, k in decontaminate.Automaton(items, size).batch(docs)]
        assert got == [brute(d, windows(items, size)) for d in docs]


def test_find_with_shards_and_odd_rows(spark, docs, odd):
    rng = random.Random(2)
    vocabulary = [f"tok{i}é" for i in range(30)]
    passage = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, passage(rng.randint(1, 30))) for i in range(20)] + [(3, None), (None, "Only-This, one"), (21, " ;; "), (2, passage(12))]
    texts = [passage(40) + " | " + (items[rng.randrange(20)][1].upper().replace("É", "é")) + " , " + passage(rng.randint(0, 40)) for _ in range(40)]
    table = list(enumerate(texts)) + [(100, None), (101, ""), (102, "only THIS one"), (103, passage(30000)), (0, texts[0])]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    plain = [("null" if i is None else str(i), decontaminate.words_of(t.encode() if t else None)) for i, t in items]
    expected = {i: brute(decontaminate.words_of((t or "").encode()), windows(plain, 10)) for i, t in table}
    for shard in (10**6, 40):
        out = decontaminate.find(odd(docs(table)), benchmark, ["doc_id"], shard_words=shard).collect()
        assert len(out) == len(table)
        for r in out:
            assert (r.n_hit, set(r["items"])) == expected[r.doc_id] and r["items"] == sorted(r["items"])
    assert decontaminate.find(docs([]), benchmark, ["doc_id"]).count() == 0
    assert decontaminate.find(docs(table), benchmark.limit(0), ["doc_id"]).where("n_hit > 0").count() == 0


def test_clean(spark, docs, odd):
    item = "one two three four five six seven eight nine ten eleven"
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    filler = " ".join(f"word{i}" for i in range(30))
    table = odd(docs([(0, f"Ünder {filler}, ONE two-three four five six; seven eight nine ten. {filler} end"), (1, "x " + item), (2, filler), (3, None), (4, "")]))
    out = {r.doc_id: r for r in decontaminate.clean(table, benchmark).collect()}
    assert set(out) == {0, 2, 3, 4} and out[2].text == filler and out[3].text is None
    assert out[0].text == f"Ünder {filler}, . {filler} end" and out[0].n_chars == len(out[0].text)


def test_shards_are_loaded_once_for_many_texts(spark, docs, monkeypatch):
    """Three shards or one: the same hits; a call with many portions loads each shard once."""
    items = [(i, " ".join(f"i{i}w{j}" for j in range(40))) for i in range(30)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    three = decontaminate.shards(benchmark, "item_id", "text", 10, 600)
    one = decontaminate.shards(benchmark, "item_id", "text", 10, 100_000)
    assert len(one) == 1 and len(three) >= 3
    texts = [f"start {items[i % 30][1]} end {i}".encode() for i in range(200)] + [None, b""]
    opened, real = [], decontaminate.file_system
    monkeypatch.setattr(decontaminate, "file_system", lambda path: opened.append(path) or real(path))
    monkeypatch.setattr(decontaminate, "PORTION", 1000)
    sizes, found = decontaminate.matcher(three)(texts)
    assert sorted(opened) == three and sizes == [len(decontaminate.words_of(t)) for t in texts]
    assert (sizes, found) == decontaminate.matcher(one)(texts) and all(k == {str(i % 30)} for i, (_, k) in enumerate(found[:200]))
    table = docs([(i, t.decode()) for i, t in enumerate(texts[:200])])
    both = [sorted(map(str, decontaminate.find(table, benchmark, ["doc_id"], shard_words=n).collect())) for n in (600, 100_000)]
    assert both[0] == both[1]


# --- chat ------------------------------------------------------------------------------------

PIECES = ["a", "\n", " ", "\\", "n", "<", "s", "/", ">", "[", "]", "é", *chat.CONTROLS, "<\\s>", "[\\\\INST]"]
text_of = st.lists(st.sampled_from(PIECES), max_size=8).map("".join) | st.text(max_size=20)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", None, "tool", "a\\n\nb", "<s>"]) | text_of, text_of | st.none()), max_size=5))
def test_chat_round_trip(turns):
    made = [chat.render_turn(r, t) for r, t in turns]
    assert chat.parse("".join(m[0] for m in made)) == [(r or "", t or "") for r, t in turns]
    assert all(chat.unescape(f[a:b]) == (t or "") for (f, a, b), (_, t) in zip(made, turns))


@pytest.mark.parametrize("bad", ["x", "[INST] a", "<s> a [/INST]", "<<TURN>>user\nx<</TURN>>\n"])
def test_chat_parser_refuses(bad):
    with pytest.raises(chat.GrammarError):
        chat.parse(bad)


def test_chat_digests(spark, odd):
    rows = [(1, 1, "assistant", "b </s> <s>"), (1, 0, "user", "a"), (2, 0, None, None), (1, 2, "tool", "{}"), (3, None, "assistant", "z"), (3, 0, "assistant", "y" * 100000), (None, 0, "user", "u"), (1, 1, "assistant", "b </s> <s>")]
    df = odd(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4))
    out = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert set(out) == {1, 2, 3, None}
    for conv, r in out.items():
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


# --- secrets ---------------------------------------------------------------------------------

ASSIGN = re.compile("""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


secret_pieces = st.sampled_from(["password", "PassWd", "secret", "TOKEN", "token", "api_key", "APIkey", "ſecret", "toKen", '"', "'", " ", ":", "=", "AKIA", "ABCDEFGH", "0123456789", "abcdef01" * 3, "deadbeef", "é", "x", "\n", "+/_.", "-"])


@settings(max_examples=500, deadline=None)
@given(st.lists(secret_pieces, max_size=14).map("".join))
def test_base_spans(text):
    base, spans = secrets.scan(text.encode(), secrets.Novelty())
    assert base == plain_spans(text) and set(base) <= set(spans)


CONTEXTS = ["auth {} end", "the token is stored in {} by the service", "set credential via {} please"]


def unseen_names(rng, n):
    """Paths, addresses, identifiers and class names of packages whose sources the dictionary has not read."""
    import os

    import numpy
    import pandas
    import pyarrow

    found = []
    for package in (pandas, pyarrow, numpy):
        root = os.path.dirname(package.__file__)
        for folder, inner, files in os.walk(root):
            inner[:] = sorted(set(inner) - {"tests"})
            for name in sorted(f for f in files if f.endswith(".py")):
                found.append(os.path.relpath(os.path.join(folder, name), os.path.dirname(root)))
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    text = f.read()
                found += re.findall(r"https?://[\w./-]{8,40}", text)[:1]
                longer = sorted(set(re.findall(r"[A-Za-z_][A-Za-z0-9_]{10,}", text)))
                found += rng.sample(longer, min(3, len(longer)))
    found = [x for x in dict.fromkeys(found) if secrets.SHORTEST <= len(x.strip("_/.")) and len(x) <= 60]
    return rng.sample(found, n)


def test_novelty_tells_keys_from_names(spark, docs):
    """Keys of all alphabets and lengths are reported, names of sources that nothing here was fitted to are not."""
    rng = random.Random(21)
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = [letters, digits, letters + digits, letters + letters.upper(), letters + letters.upper() + digits, letters + letters.upper() + digits + "+/", "0123456789ABCDEF"]
    keys = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (11, 12, 14, 16, 20, 24, 32) for _ in range(9)]
    names = unseen_names(rng, 420)
    # each in one text, since what several documents share is taken for a word
    rows = [(kind, s, CONTEXTS[i % 3].format(s)) for kind, many in (("key", keys), ("name", names)) for i, s in enumerate(many)]
    out = {r.doc_id: r.spans for r in secrets.find(docs([(i, t) for i, (_, _, t) in enumerate(rows)]), ["doc_id"]).collect()}
    told = {kind: ["novel" in out[i] or "hex" in out[i] for i, r in enumerate(rows) if r[0] == kind] for kind in ("key", "name")}
    shares = {kind: sum(x) / len(x) for kind, x in told.items()}
    assert shares["key"] >= 0.9 and shares["name"] <= 0.1, shares


def test_scan_follows_its_definition(spark, docs):
    """Base columns of the query's rows against the patterns as the contract words them."""
    rng = random.Random(22)
    bits = ["password=", "Token : ", "api_key='", "SECRET", "AKIA", "akia", "abcdef0123456789", "AB12CD34EF56", "é\n", " = ", "x" * 9, ";", "0" * 31, "f"]
    table = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(300)] + [(300, None), (301, "")] + [(5, "token=abcdefgh1")] * 2
    rules = [(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 8), ("AKIA[A-Z0-9]+", 0, 0, 16), ("[0-9a-f]+", 0, 0, 32)]
    expected = []
    for i, t in table:
        found = [(m.start(), k, m.end()) for k, (p, flags, group, least) in enumerate(rules) for m in re.finditer(p, t or "", flags) if len(m[group]) >= least]
        expected.append((i, *(sum(x[1] == k for x in found) for k in range(3)), ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))))
    rows = secrets.find(docs(table), ["doc_id"]).collect()
    assert sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base) for r in rows) == sorted(expected)
    assert sum(len(r.base) > 0 for r in rows) > 100


def test_novel_spans_and_redaction(spark, docs, odd):
    key = "q7Zp-x81KfWm3Lr9TbYc2Vh6"
    texts = [f"é Authorization: Bearer {key} and more", "authorization follows the_long_identifier_name_of_a_setting here", f"nothing near {key}", None, "", "token = abcdefgh12 AKIA" + "A1" * 8, "auth " + "word " * 30000 + key]
    table = list(enumerate(texts))
    out = {r.doc_id: r for r in secrets.find(odd(docs(table)), ["doc_id"]).collect()}
    assert out[0].spans == f"novel:{texts[0].index(key)}:{texts[0].index(key) + len(key)}" and out[0].base == ""
    assert out[1].spans == out[2].spans == out[3].spans == out[4].spans == out[6].spans == ""
    assert (out[5].n_assign, out[5].n_access) == (1, 1)
    masked = {r.doc_id: r.text for r in secrets.redact(odd(docs(table))).collect()}
    assert masked[0] == "é Authorization: Bearer [SECRET] and more" and masked[5] == "token = [SECRET] [SECRET]" and masked[2] == texts[2] and masked[3] is None
    assert secrets.find(docs([]), ["doc_id"]).count() == 0


# --- BPE -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return bpe.loaded(tokenizer_path())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def agree(model, library, text):
    own, theirs = model.encode(text), library.encode(text, add_special_tokens=False).ids
    assert own == theirs, text
    assert model.decode(own) == library.decode(theirs, skip_special_tokens=False)


FIXED = ["", "  ", "Σ ΑΣ İstanbul it's '’s 123٣½ <|endoftext|>x<|startoftext|>", "a" * 5000, "é" * 300 + "ab" * 1000, "\x1cfoo\x1dbar​﻿", "日本語 한국어 नमस्ते 👩‍👩‍👧 é", "the" * 2000, "in" * 999 + "g", "don'tcan'twe'll'llx", "ſKK", "x" * 127 + "y", "thin" * 32, "thin" * 33]


@pytest.mark.parametrize("text", FIXED)
def test_bpe_fixed(model, library, text):
    agree(model, library, text)


def test_bpe_classes_of_all_characters(model, library):
    """Every character after a letter, a sign and a space: the same tokens as the library's."""
    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(chars), 4096):
        text = " ".join(f"a{c} :{c}" for c in chars[at : at + 4096])
        assert model.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(ord(chars[at]))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="thinanreared'é 12", max_size=300) | st.text(max_size=60))
def test_bpe_random(model, library, text):
    agree(model, library, text)


def test_bpe_streams_long_words_in_constant_memory(model):
    most = 0
    common = bpe.Bpe._common

    def watch(starts, tokens, window):
        nonlocal most
        most = max(most, len(starts))
        return common(starts, tokens, window)

    model_class = type("Watched", (bpe.Bpe,), {"_common": staticmethod(watch)})
    watched = object.__new__(model_class)
    watched.__dict__.update(model.__dict__)
    word = ("thereinthing" * 4000).encode()
    parts = list(watched.word_stream(word))
    assert len(parts) > 100 and most <= 12 * model.lookahead


def test_bpe_decoder_and_blocks(model):
    text = "héllo wörld 日本 x"
    d = bpe.Decoder(model)
    ids = model.encode(text)
    assert "".join([d.feed([i]) for i in ids] + [d.feed([], final=True)]).split() == text.split()
    long = "word é  " * 1000
    assert "".join(bpe.blocks(long, 100)) == long and len(list(bpe.blocks(long, 100))) > 10
    assert list(bpe.blocks("x" * 500, 100)) == ["x" * 500]


def test_bpe_tables(spark, docs, odd, library):
    table = [(0, "Hello there"), (1, None), (2, ""), (3, "x y " * 50000), (0, "Hello there")]
    out = bpe.digest_texts(odd(docs(table)), tokenizer_path(), ["doc_id"]).collect()
    full = {r.doc_id: r for r in bpe.tokenize(odd(docs(table)), tokenizer_path(), ["doc_id"]).collect()}
    assert len(out) == 5
    for r in out:
        ids = library.encode(dict(table)[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and full[r.doc_id].ids == ids
        assert r.ids_sha256 == full[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == full[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digest_texts(docs([]), tokenizer_path(), ["doc_id"]).count() == 0
    assert bpe.encode_texts(docs([(1, "a")]), tokenizer_path(), ["doc_id"]).select(F.size("ids")).first()[0] == 1


def test_bpe_tables_are_compact():
    """Every worker of an executor holds the tokenizer's tables (95 MB when they were nested dicts and tuples)."""
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        held = bpe.Bpe(tokenizer_path())
        gc.collect()
        size = tracemalloc.get_traced_memory()[0] - before
    finally:
        tracemalloc.stop()
    assert held.encode("there") and size < 50e6


def test_secrets_dictionary_counts_all_texts(docs):
    """Words of four among 3,000 texts are in the dictionary, a word of four copies of one text is not."""
    rng = random.Random(5)
    words = ["".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(6)) for _ in range(12)]
    texts = [f"n{i} k{i * 7} {words[i % 12] if i < 48 else ''}" for i in range(3000)] + ["only here quillonetta"] * 4
    known = set(secrets.fit(docs(list(enumerate(texts)))).dictionary.decode().split())
    assert set(words) <= known and "quillonetta" not in known
