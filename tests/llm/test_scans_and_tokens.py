"""SentencePiece, secrets, packing and licences against their libraries, expressions and SQL."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_rows import TEXTS, pairs
from hypothesis import given, settings, strategies as st
from oracle import compare, connect

from tallyscope.llm import licences, packing, registry, secrets, sentencepiece_codec

MODEL, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = st.lists(st.sampled_from([*"ab e\n\t ▁é—'0　 \x1c\x85.", "the", "  ", " \n "]), max_size=30).map("".join)


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL), sentencepiece_codec.ChunkTable(MODEL)


@settings(max_examples=300, deadline=None)
@given(ALPHABET)
def test_chunks_join_to_the_whole_encoding(pieces, text):
    model, table = pieces
    ids, decoded = table.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == model.encode(text)
    assert decoded == model.decode(model.encode(text))


def test_sentencepiece_rows(spark, odd, none, pieces):
    rows = sentencepiece_codec.encode(odd, MODEL).collect()
    want = []
    for row in odd.collect():
        ids = pieces[0].encode(row.text or "", add_bos=True, add_eos=True)
        want.append((row.doc_id, np.asarray(ids, "<u4").tobytes(), pieces[0].decode(ids)))
    assert sorted(((r.id, bytes(r.ids), r.decoded) for r in rows), key=repr) == sorted(want, key=repr)
    assert sentencepiece_codec.encode(none, MODEL).count() == 0


def test_small_table_changes_nothing(pieces, monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "MOST_CHUNKS", 3)
    table = sentencepiece_codec.ChunkTable(MODEL)
    text = "one two three four one two five six one"
    assert table.encode(text) == pieces[1].encode(text) and len(table) <= 3


@pytest.fixture(scope="module")
def byte_level():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = True
    return tokenizer, packing.WordTable(BYTES)


@settings(max_examples=300, deadline=None)
@given(ALPHABET)
def test_words_join_to_the_whole_encoding(byte_level, text):
    tokenizer, table = byte_level
    assert np.frombuffer(table.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def by_default():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab <|>\n", "the", "  ", "<|endoftext|>", "<|endoftext", " <|endoftext|> "]), max_size=20).map("".join))
def test_added_tokens_have_their_own_ids(by_default, byte_level, text):
    assert np.frombuffer(byte_level[1].encode(text), "<u4").tolist() == by_default.encode(text, add_special_tokens=False).ids


def test_packed_added_token(spark):
    df = spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id bigint, text string")
    (row,) = packing.pack(df, BYTES, size=8).collect()
    assert row.doc_tokens == 4 and row.ids_crc32 == zlib.crc32(np.asarray([64, 50256, 65, 1], "<u4").tobytes())


def check_packing(rows, texts, tokenizer, size):
    """Every id in one piece, sequences gapless and within the size; returns the padding."""
    want = {}
    for doc, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want.setdefault(doc, []).append(ids)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for doc, copies in want.items():
        found = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[doc])
        if len(copies) == 1:
            ids, at = copies[0], 0
            for start, length, crc, tokens in found:
                assert start == at and tokens == len(ids) and length > 0
                assert zlib.crc32(np.asarray(ids[at : at + length], "<u4").tobytes()) == crc
                at += length
            assert at == len(ids)
        assert sum(f[1] for f in found) == sum(map(len, copies))
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def test_packing_rows(odd, none, byte_level):
    assert check_packing(packing.pack(odd, BYTES).collect(), [tuple(r)[:2] for r in odd.collect()], byte_level[0], 2048) == 0
    assert check_packing(packing.pack(odd, BYTES, size=7, open_windows=2).collect(), [tuple(r)[:2] for r in odd.collect()], byte_level[0], 7) == 0
    assert packing.pack(none, BYTES).count() == 0


def test_packing_table(spark, folder, byte_level):
    texts = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert check_packing(registry.queries()["op9_packing"](spark, folder).collect(), texts, byte_level[0], 2048) == 0


def plain_spans(text, rules=secrets.BASE + secrets.MORE):
    """The rules' own expressions over the whole text."""
    raw = (text or "").encode()
    point = lambda at: len(raw[:at].decode())
    spans = [
        (point(m.start()), i, rule.kind, point(m.end()))
        for i, rule in enumerate(rules)
        for m in re.finditer(rule.pattern, raw)
        if m.end(rule.group) - m.start(rule.group) >= rule.least
    ]
    return [(kind, start, end) for start, _, kind, end in sorted(spans)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "ToKeN", "api_key", "apikey", "=", ":", " ", '"', "'", "é", "\n", "AKIA", "0A9Z" * 5, "abc123", "deadbeef" * 3, ".", "x", "ghp_", "a1B2" * 10, "eyJ", "-----BEGIN RSA PRIVATE KEY-----", ","]), max_size=14).map("".join))
def test_automaton_finds_what_the_rules_find(text):
    scanner = _scanner()
    data, raw = np.frombuffer(text.encode(), np.uint8), text.encode()
    found = scanner.spans(data, np.array([0, len(data)]))[0]
    point = lambda at: len(raw[:at].decode())
    assert [(scanner.rules[i].kind, point(a), point(b)) for i, a, b in found] == plain_spans(text)


def _scanner(cache=[]):  # noqa: B006
    return cache[0] if cache else cache.append(secrets.Scanner()) or cache[0]


def test_secret_rows(spark, odd, none):
    extra = spark.createDataFrame([(100, "é token: 'abcdefgh' and AKIA" + "A1" * 8 + "\n" + "0af" * 9), (101, "token:key password=abc")], "doc_id bigint, text string")
    both = odd.select("doc_id", "text").unionByName(extra)
    got = pairs(secrets.scan(both), "id", "spans")
    want = sorted(((r.doc_id, [(k, a, b) for k, a, b in plain_spans(r.text)]) for r in both.collect()), key=repr)
    assert [(i, [tuple(s) for s in spans]) for i, spans in got] == want
    assert secrets.scan(none).count() == 0


def test_secret_table(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    rows = {r.doc_id: r for r in registry.queries()["op8_secret_scan"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs) and any(r.spans for r in rows.values())
    for doc in docs:
        spans = plain_spans(doc.text)
        base = [s for s in spans if s[0] in ("assign", "access", "hex")]
        row, join = rows[doc.doc_id], lambda x: ",".join(f"{k}:{a}:{b}" for k, a, b in x)
        assert row.spans == join(spans) and row.base_sha256 == hashlib.sha256(join(base).encode()).hexdigest()
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(s[0] == k for s in base) for k in ("assign", "access", "hex"))


def test_redaction_keeps_rows_and_columns(odd):
    done = secrets.redact(odd)
    assert done.columns == odd.columns and done.count() == odd.count()
    texts = [r.text for r in done.collect()]
    assert sum(t is None for t in texts) == 1 and "[SECRET]'" in texts
    assert secrets.redacted("abcdef", [(1, 3), (2, 4), (5, 6)], "_") == "a_e_"


def test_licence_rows(spark, odd, none):
    rows = spark.createDataFrame(
        [
            (100, "Copyright (c) 2020 A Person\n\n# RELEASED under   the MIT Licence!!\n"),
            (101, "text before\nLicensed under the Apache Licence, version 2.0\ntext after"),
            (102, dict((k, v) for k, v in licences.KNOWN if k == "ISC")["ISC"].upper().replace("\n\n", "\n\n© 2001 Someone\n")),
            (103, "Released under the MIT License, or so they say."),
        ],
        "doc_id bigint, text string",
    )
    found = {r.id: (r.licence, [tuple(x) for x in r.notices]) for r in licences.scan(rows).collect()}
    assert found == {100: ("MIT", [(1, "MIT")]), 101: (None, [(2, "Apache-2.0")]), 102: ("ISC", []), 103: (None, [])}
    many = licences.scan(odd)
    assert many.count() == odd.count() and [r.id for r in many.collect() if r.licence] == [TEXTS.index("Released under the MIT License.")]
    assert licences.scan(none).count() == 0


def test_licence_scan_equals_sql(spark, folder):
    assert compare(registry.queries()["op10_licence_scan"](spark, folder), connect(folder), registry.oracle_sql()["op10_licence_scan"]) is None


def test_licence_scan_is_native(spark, folder):
    plan = registry.queries()["op10_licence_scan"](spark, folder)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_entire_published_texts(spark):
    """Texts as projects carry them: their own copyright line, another heading, other line breaks, no appendix."""
    body = {p.stem: p.read_text() for p in licences.TEXTS.glob("*.txt")}
    mit = next(text for name, text in licences.SHORT if name == "MIT" and "WARRANTY" in text).split("\n", 1)[1]
    texts = [
        ("MIT", "The MIT License (MIT)\n\nCopyright (c) Facebook, Inc. and its affiliates.\n" + mit),
        ("MIT", "copyright Jane Doe 2015\n" + mit),
        ("BSD-2-Clause", "# Copyright © Jane Doe\n# All rights reserved.\n" + body["BSD-2-Clause"].split("\n", 1)[1]),
        ("BSD-3-Clause", " ".join(body["BSD-3-Clause"].split())),
        ("BSD-3-Clause", "Copyright (c) The Regents of the University of California.\n" + body["BSD-3-Clause~regents"]),
        ("Unlicense", body["Unlicense"]),
        ("Apache-2.0", body["Apache-2.0"]),
        ("Apache-2.0", body["Apache-2.0"].split("   APPENDIX")[0]),
        *((name, body[name]) for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0")),
        ("Artistic-1.0-Perl", "Artistic License\n\nCopyright 1999, Someone\n" + body["Artistic-1.0-Perl"].split("\n", 1)[1]),
        (None, "copyright notice of no year\n" + mit),
        (None, "(c) You must retain this\n" + mit),
    ]
    df = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(texts)], "doc_id bigint, text string")
    assert [r.licence for r in sorted(licences.scan(df).collect(), key=lambda r: r.id)] == [name for name, _ in texts]


def test_notices_wrapped_after_holders_and_in_old_lines(spark):
    """A notice behind a holder, between lone carriage returns, broken over two lines; holders alone say nothing."""
    notice = "Released under the MIT License."
    texts = [
        f"(c) 2020 me. {notice}", f"a\r{notice}\rb", "x\nReleased under\nthe MIT License.\ny", "Copyright 2020 Foo, Inc. and its affiliates.\r\nb",
        f"Copyright (c) 2019 A. B. {notice}", f"{notice} {notice}", "Released\nunder the\nMIT License.", None,
    ]
    rows = {r.id: [(n.line, n.licence) for n in r.notices] for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert rows == {0: [(1, "MIT")], 1: [(2, "MIT")], 2: [(2, "MIT")], 3: [], 4: [], 5: [], 6: [], 7: []}
    custom = (("X", "one line of mine"), ("Y", "two\nlines"))
    df = spark.createDataFrame([(1, "one line\nof mine"), (2, "two\nlines"), (3, "© 2001 us. One line of mine")], "doc_id int, text string")
    assert {r.id: (r.licence, [(n.line, n.licence) for n in r.notices]) for r in licences.scan(df, custom).collect()} == {1: ("X", [(1, "X")]), 2: ("Y", [(1, "Y")]), 3: ("X", [(1, "X")])}
