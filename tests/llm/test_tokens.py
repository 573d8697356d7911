"""Word BPE, lexicon, packing, token files and archives against the tokenizers library and plain Python."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnout.llm.files import dealt
from turnout.llm import lexicon, packing, tokenfiles, warc, wordbpe
from turnout.llm.files import Output, run_folder
from turnout.llm.queries import TOKENIZER


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(TOKENIZER)
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts():
    r = random.Random(1)
    alphabet = "aAbe'sStTlLrRvVmMdDéÉ 1٣²½\n\t\x1c\x85  <|endoftext|>ΣσςİıßǅΩǺ̈́.!?—…x中文🙂ஃꟊ𐐀ʹˆ"
    texts = [None, "", " ", "<|endoftext|>", "a<|startoftext|><|endoftext|>B", "it's we'll'd 'tis ''s ''' 'S", "x" * 300, "ab" * 400, "ΑΣ ΑΣΑ", "é́ ̈́", "﻿a​b"]
    return texts + ["".join(r.choice(alphabet) for _ in range(r.randrange(50))) for _ in range(3000)]


def test_blocks_match_the_library(library):
    texts = odd_texts()
    bpe = wordbpe.load(TOKENIZER)
    ids, counts = bpe.encode_block(texts)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    want = library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [p.tolist() for p in parts] == [e.ids for e in want]
    assert [bpe.decode(p).decode() for p in parts] == [library.decode(e.ids, skip_special_tokens=False) for e in want]


def test_special_tokens_can_be_ordinary_text(library):
    texts = ["a <|endoftext|> b", "<|startoftext|>"]
    plain = Tokenizer.from_file(TOKENIZER)
    plain.encode_special_tokens = True
    ids, _ = wordbpe.load(TOKENIZER).encode_block(texts, special=False)
    assert ids.tolist() == [i for e in plain.encode_batch(texts, add_special_tokens=False) for i in e.ids]


def test_automaton_numbers_its_words_and_shares_suffixes(tmp_path):
    words = sorted({("".join(random.Random(i).choice("abcé") for _ in range(random.Random(i).randrange(1, 7))) + "ing").encode() for i in range(400)} | {b"a", b"ab"})
    built = lexicon.Automaton.build(words, lambda ws: (np.concatenate([np.full(len(w), i) for i, w in enumerate(ws)]), np.array([len(w) for w in ws])))
    (tmp_path / "lex").write_bytes(built.to_bytes())
    mapped = lexicon.Automaton.mapped(str(tmp_path / "lex"))
    asked = words + [b"zzz", b"abx", b"in", words[5] + b"g"]
    sizes = np.array([len(w) for w in asked])
    numbers = mapped.numbers(np.frombuffer(b"".join(asked), np.uint8), np.cumsum(sizes) - sizes, sizes)
    assert numbers.tolist() == [words.index(w) if w in words else -1 for w in asked]
    assert len(mapped.final) < sum(map(len, words)) / 3
    known, ids, counts = mapped.lookup(np.frombuffer(b"".join(asked), np.uint8), np.cumsum(sizes) - sizes, sizes)
    assert len(known) == len(words) and ids.tolist() == [i for i, w in enumerate(words) for _ in w] and counts.tolist() == [len(w) for w in words]


def test_lexicon_does_not_change_ids(spark, library):
    texts = odd_texts()[:400] * 2
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int").repartition(3)
    name = lexicon.compile_lexicon(docs, TOKENIZER, words=200)
    rows = lexicon.decode(lexicon.encode(docs, lexicon.token_ids, {"ids": pa.list_(pa.int32())}, TOKENIZER, name), TOKENIZER).collect()
    want = library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert {r.doc_id: (r.ids, r.decoded) for r in rows} == {i: (e.ids, library.decode(e.ids, skip_special_tokens=False)) for i, e in enumerate(want)}
    counts = {bytes(r.word): r.n for r in lexicon.word_counts(docs, TOKENIZER).collect()}
    bpe = wordbpe.load(TOKENIZER)
    words, _, marks = bpe.split_block(texts)
    plain = [w for w, m in zip(words.to_pylist(), marks, strict=True) if not m]
    assert counts == {w: plain.count(w) for w in set(plain)}


def test_long_words_stay_out_of_the_lexicon_and_keep_their_ids(spark, library):
    long = "".join(random.Random(4).choice("abcdefgh") for _ in range(5000))
    docs = spark.createDataFrame([(i, f"{long} usual") for i in range(20)], "doc_id long, text string")
    words = lexicon.frequent_words(lexicon.word_counts(docs, TOKENIZER))
    assert words and max(map(len, words)) <= lexicon.LEXICON_BYTES
    name = lexicon.compile_lexicon(docs, TOKENIZER)
    ids = lexicon.encode(docs, lexicon.token_ids, {"ids": pa.list_(pa.int32())}, TOKENIZER, name).first().ids
    assert ids == library.encode(f"{long} usual", add_special_tokens=False).ids


def test_lexicon_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    name = lexicon.compile_lexicon(docs, TOKENIZER)
    assert lexicon.encode(docs, lexicon.token_ids, {"ids": pa.list_(pa.int32())}, TOKENIZER, name).collect() == []


def test_pieces_cover_each_document(spark, library):
    texts = [None, "", "a b c", "word " * 9000] + odd_texts()[11:100]
    docs = spark.createDataFrame([(i // 2, t, 1) for i, t in enumerate(texts)] + [(None, "x", 1)], "doc_id long, text string, start int")
    rows = packing.pack(docs, TOKENIZER, longest=64, with_ids=True).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.bucket == r.length == len(r.ids) and r.offset == 0 for r in rows)
    held = sorted(tuple(library.encode(t or "", add_special_tokens=False).ids + [1]) for t in [*texts, "x"])
    got, open_ids = [], []
    for r in sorted(rows, key=lambda r: r.sequence_id):
        assert r.start == len(open_ids) and r.length in {1, 2, 4, 8, 16, 32, 64}
        open_ids += r.ids
        if len(open_ids) == r.doc_tokens:
            got.append(tuple(open_ids))
            open_ids = []
    assert sorted(got) == held and packing.pack(docs.limit(0), TOKENIZER).collect() == []
    with pytest.raises(ValueError):
        packing.pack(docs, TOKENIZER, longest=48)


@pytest.mark.parametrize("tokens, longest", [(1, 8), (7, 8), (8, 8), (29, 8), (4096, 2048)])
def test_piece_lengths_add_up(tokens, longest):
    sizes = packing.piece_lengths(tokens, longest)
    assert sum(sizes) == tokens and sizes == sorted(sizes, reverse=True) and len([s for s in sizes if s < longest]) == bin(tokens % longest).count("1")


@pytest.mark.parametrize("width, block_ids, group_blocks", [(4, 3, 2), (2, 7, 3), (4, 1 << 20, 4096)])
def test_separators_are_stitched_across_blocks(spark, width, block_ids, group_blocks):
    r = random.Random(block_ids)
    folder, want, files = run_folder(spark, "flat"), set(), []
    for f, end in enumerate([True, False, True, True]):
        lengths = [] if f == 2 else [r.choice([0, 0, 1, 2, 5, 30]) for _ in range(40)]
        ids = [x for n in lengths for x in [*(r.randrange(1, 9) for _ in range(n)), 0]]
        if not end:
            ids += [5, 5, 5]
        out = Output(f"{folder}/{f}.ids")
        out.write(np.array(ids, f"<u{width}").tobytes())
        out.close()
        files.append((out.uri, len(ids)))
        want |= {(f, k, n, True) for k, n in enumerate(lengths)} | ({(f, 40, 3, False)} if not end else set())
    table = spark.createDataFrame(files, "file string, file_ids long")
    rows = tokenfiles.count_tokens(table, 0, width, block_ids, group_blocks).collect()
    assert {(int(r.file.rsplit("/", 1)[1][0]), r.ordinal, r.n_tokens, r.terminated) for r in rows} == want and len(rows) == len(want)
    listed = {r.file.rsplit("/", 1)[1]: r.file_ids for r in tokenfiles.listed_files(spark, folder, width=width).collect()}
    assert listed == {f.rsplit("/", 1)[1]: n for f, n in files if n}  # Spark lists no empty files


def test_documents_are_counted_from_their_files(spark, library):
    texts = odd_texts()[:200]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    plain = Tokenizer.from_file(TOKENIZER)
    plain.encode_special_tokens = True
    rows = tokenfiles.document_token_counts(docs, TOKENIZER, 49407, block_ids=50, group_blocks=3).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(plain.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert tokenfiles.document_token_counts(docs.limit(0), TOKENIZER, 49407).collect() == []


def pages(spark):
    rows = [(i, f"http://x/{i}", h) for i, h in enumerate(["<p>é</p>", None, "", "big" * 90_000, "<p>é</p>", "one\r\n\r\ntwo", "big" * 90_000])]
    return spark.createDataFrame([*rows, (9, "a\r\nb", "twice"), (9, None, "twice"), (None, "n", "twice"), (8, "u", "twice")], "page_id long, url string, html string")


@pytest.mark.parametrize("least", [0, 100])
def test_archives_round_trip(spark, least):
    rows = warc.read_archives(warc.write_archives(pages(spark).repartition(2), least, archive_bytes=200)).collect()
    given = pages(spark).collect()
    assert len(rows) == len(given) and all(r.problem is None for r in rows)
    last = {}
    for p in given:
        if p.page_id is not None:
            last[p.html or ""] = max(last.get(p.html or "", -1), p.page_id)
    want = []
    for p in given:
        body = (p.html or "").encode()
        to = last.get(p.html or "") if p.page_id is not None and len(body) >= least and last[p.html or ""] != p.page_id else None
        want.append((p.page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if to is None else "revisit", to))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr) == sorted(want, key=repr)


def test_reader_takes_small_steps_and_names_faults():
    good = [warc.member(warc.record(i, "u", bytes([65 + i]) * 200_000, None, "2024-01-01T00:00:00Z")) for i in range(3)]
    data = b"".join(good)

    def reader(raw, step):
        place = [0]

        def read(n):
            place[0] += min(n, step)
            return raw[place[0] - min(n, step):place[0]]
        return read

    for step in (1 << 20, 777, 64):
        records = list(warc.read_archive(reader(data, step), keep_body=True))
        assert [len(r.body) for r in records] == [200_000] * 3 and not any(r.problem for r in records)
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(reader(data[:-30], 100)))
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(reader(b"no archive at all", 100)))
    raw = warc.record(1, "u", b"payload", None, "2024-01-01T00:00:00Z")
    for broken, problem in ((raw.replace(b"payload", b"PAYLOAD"), "block digest differs"), (raw[:-6], "2 bytes missing"), (raw + b"x", "bytes after the record")):
        assert [r.problem for r in warc.read_archive(reader(warc.member(broken), 50))] == [problem]


def test_archives_of_nothing(spark):
    assert warc.read_archives(warc.write_archives(pages(spark).limit(0))).collect() == []
    assert pages(spark).where(F.col("html").isNull()).count() == 1


def test_archives_are_read_by_many_tasks(spark):
    """The rows that name archives are few bytes; the adaptive plan must not join them into one task."""
    names = spark.createDataFrame([(f"{i}",) for i in range(40)], "archive string")
    tasks = dealt(names, "archive").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 20 and dealt(names.limit(0), "archive").count() == 0
    archives = warc.write_archives(pages(spark).repartition(4), archive_bytes=1)
    assert archives.count() > 4 and warc.read_archives(archives).rdd.getNumPartitions() >= archives.count()
