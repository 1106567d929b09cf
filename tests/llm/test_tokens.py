"""Encoding, packing and token files against plain one-by-one versions."""

import functools
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from adtally.llm.encoding import PieceEncoder
from adtally.llm.packing import Bins, pack
from adtally.llm.registered import QUERIES, table
from adtally.llm.token_files import encode_documents, read_token_files, token_digest, write_token_files

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    " a\t\n b", "a\x1cb \x1c c", "x<|endoftext|> y <|endoftext|>", "  lead", "tail  \n\n", "é é  x　y", "", None,
    "'s don't I'LL", "a b\x85c", "1234 12,5%%% *** x's", "a\0b \0 c", "İSTANBUL ß ſ straße ǅ", "½²a ªbc", "\n", "\r\n a",
    "a.\nB", "word " * 30_000,
]
SCHEMA = "doc_id long, text string, shard int, tie string"


tokenizer = functools.cache(Tokenizer.from_file)


def plain(vocabulary, text, end):
    return tokenizer(vocabulary).encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(n if n % 7 else None, t, 1, "x") for n, t in enumerate(ODD)] + [(3, ODD[3], 1, "x")] * 2
    return spark.createDataFrame(rows, SCHEMA).repartition(3), rows


@pytest.mark.parametrize("vocabulary", [WORDS, BYTES])
@pytest.mark.parametrize("held", [3, 600_000])
def test_pieces_give_the_ids_of_whole_texts(vocabulary, held):
    encoder = PieceEncoder(vocabulary, 7, held)
    got = []
    for _, ids, counts in encoder.encode(pa.array(ODD, pa.string()), slice_bytes=50):
        got += np.split(ids, np.cumsum(counts)[:-1])
    assert [list(x) for x in got] == [plain(vocabulary, t, 7) for t in ODD]


def test_words_are_learnt_once_whatever_follows_them():
    encoder, asked = PieceEncoder(BYTES, 0), []
    numbered = encoder._numbered
    encoder._numbered = lambda parts: asked.extend(parts) or numbered(parts)
    texts = ["house house, house. house", "a\0b\0", "house," * 3]
    for _, ids, _ in encoder.encode(pa.array(texts)):
        assert ids.tolist() == [i for t in texts for i in plain(BYTES, t, 0)]
    assert asked.count(" house") == 1


def test_token_files_of_a_table(spark, small):
    docs = table(spark, small, "documents").collect()
    want, start = [], 0
    for row in sorted(docs, key=lambda r: r.doc_id):
        ids = plain(BYTES, row.text, 0)
        want.append((row.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    got = QUERIES["op10_token_files"](spark, small).collect()
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("encoding,found", [("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")])
def test_token_files_of_odd_rows(spark, odd, tmp_path, encoding, found):
    frame, rows = odd
    path = f"{tmp_path}/tokens"
    write_token_files(encode_documents(frame, BYTES, 0), path, encoding, page_rows=2)
    files = read_token_files(spark, path)
    got = token_digest(files).orderBy("start").collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (n or -1, len(plain(BYTES, t, 0)), crc(plain(BYTES, t, 0))) for n, t, *_ in rows
    )
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda n: -1 if n is None else n)
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    part = next(p for p in sorted((tmp_path / "tokens").glob("*.parquet")) if pq.read_metadata(p).num_rows)
    groups = pq.read_metadata(part).row_group(0)
    column = next(groups.column(i) for i in range(groups.num_columns) if groups.column(i).path_in_schema.startswith("ids"))
    assert found in column.encodings and column.has_offset_index
    plan = files.filter("doc_id = 5").select("n_tokens")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,5)" in plan and "ids" not in plan.split("ReadSchema")[1]


def test_empty_tables(spark, tmp_path):
    nothing = spark.createDataFrame([], SCHEMA)
    write_token_files(encode_documents(nothing, BYTES, 0), f"{tmp_path}/none")
    assert token_digest(read_token_files(spark, f"{tmp_path}/none")).count() == 0
    assert pack(nothing, WORDS, 1).count() == 0


def check_pieces(pieces, rows, vocabulary, end, tokens, segments, loss, ids_too=True):
    """Each id of each row lies in one piece; limits hold; offsets leave no gap."""
    bins, found = {}, {}
    for p in pieces:
        bins.setdefault(p.sequence_id, []).append(p)
        found.setdefault(p.doc_id, []).append(p)
    for held in bins.values():
        held.sort(key=lambda p: p.offset)
        assert [p.offset for p in held] == list(np.cumsum([0] + [p.length for p in held])[:-1])
        assert sum(p.length for p in held) <= tokens and len(held) <= segments
        assert sum(p.loss_tokens for p in held) <= loss
    want = {}
    for name, text, *_ in rows:
        ids = plain(vocabulary, text, end)
        want.setdefault(name, []).extend(ids)
        assert all(p.doc_tokens == len(ids) for p in found[name]) or name in (None, 3)
    for name, ids in want.items():
        assert sorted(i for p in found[name] for i in p.ids) == sorted(ids)
        assert all(p.ids_crc32 == crc(p.ids) for p in found[name])
    sizes = [sum(p.length for p in held) for held in bins.values()]
    return sum(sizes) / sum(n if n & (n - 1) == 0 else tokens for n in sizes)


def test_packing_of_odd_rows(spark, odd):
    frame, rows = odd
    fill = check_pieces(pack(frame, WORDS, 1, tokens=64, segments=4).collect(), rows, WORDS, 1, 64, 4, 64)
    assert fill > 0.9


def test_packing_under_three_limits(spark):
    rows = [(n, "word and " * (n % 50), n % 37) for n in range(1, 400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, prompt int").repartition(2)
    pieces = pack(frame, WORDS, 1, tokens=100, segments=5, loss=60, prompt_column="prompt").collect()
    check_pieces(pieces, rows, WORDS, 1, 100, 5, 60)
    starts = {}
    for p in pieces:
        starts.setdefault(p.doc_id, []).append((p.start, p.length))
    for name, text, prompt in rows:
        own = sorted(starts[name])
        assert [s for s, _ in own] == list(np.cumsum([0] + [k for _, k in own])[:-1])
        loss = sum(p.loss_tokens for p in pieces if p.doc_id == name)
        assert loss == max(0, len(plain(WORDS, text, 1)) - prompt)


def drawn_bins(tokens, segments, loss, prompts):
    rng = np.random.default_rng(6)
    bins = Bins(tokens, segments, loss, 4)
    for n in range(300):
        example = SimpleNamespace(name=n, prompt=int(rng.integers(0, 60)) if prompts else 0)
        bins.add(example, 0, int(rng.integers(1, 90)))
    out = []
    while bins.pooled:
        size = bins.next_size()
        out.append((size, bins.fill(size)))
        assert out[-1][1]
    return out


def test_loss_bearing_tokens_decide_what_goes_together():
    """Bins reach their size under a loss limit that longest-first filling, blind to loss, breaks."""
    held = drawn_bins(256, 32, 160, prompts=True)
    for size, pieces in held:
        assert sum(p[2] for p in pieces) <= size and len(pieces) <= 32
        assert sum(Bins._loss_of(*p) for p in pieces) <= 160
    assert sum(sum(p[2] for p in pieces) for _, pieces in held) > 0.97 * sum(size for size, _ in held)
    blind = drawn_bins(256, 32, 256, prompts=True)
    assert max(sum(Bins._loss_of(*p) for p in pieces) for _, pieces in blind) > 160


def test_a_pool_of_too_much_loss_goes_into_powers_of_two():
    held = drawn_bins(256, 256, 160, prompts=False)
    assert {size & (size - 1) for size, _ in held} == {0} and held[0][0] == 128
    assert all(sum(p[2] for p in pieces) == size for size, pieces in held)


def test_packing_of_a_table(spark, small):
    docs = {r.doc_id: plain(WORDS, r.text, 1) for r in table(spark, small, "documents").collect()}
    pieces = QUERIES["op9_packing"](spark, small).collect()
    spans, bins, losses = {}, {}, {}
    for p in pieces:
        losses[p.sequence_id] = losses.get(p.sequence_id, 0) + p.loss_tokens
        spans.setdefault(p.doc_id, []).append((p.start, p.length))
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert p.ids_crc32 == crc(docs[p.doc_id][p.start : p.start + p.length])
        assert p.doc_tokens == len(docs[p.doc_id])
    for parts, total in [(sorted(v), len(docs[k])) for k, v in spans.items()] + [(sorted(v), None) for v in bins.values()]:
        assert [s for s, _ in parts] == list(np.cumsum([0] + [k for _, k in parts])[:-1])
        assert total is None or sum(k for _, k in parts) == total
    sizes = [sum(k for _, k in v) for v in bins.values()]
    assert max(losses.values()) <= 1792 and sum(losses.values()) < 0.9 * sum(sizes)
    assert max(sizes) <= 2048 and len(spans) == len(docs)
    assert sum(sizes) / sum(n if n & (n - 1) == 0 else 2048 for n in sizes) > 0.99
