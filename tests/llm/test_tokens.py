import io
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import packing, sstable, token_counts, tokens

BYTES, WORDS = tokens.default_path("byte_bpe_50k.json"), tokens.default_path("word_bpe_49k.json")
PIECES = st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "Éa", "ß", "12", "don't", "'s", "_", "!", "…", "中文", "é", "<|endoftext|>", "\x85", " ", "İ", "ǅ", "|", "¡"]), max_size=12)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_pieces_and_counts_are_the_librarys(parts):
    text = "".join(parts)
    for path in (BYTES, WORDS):
        want = tokens.load(path).encode(text, add_special_tokens=False).ids
        assert tokens.encoder(path).batch([text]) == [np.array(want, "<u4").tobytes()]
    assert tokens.TokenCounter(WORDS, tokens.whole_tokens(WORDS)).batch([text]) == [len(tokens.load(WORDS).encode(text, add_special_tokens=False).ids)]


def test_cache_limit_changes_nothing():
    texts = ["one two three four five", "six seven\neight one"]
    assert tokens.PieceEncoder(BYTES, limit=2).batch(texts) == tokens.PieceEncoder(BYTES).batch(texts)


def test_token_counts(odd, empty, odd_rows):
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(odd, WORDS).collect())
    want = sorted((i or -1, len((t or "").encode()), n := len(tokens.load(WORDS).encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in odd_rows)
    assert got == want
    assert token_counts.token_counts(empty, WORDS).count() == 0
    with pytest.raises(ValueError):
        tokens.TokenCounter(BYTES, frozenset())


def test_packing_covers_every_id_once(odd, empty, odd_rows, small):
    for docs, rows in ((odd, odd_rows), (small, [(r.doc_id, r.text) for r in small.collect()])):
        got = packing.pack(docs, WORDS, slots=4).collect()
        ids = defaultdict(list)
        for i, t in rows:
            ids[i].append(tokens.encoder(WORDS).batch([t or ""])[0] + np.array([2], "<u4").tobytes())
        assert sum(r.length for r in got) == sum(len(x) // 4 for v in ids.values() for x in v)
        for r in got:
            assert len(r.ids) == 4 * r.length and r.ids_crc32 == zlib.crc32(r.ids)
            assert any(len(x) == 4 * r.doc_tokens and x[4 * r.start : 4 * (r.start + r.length)] == r.ids for x in ids[r.doc_id])
        windows = defaultdict(list)
        for r in got:
            windows[r.sequence_id].append((r.offset, r.length))
        for pieces in windows.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= packing.WINDOW
    assert packing.pack(empty, WORDS).count() == 0


def test_packer_keeps_few_windows_open_and_pads_little():
    rng = np.random.default_rng(0)
    packer, used, closed = packing.Packer(4096, 16, 64), 0, 0
    cut = lambda piece, gap: (piece, piece)
    for n in rng.integers(1, 4097, 5000):
        for window in packer.put("x", int(n), cut):
            closed += 1
            used += sum(k for _, k in window)
        assert len(packer.open) <= 16
    assert used / (4096 * closed) > 0.98


def test_sstable_round_trip(odd, empty, odd_rows, spark):
    got = sstable.sstable(odd, BYTES, shard_bytes=20_000).orderBy("start").collect()
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, (i, t) in zip(got, order, strict=True):
        want = tokens.encoder(BYTES).batch([t or ""])[0] + np.array([2], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (i, start, len(want) // 4, want)
        start += r.n_tokens
    assert sstable.sstable(empty, BYTES).count() == 0


def test_sstable_lookup():
    out = io.BytesIO()
    writer = sstable.Writer(out, block=200)
    keys = [None, *range(-50, 400, 3), 7_000_000_000]
    keys = sorted([*keys, 4, 4], key=lambda k: sstable.key_bytes(k))
    for k in keys:
        writer.add(sstable.key_bytes(k), np.array([(k or 0) % 1000, 2], "<u4").tobytes())
    writer.close()
    reader = sstable.Reader(io.BytesIO(out.getvalue()))
    assert [sstable.key_value(k) for k, _ in reader.scan()] == keys
    assert len(reader.index) > 5
    for k in set(keys):
        assert len(reader.get(k)) == keys.count(k)
    assert reader.get(5) == [] and reader.get(10**12) == []
    with pytest.raises(ValueError):
        writer.add(sstable.key_bytes(-60), b"")


def test_other_operators_tasks_give_back_what_tokenizers_kept():
    from lodestone.llm import bytescan

    path = tokens.default_path("word_bpe_49k.json")
    before = tokens.encoder(path).batch(["some words"])
    assert tokens._LOADED
    bytescan.release()
    assert not tokens._LOADED and tokens.encoder(path).batch(["some words"]) == before
