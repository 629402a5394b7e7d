import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from helpers import ROWS, docs
from tokenizers import Tokenizer

from feltgrid.llm import packing
from feltgrid.llm.tokens import encoder

PATH = public_tokenizers.path(packing.TOKENIZER)


def reference():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_those_of_the_tokenizers_library():
    want, own = reference(), encoder(PATH)
    texts = [r[1] or "" for r in ROWS] + ["<|endoftext|> a", "don't  x \n\n y", "日本語 🎉 é", "a  b ", " \n \n x", "A" * 500 + " " * 300, " 　x\u0085"]
    for t in texts:
        assert own.ids(t).tolist() == want(t)


def test_every_id_lies_in_one_piece_and_nothing_is_padded(spark):
    ids = reference()
    rows = packing.pack_documents(docs(spark).coalesce(2), chunk_tokens=9_000).collect()
    want = sorted((str(r[0]), np.array(ids(r[1]) + [1], "<u4").tobytes()) for r in ROWS)
    pieces = defaultdict(list)
    for r in rows:
        pieces[(str(r.doc_id), r.doc_tokens)].append((r.start, r.length, r.ids_crc32))
    lengths = defaultdict(list)
    for key, data in want:
        lengths[(key, len(data) // 4)].append(data)
    assert pieces.keys() == lengths.keys()
    for key, found in pieces.items():
        documents = lengths[key]
        assert sum(n for _, n, _ in found) == key[1] * len(documents)
        for start, n, crc in found:
            assert any(zlib.crc32(d[4 * start : 4 * (start + n)]) == crc for d in documents)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length, r.sequence_tokens))
    for parts in sequences.values():
        at = 0
        for offset, n, _ in sorted(parts):
            assert offset == at
            at += n
        assert at == parts[0][2] <= 2048 and at & (at - 1) == 0
    steps = defaultdict(int)
    for r in rows:
        steps[r.step_id] += r.length
    assert max(steps.values()) <= 8 * 2048


def test_windows_are_filled():
    rng = random.Random(2)
    rests = packing.Rests(64)
    total = 0
    for i in range(300):
        n = rng.randrange(1, 65)
        total += n
        rests.add((i, 0, n))
    windows, left = packing.pack(rests, 64, 8)
    sizes = [sum(p[2] for p in w) for w in windows]
    assert all(s & (s - 1) == 0 and 8 <= s <= 64 for s in sizes)
    assert sum(sizes) + sum(p[2] for p in left) == total
    cut = packing.cut_at_powers(left)
    assert sum(p[2] for w in cut for p in w) == sum(p[2] for p in left)


def test_no_rows(spark):
    assert packing.pack_documents(docs(spark, [])).count() == 0


def test_added_tokens_have_the_ids_of_an_unmodified_tokenizer(spark):
    t = Tokenizer.from_file(PATH)
    want = lambda text: t.encode(text, add_special_tokens=False).ids
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x\n", "x  <|endoftext|>  y", "<|endoftext", "é<|endoftext|>🎉"]
    for text in texts:
        assert encoder(PATH).ids_with_added(text).tolist() == want(text)
    rows = packing.pack_documents(docs(spark, [(i, text, "en", "a") for i, text in enumerate(texts)])).collect()
    assert {r.doc_id: r.doc_tokens for r in rows} == {i: len(want(text)) + 1 for i, text in enumerate(texts)}
