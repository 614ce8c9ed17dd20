"""Best-fit packing against best fit of single documents and against the tokenizer."""

import random
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from matchloom.llm import fitpacking
from matchloom.llm.fitpacking import op13_best_fit_packing, pack_best_fit, plan
from matchloom.llm.tokens import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(lengths, room):
    left = []
    for n in sorted(lengths, reverse=True):
        at = bisect_left(left, n)
        insort(left, (left.pop(at) if at < len(left) else room) - n)
    return len(left)


def checked(rows, docs, room):
    """Ids, cuts and gapless places; returns the number of sequences. docs: (doc_id, text)."""
    tok = Tokenizer.from_file(PATH)
    wanted = Counter()
    for doc_id, text in docs:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        for i, at in enumerate(range(0, len(ids), room)):
            wanted[doc_id, i, at, len(ids[at : at + room]), zlib.crc32(array("I", ids[at : at + room]).tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= room
    return len(sequences)


def test_plan_is_best_fit():
    rnd = random.Random(3)
    for _ in range(300):
        room = rnd.choice([7, 20, 64])
        lengths = [rnd.randint(1, room) for _ in range(rnd.choice([0, 1, 5, 50, 400]))] + [rnd.randint(1, room)] * rnd.choice([0, 200])
        runs, used = plan(Counter(lengths), room)
        assert used == one_by_one(lengths, room) and len(runs) <= 12 * room


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op13_best_fit_packing(spark, sf).collect()
    assert checked(rows, docs, 2048) == one_by_one([r.length for r in rows], 2048)


def test_odd_rows(spark, monkeypatch):
    """Null and empty texts, null and repeated ids, a text of many pieces, one length for most rows, clashing names; with the broadcast and without."""
    rows = [(None, None), (1, ""), (1, ""), (2, " \n"), (None, "a b"), (3, "one two three " * 500), (4, "<|endoftext|>")] + [(100 + i, "same words here") for i in range(300)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, `a.b` int, length string").repartition(6)
    for most in (fitpacking.BROADCAST_BLOCKS, 0):
        monkeypatch.setattr(fitpacking, "BROADCAST_BLOCKS", most)
        got = pack_best_fit(frame, room=32, keep_ids=True).collect()
        assert checked(got, rows, 32) == one_by_one([r.length for r in got], 32)
        assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    assert pack_best_fit(frame.where("false")).count() == 0


def test_encoder_equals_library():
    rnd = random.Random(1)
    letters = "aAbßÉé 'sStTreve .,!<|>12²½ \t\n\r\x1c\x1f\x85\xa0́İΣσςµ漢字😀‍\xad\x00\x7f "
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(3000)] + ["a<|endoftext|>b <|startoftext|>", "<|endoftext|>", "don't WE'LL it's", None, ""]
    enc = encoder(PATH)
    assert enc.encode(texts) == [array(enc.code, enc.tokenizer.encode(t or "", add_special_tokens=False).ids).tobytes() for t in texts]
