"""Operators that look at one document at a time, against plain versions."""

import itertools
import re
import struct
import zlib

import numpy as np
import pytest
from matchloom.llm import licenses, packing, quality, records, tokens
from matchloom.llm.common import tokenizer_path

ODD = [
    None, "", " ", "\n\n", "a", "a b c", "a b c a b c", "x" * 200_000, "é  ü  z\n  \n x", "\x1c\x1d a \x85 b",
    "trailing  ", "  leading", "tab\t\tand  two\r\n\r\nlines ", "<|endoftext|> word <|endoftext|>", "don't we'll  I'm 123abc ___  !?",
    "0" * 5000, " ".join(["word"] * 3000), "🙂🙂 emoji 漢字かな", "a \n b  \n\n  c   d",
]


def frame(spark, texts):
    """Documents with a repeated row, a null id and an extra column whose name clashes with a result's."""
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id here", "y"), (3, texts[3], "x"), (3, texts[3], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string")


def documents(spark, sf, n=200):
    return [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(n).collect()]


def test_encoder_equals_library(spark, sf):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    enc, plain = tokens.Encoder(path, most=500), Tokenizer.from_file(path)
    texts = documents(spark, sf, 80) + ODD
    for t, got in zip(texts, enc.encode(texts)):
        assert np.frombuffer(got, enc.dtype).tolist() == plain.encode(t or "", add_special_tokens=False).ids


def test_encoder_does_not_learn_common_words_again():
    """Words that come back are still known after more than `most` others; only those of the last part were kept before."""
    import public_tokenizers

    enc, learned = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), most=200, part=100), []
    for name in ("_word", "_lettered"):
        if f := getattr(enc, name, None):
            setattr(enc, name, lambda x, f=f: learned.extend([x] if isinstance(x, str) else x) or f(x))
    texts = [" ".join(f"{a}{x}{y}" for x in "klmnopqr" for y in "stuvwxyz") for a in "abcd"]
    enc.encode(texts * 5)
    assert len(learned) <= 300



def test_encoder_on_any_letters():
    """Random texts over characters at which the cuts and the pattern could differ from the library's."""
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    enc, plain = tokens.Encoder(path, most=300, part=500), Tokenizer.from_file(path)
    rng = np.random.default_rng(9)
    letters = [*"ab zé ß ªµº×÷ 1 2 ² ½ ' s t re ll d \t \n \r \x0b \x0c \x1c \x85 \xa0 \u2028 \u3000 . , ! - _ < > | ñ Ω 漢 🙂".split(" "), " ", " ", " ", "\n", "\x0b", "\x85", "\xa0", "<|endoftext|>", "'"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(3000)]
    for t, got in zip(texts, enc.encode(texts)):
        assert np.frombuffer(got, enc.dtype).tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_encoder_asks_the_library_once_for_each_word():
    """Whatever stands around a word, and however often it comes back; what goes through the whole library is not plain."""
    import public_tokenizers

    enc, words, odd = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), most=200, part=100), [], []
    lined, whole = enc._lined, enc._whole
    enc._lined = lambda data, starts: words.extend(bytes(data[a:b]) for a, b in zip(starts, starts[1:])) or lined(data, starts)
    enc._whole = lambda pieces: odd.extend(pieces) or whole(pieces)
    texts = ["".join(f" {a}{x}{y}é{end}" for x in "klmnopqr" for y, end in zip("stuvwxyz", ["", ".", ",", "\n", "!", ")", "%%%", " ."])) for a in "abcd"]
    out = enc.encode(texts * 5)
    assert out[:4] == out[-4:]
    assert len(words) <= 300 and not odd


def test_encoder_cuts_and_added_tokens():
    """Random texts of signs, white space, letters beyond ASCII and whole or broken added tokens, side by side in one part and alone."""
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    enc, plain = tokens.Encoder(path, most=100, part=3000), Tokenizer.from_file(path)
    rng = np.random.default_rng(4)
    letters = [*"ab Z é × 7 ' 's .. ,) \t \n \n\n \r\n \x00 \x7f \x85 \xa0 \u3000 e\u0301 Ж 漢 <|endoftext|> <|endof text|> <|endof<|endoftext|> < |>".split(" "), " ", " ", "  ", "   ", "\x0b", "\x0c"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 12))) for _ in range(4000)]
    wanted = [np.array(plain.encode(t, add_special_tokens=False).ids, enc.dtype).tobytes() for t in texts]
    assert enc.encode(texts) == wanted
    assert [enc.encode([t])[0] for t in texts[:500]] == wanted[:500]


def test_encoder_of_other_vocabularies(tmp_path):
    """Where the rules of the cuts do not hold, whole texts go to the library."""
    from tokenizers import AddedToken, Tokenizer, normalizers

    path = tokenizer_path("byte_bpe_50k.json")
    texts = ["Some words, WORDS  and\n\n more", "a <|x|>  b <|x|>c", "", None, "end "]
    for change in (
        lambda t: setattr(t, "normalizer", normalizers.Lowercase()),
        lambda t: t.add_tokens([AddedToken("<|x|>", lstrip=True, rstrip=True)]),
        lambda t: t.add_tokens(["words"]),
    ):
        other = Tokenizer.from_file(path)
        change(other)
        other.save(f"{tmp_path}/other.json")
        enc = tokens.Encoder(f"{tmp_path}/other.json")
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == [other.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_crc32c():
    def slow(data):
        c = 0xFFFFFFFF
        for b in data:
            c ^= b
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    rng = np.random.default_rng(0)
    messages = [b"", b"123456789", *(rng.bytes(n) for n in (1, 2, 511, 512, 513, 1024, 5000))]
    assert records.crc32c([b"123456789"])[0] == 0xE3069283
    assert records.crc32c(messages).tolist() == [slow(m) for m in messages]


def test_records_round_trip(spark, sf, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    df = frame(spark, documents(spark, sf, 60) + ODD)
    got = records.read_records(records.write_records(df, f"file://{tmp_path}/r", tokenizer_path("byte_bpe_50k.json"))).collect()
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in df.collect()), key=lambda x: (x is not None, x))
    start, texts = 0, {r.doc_id: r.text for r in df.collect()}
    for r in got:
        ids = plain.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_records_in_any_order(spark, sf, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    df = frame(spark, documents(spark, sf, 60) + ODD)
    manifest = records.write_records(df, f"file://{tmp_path}/s", tokenizer_path("byte_bpe_50k.json"))
    wanted = sorted((str(r.doc_id), [*plain.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in df.collect())
    orders = [[(str(r.doc_id), r.ids) for r in records.read_shuffled(manifest, seed).collect()] for seed in (1, 1, 2)]
    assert orders[0] == orders[1] != orders[2]
    assert all(sorted(x) == wanted for x in orders)
    biggest = manifest.orderBy("documents", ascending=False).first()
    index = records.index_of(biggest.data)
    some = np.arange(biggest.documents)[::-1]
    assert [i for i, _ in records.take(biggest.data, some, index)] == [i for i, _ in records.take(biggest.data, some[::-1], index)][::-1]
    small = records.write_records(df, f"file://{tmp_path}/t", tokenizer_path("byte_bpe_50k.json"), range_bytes=2000)
    assert small.count() > manifest.count()
    read = lambda m: sorted((r.start, r.n_tokens, r.ids_crc32) for r in records.read_records(m).collect())
    assert read(small) == read(manifest)


def test_records_notice_damage():
    good = records.frames([b"some payload"])[0]
    assert records.payloads(good, np.array([0])) == [b"some payload"]
    with pytest.raises(ValueError):
        records.payloads(good[:14] + b"?" + good[15:], np.array([0]))
    assert struct.unpack("<Q", good[:8])[0] == 12


def test_records_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert records.read_records(records.write_records(df, f"file://{tmp_path}/e", tokenizer_path("byte_bpe_50k.json"))).count() == 0


def test_packing(spark, sf):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = documents(spark, sf) + ODD
    df = frame(spark, texts).where("doc_id is null or doc_id <> 3")
    rows = packing.pack_documents(df).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    lost = 0
    for d in df.collect():
        ids, at = plain.encode(d.text or "", add_special_tokens=False).ids + [0], 0
        for r in sorted(by_doc.pop(d.doc_id), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 1024
        lost += 0 if at & (at - 1) == 0 else 1024 - at
    assert lost == 0
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_hilbert_neighbours():
    """Every point of the grid once, and each step moves by one along one axis."""
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert(grid, bits=3)
    assert sorted(key.tolist()) == list(range(512))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def plain_verdict(t):
    """The rules written anew, on words and characters: the name of the first that rejects."""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for k in range(len(w) - 2):
        seen.setdefault(tuple(w[k : k + 3]), []).append(k)
    hit = {k + j for v in seen.values() if len(v) > 1 for k in v for j in range(3)}
    insults = "idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown clowns imbecile dumbass bastard bastards asshole assholes bitch bitches retard retards"
    rude = sum(x.lower().strip(".,;:!?\"'()") in insults.split() for x in w if x.isascii())
    n, chars, symbols, again = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines))
    upper = sum(1 for x in w if (y := "".join(c for c in x if c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")) and y == y.upper())
    letters = sum(1 for x in w if re.search(r"[A-Za-z]|[^\x00-\x7f]", x))
    common = max((w.count(x) for x in set(w)), default=0)
    failed = {
        "too_few_words": n < 50, "repeated_words": len(hit) > 0.5 * n, "symbol_heavy": symbols > 0.2 * n, "odd_word_length": chars < 2 * n or chars > 15 * n,
        "shouting": upper > n / 2, "repeated_lines": len(lines) >= 4 and again > len(lines) / 2, "few_letters": letters < 0.6 * n, "one_word": common > 0.4 * n,
        "abusive": rude >= 2 or rude == 1 and n <= 100,
    }
    return (n, chars, symbols, again, len(hit)), {k for k, v in failed.items() if v}


MADE = ["SHOUT OUT LOUD " * 30 + "so", "abc " * 20 + "word " * 40 + " ".join(f"w{i}" for i in range(20)), "a b c " + " ".join(chr(97 + i % 26) for i in range(80)), "1 2 3 " * 3 + " ".join(map(str, range(70))), "line of words\n" * 5 + "\n".join(f"other line {i}" for i in range(3)) + " w" * 60]
MADE += [" ".join(f"word{i}" for i in range(60)) + x for x in ("", " you idiot", " idiot moron", " Idiot! trash", " # $ % & | < > * # $ % & *", " ".join(["supercalifragilisticexpialidocious"] * 90))]
MADE += [" ".join(f"word{i}" for i in range(200)) + " one idiot here"]


def test_quality_counts_and_verdicts(spark, sf):
    texts = documents(spark, sf) + ODD + MADE
    got = {r.doc_id: r for r in quality.judge(frame(spark, texts)).collect()}
    kept = {r.doc_id for r in quality.kept_documents(frame(spark, texts)).collect()}
    rejected = set()
    for i, t in enumerate(texts):
        counts, failed = plain_verdict(t or "")
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == bool(failed & {"too_few_words", "repeated_words"})
        assert r.kept == (not failed) == (i in kept) and (r.failed_rule in failed if failed else r.failed_rule is None), (i, failed)
        rejected |= failed
    assert rejected == set(quality.all_rules())


def test_quality_order_is_by_rejection_per_cost(spark):
    """A dear rule that rejects as much comes later, one that rejects nothing last; measures are taken when first read."""
    def dear(p):
        return sum(range(20_000)) > 0

    rules = {"never": lambda p: False, "dear": dear, "cheap": lambda p: True}
    docs = frame(spark, ["some words"] * 50)
    assert quality.rule_order(docs, rules) == ["cheap", "dear", "never"]
    assert quality.rule_order(docs.limit(0), rules) == list(rules)
    p = quality.Page(b"one two")
    assert p.n_symbols == 0 and "words" not in p.__dict__ and "n_repeat_words" not in p.__dict__


def test_quality_agrees_with_labels(spark, sf):
    """Held-out labels: clean documents that pass the base rule stay, junk goes."""
    base = sf.replace("0.001", "0.1")
    docs = spark.read.parquet(f"{base}/documents.parquet").join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id")
    rows = quality.judge(docs, keep=("doc_id", "quality", "toxic")).collect()
    clean = [r for r in rows if r.quality == 1 and not r.toxic and not r.base_failed]
    junk = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)
    assert sum(not r.kept for r in junk) >= 0.97 * len(junk)


def test_quality_empty_and_columns(spark):
    df = frame(spark, ODD)
    assert quality.judge(df.limit(0)).count() == 0
    assert quality.kept_documents(df).columns == df.columns
    assert quality.judge(df).count() == df.count()


def test_license_phrases(spark, sf):
    texts = documents(spark, sf) + ODD + [
        "Under the MIT License, under the MIT license.", "Apache License, Version 2.0", "CC BY-NC 4.0",
        "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
        "licensed under the Apache License, as amended, version 2", "Éunder the mit license",
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    upper = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(upper))
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1
    n = len(texts)
    assert [got[k].labels for k in range(n - 7, n)] == ["mit", "apache-2", "cc-by-nc", "apache-2", "gpl-3", "", ""]
    assert got[n - 4].score == 1.0 and 0 < got[n - 2].score < 1
    assert all(r.score == 1 for r in got.values() if r.labels) and all(r.score < 1 for r in got.values() if not r.labels)


def test_template_automaton():
    a = licenses.Automaton("[[please]] keep {1,2} this [[very]] notice")
    match = lambda s: a.match(s.encode().split(), 0)[0]
    assert match("please keep x this notice") == 5
    assert match("keep x y this very notice more") == 6
    assert match("keep this notice") is None and match("keep x this bad notice") is None
    assert a.total == 3


def paths(template):
    """The texts of a template, free words as z, written anew by expansion, one at a time."""
    parts = []
    for optional, least, most, word in re.findall(r"\[\[(.*?)\]\]|\{(\d+),(\d+)\}|([^\s\[\]{}]+)", template):
        parts.append([[], optional.split()] if optional else [["z"] * k for k in range(int(least), int(most) + 1)] if most else [[word]])
    return ([w for x in chosen for w in x] for chosen in itertools.product(*parts))


def test_templates_accept_their_texts_and_no_changed_ones():
    rng = np.random.default_rng(7)
    automata = licenses.compiled(licenses.TEMPLATES)
    for label, texts in licenses.TEMPLATES.items():
        for t in texts:
            for words in itertools.islice(paths(t), 40):
                text = [w.encode() for w in words]
                runs, _ = licenses.scan([b"before", *text, b"after"], automata)
                assert (label, 1, 1 + len(text)) in [(a, b, c) for a, b, c in runs] or any(a == label for a, *_ in runs), (label, t[:60])
    for label, texts in licenses.TEXTS.items():
        (t,) = texts
        words = [w.encode() for w in next(paths(t))]
        mandatory = [k for k, w in enumerate(words) if w != b"z"]
        for k in rng.choice(mandatory[3:], 12, replace=False):
            runs, score = licenses.scan([*words[:k], b"changed", *words[k + 1 :]], automata)
            if words[k + 1 : k + 2] != [b"z"] and words[k - 1] != b"z":
                assert label not in [a for a, *_ in runs] and 0 < score < 1, (label, words[k])


def test_template_scan_equals_expansion():
    """Random words against all texts of small templates, place by place."""
    rng = np.random.default_rng(3)
    small = {"x": ["a [[b]] c {0,2} d"], "y": ["b {1,1} a", "c c [[d a]] b"]}
    automata = licenses.compiled(small)
    fits = lambda p, w: len(p) == len(w) and all(a == "z" or a == b for a, b in zip(p, w))
    for _ in range(300):
        w = [str(c) for c in rng.choice(list("abcd"), 12)]
        wanted = []
        for label, ts in small.items():
            for t in ts:
                i = 0
                while i < len(w):
                    ends = [j for j in range(i + 1, len(w) + 1) if any(fits(p, w[i:j]) for p in paths(t))]
                    if ends:
                        wanted.append((label, i, max(ends)))
                    i = max(ends, default=i + 1)
        assert sorted(licenses.scan([x.encode() for x in w], automata)[0]) == sorted(wanted), w


def test_license_long_text(spark):
    text = "word " * 50_000 + "Licensed under the Apache License, Version 2.0. " + "permission " * 5000
    r = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert (r.labels, r.n_base, r.first_word) == ("apache-2", 1, 50_003)


def test_license_many_phrases():
    """Places of a long text full of phrases, in time that grows with the text."""
    import time

    spaced = {f" {p} ".encode(): label for p, label in licenses.PHRASES.items()}
    words = ["so", *"cc by nc under the mit license apache license version 2".split()]
    small = (words * 50)[:-3]
    plain = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(small)) if small[i : i + len(p.split())] == p.split())
    assert licenses.phrase_places([w.encode() for w in small], spaced) == plain and len(plain) > 100
    began = time.thread_time()
    assert len(licenses.phrase_places([b"cc", b"by", b"nc"] * 400_000, spaced)) == 400_000
    assert time.thread_time() - began < 20  # hours where each place counts from the start


def test_license_empty(spark):
    assert licenses.scan_licenses(frame(spark, ODD).limit(0)).count() == 0


def toxic_model(spark, base):
    from matchloom.llm import toxicity

    return toxicity.labelled(spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet"))


def test_toxic_wording_of_held_out_documents_in_all_languages(spark):
    """Fitted to the table's own labels, of whatever invented words its toxic documents consist."""
    from matchloom.llm import toxicity

    for base, least in (("/root/testdata/sf0.1", 0.6),):
        docs = spark.read.parquet(f"{base}/documents.parquet")
        rows = toxic_model(spark, base)
        rules = quality.all_rules(toxicity.fit(rows))
        lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
        held = [r for r in rows if toxicity.part(r[0]) == "held out"]
        said = {i: any(rules[n](quality.Page(t)) for n in ("abusive", "toxic_wording")) for i, t, _ in held}
        for g in ("en", "de", "fr", "es"):
            toxic = [said[i] for i, _, y in held if y and lang[i] == g]
            print(base, g, sum(toxic), len(toxic))
            # sf0.1 has only 33 toxic Spanish documents, 3 of them held out
            assert len(toxic) < 10 or sum(toxic) >= least * len(toxic)
        print(base, "right of rejected", sum(y for i, _, y in held if said[i]), sum(said.values()), "clean", sum(1 - y for *_, y in held))
        assert sum(y for i, _, y in held if said[i]) >= 0.9 * sum(said.values())


def test_toxicity_sample_and_odd_labels(spark):
    from matchloom.llm import toxicity

    docs = spark.createDataFrame([(i, "nice words here" if i % 2 else "vile awfulness here") for i in range(200)] + [(None, "x"), (300, None), (5, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, 1 - i % 2) for i in range(200)] + [(None, 1, 1), (300, 1, 1), (7, 1, None), (999, 1, 0)], "doc_id long, quality int, toxic int")
    some = toxicity.labelled(docs, labels, rows=100)
    assert len(some) <= 100 and sorted(some) == sorted(toxicity.labelled(docs.repartition(7), labels.repartition(3), rows=100))
    model = toxicity.fit(toxicity.labelled(docs, labels))
    assert model(b"so vile an awfulness") and not model(b"nice words") and not model(b"")
    assert not toxicity.fit(toxicity.labelled(docs, labels.limit(0)))(b"vile awfulness")
