"""Operators 1, 2, 4, 5, 7, 8 and 9 on small fixtures against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kinsight.llm import decontaminate as dc
from kinsight.llm import jaccard_join as jj
from kinsight.llm import quality_gam as qg
from kinsight.llm import secret_scan as ss
from kinsight.llm import suffix_buckets as sb
from kinsight.llm import token_files as tf
from kinsight.llm.bpe_prefix_dp import PrefixBpe, encode_documents
from kinsight.llm.trigram_query import trigram_query
from tests.llm.helpers import awkward, docs, empty, rows_of

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "aa", "b", " ", "  ", "\n", "\t", "'s", "é", "中", "1", "23", "<|endoftext|>", "The", "ing", "🙂", "\x85", "\x1c", "²", "\r\n", "=", "ZZ", "\x00", "​"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCAB)


def ids_of(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_bpe_equals_library(library):
    bpe, r = PrefixBpe(VOCAB), random.Random(3)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    for text in [*texts, "a" * 3000, "ab" * 2000, "!" * 2000, " " * 500, "中" * 500]:
        ids = ids_of(library, text)
        assert bpe.encode(text) == ids, repr(text)
        assert bpe.decode(ids) == library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_bpe_documents(spark, library):
    frame = awkward(spark, (7, "x <|endoftext|> y"))
    want = sorted(((r.doc_id, len(ids_of(library, r.text or "")) // 4, hashlib.sha256(ids_of(library, r.text or "")).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in frame.collect()), key=repr)
    assert rows_of(encode_documents(frame, VOCAB), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert encode_documents(empty(spark), VOCAB).collect() == []


def test_library_encoder_equals_library(library):
    encoder, r = tf.LibraryEncoder(VOCAB), random.Random(5)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 14))) for _ in range(2000)]
    assert list(encoder.batch(texts)) == [ids_of(library, t) for t in texts]


def test_token_files(spark, library):
    frame = docs(spark, [(5, "one two"), (1, "alpha beta gamma!"), (3, None), (9, "z " * 900), (3, "same id")])
    manifest = tf.write_sequences(frame, VOCAB, seq_len=64)
    got = sorted(tuple(r) for r in tf.read_documents(spark, manifest).collect())
    want, start = [], 0
    for r in sorted(frame.collect(), key=lambda r: (r.doc_id, r.text or "")):
        ids = ids_of(library, r.text or "") + bytes(4)
        want.append((r.doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert got == sorted(want)
    path = manifest.first().path
    reader = tf.SequenceReader(path)
    assert len(reader.sequence(0)) == 64 and reader.file.schema.field("ids").type.list_size == 64
    assert got == sorted(want)


def test_random_access_to_every_sequence(spark, library):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(PIECES) for _ in range(r.choice([0, 3, 40, 700])))) for i in range(400)]
    manifest = tf.write_sequences(docs(spark, rows).coalesce(1), VOCAB, seq_len=16)
    texts = dict(rows)
    for row in manifest.collect():
        reader = tf.SequenceReader(row.path)
        stream = np.concatenate([np.frombuffer(ids_of(library, texts[i]) + bytes(4), "<u4") for i in reader.index["doc_id"].to_pylist()])
        assert len(reader) == -(-len(stream) // 16) > tf.BATCH
        for i in range(len(reader)):
            want = stream[16 * i : 16 * i + 16]
            assert (reader.sequence(i)[reader.mask(i)] == want).all() and reader.mask(i).sum() == len(want)
        with pytest.raises(IndexError):
            reader.sequence(len(reader))


def test_token_files_of_awkward_rows(spark, library):
    frame = awkward(spark)
    got = rows_of(tf.read_documents(spark, tf.write_sequences(frame, VOCAB)), "doc_id", "n_tokens", "ids_crc32")
    told = [(x.doc_id, ids_of(library, x.text or "") + bytes(4)) for x in frame.collect()]
    assert got == sorted(((i, len(b) // 4, zlib.crc32(b)) for i, b in told), key=repr)
    assert tf.read_documents(spark, tf.write_sequences(empty(spark), VOCAB)).collect() == []


def removed(rows, depth=100):
    """Brute force over (doc_id, text); a null id is before all others."""
    first, out = {}, []
    low = -(1 << 63)
    for i, t in rows:
        t, i = (t or "").encode(), low if i is None else i
        for p in range(len(t) - depth + 1):
            first[t[p : p + depth]] = min(first.get(t[p : p + depth], (i, p)), (i, p))
    for d, t in rows:
        t, i = (t or "").encode(), low if d is None else d
        gone = bytearray(len(t))
        for p in range(len(t) - depth + 1):
            if first[t[p : p + depth]] < (i, p):
                gone[p : p + depth] = b"\1" * depth
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("frequent", [False, True])
def test_repeats_removed(spark, monkeypatch, frequent):
    if frequent:  # nearly every shared anchor counts as frequent
        monkeypatch.setattr(sb, "SAMPLE", 1)
        monkeypatch.setattr(sb, "HEAVY_SHARE", 10**9)
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, base = text(40), text(200)
    rows = [(i, text(60) + shared + text(30)) for i in range(6)] + [(20, base), (21, base), (22, base[:300] + "X" + base[301:]), (23, "ab" * 400), (24, "ab" * 90 + shared[3:130]), (25, ""), (26, None), (27, shared[:99]), (28, shared[:100])]
    frame = docs(spark, rows + [(20, base)])
    got = rows_of(sb.remove_repeats(frame), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == removed(rows + [(20, base)])
    assert sb.remove_repeats(empty(spark)).collect() == []
    odd = awkward(spark, (7, shared), (7, shared), (8, base + shared), (8, shared + base), (None, base[:250]), (None, base[:250] + shared), (None, base[:250]))
    assert rows_of(sb.remove_repeats(odd), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed([(x.doc_id, x.text) for x in odd.collect()])


def test_long_text_in_parts():
    data = bytes(random.Random(2).choices(range(97, 123), k=sb.PIECE + 5000))
    found = list(sb.pieces([data], 100))
    assert len(found) == 2 and sum(len(d) for d, *_ in found) == len(data) + 99


def test_repeats_across_the_parts_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(sb, "PIECE", 700)
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    passage = text(260)
    rows = [(1, text(600) + passage + text(900)), (2, text(650) + passage + text(400) + passage), (3, passage), (4, text(1400))]
    got = rows_of(sb.remove_repeats(docs(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == removed(rows)


def test_texts_under_one_id_are_told_apart(spark):
    """Of many texts under one id and under none, each loses its own bytes alone."""
    r = random.Random(10)
    shared = "".join(r.choice("abcdefgh") for _ in range(150))
    rows = [(0, shared)] + [(k % 2 * 5 or None, "".join(r.choice("xyzw") for _ in range(240)) + (shared if k % 7 == 0 else "")) for k in range(120)]
    got = rows_of(sb.remove_repeats(docs(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == removed(rows)


WORDS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contaminated(rows, items, length=10):
    windows = {}
    for i, t in items:
        w = WORDS.findall((t or "").translate(ASCII))
        for win in ([tuple(w)] if 0 < len(w) < length else [tuple(w[k : k + length]) for k in range(len(w) - length + 1)]):
            windows.setdefault(win, set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, met = WORDS.findall((t or "").translate(ASCII)), set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    met |= ids
        out.append((i, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_decontamination(spark):
    passage = " ".join(f"w{i % 7}é" for i in range(14))
    items = [(1, passage), (2, "Short Item"), (3, None), (4, ""), (10, passage), (5, "never seen in any text")]
    frame = awkward(spark, (7, f"start {passage.upper()} end short item; short-item"), (8, passage[:40]), (9, f"{passage} {passage}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows_of(dc.decontaminate(frame, bench), *names) == contaminated(rows, items)
    assert rows_of(dc.decontaminate(frame, bench.limit(0)), *names) == contaminated(rows, [])
    assert dc.decontaminate(empty(spark), bench).collect() == []
    kept = dc.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns and kept.where("doc_id IN (7, 8, 9)").count() == 0 and kept.count() == frame.count() - 3
    near = dc.proximity_matches(frame, bench, slop=30)
    # only A-Z are lower-cased: the passage in capitals keeps its É, and document 7 holds the second item alone
    assert {r.item_id for r in near.where("doc_id = 7").collect()} == {"2"}
    assert {r.item_id for r in near.where("doc_id = 9").collect()} == {"1", "10"}


def test_trigram_queries():
    assert trigram_query("[0-9a-f]{32,}") == []
    assert trigram_query("AKIA[A-Z0-9]{12,}") == [[frozenset({"aki", "kia"})]]
    keys = trigram_query(ss.BASE_RULES[0].regex)
    assert frozenset({"tok", "oke", "ken"}) in keys[0] and len(keys) == 1


def secrets(text):
    text, out = text or "", []
    out += [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [s for *_, s in sorted(out)]


def test_secret_scan(spark):
    hex40 = "0123456789abcdef" * 2 + "01234567"
    frame = awkward(spark, (7, f'é🙂 Token = "{hex40}" and AKIA{"Z9" * 8}!'), (8, "token=secret: abcdefghij"), (9, "AKIAAKIA API_KEY:short passwd = longenough1"), (10, hex40 + " " + hex40), (11, "ghp_" + "a1B2" * 10), (12, f"secret={hex40}"))
    names = ("doc_id", "base_sha256")
    got = rows_of(ss.summarise(ss.scan(frame)), *names)
    want = sorted(((r.doc_id, hashlib.sha256(",".join(secrets(r.text)).encode()).hexdigest()) for r in frame.collect()), key=repr)
    assert got == want
    assert ss.summarise(ss.scan(frame)).where("doc_id = 11").first().spans == "forge:0:44"
    masked = ss.redact(frame)
    assert masked.columns == frame.columns and masked.count() == frame.count()
    text = {r.doc_id: r.text for r in masked.collect()}
    assert text[12] == "[SECRET]" and text[10] == "[SECRET] [SECRET]" and text[8] == "token=secret: abcdefghij" and text[1] is None
    assert ss.summarise(ss.scan(empty(spark))).collect() == []


SPACED = re.compile("[^\x20\x09-\x0D]+")


def shingle_set(text, size=5):
    w = SPACED.findall((text or "").translate(ASCII))
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def linked(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if either and sets[i] and sets[j] and 100 * both >= 75 * either:
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), d if not sets[i] else low.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def test_jaccard_components(spark, monkeypatch):
    monkeypatch.setattr(jj, "COMMON", 3)
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows = []
    for size in (1, 3, 4, 5, 6, 8, 12, 20, 40, 68, 69, 90, 150, 400):
        base = [word() for _ in range(size)]
        for _ in range(7):
            copy = list(base)
            for _ in range(r.randint(0, max(1, size // 25))):
                copy[r.randrange(size)] = word()
            rows.append((len(rows) + 10, " ".join(copy) + r.choice(["", " ", "\n"])))
    passage = [word() for _ in range(60)]
    rows += [(1000 + i, " ".join([word() for _ in range(50)] + passage + [word() for _ in range(40)])) for i in range(25)]
    frame = awkward(spark, *rows)
    pairs = [(x.doc_id, x.text) for x in frame.collect()]
    assert rows_of(jj.similar_components(frame), "doc_id", "n_shingles", "component_id") == linked(pairs)
    assert jj.similar_components(empty(spark)).collect() == []
    kept = jj.keep_one(frame)
    wordless = sum(not shingle_set(t) for _, t in pairs)
    # the two texts of id 4 are groups of their own
    assert kept.columns == frame.columns and kept.count() == len({c for _, n, c in linked(pairs) if n}) + 1 + wordless


def test_quality_model(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(r.randint(2, 9)))
    good = [(i, " ".join(word() for _ in range(60)) + ".") for i in range(150)]
    bad = [(1000 + i, "!! ".join(word().upper() for _ in range(60))) for i in range(150)]
    frame = docs(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad] + [(None, 1, 0), (5, None, 0), (7777, 1, 1)], "doc_id long, quality int, toxic int")
    model = qg.train(frame, labels)
    told = qg.score(frame, model).collect()
    held = [x for x in told if x.held_out]
    assert {x.doc_id for x in held} == {i for i, _ in good + bad if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([x.predicted == int(x.doc_id < 1000) for x in held]) > 0.95
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in told)
    odd = awkward(spark)
    assert qg.score(odd, model).count() == odd.count()
    assert qg.keep_good(frame, model).columns == frame.columns
    assert {x.score for x in qg.score(odd, qg.train(odd, labels.limit(0))).collect()} == {0.5}
    assert qg.score(empty(spark), model).collect() == []
