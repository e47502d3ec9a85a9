"""Tokenizing, packing, token planes, mixing: exact round trips and brute force."""

import collections
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, packing, token_planes, tokenizing

RULES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]


def plain(texts, name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizing.tokenizer_path(name))
    return [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name,spaced", RULES)
def test_words_make_the_same_ids_as_whole_texts(name, spaced):
    r = random.Random(1)
    bits = ["a", "b", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "É", "é", "é", "\xa0", "\x1c", " ", "9", "٣", "²", "#", "İ", "Σ", "ς", "<|endoftext|>", "中", "　", "\x85", "don't", "\0", " .", "Word", "plain", "ŉ"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(5000)] + ["", None, " ", "x" * 5000]
    assert list(tokenizing.encode_texts(texts, name, spaced)) == plain(texts, name)


@pytest.mark.parametrize("name,spaced", RULES)
def test_runs_of_white_space_and_special_strings(name, spaced):
    from tokenizers import Tokenizer

    r = random.Random(7)
    bits = ["word", "Ab", "é", " ", "\n", "\n\n", " \n", "  ", "\r\n", ". ", ",", " x", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "\t", "9", "'s "]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(5000)]
    assert list(tokenizing.encode_texts(texts, name, spaced)) == plain(texts, name)
    t = Tokenizer.from_file(tokenizing.tokenizer_path(name))
    t.encode_special_tokens = True
    assert list(tokenizing.encode_texts(texts, name, spaced, special_as_text=True)) == [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name,spaced", RULES)
def test_long_texts_are_cut_between_words(name, spaced, monkeypatch):
    monkeypatch.setattr(tokenizing, "GROUP_BYTES", 500)
    r = random.Random(8)
    texts = ["".join(r.choice(["word", " ", " and", "\n", "é ", ". ", "x" * 700]) for _ in range(2000)) for _ in range(5)] + ["z" * 5000]
    assert list(tokenizing.encode_texts(texts, name, spaced)) == plain(texts, name)


def test_words_are_dropped_from_the_cache_without_effect(monkeypatch):
    monkeypatch.setattr(tokenizing, "CACHE_WORDS", 50)
    monkeypatch.setattr(tokenizing, "GROUP_BYTES", 200)
    monkeypatch.setattr(tokenizing, "_loaded", {})
    r = random.Random(2)
    texts = [" ".join("".join(r.choice("abcde") for _ in range(r.randint(1, 5))) + r.choice(["", ".", ",\n"]) for _ in range(60)) for _ in range(60)]
    for name, spaced in RULES:
        assert list(tokenizing.encode_texts(texts, name, spaced)) == plain(texts, name)


def test_best_fit_decreasing_equals_a_search_of_all_windows():
    r = random.Random(3)
    for _ in range(60):
        window = r.choice([8, 16, 100])
        lengths = [r.randint(1, window) for _ in range(r.randint(0, 120))]
        places, offsets = packing.best_fit_decreasing(lengths, window)
        rooms = []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [room for room in rooms if room >= lengths[i]]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - lengths[i])
            else:
                rooms.append(window - lengths[i])
        used = collections.Counter()
        for p, n in zip(places, lengths):
            used[p] += n
        assert sorted(window - u for u in used.values()) == sorted(rooms)
        spans = collections.defaultdict(list)
        for p, o, n in zip(places, offsets, lengths):
            spans[p].append((o, n))
        for s in spans.values():
            at = 0
            for o, n in sorted(s):
                assert o == at
                at += n
            assert at <= window


def check_packed(rows, texts, window=packing.WINDOW):
    """rows: pieces; texts: of each doc_id (one row an id)."""
    ids = {d: b + packing.END_ID.to_bytes(4, "little") for d, b in zip(texts, plain(texts.values(), packing.TOKENIZER))}
    by, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert by.keys() == ids.keys()
    for d, ps in by.items():
        at = 0
        for r in sorted(ps, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[d]) // 4
            assert r.ids_crc32 == zlib.crc32(ids[d][4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids[d]) // 4
    for ps in seqs.values():
        at = 0
        for r in sorted(ps, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and all(r.sequence_tokens == at for r in ps)
        assert all(r.padded_tokens == (at if at & (at - 1) == 0 else window) for r in ps)
    return ids


def test_packing_round_trip(spark):
    r = random.Random(4)
    texts = {i: " ".join(r.choice(["alpha", "beta", "gamma,", "delta."]) for _ in range(r.randint(0, 9000 if i % 20 == 0 else 700))) for i in range(120)} | {500: None, 501: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = packing.pack(docs, with_ids=True).cache()
    ids = check_packed(rows.collect(), texts)
    s = rows.select("sequence_id", "sequence_tokens", "padded_tokens").distinct().collect()
    assert sum(x.sequence_tokens for x in s) == sum(len(b) // 4 for b in ids.values())
    assert sum(x.sequence_tokens for x in s) / sum(x.padded_tokens for x in s) > 0.95
    full = {x.sequence_id: x.ids for x in packing.sequences(rows).collect()}
    for x in rows.collect():
        assert full[x.sequence_id][4 * x.offset : 4 * (x.offset + x.length)] == ids[x.doc_id][4 * x.start : 4 * (x.start + x.length)]


def test_packing_odd(odd_docs, no_docs):
    rows = packing.pack(odd_docs).collect()
    assert sum(1 for r in rows if r.doc_id == 1) == 2 and sum(1 for r in rows if r.doc_id in (2, 3, 4)) == 3
    assert all(r.length == 1 for r in rows if r.doc_id in (2, 3, 4))
    assert packing.pack(no_docs).count() == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(5)
    for n in (1, 7, 8, 9, 1000):
        for top in (1, 50_257, 2**32):
            ids = rng.integers(0, top, n).astype("<u4")
            assert (token_planes.from_planes(token_planes.to_planes(ids, kind), n) == ids).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("sizes", [[], [1], [3, 0, 5, 64], [1] * 70, [200, 1]])
def test_plane_files_round_trip(kind, sizes):
    rng = np.random.default_rng(6)
    docs = [(None if i == 0 else i, rng.integers(0, 50_257, s).astype("<u4").tobytes()) for i, s in enumerate(sizes)]
    f = io.BytesIO()
    w = token_planes.PlaneWriter(f, block=16, kind=kind)
    for d, b in docs:
        w.add(d, b)
    w.close()
    reader = token_planes.PlaneReader(f)
    start, want = 0, []
    for d, b in docs:
        want.append((d, start, len(b) // 4, zlib.crc32(b)))
        start += len(b) // 4
    assert list(reader.rows()) == want and reader.n_ids == start
    whole = b"".join(b for _, b in docs)
    assert b"".join(reader.block(k).tobytes() for k in range(reader.n_blocks)) == whole


def test_token_planes_of_documents(spark, tmp_path):
    r = random.Random(7)
    texts = {i: " ".join(r.choice(["one", "two", "Three", "four."]) for _ in range(r.randint(0, 300))) for i in range(90)} | {-5: None, 700: ""}
    rows = list(texts.items())
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    folder = f"file:{tmp_path}/planes"
    got = {x.doc_id: tuple(x)[1:] for x in token_planes.read_planes(spark, token_planes.write_planes(docs, folder, block=64), folder).collect()}
    start = 0
    for d in sorted(texts):
        b = plain([texts[d]], token_planes.TOKENIZER)[0] + token_planes.END_ID.to_bytes(4, "little")
        assert got.pop(d) == (start, len(b) // 4, zlib.crc32(b))
        start += len(b) // 4
    assert not got
    again = token_planes.write_planes(docs, folder, block=64)
    assert not [p for p in (tmp_path / "planes").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")] and sum(x[3] for x in again) == start


def test_token_planes_odd(spark, odd_docs, no_docs, tmp_path):
    folder = f"{tmp_path}/odd"
    rows = token_planes.read_planes(spark, token_planes.write_planes(odd_docs, folder), folder).collect()
    assert len(rows) == odd_docs.count()
    assert token_planes.write_planes(no_docs, f"{tmp_path}/none") == []
    assert token_planes.read_planes(spark, [], f"{tmp_path}/none").count() == 0


def brute_mix(rows, weights=mixing.WEIGHTS, epochs=1.5, cap=2):
    import hashlib

    size = collections.Counter()
    for _, s, n in rows:
        size[s] += n
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, stopped, budget = {}, set(), epochs * sum(size.values())
    while True:
        left = budget - sum(cap * size[s] for s in stopped)
        total = sum(weight[s] for s in names if s not in stopped)
        target = {s: cap * size[s] if s in stopped else left * weight[s] / total for s in names}
        more = {s for s in names if s not in stopped and target[s] >= cap * size[s]}
        if not more:
            break
        stopped |= more
    taken = {}
    h = lambda d: int(hashlib.md5(f"mix:{'null' if d is None else d}".encode()).hexdigest()[:15], 16)
    for s in names:
        times = int(target[s] // size[s]) if size[s] else 0
        rest, run, groups = target[s] - times * size[s], 0, collections.Counter()
        for d, x, n in rows:
            if x == s:
                groups[h(d)] += n
        for k in sorted(groups):
            taken[(s, k)] = times + (run + groups[k] / 2 <= rest)
            run += groups[k]
    return target, [(d, n * taken[(s, h(d))]) for d, s, n in rows]


@pytest.mark.parametrize("case", ["even", "hot", "one", "nulls", "empty source"])
def test_mixing_equals_brute_force(spark, case):
    r = random.Random(8)
    source = {"even": lambda i: f"s{i % 7}", "hot": lambda i: "a" if i % 3 else f"s{i % 5}", "one": lambda i: "only", "nulls": lambda i: None if i % 4 == 0 else "x", "empty source": lambda i: "void" if i % 5 == 0 else f"s{i % 3}"}[case]
    docs = [(i, " ".join(["w"] * (0 if source(i) == "void" else r.randint(0, 60))), source(i)) for i in range(300)]
    got = {x.doc_id: x for x in mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    target, taken = brute_mix([(d, s, len(t.split())) for d, t, s in docs])
    assert [got[d].size * got[d].copies for d, _, _ in docs] == [n for _, n in taken]
    assert all(abs(got[d].target - target[s]) < 1e-6 for d, _, s in docs)
    assert all(got[d].copies in (0, 1, 2) for d, _, _ in docs)


def test_mixing_smaller_budgets_are_nested(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 50), f"s{i % 3}") for i in range(200)], "doc_id long, text string, source string")
    few, many = ({r.doc_id: r.copies for r in mixing.mix(docs, epochs=e).collect()} for e in (0.3, 0.9))
    assert all(few[d] <= many[d] for d in few)


def test_mixing_odd(odd_docs, no_docs):
    assert mixing.mix(odd_docs).count() == odd_docs.count()
    out = mixing.mix(odd_docs, keep_text=True)
    assert out.count() == odd_docs.count() and [c.lower() for c in out.columns].count("copies") == 1
    assert mixing.mix(no_docs).count() == 0
